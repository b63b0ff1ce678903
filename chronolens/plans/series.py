"""Tidy price and return series: rows (series_id, dt, price) and (series_id, i, dt, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ORCHESTRATED, MIN_ROWS, MIN_SCREENED = 500, 100, 252  # observations that the gates ask for


def finite(x: Column) -> Column:
    """x, with NaN and infinities as NULL: inside the engine only NULL means absent."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def normalised(df: DataFrame) -> DataFrame:
    """Column names in lower case, trimmed, with underscores for spaces."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def first_column(df: DataFrame, candidates: tuple[str, ...] = ("ret", "adj_close", "close")) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def latest_rows(df: DataFrame, key: list[str], retrieved: str = "retrieved_at") -> DataFrame:
    """One row of each key: the one retrieved last. Full histories that are appended daily come back once."""
    newest = Window.partitionBy(*key).orderBy(F.col(retrieved).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def returns(prices: DataFrame, log: bool = True, bridge: bool = False) -> DataFrame:
    """Returns of each series in date order, numbered from 1.

    bridge: drop prices that aren't positive before differencing, so that a bad
    price's neighbours are compared with each other.
    """
    by = Window.partitionBy("series_id").orderBy("dt")
    source = prices.where(F.col("price") > 0) if bridge else prices
    before = F.lag("price").over(by)
    change = F.when((before > 0) & (F.col("price") > 0), F.ln(F.col("price") / before)) if log else F.when(before != 0, F.col("price") / before - 1)
    return numbered(source.select("series_id", "dt", finite(change).alias("ret")).where(F.col("ret").isNotNull()))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (series_id, dt, ret) with i, their number in date order."""
    by = Window.partitionBy("series_id").orderBy("dt")
    return rows.withColumn("i", F.row_number().over(by).cast("long")).select("series_id", "i", "dt", "ret")


def with_enough(series: DataFrame, least: int) -> DataFrame:
    """Only the series with at least so many rows."""
    enough = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return series.join(enough.select("series_id"), "series_id", "left_semi")


def last_n(series: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series."""
    back = Window.partitionBy("series_id").orderBy(F.col("i").desc())
    return series.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= n).drop("__n")


def daily_prices(orders: DataFrame) -> DataFrame:
    """Total order value of each day, as one series; whole cents, so that no order of summing shows."""
    return orders.groupBy(F.col("o_orderdate").alias("dt")).agg(F.round(F.sum("o_totalprice"), 2).alias("price")).select(F.lit("ALL").alias("series_id"), "dt", "price")


def segment_prices(orders: DataFrame, customers: DataFrame, by: str = "c_mktsegment") -> DataFrame:
    """The same by a column of the customer."""
    joined = orders.select("o_custkey", "o_orderdate", "o_totalprice").join(customers.select("c_custkey", by), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col(by).cast("string").alias("series_id"), F.col("o_orderdate").alias("dt")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
