"""Lookahead audits: does a feature or signal use what wasn't knowable?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolens.functions import stats

TOLERANCE, IMPLAUSIBLE, FLAT = 1e-10, 5.0, 1e-12
RESULT = "name string, n_checked long, n_mismatched long, max_abs_diff double, passed boolean"


def sampled(frame: DataFrame, n: int, seed: int = 0, value: str = "feature") -> DataFrame:
    """At most n rows of each series with a value, without replacement, by the hash of (seed, i)."""
    order = Window.partitionBy("series_id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("i"))), "i")
    return frame.where(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def summarise(checked: DataFrame, name: str, tolerance: float = TOLERANCE) -> DataFrame:
    """One result row from rows (feature, rebuilt); a rebuilt NULL is a mismatch, and no rows at all fail."""
    gap = F.abs(F.col("feature") - F.col("rebuilt"))
    bad = F.col("rebuilt").isNull() | (gap > tolerance)
    sums = checked.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(bad).alias("n_mismatched"), F.max(gap).alias("max_abs_diff"))
    return sums.select(F.lit(name).alias("name"), "n_checked", "n_mismatched", "max_abs_diff", ((F.col("n_checked") > 0) & (F.col("n_mismatched") == 0)).alias("passed"))


def audit_window(frame: DataFrame, feature: str, rebuild: Callable, name: str, n_samples: int = 200, seed: int = 0, tolerance: float = TOLERANCE) -> DataFrame:
    """Audits a feature whose honest value is an aggregate over the history: rebuild takes a window and gives a Column.

    The history of every row is a running frame, so the audit is one window
    pass, not a join of every sampled row with its past.
    """
    past = Window.partitionBy("series_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    both = frame.withColumnRenamed(feature, "feature").withColumn("rebuilt", rebuild(past))
    return summarise(sampled(both, n_samples, seed), name, tolerance)


def audit_truncated(frame: DataFrame, feature: str, rebuild: Column, name: str, last: int | None = None, n_samples: int = 200, seed: int = 0, tolerance: float = TOLERANCE) -> DataFrame:
    """Audits a feature against an aggregate over what each sampled row's history held: its rows up to that one, or the last of them.

    The sampled rows (a bounded number of each series) are joined with their
    own past, which nothing later can enter.
    """
    marks = sampled(frame.select("series_id", "i", F.col(feature).alias("feature")), n_samples, seed)
    past = frame.drop(feature).withColumnsRenamed({"series_id": "__s", "i": "__i"})
    near = (F.col("__s") == F.col("series_id")) & (F.col("__i") <= F.col("i"))
    if last is not None:
        near = near & (F.col("__i") > F.col("i") - last)
    rebuilt = marks.join(past, near, "left").groupBy("series_id", "i").agg(F.first("feature").alias("feature"), rebuild.alias("rebuilt"))
    return summarise(rebuilt, name, tolerance)


def audit_rebuild(frame: DataFrame, feature: str, rebuild: Callable, name: str, n_samples: int = 200, seed: int = 0, tolerance: float = TOLERANCE) -> DataFrame:
    """Audits any feature: rebuild takes the history up to a row as a pandas frame and gives the value.

    Each series is one group; its sampled rows are rebuilt from truncated
    copies.  A rebuild that raises gives NULL, which is a mismatch.
    """
    marks = sampled(frame.select("series_id", "i", F.col(feature).alias("feature")), n_samples, seed).select("series_id", "i", "feature")
    joined = frame.join(marks.withColumnRenamed("feature", "__feature"), ["series_id", "i"], "left")

    def run(history):
        history = history.sort_values("i").reset_index(drop=True)
        out = []
        for at in history.index[history["__feature"].notna()]:
            try:
                value = float(rebuild(history.drop(columns=["__feature"]).iloc[: at + 1]))
            except Exception:
                value = None
            out.append((float(history.loc[at, "__feature"]), value if value == value else None))
        import pandas as pd

        return pd.DataFrame(out, columns=["feature", "rebuilt"])

    return summarise(joined.groupBy("series_id").applyInPandas(run, "feature double, rebuilt double"), name, tolerance)


def shift_test(frame: DataFrame, signal: str = "signal", metric: Callable[[str], Column] = stats.sharpe, implausible: float = IMPLAUSIBLE) -> DataFrame:
    """Rows (series_id, base, lagged, drop, passed): the metric of signal * ret, and with the signal one bar late.

    Fails only if the base is implausibly good; a flat base passes.  Products
    that aren't numbers are 0, infinite ones the largest number.
    """
    order = Window.partitionBy("series_id").orderBy("i")
    late = F.lag(signal, 1, 0.0).over(order)
    largest = F.lit(1.7976931348623157e308)
    bounded = lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).when(F.abs(x) <= largest, x).otherwise(F.signum(x) * largest)
    product = lambda s: bounded(s * F.col("ret"))
    both = frame.select("series_id", product(F.col(signal)).alias("now"), product(late).alias("late"))
    zero = F.lit(0.0)  # also of a metric that overflows
    sums = both.groupBy("series_id").agg(F.nanvl(metric("now"), zero).alias("base"), F.nanvl(metric("late"), zero).alias("lagged"))
    flat = F.abs("base") < FLAT
    return sums.select("series_id", "base", "lagged", F.when(~flat, (F.col("base") - F.col("lagged")) / F.abs("base")).alias("drop"), (flat | (F.abs("base") <= implausible)).alias("passed"))


def audit_pit_frame(df: DataFrame, name: str = "pit") -> DataFrame:
    """One result row: the number of rows knowable before they happened; missing stamps fail."""
    if not {"event_time", "knowable_at"} <= set(df.columns):
        return df.sparkSession.createDataFrame([(name, 0, 0, None, False)], RESULT)
    bad = F.count_if(F.col("knowable_at") < F.col("event_time"))
    return df.agg(F.count(F.lit(1)).alias("n_checked"), bad.alias("n_mismatched")).select(F.lit(name).alias("name"), "n_checked", "n_mismatched", F.lit(None).cast("double").alias("max_abs_diff"), (F.col("n_mismatched") == 0).alias("passed"))
