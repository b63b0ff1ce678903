"""Surrogate series: permutation, circular blocks and the stationary bootstrap, as DataFrame plans.

Randomness is a counter-based hash of (seed, null, simulation, position), so a
surrogate doesn't depend on how the data are partitioned, and any engine with
md5 makes the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 20
SCALE = 4294967296.0  # 2^32


def draw(*parts) -> Column:
    """A whole number below 2^32 from the md5 of the parts, joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")


def simulations(series: DataFrame, n_sim: int) -> DataFrame:
    """series with sim 0..n_sim-1: each row once for each simulation."""
    return series.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sim - 1))))


def sizes(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def _drawn_from(series: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (series_id, sim, i, source) with the return that stands at the source position (from 0)."""
    values = series.select("series_id", (F.col("i") - 1).alias("source"), "ret")
    return chosen.join(values, ["series_id", "source"]).select("series_id", "sim", "i", "source", "ret")


def iid_shuffle(series: DataFrame, n_sim: int, seed: int = 0) -> DataFrame:
    """Permutations: the marginal distribution stays, order goes."""
    ranked = simulations(series, n_sim).withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffled"), F.col("sim"), F.col("i"))))
    order = Window.partitionBy("series_id", "sim").orderBy("__h", "i")
    return ranked.select("series_id", "sim", F.row_number().over(order).cast("long").alias("place"), (F.col("i") - 1).alias("source"), "ret").withColumnRenamed("place", "i")


def circular_block(series: DataFrame, n_sim: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Blocks of consecutive returns from uniform starts, wrapping at the end."""
    n = F.col("n")
    length = F.greatest(F.lit(1), F.least(F.lit(block), n))
    t = F.col("i") - 1
    grid = simulations(series.select("series_id", "i").join(sizes(series), "series_id"), n_sim)
    start = draw(seed, "block", F.col("sim"), F.floor(t / length)) % n
    return _drawn_from(series, grid.select("series_id", "sim", "i", ((start + t % length) % n).alias("source")))


def stationary_bootstrap(series: DataFrame, n_sim: int, seed: int = 0, mean_block: int = BLOCK) -> DataFrame:
    """Blocks of geometric length: at each position a restart with probability 1 / mean_block, else the next return."""
    n, t = F.col("n"), F.col("i") - 1
    grid = simulations(series.select("series_id", "i").join(sizes(series), "series_id"), n_sim)
    restart = (t == 0) | (draw(seed, "restart", F.col("sim"), t) < SCALE / mean_block)
    marked = grid.withColumn("begin", F.when(restart, F.struct(t.alias("t"), (draw(seed, "stationary", F.col("sim"), t) % n).alias("at"))))
    order = Window.partitionBy("series_id", "sim").orderBy("i")
    run = marked.withColumn("run", F.last("begin", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return _drawn_from(series, run.select("series_id", "sim", "i", ((F.col("run.at") + t - F.col("run.t")) % n).alias("source")))


#: Weakest null first.
GENERATORS: dict[str, Callable[..., DataFrame]] = {"shuffled": iid_shuffle, "block": circular_block, "stationary": stationary_bootstrap}
NULLS = (*GENERATORS, "garch")
