"""Real statistics against those of surrogates: empirical p-values and verdicts.

Two ways lead to the rows (series_id, statistic, null_name, sim, value):
``sql_distribution`` for the three bootstrap nulls as pure DataFrame plans,
whose values any engine can check, and ``distribution`` for bulk runs, where
each (series, null, batch of simulations) is generated and measured in one
numpy kernel.  Only the values leave the kernel; surrogates never move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.functions import kernel, stats
from chronolens.operators import garch
from chronolens.operators.surrogates import BLOCK, GENERATORS, NULLS

BATCH = 100
VALUES = "series_id string, null_name string, statistic string, value double"


def paths(r: np.ndarray, null: str, n_sim: int, rng: np.random.Generator, block: int, mean_block: int, params=None, z=None) -> np.ndarray:
    n = len(r)
    if null == "shuffled":
        return r[np.argsort(rng.random((n_sim, n)), axis=1)]
    if null == "block":
        length = max(1, min(block, n))
        starts = rng.integers(0, n, size=(n_sim, -(-n // length)))
        return r[(starts[:, :, None] + np.arange(length)).reshape(n_sim, -1)[:, :n] % n]
    if null == "stationary":
        restart = rng.random((n_sim, n)) < 1 / mean_block
        restart[:, 0] = True
        begin = np.maximum.accumulate(np.where(restart, np.arange(n), 0), axis=1)
        at = np.take_along_axis(rng.integers(0, n, size=(n_sim, n)), begin, axis=1)
        return r[(at + np.arange(n) - begin) % n]
    return garch.simulate(r, params, z, n_sim, rng)


@dataclass(frozen=True)
class Setup:
    """What a comparison measures, and against what.

    statistics: own ones by name, each a function of a series's returns as an
    array; None means the eleven registered ones, with window, k and horizon.
    generators: own nulls by name, each a function (returns, number of paths,
    random generator) that gives one path a row.
    """

    n_sim: int = 1000
    nulls: tuple[str, ...] = NULLS
    seed: int = 0
    block: int = BLOCK
    mean_block: int = BLOCK
    window: int = stats.WINDOW
    k: int = stats.BANDS
    horizon: int = stats.HORIZON
    statistics: dict[str, Callable[[np.ndarray], float]] | None = None
    generators: dict[str, Callable[[np.ndarray, int, np.random.Generator], np.ndarray]] | None = None

    def __post_init__(self):
        unknown = set(self.nulls) - set(NULLS) - set(self.generators or {})
        if unknown or self.n_sim < 1:
            raise ValueError(f"unknown nulls {sorted(unknown)}" if unknown else "n_sim must be at least 1")

    @property
    def names(self) -> tuple[str, ...]:
        return stats.NAMES if self.statistics is None else tuple(self.statistics)

    def measure(self, rows: np.ndarray) -> np.ndarray:
        """One row of values for each path, in the order of names; NaN is undefined."""
        if self.statistics is None:
            return kernel.statistics(rows, self.window, self.k, self.horizon)
        return np.array([[np.nan if (v := f(row)) is None else float(v) for f in self.statistics.values()] for row in rows]).reshape(len(rows), len(self.names))


def _rows(series: str, null: str | None, values: np.ndarray, names: tuple[str, ...]) -> pa.Table:
    flat = values.ravel()
    columns = {"series_id": [series] * len(flat), "null_name": [null] * len(flat), "statistic": list(names) * len(values)}
    return pa.table([*(pa.array(c, pa.string()) for c in columns.values()), pa.array(flat, mask=~np.isfinite(flat))], names=[*columns, "value"])


def _simulate(setup: Setup):
    def run(table: pa.Table) -> pa.Table:
        series, null, batch = (table.column(c)[0].as_py() for c in ("series_id", "null_name", "batch"))
        r = np.array(table.column("rets")[0].values, dtype=float)
        size = min(BATCH, setup.n_sim - batch * BATCH)
        rng = garch.generator(setup.seed, series, null, batch)
        params = z = None
        if null in (setup.generators or {}):
            drawn = np.asarray(setup.generators[null](r, size, rng), dtype=float)
        else:
            if null == "garch":
                params = garch.Params(*(table.column(c)[0].as_py() for c in ("mu", "omega", "alpha", "beta")))
                try:
                    z = garch.residuals(r, params)
                except ValueError:  # a series without variance has no such null; its values are NULL
                    return _rows(series, null, np.full((size, len(setup.names)), np.nan), setup.names)
            drawn = paths(r, null, size, rng, setup.block, setup.mean_block, params, z)
        return _rows(series, null, setup.measure(drawn), setup.names)

    return run


def finite_series(series: DataFrame) -> DataFrame:
    """series without returns that aren't finite."""
    return series.where(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") < float("inf"))).select("series_id", "i", "ret")


def distribution(series: DataFrame, setup: Setup) -> DataFrame:
    """Rows (series_id, null_name, statistic, value), one for each simulation.

    Each series is fitted once and packed into one row, so what moves for a
    batch of simulations is one array.  Work is dealt by (series, null, batch),
    so one long series spreads over the cluster as well as many short ones do.
    """
    spark = series.sparkSession
    batches = -(-setup.n_sim // BATCH)
    jobs = spark.createDataFrame([(null, b) for null in setup.nulls for b in range(batches)], "null_name string, batch int")
    own = finite_series(series)
    packed = own.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "ret"))), lambda x: x["ret"]).alias("rets"))
    if "garch" in setup.nulls and "garch" not in (setup.generators or {}):
        packed = packed.join(garch.fit_all(own).select("series_id", "mu", "omega", "alpha", "beta"), "series_id")
    # a few dozen jobs, whatever the data; few bytes but much work, so the number of tasks is stated
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches * len(setup.nulls))
    dealt = packed.crossJoin(F.broadcast(jobs)).repartition(tasks, "series_id", "null_name", "batch")
    return dealt.groupBy("series_id", "null_name", "batch").applyInArrow(_simulate(setup), VALUES)


def real_values(series: DataFrame, setup: Setup) -> DataFrame:
    """Rows (series_id, statistic, value) of the series themselves."""
    own = finite_series(series)
    if setup.statistics is None:
        return stats.all_statistics(own, window=setup.window, k=setup.k, horizon=setup.horizon)

    def run(table: pa.Table) -> pa.Table:
        return _rows(table.column("series_id")[0].as_py(), None, setup.measure(garch.ordered(table)[None, :]), setup.names).drop_columns(["null_name"])

    return own.groupBy("series_id").applyInArrow(run, "series_id string, statistic string, value double")


def sql_distribution(series: DataFrame, n_sim: int, nulls: tuple[str, ...] = tuple(GENERATORS), seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The same rows for the bootstrap nulls by DataFrame plans alone, with hash-based randomness."""
    keys = ("series_id", "null_name", "sim")
    frames = [GENERATORS[null](series, n_sim, seed, *([block] if null != "shuffled" else [])).select("series_id", F.lit(null).alias("null_name"), "sim", "i", "ret") for null in nulls]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionAll(f)
    return stats.all_statistics(whole, keys).select("series_id", "null_name", "statistic", "value")


def p_values(real: DataFrame, dist: DataFrame) -> DataFrame:
    """Rows (series_id, statistic, null_name, real, mean, sd, p_greater, p_two_sided, z).

    p-values count the real value itself, so none is below 1 / (n + 1).  NULL
    values of a distribution don't count; a NULL real value has NULL p-values.
    """
    joined = dist.join(real.withColumnRenamed("value", "real"), ["series_id", "statistic"])
    n, known = F.count("value"), F.col("real").isNotNull()
    sums = joined.groupBy("series_id", "statistic", "null_name").agg(
        F.max("real").alias("real"), n.alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count_if(known & (F.col("value") >= F.col("real"))).alias("ge"), F.count_if(known & (F.col("value") <= F.col("real"))).alias("le")
    )
    usable = F.col("real").isNotNull() & (F.col("n") > 0)
    share = lambda c: F.when(usable, (1 + F.col(c)) / (F.col("n") + 1))
    two = F.when(usable, F.least(F.lit(1.0), 2 * F.least(share("ge"), share("le"))))
    return sums.select("series_id", "statistic", "null_name", "real", "mean", "sd", share("ge").alias("p_greater"), two.alias("p_two_sided"), F.when(F.col("sd") > 0, (F.col("real") - F.col("mean")) / F.col("sd")).alias("z"))


def survivors(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows (series_id, statistic, survives, hardest_null): survives if every null has p below alpha; the hardest has the largest p, the weaker null on ties."""
    rank = F.array_position(F.array(*[F.lit(x) for x in NULLS]), F.col("null_name"))
    below = F.coalesce(F.col("p_two_sided") < alpha, F.lit(False))
    return results.groupBy("series_id", "statistic").agg(F.bool_and(below).alias("survives"), F.max_by("null_name", F.struct(F.coalesce("p_two_sided", F.lit(-1.0)), -rank, "null_name")).alias("hardest_null"))


def verdicts(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows (series_id, n_survivors, verdict)."""
    place = F.array_position(F.array(*[F.lit(x) for x in stats.NAMES]), F.col("statistic"))
    each = survivors(results, alpha).groupBy("series_id").agg(F.count_if("survives").alias("n_survivors"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("survives"), F.struct(place.alias("p"), F.col("statistic").alias("s"))))).alias("who"))
    names = F.array_join(F.transform("who", lambda x: x["s"]), ", ")
    found = F.concat(F.col("n_survivors").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" statistics differ from all nulls: "), names)
    return each.select("series_id", "n_survivors", F.when(F.col("n_survivors") == 0, F.lit("no signal: some null reproduces each statistic")).otherwise(found).alias("verdict"))


def panel(results: DataFrame, nulls: tuple[str, ...] = NULLS, alpha: float = 0.05) -> DataFrame:
    """The wide table: statistic, real, {null}_mean, {null}_p for each null, survives_all."""
    wide = results.groupBy("series_id", "statistic").agg(F.max("real").alias("real"), *[F.max(F.when(F.col("null_name") == x, F.col(c))).alias(f"{x}_{n}") for x in nulls for c, n in (("mean", "mean"), ("p_two_sided", "p"))])
    return wide.join(survivors(results, alpha).select("series_id", "statistic", F.col("survives").alias("survives_all")), ["series_id", "statistic"])


def compare(series: DataFrame, n_sim: int = 1000, nulls: tuple[str, ...] | None = None, seed: int = 0, **more) -> DataFrame:
    """The whole comparison of many series, as rows of p_values.

    more: block, mean_block, window, k, horizon, statistics and generators, as
    in Setup.  Without nulls, all four and the own generators are used.
    """
    setup = Setup(n_sim, tuple(dict.fromkeys((*NULLS, *(more.get("generators") or {})))) if nulls is None else tuple(nulls), seed, **more)
    return p_values(real_values(series, setup), distribution(series, setup))
