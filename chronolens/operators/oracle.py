"""The null comparison of every return series in a lake, in one plan over all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.operators import compare, garch
from chronolens.plans import series as S
from chronolens.sources.lake import Lake

SERIES = "series_id string, i long, dt string, ret double"
TIMES = ("date", "dt", "event_time")


def dataset_series(lake: Lake, key: str, simple: tuple[str, ...] = ("ret", "adj_close", "close")) -> DataFrame | None:
    """A dataset's returns, in the order of its first time column: as they are in ``ret``, else from its prices; None if it has neither or no time.

    Of rows of one time, the one retrieved last counts.
    """
    layer, dataset = key.split("/", 1)
    df = S.normalised(lake.read(layer, dataset))
    column, time = S.first_column(df, simple), next((c for c in TIMES if c in df.columns), None)
    if column is None or time is None:
        return None
    own = [c for c in ("symbol", time) if c in df.columns]
    if "retrieved_at" in df.columns:
        df = S.latest_rows(df, own)
    name = F.concat_ws(":", F.lit(key), *([F.col("symbol").cast("string")] if "symbol" in df.columns and df.select("symbol").distinct().limit(2).count() > 1 else []))
    tidy = df.select(name.alias("series_id"), F.col(time).alias("dt"), F.col(column).cast("double").alias("price"))
    if column == "ret":
        kept = tidy.select("series_id", "dt", S.finite(F.col("price")).alias("ret")).where("ret IS NOT NULL")
        out = S.numbered(kept)
    else:
        out = S.returns(tidy, bridge=True)
    return out.select("series_id", "i", F.col("dt").cast("string").alias("dt"), "ret")


def lake_series(lake: Lake, least: int = S.MIN_ORCHESTRATED) -> DataFrame:
    """The returns of every dataset with at least so many, as series named by their dataset. One that can't be read is passed over."""
    found = []
    for key in lake.keys():
        try:
            own = dataset_series(lake, key)
        except Exception:
            continue
        if own is not None:
            found.append(own)
    whole = reduce(DataFrame.unionAll, found) if found else lake.spark.createDataFrame([], SERIES)
    return S.with_enough(whole, least)


def returns_of(lake: Lake, part: str) -> DataFrame | None:
    """The returns of the first dataset, by name, whose name contains part, from its positive prices; None if there is none."""
    key = next((k for k in lake.keys() if part in k), None)
    return None if key is None else dataset_series(lake, key, ("adj_close", "close"))


def findings(series: DataFrame, n_sim: int = 500, seed: int = 42) -> DataFrame:
    """One row of each series: dataset, n_obs, n_sim, garch, survives_all_nulls, verdict, statistics (by name: real, p_garch)."""
    results = compare.compare(series, n_sim, seed=seed)
    kept = compare.survivors(results).groupBy("series_id").agg(F.sort_array(F.collect_list(F.when(F.col("survives"), F.col("statistic")))).alias("survives_all_nulls"))
    each = results.groupBy("series_id", "statistic").agg(F.max("real").alias("real"), F.max(F.when(F.col("null_name") == "garch", F.col("p_two_sided"))).alias("p_garch"))
    maps = each.groupBy("series_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("statistic", F.struct("real", "p_garch"))))).alias("statistics"))
    fit = garch.fit_all(series).select("series_id", F.struct("alpha", "beta", "persistence").alias("garch"))
    out = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_obs")).withColumn("n_sim", F.lit(n_sim))
    for part in (fit, kept, compare.verdicts(results).select("series_id", "verdict"), maps):
        out = out.join(part, "series_id", "left")
    return out.withColumnRenamed("series_id", "dataset").orderBy("dataset")
