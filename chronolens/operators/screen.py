"""The screener: one row for each series, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.functions import stats
from chronolens.operators import compare, garch
from chronolens.plans import series as S


def trailing_vol(series: DataFrame, n: int) -> DataFrame:
    """Rows (series_id, vol): annualised volatility of the last n returns; NULL for shorter series."""
    tail = S.last_n(series, n).groupBy("series_id").agg(F.count("ret").alias("n"), stats.ann_vol().alias("v"))
    return tail.select("series_id", F.when(F.col("n") >= n, F.col("v")).alias("vol"))


def screen(series: DataFrame, least: int = S.MIN_SCREENED, prices: DataFrame | None = None) -> DataFrame:
    """Rows (series_id, n_obs, ann_return, ann_vol, sharpe, excess_kurtosis, acf_abs_lag1, acf_signed_lag1, same_band_rate, vol_20d, vol_60d, vol_ratio, last_date), of series with enough returns; with prices (series_id, dt, price), last_close too."""
    own = S.with_enough(series, least)
    out = stats.moments(own).withColumnRenamed("n", "n_obs").drop("skewness")
    acf = lambda absolute, name: stats.autocorrelations(own, [1], absolute).select("series_id", F.col("acf").alias(name))
    bands = stats.band_statistics(stats.band_pairs(stats.vol_bands(own))).select("series_id", F.col("same_band").alias("same_band_rate"))
    vols = trailing_vol(own, 20).withColumnRenamed("vol", "vol_20d").join(trailing_vol(own, 60).withColumnRenamed("vol", "vol_60d"), "series_id")
    last = own.groupBy("series_id").agg(F.max("dt").alias("last_date"))
    for part in (acf(True, "acf_abs_lag1"), acf(False, "acf_signed_lag1"), bands, vols, last):
        out = out.join(part, "series_id", "left")
    if prices is not None:
        out = out.join(prices.groupBy("series_id").agg(F.max_by("price", "dt").alias("last_close")), "series_id", "left")
    return out.withColumn("vol_ratio", F.when(F.col("vol_60d") > 0, F.round(F.col("vol_20d") / F.col("vol_60d"), 2)))


def full_screen(series: DataFrame, n_sim: int = 300, seed: int = 42, prices: DataFrame | None = None) -> DataFrame:
    """screen with the GARCH fit, the surviving statistics, and p-values by statistic."""
    own = S.with_enough(series, S.MIN_SCREENED)
    results = compare.compare(own, n_sim, seed=seed)
    kept = compare.survivors(results).groupBy("series_id").agg(F.sort_array(F.collect_list(F.when(F.col("survives"), F.col("statistic")))).alias("survives_all_nulls"))
    p = lambda null: F.max(F.when(F.col("null_name") == null, F.col("p_two_sided")))
    each = results.groupBy("series_id", "statistic").agg(F.max("real").alias("real"), p("garch").alias("p_garch"), p("shuffled").alias("p_shuffle"))
    maps = each.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("statistic", F.struct("real", "p_garch", "p_shuffle")))).alias("statistics"))
    fit = garch.fit_all(own).select("series_id", F.struct("alpha", "beta", "persistence", "half_life").alias("garch"))
    out = screen(series, prices=prices)
    for part in (fit, kept, maps, compare.verdicts(results)):
        out = out.join(part, "series_id", "left")
    return out
