"""The statistics of return series as DataFrame plans.

Every function takes rows (keys..., i, ret) and groups by the keys, so one plan
serves one series, thousands of series, or thousands of surrogates.  What the
statistics share (means, volatilities, bands, pairs of bands) is computed once
in ``band_pairs`` and friends and reused by callers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS, WINDOW, BANDS, HORIZON, LAGS = 252, 20, 5, 5, 22
KEYS = ("series_id",)
TIE = 1e-12  # a volatility this close to a cut, relatively, is at it: resampled series repeat values but for the order of summing
NAMES = ("Ann. volatility", "Excess kurtosis", "ACF |r| lag 1", "ACF |r| lag 22", "ACF |r| lag 66", "ACF r lag 1", f"Ljung-Box Q({LAGS}) on |r|", "Same-band rate", "Lift over independence", "Cramer's V", "Regression R2")


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b where b is positive, else default."""
    return F.when(b > 0, a / b).otherwise(F.lit(default).cast("double"))


def ann_vol(x: Column | str = "ret", periods: int = PERIODS) -> Column:
    return F.stddev_samp(x) * F.sqrt(F.lit(float(periods)))


def excess_kurtosis(x: Column | str = "ret") -> Column:
    return F.coalesce(F.kurtosis(x), F.lit(0.0))


def skewness(x: Column | str = "ret") -> Column:
    return F.coalesce(F.skewness(x), F.lit(0.0))


def sharpe(x: Column | str = "ret", periods: int = PERIODS) -> Column:
    return ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(float(periods)))


def moments(frame: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row of each series: n, ann_return, ann_vol, excess_kurtosis, skewness, sharpe. One aggregation."""
    return frame.groupBy(*keys).agg(F.count("ret").alias("n"), (F.avg("ret") * PERIODS).alias("ann_return"), ann_vol().alias("ann_vol"), excess_kurtosis().alias("excess_kurtosis"), skewness().alias("skewness"), sharpe().alias("sharpe"))


def autocorrelations(frame: DataFrame, lags: list[int], absolute: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows (keys, lag, acf, n).

    Products with all lags come from one window pass; the mean is the whole
    series's.  A lag of 0 or less gives 1, one of n or more 0, and a series
    without variance 0.
    """
    x = F.abs("ret") if absolute else F.col("ret")
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("i")
    centred = frame.select(*keys, "i", (x - F.avg(x).over(whole)).alias("d"))
    products = centred.select(*keys, "d", *[(F.col("d") * F.lag("d", h).over(order)).alias(f"p{h}") for h in lags if h > 0])
    sums = products.groupBy(*keys).agg(F.count("d").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s"), *[F.sum(f"p{h}").alias(f"p{h}") for h in lags if h > 0])
    value = lambda h: F.lit(1.0) if h <= 0 else F.when(F.col("n") <= h, 0.0).otherwise(F.coalesce(ratio(F.col(f"p{h}"), F.col("s")), F.lit(0.0)))
    return sums.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(h).alias("lag"), value(h).alias("acf")) for h in lags])).alias("x")).select(*keys, "x.lag", "x.acf", "n")


def ljung_box(frame: DataFrame, m: int = LAGS, absolute: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows (keys, q): n (n + 2) times the sum of acf(h)^2 / (n - h) for h up to m."""
    acf = autocorrelations(frame, list(range(1, m + 1)), absolute, keys).where(F.col("n") > F.col("lag"))
    return acf.groupBy(*keys).agg((F.max("n") * (F.max("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"))


def realised_vol(frame: DataFrame, window: int = WINDOW, periods: int = PERIODS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """frame with rv, the trailing annualised volatility; NULL before the window is full."""
    order = Window.partitionBy(*keys).orderBy("i")
    full = F.row_number().over(order) >= window
    return frame.withColumn("rv", F.when(full, F.stddev_samp("ret").over(order.rowsBetween(-(window - 1), 0)) * F.sqrt(F.lit(float(periods)))))


def vol_bands(frame: DataFrame, window: int = WINDOW, k: int = BANDS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """frame with rv and band: 0..k-1 by the series's own quantiles of rv (linear interpolation, a cut belongs to the band above it), -1 where rv is undefined or has fewer than k values."""
    vol = realised_vol(frame, window, keys=keys)
    marks = F.array(*[F.lit(j / k) for j in range(1, k)])
    cuts = vol.groupBy(*keys).agg(F.percentile("rv", marks).alias("cuts"), F.count("rv").alias("valid"))
    label = F.aggregate("cuts", F.lit(0), lambda n, c: n + F.when(F.col("rv") >= c * (1 - TIE), 1).otherwise(0))
    banded = vol.join(cuts, list(keys)).withColumn("band", F.when(F.col("rv").isNull() | (F.col("valid") < k), -1).otherwise(label))
    return banded.drop("cuts", "valid")


def band_pairs(banded: DataFrame, horizon: int = HORIZON, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows (keys, a, b, rv, rv_ahead) of labelled days and the days horizon later."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    order = Window.partitionBy(*keys).orderBy("i")
    ahead = banded.select(*keys, F.col("band").alias("a"), F.lead("band", horizon).over(order).alias("b"), "rv", F.lead("rv", horizon).over(order).alias("rv_ahead"))
    return ahead.where("a >= 0 and b >= 0")


def band_statistics(pairs: DataFrame, k: int = BANDS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row of each series: n_pairs, same_band, independence, lift, cramers_v, vol_r2.

    The k x k table of pairs is counted once, in one aggregation, and everything
    follows from its cells and margins.
    """
    cells = [F.count_if((F.col("a") == i) & (F.col("b") == j)).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    both = (F.col("rv") > 0) & (F.col("rv_ahead") > 0)
    fit = F.regr_r2(F.when(both, F.ln("rv_ahead")), F.when(both, F.ln("rv")))
    counts = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("n_fit"), fit.alias("r2"), *cells)
    cell = lambda i, j: F.col(f"c{i}_{j}").cast("double")
    total = lambda xs: sum(xs[1:], xs[0])
    rows = [total([cell(i, j) for j in range(k)]) for i in range(k)]
    columns = [total([cell(i, j) for i in range(k)]) for j in range(k)]
    n = F.col("n").cast("double")
    same = total([cell(i, i) for i in range(k)]) / n
    chance = total([rows[i] * columns[i] for i in range(k)]) / (n * n)
    part = lambda i, j: F.when(rows[i] * columns[j] > 0, F.pow(cell(i, j) - rows[i] * columns[j] / n, F.lit(2.0)) / (rows[i] * columns[j] / n)).otherwise(0.0)
    chi2 = total([part(i, j) for i in range(k) for j in range(k)])
    return counts.select(
        *keys,
        F.col("n").alias("n_pairs"),
        same.alias("same_band"),
        chance.alias("independence"),
        ((same - chance) * 100).alias("lift"),
        F.sqrt(ratio(chi2, n * (k - 1))).alias("cramers_v"),
        F.when(F.col("n_fit") >= 30, F.col("r2")).alias("vol_r2"),
    )


def band_shares(banded: DataFrame, k: int = BANDS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows (keys, band, n, share) for every band 0..k-1, empty ones too."""
    counts = banded.where("band >= 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("band") == b).alias(f"c{b}") for b in range(k)])
    return counts.select(*keys, "total", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"c{b}").alias("n")) for b in range(k)])).alias("x")).select(*keys, "x.band", "x.n", (F.col("x.n") / F.col("total")).alias("share"))


def all_statistics(frame: DataFrame, keys: tuple[str, ...] = KEYS, window: int = WINDOW, k: int = BANDS, horizon: int = HORIZON) -> DataFrame:
    """Rows (keys, statistic, value) of the eleven registered statistics."""
    vol = frame.groupBy(*keys).agg(ann_vol().alias("v0"), excess_kurtosis().alias("v1"))
    absolute = autocorrelations(frame, [*range(1, LAGS + 1), 66], True, keys)
    pick = lambda h: F.max(F.when(F.col("lag") == h, F.col("acf")))
    box = F.max("n") * (F.max("n") + 2) * F.sum(F.when((F.col("lag") <= LAGS) & (F.col("n") > F.col("lag")), F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))))
    acf = absolute.groupBy(*keys).agg(pick(1).alias("v2"), pick(22).alias("v3"), pick(66).alias("v4"), box.alias("v6"))
    signed = autocorrelations(frame, [1], False, keys).select(*keys, F.col("acf").alias("v5"))
    bands = band_statistics(band_pairs(vol_bands(frame, window, k, keys), horizon, keys), k, keys).select(*keys, F.col("same_band").alias("v7"), F.col("lift").alias("v8"), F.col("cramers_v").alias("v9"), F.col("vol_r2").alias("v10"))
    wide = vol.join(acf, list(keys), "left").join(signed, list(keys), "left").join(bands, list(keys), "left")
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), F.col(f"v{i}").cast("double").alias("value")) for i, name in enumerate(NAMES)])).alias("x")).select(*keys, "x.statistic", "x.value")
