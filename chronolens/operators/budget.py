"""The multiple-testing budget: the bar that the best of many trials must clear, and the ledger in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolens.functions import stats
from chronolens.functions.normal import cdf_sql, ppf_sql

EULER_GAMMA = 0.5772156649015329  # fixed value
E = 2.718281828459045  # fixed value
DSR_BAR, PERIODS, FEW = 0.95, 252, 10


def expected_max_sharpe_sql(n: str, variance: str) -> str:
    """Expected largest Sharpe ratio of n trials without skill, as SQL that Spark and DuckDB share."""
    n = f"CAST({n} AS DOUBLE)"
    first, second = ppf_sql(f"1 - 1 / {n}"), ppf_sql(f"1 - 1 / ({n} * {E})")
    return f"CASE WHEN {n} <= 1 THEN CAST(0 AS DOUBLE) ELSE sqrt(greatest({variance}, 1e-12)) * ((1 - {EULER_GAMMA}) * ({first}) + {EULER_GAMMA} * ({second})) END"


def deflated_sharpe_sql(sr: str, n_obs: str, bar: str, skew: str, kurtosis: str) -> str:
    """Probability that the true Sharpe ratio is above the bar; kurtosis isn't excess. NULL if undefined."""
    spread = f"(1 - ({skew}) * ({sr}) + (({kurtosis}) - 1) / 4 * ({sr}) * ({sr}))"
    x = f"((({sr}) - ({bar})) * sqrt(CAST({n_obs} AS DOUBLE) - 1) / sqrt({spread}))"
    return f"CASE WHEN ({n_obs}) < 2 OR {spread} <= 0 THEN NULL ELSE {cdf_sql(x)} END"


def with_bar(df: DataFrame, n: str = "n_trials", variance: str = "variance") -> DataFrame:
    return df.withColumn("bar", F.expr(expected_max_sharpe_sql(n, variance)))


def with_dsr(df: DataFrame, sr: str = "sharpe", n_obs: str = "n_obs", bar: str = "bar", skew: str = "skew", kurtosis: str = "kurtosis") -> DataFrame:
    return df.withColumn("dsr", F.expr(deflated_sharpe_sql(sr, n_obs, bar, skew, kurtosis)))


def trial_moments(strategies: DataFrame, order_by: str) -> DataFrame:
    """Rows (trial, agent..., sharpe, n_obs, skew, kurtosis) from returns (series_id, ret, order): per-period Sharpe, 0 without variance."""
    return strategies.groupBy("series_id", order_by).agg(
        F.coalesce(stats.ratio(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("sharpe"), F.count("ret").alias("n_obs"), stats.skewness().alias("skew"), (stats.excess_kurtosis() + 3).alias("kurtosis")
    )


def replay(trials: DataFrame, book: str = "book", order_by: str = "trial_order") -> DataFrame:
    """The ledger's verdicts for trials recorded in the given order, each book on its own.

    A trial is judged on the trials before it and counts itself; verdicts are
    never revised, so running windows give what recording one by one gives.
    Under ten trials, the variance of Sharpe ratios is taken as 1 / n_obs of the
    last trial (1 / 1000 when there is none).
    """
    order = Window.partitionBy(book).orderBy(order_by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = trials.withColumn("n_trials", F.row_number().over(order).cast("long"))
    seen = F.col("n_trials") - 1
    spread = F.when(seen >= FEW, F.var_samp("sharpe").over(before)).when(seen > 0, 1 / F.lag("n_obs").over(order).cast("double")).otherwise(F.lit(0.001))
    judged = with_dsr(with_bar(counted.withColumn("variance", spread)))
    passed = (F.col("sharpe") > F.col("bar")) & (F.coalesce("dsr", F.lit(0.0)) > DSR_BAR)
    reason = F.when(passed, "clears the bar").when(F.col("sharpe") <= F.col("bar"), "below the bar").otherwise("clears the bar but the sample is too short or too fat-tailed")
    root = F.sqrt(F.lit(float(PERIODS)))
    return judged.withColumns({"passed": passed, "sharpe_annual": F.col("sharpe") * root, "threshold_annual": F.col("bar") * root, "reason": reason})


def sharpe_variance(trials: DataFrame, order_by: str = "trial_order") -> DataFrame:
    """One row: the variance that the next trial is judged with, of one book."""
    sums = trials.agg(F.count(F.lit(1)).alias("n"), F.var_samp("sharpe").alias("v"), F.max_by("n_obs", order_by).alias("last"))
    return sums.select("n", F.when(F.col("n") >= FEW, F.col("v")).when(F.col("n") > 0, 1 / F.col("last").cast("double")).otherwise(F.lit(0.001)).alias("variance"))


def by_agent(verdicts: DataFrame) -> DataFrame:
    """Rows (agent, trials, passed)."""
    return verdicts.groupBy("agent").agg(F.count(F.lit(1)).alias("trials"), F.count_if("passed").alias("passed"))
