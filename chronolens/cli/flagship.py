"""The flagship: one index history against four nulls, from prices to the gold table."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens import report
from chronolens.functions import stats
from chronolens.operators import compare, garch
from chronolens.plans import series as S
from chronolens.session import local_session
from chronolens.sources import connectors
from chronolens.sources.lake import Lake

WINDOW, BANDS, HORIZON = stats.WINDOW, stats.BANDS, stats.HORIZON


def run(spark: SparkSession, bars: DataFrame, lake: Lake, n_sim: int = 1000, seed: int = 42, name: str = "sp500", say=print) -> DataFrame:
    """Stores bars (bronze), their log returns (silver) and the panel (gold); says what it found; returns the comparison's rows."""
    lake.write("bronze", f"{name}_daily", bars, source="supplied file")
    prices = lake.read("bronze", f"{name}_daily").select(F.lit(name).alias("series_id"), F.col("date").alias("dt"), F.col(S.first_column(bars, ("adj_close", "close"))).cast("double").alias("price"))
    lake.write("silver", f"{name}_returns", S.returns(prices, bridge=True).withColumnRenamed("dt", "date"), source=f"bronze/{name}_daily")
    own = lake.read("silver", f"{name}_returns").withColumnRenamed("date", "dt")
    lake.write("gold", f"{name}_comparison", compare.compare(own, n_sim, seed=seed, window=WINDOW, k=BANDS, horizon=HORIZON), source=f"silver/{name}_returns", note=f"n_sim={n_sim} seed={seed}")
    results = lake.read("gold", f"{name}_comparison")
    fit = garch.fit_all(own).first()
    span = own.agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("a"), F.max("dt").alias("b")).first()
    say(f"{name}: {span['n']} returns, {span['a']} to {span['b']}")
    say(f"GARCH(1,1): omega {fit['omega']:.3e}, alpha {fit['alpha']:.4f}, beta {fit['beta']:.4f}, persistence {fit['persistence']:.5f}")
    say(report.comparison_text(results))
    say(report.p_value_text(results))
    rate = {r["null_name"]: r for r in results.where("statistic = 'Same-band rate'").collect()}
    real = rate["shuffled"]["real"]
    say(f"same-band rate {real:.1%}; over 1/k {(real - 1 / BANDS) * 100:+.1f} points, over shuffled {(real - rate['shuffled']['mean']) * 100:+.1f}, over garch {(real - rate['garch']['mean']) * 100:+.1f}")
    shares = stats.band_shares(stats.vol_bands(own, WINDOW, BANDS), BANDS).orderBy("band").collect()
    say("\n".join(f"band {r['band']}  {'#' * int(r['share'] * 60)} {r['share']:.1%}" for r in shares))
    say(compare.verdicts(results).first()["verdict"])
    lake.write("gold", "vol_lab_three_worlds", compare.panel(results), source=f"silver/{name}_returns", note=f"n_sim={n_sim} window={WINDOW} k={BANDS} horizon={HORIZON}")
    return results


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("prices", help="CSV of daily bars: date, close or adj close")
    ask.add_argument("--data", default="data", help="folder of the lake")
    ask.add_argument("--n-sim", type=int, default=1000)
    args = ask.parse_args(argv)
    spark = local_session("flagship")
    lake = Lake(spark, args.data)
    run(spark, connectors.index_bars(spark, args.prices), lake, args.n_sim)
    lake.summary().select("dataset", "rows", "hash", "source").show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
