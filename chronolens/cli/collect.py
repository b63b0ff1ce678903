"""The collector: lands each source in the lake; one source's failure doesn't stop the others."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from chronolens.session import local_session
from chronolens.sources import connectors
from chronolens.sources.lake import Lake


def jobs(spark: SparkSession, landing: str) -> dict[str, Callable[[], DataFrame]]:
    """What is collected, from files of the landing folder."""
    at = lambda name: str(Path(landing) / name)
    return {
        "vix_daily": lambda: connectors.volatility_index(spark, at("vix.csv")),
        "sp500_daily": lambda: connectors.index_bars(spark, at("sp500.csv")),
        "cftc_cot": lambda: connectors.positioning(spark, at("cot.zip") if Path(at("cot.zip")).exists() else at("cot.csv")),
        "edgar_tickers": lambda: connectors.company_tickers(spark, at("company_tickers.json")),
    }


def verify(lake: Lake, say=print) -> int:
    """1 if a dataset isn't what its manifest entry says."""
    bad = sorted(name for name, ok in lake.verify().items() if not ok)
    say(f"differ from the manifest: {', '.join(bad)}" if bad else f"{len(lake.keys())} datasets are as the manifest says")
    return 1 if bad else 0


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("--landing", default="landing", help="folder of the fetched files")
    ask.add_argument("--data", default="data", help="folder of the lake")
    ask.add_argument("--verify-only", action="store_true")
    args = ask.parse_args(argv)
    spark = local_session("collect")
    lake = Lake(spark, args.data)
    if args.verify_only:
        return verify(lake)
    outcomes = connectors.collect(lake, jobs(spark, args.landing))
    for name, outcome in outcomes.items():
        print(f"  {name:20} {outcome}")
    print(f"{sum(x == 'ok' for x in outcomes.values())} of {len(outcomes)} sources collected")
    return connectors.exit_code(outcomes)


if __name__ == "__main__":
    raise SystemExit(main())
