"""The screener: daily bars of many symbols, stored, tested against the nulls, and written as findings."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import date
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens import report
from chronolens.operators import screen
from chronolens.plans import series as S
from chronolens.session import local_session
from chronolens.sources import connectors, findings
from chronolens.sources.lake import Lake


def run(lake: Lake, symbols: list[str], read: Callable[[str], DataFrame], n_sim: int = 300, seed: int = 42, say=print) -> DataFrame | None:
    """Appends each symbol's bars to the lake, screens all symbols in one plan and writes the findings; symbols that can't be read are passed over."""
    day = date.today()
    kept = []
    for symbol in symbols:
        bars = connectors.stock_history(read, symbol)
        if bars is None:
            say(f"{symbol}: no bars")
            continue
        name = f"stock_{symbol.lower()}"
        lake.append("bronze", name, bars, day.isoformat(), source=f"bars of {symbol}")
        column = S.first_column(bars, ("close", "adj_close"))
        kept.append(lake.read("bronze", name).select(F.lit(symbol).alias("series_id"), F.to_date("date").alias("dt"), F.col(column).cast("double").alias("price")))
    if not kept:
        return None
    prices = S.latest_rows(reduce(DataFrame.unionAll, kept).withColumn("at", F.lit(0)), ["series_id", "dt"], "at").drop("at")
    found = screen.full_screen(S.returns(prices, bridge=True), n_sim, seed, prices.where("price > 0"))
    path = findings.write(lake, "stocks", "stocks", found, day, n_sim=n_sim)
    say(report.screener_text(found))
    say(f"wrote {path}")
    return found


def symbols_of(spark: SparkSession, symbols: list[str], watchlist: str | None) -> list[str]:
    """The symbols named, or those of the watchlist ('default', or a file); the default list where neither is given."""
    if watchlist == "default" or not symbols and not watchlist:
        return connectors.watchlist(spark)
    return connectors.watchlist(spark, watchlist) if watchlist else [s.upper() for s in symbols]


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("symbols", nargs="*")
    ask.add_argument("--watchlist", help="'default', or a file with one symbol a line")
    ask.add_argument("--bars", default="landing", help="folder with one CSV of daily bars for each symbol")
    ask.add_argument("--data", default="data", help="folder of the lake")
    ask.add_argument("--n-sim", type=int, default=300)
    args = ask.parse_args(argv)
    spark = local_session("screener")
    found = run(Lake(spark, args.data), symbols_of(spark, args.symbols, args.watchlist), lambda s: connectors.daily_bars(spark, str(Path(args.bars) / f"{s}.csv"), s), args.n_sim)
    return 0 if found is not None else 1


if __name__ == "__main__":
    raise SystemExit(main())
