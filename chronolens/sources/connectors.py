"""Parsers of the outside sources' files, and the collector that lands them in the lake.

Fetching is the driver's: files go to a landing folder, and Spark reads them
from there.  Executors never touch the network.
"""

from __future__ import annotations

import hashlib
import time
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.operators.pit import FILING_LAG_DAYS
from chronolens.plans.series import MIN_ROWS, normalised
from chronolens.sources.lake import Lake

# Symbols screened when no list is given.
DEFAULT_WATCHLIST = "AAPL MSFT NVDA GOOG AMZN META TSLA JPM V UNH XOM LLY AVGO COST SPY QQQ IWM GLD TLT".split()


def fetch(url: str, landing: str | Path, headers: dict | None = None, ttl_hours: float = 24, rate_limit_s: float = 0.15) -> Path:
    """The file of a URL in the landing folder, downloaded again when older than ttl_hours. HTTP errors raise."""
    path = Path(landing) / hashlib.sha256(url.encode()).hexdigest()[:24]
    if path.exists() and time.time() - path.stat().st_mtime < ttl_hours * 3600:
        return path
    time.sleep(rate_limit_s)
    path.parent.mkdir(parents=True, exist_ok=True)
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {})) as answer:
        path.write_bytes(answer.read())
    return path


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return normalised(spark.read.csv(path, header=True))


def _stamped(df: DataFrame, event, knowable=None) -> DataFrame:
    return df.withColumns({"event_time": event, "knowable_at": event if knowable is None else knowable, "retrieved_at": F.current_timestamp()})


def _numbers(df: DataFrame, but: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in but else F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in df.columns])


def daily_bars(spark: SparkSession, path: str, symbol: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy")) -> DataFrame:
    """Daily prices of one symbol: columns in lower case, date, the stamps (knowable at its own close)."""
    raw = _csv(spark, path)
    date = F.coalesce(*[F.try_to_timestamp(F.col("date"), F.lit(f)).cast("timestamp_ntz") for f in formats])
    bars = _numbers(raw, ("date",)).withColumn("date", date).withColumn("symbol", F.lit(symbol))
    return _stamped(bars, F.col("date"))


def index_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of the index, from a supplied file."""
    return daily_bars(spark, path, "^GSPC")


def volatility_index(spark: SparkSession, path: str) -> DataFrame:
    """Like daily_bars, without rows that have any null."""
    return daily_bars(spark, path, "^VIX").na.drop("any")


def positioning(spark: SparkSession, path: str, landing: str | None = None) -> DataFrame:
    """Weekly positioning reports from CSV, or a ZIP of one: knowable three days after the day they describe."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            name = z.namelist()[0]
            path = z.extract(name, landing or str(Path(path).parent))
    df = _csv(spark, path)
    # a report may state its day twice: in full, and with two digits of the year
    named = sorted((c for c in df.columns if "yyyy-mm-dd" in c or c.startswith("report_date") or c.startswith("as_of_date")), key=lambda c: ("yyyy-mm-dd" not in c, not c.startswith("report_date")))
    event = F.coalesce(*[F.try_to_timestamp(F.col(f"`{named[0]}`"), F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd", "yyMMdd")])
    return _stamped(df, event, event + F.make_dt_interval(F.lit(FILING_LAG_DAYS["COT"]))).na.drop(subset=["event_time"])


def company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cik, ticker, title) from a JSON object of objects. No stamps: the map has no history."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))).alias("x"))
    return rows.select(F.col("x.cik_str").alias("cik"), "x.ticker", "x.title")


def filings(spark: SparkSession, path: str, cik: int, forms: tuple[str, ...]) -> DataFrame:
    """Filings of these forms from a JSON object of parallel arrays; rows without a valid report or filing date go."""
    whole = spark.read.json(path, multiLine=True).select("filings.recent.*")
    rows = whole.select(F.inline(F.arrays_zip(*[F.col(c) for c in whole.columns])))
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    stamped = _stamped(rows.where(F.col("form").isin(*forms)), day("reportDate"), day("filingDate"))
    return stamped.withColumn("cik", F.lit(cik).cast("long")).na.drop(subset=["event_time", "knowable_at"])


def fund_holdings(spark: SparkSession, path: str) -> DataFrame:
    """A holdings CSV after a preamble: everything from the line that begins with ``Ticker,``. No stamps."""
    lines = spark.read.text(path, wholetext=True).select(F.expr("substring(value, locate('Ticker,', value))").alias("rest"))
    text = lines.first()["rest"]  # one file of one fund: a few hundred lines
    return normalised(spark.read.csv(spark.sparkContext.parallelize(text.splitlines(), 1), header=True))


def stock_history(read: Callable[[str], DataFrame], symbol: str) -> DataFrame | None:
    """A quote source's frame, or None if it fails or has under MIN_ROWS rows."""
    try:
        df = normalised(read(symbol))
        return df if df.limit(MIN_ROWS).count() >= MIN_ROWS else None
    except Exception:
        return None


def watchlist(spark: SparkSession, path: str | None = None) -> list[str]:
    """Symbols of a file, one a line, trimmed, in capitals, without empty lines; a missing file has none; no path means the default list."""
    if path is None:
        return list(DEFAULT_WATCHLIST)
    if not Path(path).exists():
        return []
    rows = spark.read.text(path).select(F.upper(F.trim("value")).alias("s")).where("s <> ''")
    return [r["s"] for r in rows.collect()]


def collect(lake: Lake, jobs: dict[str, Callable[[], DataFrame]], layer: str = "bronze") -> dict[str, str]:
    """Runs each job and appends what it gives; one job's failure doesn't stop the others. Outcome by name: ok, empty, failed(Type)."""
    out = {}
    for name, job in jobs.items():
        try:
            df = job()
            if df is None or df.isEmpty():
                out[name] = "empty"
            else:
                lake.append(layer, name, df, source=name)
                out[name] = "ok"
        except Exception as e:
            out[name] = f"failed({type(e).__name__})"
    return out


def exit_code(outcomes: dict[str, str]) -> int:
    """0 if anything succeeded."""
    return 0 if "ok" in outcomes.values() else 1
