"""The static report: five tabs of tables, from the lake, the findings, the hypotheses and the ledger."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens import report
from chronolens.functions import stats
from chronolens.operators import budget, oracle
from chronolens.operators.registry import Hypotheses, Ledger
from chronolens.session import local_session
from chronolens.sources import findings
from chronolens.sources.lake import Lake


def _frame(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    return spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def tabs(spark: SparkSession, lake: Lake, ledger: Ledger, hypotheses: Hypotheses, dataset: str = "sp500_daily") -> dict[str, DataFrame]:
    stocks = sorted((findings.newest(lake, "stocks") or {}).get("stocks", []), key=lambda r: (-len(r["survives_all_nulls"] or []), r["series_id"]))
    own = oracle.returns_of(lake, dataset)
    bands = stats.band_shares(stats.vol_bands(own)) if own is not None else _frame(spark, [], ["series_id", "band", "n", "share"])
    trials = ledger.frame(spark)
    return {
        "Stocks": _frame(spark, stocks, ["series_id", "n_obs", "ann_return", "ann_vol", "sharpe", "excess_kurtosis", "vol_ratio", "last_close", "last_date", "survives_all_nulls", "verdict"]),
        "Volatility": bands,
        "Research": _frame(spark, [{**h.fields, "hypothesis_id": h.hypothesis_id, "agent": h.agent, "status": h.status} for h in hypotheses.all()], ["hypothesis_id", "agent", "status", "mechanism", "predicted_sign", "falsifier"]),
        "Pipeline": lake.summary().select("dataset", "rows", "hash", "bytes", "source", "written_at"),
        "Budget": budget.by_agent(trials).orderBy(F.desc("trials"), "agent"),
    }


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("--data", default="data", help="folder of the lake")
    ask.add_argument("--research", default="research", help="folder of the ledger and the hypotheses")
    ask.add_argument("--out", default="dashboard.html")
    args = ask.parse_args(argv)
    spark = local_session("dashboard")
    report.write(tabs(spark, Lake(spark, args.data), Ledger(f"{args.research}/ledger.json"), Hypotheses(f"{args.research}/hypotheses")), args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
