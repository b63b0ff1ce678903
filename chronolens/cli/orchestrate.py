"""The scheduled run: the null comparison over the lake, with the budget before and after. It charges no trial."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from chronolens import report
from chronolens.operators import oracle
from chronolens.operators.registry import Hypotheses, Ledger
from chronolens.session import local_session
from chronolens.sources import findings
from chronolens.sources.lake import Lake

# Roles that run, and roles that need a backtester first.
READY = {"oracle"}
BLOCKED = {"athena", "chartist", "nimbus", "sentinel", "pilot"}


def run_oracle(lake: Lake, n_sim: int, seed: int = 42, say=print) -> int:
    """Compares every usable dataset of the lake and writes the findings; returns how many there were."""
    frame = oracle.findings(oracle.lake_series(lake), n_sim, seed)
    found = frame.collect()  # a row of each dataset
    for r in found:
        say(f"  {r['dataset']}: {r['n_obs']} returns, {r['verdict']}")
    if found:
        known = lake.spark.createDataFrame(found, frame.schema)
        say(f"  wrote {findings.write(lake, 'oracle', 'findings', known)}")
    return len(found)


def run(spark: SparkSession, lake: Lake, ledger: Ledger, hypotheses: Hypotheses, agents: set[str], n_sim: int = 500, say=print) -> int:
    say("budget before\n" + report.ledger_text(ledger, spark))
    n = run_oracle(lake, n_sim, say=say)
    if waiting := sorted(agents & BLOCKED):
        say(f"not run, for want of a backtester: {', '.join(waiting)}")
    if unknown := sorted(agents - READY - BLOCKED):
        say(f"unknown roles: {', '.join(unknown)}")
    say("budget after\n" + report.ledger_text(ledger, spark))
    say(f"{n} datasets compared, 0 trials charged, {len(hypotheses.all())} hypotheses on file")
    return 0


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("--max-trials", type=int, default=5, help="the most trials that this run may charge")
    ask.add_argument("--agents", default="athena", help="roles, with commas")
    ask.add_argument("--n-sim", type=int, default=500)
    ask.add_argument("--data", default="data", help="folder of the lake")
    ask.add_argument("--research", default="research", help="folder of the ledger and the hypotheses")
    args = ask.parse_args(argv)
    spark = local_session("orchestrate")
    used = len(Ledger(f"{args.research}/ledger.json").trials)
    ledger = Ledger(f"{args.research}/ledger.json", used + args.max_trials)
    agents = {a.strip().lower() for a in args.agents.split(",") if a.strip()}
    return run(spark, Lake(spark, args.data), ledger, Hypotheses(f"{args.research}/hypotheses"), agents, args.n_sim)


if __name__ == "__main__":
    raise SystemExit(main())
