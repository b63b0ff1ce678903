"""Governance on the driver: pre-registration of hypotheses, the append-only trial ledger, and the gate in front of returns."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.operators import budget

# What a hypothesis must state, and what doesn't count as a statement.
REQUIRED = ("mechanism", "who_is_forced", "counterparty", "predicted_sign", "predicted_magnitude_bp", "predicted_timing", "falsifier")
PROSE = ("mechanism", "falsifier", "who_is_forced", "counterparty")
PLACEHOLDERS = ("tbd", "n/a", "unknown", "none")
LEAST_PROSE = 15
ID = re.compile(r"H-\d{4,}")


class PreRegistrationError(RuntimeError):
    """Data or a verdict was asked for without a valid registration."""


def write_atomically(path: Path, text: str) -> None:
    """All of the new text or all of the old, never a part."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(name, path)


def problems(fields: dict) -> list[str]:
    """Why these fields can't be registered."""
    out = [f"{f}: empty" for f in REQUIRED if fields.get(f) in (None, "", [], (), {})]
    for f in PROSE:
        text = str(fields.get(f) or "").strip()
        if text and (len(text) < LEAST_PROSE or text.lower() in PLACEHOLDERS):
            out.append(f"{f}: a placeholder")
    return out


def invalid_hypotheses(df: DataFrame) -> DataFrame:
    """The rows of a table of hypotheses (as strings) with ``problems``, the fields that fail the same rules."""
    text = lambda f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))
    bad = [F.when((text(f) == "") | ((F.length(text(f)) < LEAST_PROSE) | F.lower(text(f)).isin(*PLACEHOLDERS) if f in PROSE else F.lit(False)), F.lit(f)) for f in REQUIRED]
    return df.withColumn("problems", F.array_compact(F.array(*bad))).where(F.size("problems") > 0)


@dataclass
class Hypothesis:
    hypothesis_id: str
    agent: str
    fields: dict
    parent_id: str | None = None
    registered_at: str = ""
    status: str = "registered"
    verdict: dict | None = None


class Hypotheses:
    """One JSON file for each hypothesis."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def path(self, hypothesis_id: str) -> Path:
        if not ID.fullmatch(hypothesis_id):
            raise ValueError(f"not a hypothesis id: {hypothesis_id!r}")
        return self.folder / f"{hypothesis_id}.json"

    def next_id(self) -> str:
        taken = [int(p.stem[2:]) for p in self.folder.glob("H-*.json") if ID.fullmatch(p.stem)]
        return f"H-{max(taken, default=0) + 1:04d}"

    def register(self, agent: str, parent_id: str | None = None, **fields) -> Hypothesis:
        if found := problems(fields):
            raise PreRegistrationError("; ".join(found))
        if parent_id is not None:
            self.get(parent_id)
        h = Hypothesis(self.next_id(), agent, {k: fields[k] for k in REQUIRED}, parent_id, datetime.now(UTC).isoformat())
        self.save(h)
        return h

    def save(self, h: Hypothesis) -> None:
        write_atomically(self.path(h.hypothesis_id), json.dumps(asdict(h), indent=1, sort_keys=True))

    def get(self, hypothesis_id: str) -> Hypothesis:
        return Hypothesis(**json.loads(self.path(hypothesis_id).read_text()))

    def update(self, hypothesis_id: str, **changes) -> Hypothesis:
        h = self.get(hypothesis_id)
        for k, v in changes.items():
            setattr(h, k, v)
        self.save(h)
        return h

    def all(self) -> list[Hypothesis]:
        return [self.get(p.stem) for p in sorted(self.folder.glob("H-*.json")) if ID.fullmatch(p.stem)]


class Ledger:
    """Trials, append-only: there is no way to take one back. One writer at a time, by an exclusive lock."""

    def __init__(self, path: str | Path, max_trials: int | None = None):
        self.path, self.max_trials = Path(path), max_trials

    @property
    def trials(self) -> list[dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else []

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "trial_id long, hypothesis_id string, agent string, sharpe double, n_obs long, timestamp string, passed boolean, note string"
        return spark.createDataFrame([tuple(t[c.split()[0]] for c in schema.split(", ")) for t in self.trials], schema)

    def record(self, hypothesis_id: str, agent: str, returns: DataFrame, note: str = "") -> dict:
        """Charges one trial and rules on it; returns is a frame with a column ret, reduced in one aggregation."""
        import fcntl

        clean = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") < float("inf")))
        moments = budget.trial_moments(clean.select(F.lit(hypothesis_id).alias("series_id"), F.lit(0).alias("o"), "ret"), "o").first()
        sharpe, n_obs, skew, kurtosis = (moments["sharpe"], moments["n_obs"], moments["skew"], moments["kurtosis"]) if moments else (0.0, 0, 0.0, 3.0)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            trials = self.trials
            if self.max_trials is not None and len(trials) >= self.max_trials:
                raise PreRegistrationError(f"the budget of {self.max_trials} trials is spent")
            spark = returns.sparkSession
            rows = [(t["sharpe"], t["n_obs"], 0.0, 3.0, i) for i, t in enumerate(trials)] + [(sharpe, n_obs, skew, kurtosis, len(trials))]
            frame = spark.createDataFrame(rows, "sharpe double, n_obs long, skew double, kurtosis double, trial_order long").withColumn("book", F.lit(0))
            v = budget.replay(frame).orderBy(F.desc("trial_order")).first()
            verdict = {"hypothesis_id": hypothesis_id, "agent": agent, "sharpe_annual": v["sharpe_annual"], "n_trials_at_test": v["n_trials"], "threshold_annual": v["threshold_annual"], "dsr": v["dsr"], "passed": v["passed"], "reason": v["reason"]}
            trials.append({"trial_id": v["n_trials"], "hypothesis_id": hypothesis_id, "agent": agent, "sharpe": sharpe, "n_obs": n_obs, "timestamp": datetime.now(UTC).isoformat(), "passed": v["passed"], "note": note})
            write_atomically(self.path, json.dumps(trials, indent=1))
        return verdict


@dataclass
class Gate:
    """What an agent may do: register, then look, then be judged. Ownership is what the registration says."""

    agent: str
    hypotheses: Hypotheses
    ledger: Ledger
    provider: Callable[..., DataFrame]
    opened: list[str] = field(default_factory=list)

    def register_hypothesis(self, **fields) -> Hypothesis:
        return self.hypotheses.register(self.agent, **fields)

    def refine_hypothesis(self, parent_id: str, **fields) -> Hypothesis:
        """A child is a new hypothesis, and a new trial."""
        return self.hypotheses.register(self.agent, parent_id=parent_id, **fields)

    def _own(self, hypothesis_id: str) -> Hypothesis:
        try:
            h = self.hypotheses.get(hypothesis_id)
        except FileNotFoundError:
            raise PreRegistrationError(f"{hypothesis_id} isn't registered") from None
        if h.agent != self.agent:
            raise PreRegistrationError(f"{hypothesis_id} belongs to {h.agent}")
        return h

    def get_returns(self, hypothesis_id: str, **kwargs) -> DataFrame:
        self._own(hypothesis_id)
        self.opened.append(hypothesis_id)
        return self.provider(hypothesis_id, **kwargs)

    def submit_for_verdict(self, hypothesis_id: str, returns: DataFrame, note: str = "") -> dict:
        self._own(hypothesis_id)
        verdict = self.ledger.record(hypothesis_id, self.agent, returns, note)
        self.hypotheses.update(hypothesis_id, status="passed" if verdict["passed"] else "failed", verdict=verdict)
        return verdict

    def journal(self) -> list[dict]:
        """What was tried: hypotheses with a verdict, in short."""
        return [{"hypothesis_id": h.hypothesis_id, "agent": h.agent, "status": h.status, "mechanism": h.fields["mechanism"][:120], "reason": (h.verdict or {}).get("reason")} for h in self.hypotheses.all() if h.status != "registered"]

    def budget_status(self) -> dict:
        trials = self.ledger.trials
        agents = sorted({t["agent"] for t in trials})
        return {"n_trials": len(trials), "passed": sum(t["passed"] for t in trials), "by_agent": {a: sum(t["agent"] == a for t in trials) for a in agents}, "left": None if self.ledger.max_trials is None else self.ledger.max_trials - len(trials)}


def journal_frame(hypotheses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hypotheses with a verdict, joined with it, the mechanism cut to 120 characters."""
    own = hypotheses.where("status <> 'registered'").select("hypothesis_id", "agent", "status", F.substring("mechanism", 1, 120).alias("mechanism"))
    return own.join(verdicts.select("hypothesis_id", "reason", "passed"), "hypothesis_id", "left")


#: Chains written from one row; bounds the arrays that ``lineage`` expands.
CHAINS = 4096


def lineage(hypotheses: DataFrame, limit: int = 100, generations: int | None = None) -> DataFrame:
    """Rows (hypothesis_id, root_id, depth): a refinement's oldest ancestor; a parent that isn't in the table is none.

    Pointers double each round, so limit rounds reach 2^limit deep; ids must be unique and without cycles. With
    ``generations``, that many steps up at most: the rows of as many left joins, so a repeated id gives one for each chain.
    """
    if generations is not None:
        return _chains(hypotheses, generations)
    known = hypotheses.select(F.col("hypothesis_id").alias("parent")).distinct()
    at = hypotheses.join(known, F.col("parent_id") == F.col("parent"), "left").select("hypothesis_id", F.coalesce("parent", "hypothesis_id").alias("root_id"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(limit):
        up = at.select(F.col("hypothesis_id").alias("root_id"), F.col("root_id").alias("above"), F.col("depth").alias("more"))
        after = at.join(up, "root_id", "left").select("hypothesis_id", F.coalesce("above", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
        if after.select("hypothesis_id", "root_id").subtract(at.select("hypothesis_id", "root_id")).isEmpty():
            return after
        at = after
    return at


def _chains(hypotheses: DataFrame, generations: int) -> DataFrame:
    """Chains are counted on the way up, as they multiply with repeated ids, and written out by all tasks at the end."""
    own = hypotheses.groupBy("hypothesis_id", "parent_id").agg(F.count(F.lit(1)).alias("n"))
    up = own.select(F.col("hypothesis_id").alias("above"), F.col("parent_id").alias("beyond"), F.col("n").alias("times"))
    at = own.select("hypothesis_id", F.col("hypothesis_id").alias("root_id"), "parent_id", F.lit(0).alias("depth"), "n")
    for _ in range(generations):
        found = F.col("above").isNotNull().cast("int")
        step = at.join(up, F.col("parent_id") == F.col("above"), "left").select("hypothesis_id", F.coalesce("above", "root_id").alias("root_id"), F.col("beyond").alias("parent_id"), (F.col("depth") + found).alias("depth"), (F.col("n") * F.coalesce("times", F.lit(1))).alias("n"))
        at = step.groupBy("hypothesis_id", "root_id", "parent_id", "depth").agg(F.sum("n").alias("n"))
    tasks = int(hypotheses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = at.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHAINS)))).repartition(tasks)
    chains = F.sequence(F.lit(1), F.least(F.lit(CHAINS), F.col("n") - F.col("piece") * CHAINS).cast("int"))
    return pieces.select("hypothesis_id", "root_id", "depth", F.explode(chains).alias("chain")).drop("chain")
