"""A static HTML report of the engine's small result tables: no server, no outside files, one tab for each table."""

from __future__ import annotations

from datetime import UTC, datetime
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.functions import stats
from chronolens.operators import budget, compare
from chronolens.operators.registry import Ledger
from chronolens.operators.surrogates import NULLS

MAX_ROWS = 2_000  # a report shows this many rows of a table and says how many there are

STYLE = "body{font:14px system-ui;margin:2em}table{border-collapse:collapse}td,th{padding:3px 10px;border-bottom:1px solid #ddd;text-align:right}td:first-child,th:first-child{text-align:left}input[name=tab]{display:none}label{padding:6px 12px;cursor:pointer;background:#eee;margin-right:4px}section{display:none;margin-top:1em}"


def _cell(x) -> str:
    if x is None:
        return ""
    return escape(f"{x:.4g}" if isinstance(x, float) else str(x))


def table_html(df: DataFrame) -> str:
    rows = df.limit(MAX_ROWS + 1).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(x)}</td>" for x in row) + "</tr>" for row in rows[:MAX_ROWS])
    more = f"<p>The first {MAX_ROWS} of {df.count()} rows.</p>" if len(rows) > MAX_ROWS else ""
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}"


def render(tabs: dict[str, DataFrame], title: str = "Report") -> str:
    shown, labels, sections = [], [], []
    for i, (name, df) in enumerate(tabs.items()):
        labels.append(f'<input type="radio" name="tab" id="t{i}"{" checked" if not i else ""}><label for="t{i}">{escape(name)}</label>')
        sections.append(f'<section id="s{i}"><h2>{escape(name)}</h2>{table_html(df)}</section>')
        shown.append(f"#t{i}:checked~#s{i}{{display:block}}")
    made = datetime.now(UTC).strftime("%Y-%m-%d %H:%M UTC")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}{''.join(shown)}</style></head><body><h1>{escape(title)}</h1><p>{made}</p>{''.join(labels)}{''.join(sections)}</body></html>"


def write(tabs: dict[str, DataFrame], path: str | Path, title: str = "Report") -> Path:
    path = Path(path)
    path.write_text(render(tabs, title), encoding="utf-8")
    return path


def fixed_width(head: list[str], rows: list[list]) -> str:
    """Rows as fixed-width text: the first column to the left, others to the right."""
    cells = [head, *([_plain(x) for x in r] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(head))]
    lines = ["  ".join(x.ljust(w) if not i else x.rjust(w) for i, (x, w) in enumerate(zip(r, widths, strict=True))) for r in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def _plain(x) -> str:
    return "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def comparison_text(results: DataFrame, nulls: tuple[str, ...] = NULLS, alpha: float = 0.05) -> str:
    """The comparison of one series: each statistic's real value, its mean in each null, and whether it survives or which null is hardest."""
    kept = compare.survivors(results, alpha).select("series_id", "statistic", "survives", "hardest_null")
    rows = compare.panel(results, nulls, alpha).join(kept, ["series_id", "statistic"]).collect()  # a row of each statistic
    return fixed_width(["statistic", "real", *nulls, "verdict"], [[r["statistic"], r["real"], *(r[f"{n}_mean"] for n in nulls), "survives" if r["survives"] else f"like {r['hardest_null']}"] for r in _in_order(rows)])


def p_value_text(results: DataFrame, nulls: tuple[str, ...] = NULLS) -> str:
    rows = compare.panel(results, nulls).collect()
    return fixed_width(["statistic", *(f"p {n}" for n in nulls)], [[r["statistic"], *(r[f"{n}_p"] for n in nulls)] for r in _in_order(rows)])


def _in_order(rows: list) -> list:
    place = {n: i for i, n in enumerate(stats.NAMES)}
    return sorted(rows, key=lambda r: (place.get(r["statistic"], len(place)), r["statistic"]))


def ledger_text(ledger: Ledger, spark: SparkSession) -> str:
    """How many trials are used, the bar of the next one, and each agent's trials."""
    trials = ledger.frame(spark)
    agents = budget.by_agent(trials).orderBy("agent").collect()
    numbered = trials.select("sharpe", "n_obs", F.col("trial_id").alias("trial_order"))
    bar = budget.with_bar(budget.sharpe_variance(numbered).withColumn("n_trials", F.col("n") + 1)).first()
    head = f"trials used: {bar['n']}\nbar of trial {bar['n'] + 1}: annualised Sharpe {bar['bar'] * budget.PERIODS**0.5:.2f}"
    return "\n".join([head, *(f"  {a['agent']}: {a['trials']} trials, {a['passed']} passed" for a in agents)])


def screener_text(rows: DataFrame) -> str:
    """Rows of full_screen, best Sharpe ratio first."""
    own = rows.orderBy(F.desc_nulls_last("sharpe"), "series_id").collect()
    head = ["symbol", "days", "return %", "vol %", "sharpe", "kurtosis", "persistence", "vol ratio", "verdict"]
    return fixed_width(head, [[r["series_id"], r["n_obs"], r["ann_return"] * 100, r["ann_vol"] * 100, r["sharpe"], r["excess_kurtosis"], r["garch"]["persistence"] if r["garch"] else None, r["vol_ratio"], "signal" if r["survives_all_nulls"] else "no signal"] for r in own])
