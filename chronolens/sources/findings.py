"""Findings: what a run found, one JSON document for each kind and day, written again on the same day."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.sources.lake import Lake

FOLDER = "findings"


def write(lake: Lake, kind: str, key: str, rows: DataFrame, day: date | None = None, **more) -> str:
    """Writes {run_at, more..., key: [rows]}; returns its path. rows are a few of each series, and go through the driver as JSON."""
    found = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    path = f"{lake.root}/{FOLDER}/{kind}-{(day or date.today()).isoformat()}.json"
    lake.put(path, json.dumps({"run_at": datetime.now(UTC).isoformat(), **more, key: found}, indent=1))
    return path


def newest(lake: Lake, kind: str) -> dict | None:
    """The document of a kind whose name is last; None if there is none."""
    folder = lake._path(f"{lake.root}/{FOLDER}")
    if not lake._fs.exists(folder):
        return None
    names = sorted(n for s in lake._fs.listStatus(folder) if (n := s.getPath().getName()).startswith(f"{kind}-") and n.endswith(".json"))
    if not names:
        return None
    return json.loads("\n".join(r[0] for r in lake.spark.read.text(f"{lake.root}/{FOLDER}/{names[-1]}", wholetext=True).collect()))
