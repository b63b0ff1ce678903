"""Line dedup by overlapping three-line windows.

Lines without a word are passed over.  Every three consecutive lines of a
document make a window; a window whose lines are found at an earlier place, in
the order of (id, line number), is a later occurrence, and its three lines are
covered.  Covered lines are removed; overlapping windows merge by that.

Only hashes and positions move for the search: one row for each window, reduced
in the tasks to the first place and the count of each hash.  A window that a
third of all documents hold is one row for each task.  Joining the repeated
hashes back to the windows is an ordinary join, whose hot keys Spark splits.
Texts are dealt once by id, to meet their covered lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolens.llm.scratch import Scratch
from chronolens.llm.text import SPACES, U, byte_table, hashed_words, mix, texts_of

WIDTH = 3
LINE = byte_table(b"\n", inside=False)
_WORDS = byte_table(SPACES + b"\n", inside=False)


def lines_of(text: bytes) -> list[bytes]:
    """Lines with the white space at their ends taken off; those without a word are empty."""
    return [x.strip(SPACES) for x in text.split(b"\n")]


def line_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and hashes of the lines that have a word."""
    lines = lines_of(text)
    number = np.array([i for i, x in enumerate(lines) if x], dtype=np.int64)
    full = [x for x in lines if x]
    parts = [h for _, _, h, _ in hashed_words([b"\n".join(full)], LINE, lower=False)]
    return number, np.concatenate(parts) if parts else np.zeros(0, dtype=U)


def window_hashes(h: np.ndarray) -> np.ndarray:
    n = len(h) - WIDTH + 1
    out = np.zeros(max(n, 0), dtype=U)
    for i in range(WIDTH if n > 0 else 0):
        out = mix(out + h[i : i + n] + U(i + 1))
    return out


def fingerprint(text: bytes) -> int:
    """Tells rows of one id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, rows, places = [], [], []
        texts = texts_of(batch.column(1))
        marks = np.array([fingerprint(x) for x in texts], dtype=np.int64)
        for row, text in enumerate(texts):
            if text.count(b"\n") >= WIDTH - 1:
                w = window_hashes(line_hashes(text)[1])
                hashes.append(w)
                rows.append(np.full(len(w), row))
                places.append(np.arange(len(w)))
        if hashes and sum(map(len, hashes)):
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(at), pa.array(marks).take(at), pa.array(np.concatenate(places))], names=["h", "id", "mark", "place"])


def covered_lines(text: bytes, places: list[int]) -> np.ndarray:
    """Numbers of the lines under the windows that begin at these full lines."""
    number, _ = line_hashes(text)
    cover = np.zeros(len(number) + 1, dtype=np.int64)
    at = np.array(places, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WIDTH, -1)
    return number[np.cumsum(cover[:-1]) > 0]


def _cut(text_at: int, names: list[str]):
    """Rewrites the texts of the last column's places; adds n_lines and n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = texts_of(batch.column(text_at)), batch.column(batch.num_columns - 1).to_pylist()
            fresh = batch.column(text_at).to_pylist()
            lines, removed = [], []
            for row, text in enumerate(texts):
                lines.append(sum(1 for x in text.split(b"\n") if x.strip(SPACES)))
                removed.append(0)
                if places[row]:
                    out = covered_lines(text, places[row])
                    removed[-1] = len(out)
                    gone = set(out.tolist())
                    fresh[row] = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone).decode()
            columns = [pa.array(fresh, x.type) if i == text_at else x for i, x in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=names)

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array(np.array([fingerprint(x) for x in texts_of(batch.column(0))], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], marks], names=[*batch.schema.names[1:], "__mark"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with their repeated lines removed, and n_lines (lines with a word) and n_removed as ``__n_lines`` and ``__n_removed``.

    Columns of docs that have one of these two names are replaced; no other
    name clashes with anything here.

    Null, empty and short texts (under three full lines) stay as they are.
    Rows equal in id and text are one place: what one keeps, all keep.  Rows
    of one id with other texts come in the order of a hash of the text; a null
    id comes first.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    windows = scratch.write(source.mapInArrow(_windows, "h long, id long, mark long, place long"))
    place = F.struct("id", "mark", "place")
    first = windows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    later = windows.join(first, "h").where(~place.eqNullSafe(F.col("first"))).select("id", "mark", "place")
    spots = later.groupBy(F.col("id").alias("__spot_id"), F.col("mark").alias("__spot_mark")).agg(F.collect_set("place").alias("__places"))
    docs = docs.drop("__n_lines", "__n_removed")
    # columns go by number, so that none of theirs has a name of ours
    names = [*docs.columns, "__n_lines", "__n_removed"]
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    named = list(inner.columns)
    marked = inner.select(F.col(f"c{text_at}").cast("string").alias("text"), *named).mapInArrow(_mark, _plus(inner.schema, "__mark long"))
    met = marked.join(spots, marked[f"c{id_at}"].cast("long").eqNullSafe(spots["__spot_id"]) & (marked["__mark"] == spots["__spot_mark"]), "left").select(*named, "__mark", "__places")
    return met.mapInArrow(_cut(text_at, [*named, "__n_lines", "__n_removed"]), _plus(inner.schema, "__n_lines long, __n_removed long")).toDF(*names)


def _plus(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])
