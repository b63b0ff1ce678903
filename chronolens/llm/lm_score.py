"""LM scoring by deleted interpolation.

A text's tokens are its words and one end.  The model mixes the bigram's
maximum-likelihood estimate with the unigram's (smoothed by half a count, so
nothing is impossible):

    p(w | u) = L[b] * c(u w) / c(u) + (1 - L[b]) * (c(w) + 0.5) / (N + 0.5 * (V + 1))

with one weight L for each bucket b of the context's frequency (by powers of
two).  Part of the training documents is held out of the counts, and the
weights are learned on its tokens by expectation-maximisation.  A token's
responsibility depends only on the ratio of the two estimates, so a histogram
of ratios by bucket, of bounded size, is all that the driver sees.  Scores then
use the counts of all training documents.

Counting and looking up are one exchange in each direction.  A task cuts its
documents into chunks of about ``CHUNK`` tokens and sends, to each part of the
hash space, the chunk's different n-grams with the chunk's own counts, as one
packed blob; the part adds up and answers with the totals in the same order.
An n-gram costs one entry for each chunk, however often it occurs; no table of
counts is broadcast or held whole anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.planes import pack, unpack
from chronolens.llm.scratch import Scratch
from chronolens.llm.text import U, hashed_words, mix, texts_of

CHUNK = 1_200_000
PART_BYTES = 8 << 20  # of the input, for each part of the hash space: what a part holds doesn't grow with the input
KEY_BITS = 56, 48  # of the hashes of single words and of pairs
FOLDS, TEST_FOLD, TUNING_FOLD = 5, 1, 2  # of crc32(id as text)
BUCKETS = 64
BINS, PER_OCTAVE = 512, 8
ROUNDS = 60
END = U(0x0E0D0E0D0E0D0E0D)
START = U(0x57A2757A2757A275)


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class Chunk:
    """Some documents: their tokens as numbers of the chunk's different words, the most frequent first."""

    def __init__(self, ids: list, lengths: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.ids, self.lengths, self.words, self.tokens = ids, lengths, words, tokens

    @classmethod
    def of(cls, ids: list, documents: list[np.ndarray]) -> Chunk:
        h = np.concatenate(documents)
        words, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return cls(ids, np.array([len(x) for x in documents], dtype=np.int64), words[order], place[inverse])

    def dump(self) -> bytes:
        mask = np.array([x is None for x in self.ids], dtype=np.uint8)
        ids = np.array([x or 0 for x in self.ids], dtype=np.int64)
        parts = [mask.tobytes(), ids.tobytes(), self.lengths.astype("<u4").tobytes(), self.words.tobytes(), pack(self.tokens.astype(U), 0, 4)]
        head = np.array([len(ids), len(self.words), len(self.tokens)], dtype="<u8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @classmethod
    def load(cls, blob: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, v, t = (int(x) for x in np.frombuffer(raw, dtype="<u8", count=3))
        at, out = 24, []
        for dtype, count in (("u1", n), ("<i8", n), ("<u4", n), ("<u8", v)):
            out.append(np.frombuffer(raw, dtype=dtype, count=count, offset=at))
            at += out[-1].nbytes
        mask, ids, lengths, words = out
        return cls([None if m else x for m, x in zip(mask, ids.tolist(), strict=True)], lengths.astype(np.int64), words, unpack(raw[at : at + 4 * t], 0, 4).astype(np.int64))

    def folds(self) -> np.ndarray:
        """Of each token."""
        return np.repeat(np.array([fold(x) for x in self.ids], dtype=np.int64), self.lengths)

    def keys(self, kind: int) -> np.ndarray:
        """Of each token: its word's hash (kind 0), or that of the pair with its predecessor or the start (1)."""
        h = self.words[self.tokens]
        if kind == 0:
            return h >> U(64 - KEY_BITS[0])
        before = np.concatenate(([START], h[:-1]))
        before[np.concatenate(([0], np.cumsum(self.lengths)[:-1]))] = START
        return mix(before * U(0x9E3779B97F4A7C15) + h) >> U(64 - KEY_BITS[1])


def counts_of(inverse: np.ndarray, folds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n kinds: occurrences in the counting folds, and in the tuning fold."""
    return np.bincount(inverse[(folds != TEST_FOLD) & (folds != TUNING_FOLD)], minlength=n), np.bincount(inverse[folds == TUNING_FOLD], minlength=n)


def rising(x: np.ndarray) -> bytes:
    """Sorted keys as packed differences."""
    return zstandard.ZstdCompressor(level=1).compress(pack(np.diff(x, prepend=U(0)), 0, 7))


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(zstandard.ZstdDecompressor().decompress(blob), 0, 7), dtype=U)


def small(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(x.astype(U), 0, 6))


def large(blob: bytes) -> np.ndarray:
    return unpack(zstandard.ZstdDecompressor().decompress(blob), 0, 6).astype(np.int64)


ROWS = "p int, chunk long, keys binary, main binary, tuning binary, body binary"
NAMES = ["p", "chunk", "keys", "main", "tuning", "body"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=NAMES)


def _ask(parts: int):
    """Each chunk's body, and its n-grams by part: single words go to parts 0.., pairs to parts from ``parts`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        documents: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if not ids:
                return
            chunk = Chunk.of(ids, documents)
            name = (task << 24) + made
            made += 1
            yield _rows([(name % parts, name, None, None, None, chunk.dump())])
            folds = chunk.folds()
            for kind in (0, 1):
                keys, inverse = np.unique(chunk.keys(kind), return_inverse=True)
                main, tuning = counts_of(inverse, folds, len(keys))
                cuts = np.searchsorted(keys >> U(KEY_BITS[kind] - 32), (np.arange(parts + 1) << 32) // parts)
                cuts[-1] = len(keys)
                rows = [(kind * parts + i, name, rising(keys[a:b]), small(main[a:b]), small(tuning[a:b]), None) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                for a in range(0, len(rows), 128):
                    yield _rows(rows[a : a + 128])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, last, h, at in hashed_words(texts_of(batch.column(1))):
                for row in range(first, last):
                    documents.append(np.append(h[at[row - first] : at[row - first + 1]], END))
                    ids.append(own[row])
                    size += len(documents[-1])
                    if size >= CHUNK:
                        yield from flush()
                        ids, documents, size = [], [], 0
        yield from flush()

    return run


ANSWERS = "chunk long, p int, main binary, tuning binary, body binary, n_main long, n_tuning long, v_main long, v long"


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one part's n-grams, to each chunk that asked; and the part's sums."""
    rows, asked = [], []
    for p, chunk, keys, main, tuning, body in zip(*(table.column(x).to_pylist() for x in NAMES), strict=True):
        if body is not None:
            rows.append((chunk, -1, None, None, body, 0, 0, 0, 0))
        else:
            asked.append((chunk, p, risen(keys), large(main), large(tuning)))
    if asked:
        keys, inverse = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        totals = []
        for i in (3, 4):
            total = np.zeros(len(keys), dtype=np.int64)
            np.add.at(total, inverse, np.concatenate([x[i] for x in asked]))
            totals.append(total)
        main, tuning = totals
        sums = (int(main.sum()), int(tuning.sum()), int(np.count_nonzero(main)), int(np.count_nonzero(main + tuning)))
        at = 0
        for chunk, p, own, _, _ in asked:
            back = inverse[at : at + len(own)]
            at += len(own)
            rows.append((chunk, p, small(main[back]), small(tuning[back]), None, *sums))
            sums = (0, 0, 0, 0)
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 4]
    columns = list(zip(*rows, strict=True))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "p", "main", "tuning", "body", "n_main", "n_tuning", "v_main", "v"])


def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), 0)


class Looked:
    """A chunk with the totals of its n-grams; all arrays are by token."""

    def __init__(self, table: pa.Table, parts: int):
        answers = []
        for p, main, tuning, body in zip(*(table.column(x).to_pylist() for x in ("p", "main", "tuning", "body")), strict=True):
            if body is not None:
                self.chunk = Chunk.load(body)
            else:
                answers.append((p, large(main), large(tuning)))
        answers.sort(key=lambda x: x[0])
        chunk = self.chunk
        self.folds = chunk.folds()
        first = np.zeros(len(chunk.tokens), dtype=bool)
        first[np.concatenate(([0], np.cumsum(chunk.lengths)[:-1]))] = True
        by_kind = []
        for kind in (0, 1):
            _, inverse = np.unique(chunk.keys(kind), return_inverse=True)
            own = [x for x in answers if (x[0] >= parts) == bool(kind)]
            by_kind.append([np.concatenate([x[i] for x in own])[inverse] for i in (1, 2)])
        (self.w_main, self.w_tuning), (self.uw_main, self.uw_tuning) = by_kind
        # a context's count is its word's; the start's is that of the end
        end = np.concatenate((np.flatnonzero(chunk.words[chunk.tokens] == END), [0]))[0]
        before = lambda x: np.where(first, x[end], np.concatenate(([0], x[:-1])))
        self.u_main, self.u_tuning = before(self.w_main), before(self.w_tuning)


def _ratios(parts: int, n: int, v: int):
    """Histogram of the ratios of the estimates, for the tuning fold's tokens."""

    def run(table: pa.Table) -> pa.Table:
        x = Looked(table, parts)
        own = x.folds == TUNING_FOLD
        u, uw, w = x.u_main[own], x.uw_main[own], x.w_main[own]
        ratio = np.where(u > 0, uw / np.maximum(u, 1), 0) / ((w + 0.5) / (n + 0.5 * (v + 1)))
        slot = np.where(ratio > 0, np.clip(np.floor(np.log2(np.where(ratio > 0, ratio, 1)) * PER_OCTAVE) + BINS // 2, 1, BINS - 1), 0).astype(np.int64)
        key = bucket_of(u) * BINS + slot
        count, total = np.bincount(key, minlength=BUCKETS * BINS), np.bincount(key, weights=ratio, minlength=BUCKETS * BINS)
        full = np.flatnonzero(count)
        return pa.table([pa.array(full // BINS), pa.array(full % BINS), pa.array(count[full]), pa.array(total[full].astype(float))], names=["bucket", "slot", "n", "ratio"])

    return run


def weights(rows: list[tuple[int, int, float]]) -> np.ndarray:
    """Mixture weight of the bigram by bucket, from (bucket, count, mean ratio), by expectation-maximisation."""
    out = np.zeros(BUCKETS)
    for bucket in {r[0] for r in rows} - {0}:
        n = np.array([r[1] for r in rows if r[0] == bucket], dtype=float)
        ratio = np.array([r[2] for r in rows if r[0] == bucket])
        weight = 0.5
        for _ in range(ROUNDS):
            weight = float(np.sum(n * weight * ratio / (weight * ratio + 1 - weight)) / n.sum())
        out[bucket] = min(weight, 1 - 1e-6)
    return out


SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(parts: int, n: int, v: int, mixture: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        x = Looked(table, parts)
        w, u, uw = x.w_main + x.w_tuning, x.u_main + x.u_tuning, x.uw_main + x.uw_tuning
        one = (w + 0.5) / (n + 0.5 * (v + 1))
        own = mixture[bucket_of(u)]
        both = own * (uw / np.maximum(u, 1)) + (1 - own) * one
        at = np.concatenate(([0], np.cumsum(x.chunk.lengths)[:-1]))
        sums = [np.add.reduceat(a, at) for a in ((w > 0).astype(np.int64), np.log10(one), np.log10(both))]
        held = [fold(i) == TEST_FOLD for i in x.chunk.ids]
        columns = [pa.array(x.chunk.ids, pa.int64()), pa.array(held), pa.array(x.chunk.lengths), pa.array(sums[0]), pa.array(np.full(len(held), n)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def input_bytes(docs: DataFrame) -> int:
    """What the planner knows of the size of docs; 0 where it knows nothing."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose fold isn't TEST_FOLD.  A null or empty text
    has the end token only; a null id is in fold 0.  Rows that repeat are
    counted and scored as often.  Other columns, of any name, are not read.  No
    rows give no rows; with no training documents, all counts are 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(input_bytes(docs) // PART_BYTES, 1 << 20))
    asked = source.mapInArrow(_ask(parts), ROWS)
    answers = scratch.write(asked.groupBy("p").applyInArrow(_answer, ANSWERS))
    del asked
    scratch.free_shuffles()
    sums = answers.where((F.col("p") >= 0) & (F.col("p") < parts)).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_main", "n_tuning", "v_main", "v"))).first()
    n_main, n_tuning, v_main, v = (int(x) for x in sums)
    by_chunk = answers.select("chunk", "p", "main", "tuning", "body").groupBy("chunk")
    ratios = by_chunk.applyInArrow(_ratios(parts, n_main, v_main), "bucket long, slot long, n long, ratio double")
    histogram = ratios.groupBy("bucket", "slot").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio")).orderBy("bucket", "slot").collect()  # at most BUCKETS * BINS rows
    mixture = weights([(r["bucket"], r["n"], r["ratio"] / r["n"]) for r in histogram])
    del ratios
    scratch.free_shuffles()
    out = by_chunk.applyInArrow(_score(parts, n_main + n_tuning, v, mixture), SCORES)
    return out.withColumnRenamed("id", id_col)
