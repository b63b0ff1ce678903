"""Benchmark decontamination by an FM-index of each training shard.

The benchmark's windows (ten consecutive words; an item of fewer words is one
window) are the phrases.  A shard is a few megabytes of whole documents.  Its
words that no phrase has become gaps; the runs between gaps that are long
enough for the shortest phrase make the indexed text.  All phrases are searched
backward at once, occurrences are located, and their word spans merged.

Phrases are made and gathered into blocks of about ``BLOCK`` windows by the
tasks; the driver passes on one block after the other, never the benchmark's
texts.  A round searches at most ``ROUND`` blocks, each one broadcast of bounded
size.  A benchmark of one round, which is the usual case, needs no shuffle of
documents; of a larger one every round writes the spans it finds, and these
meet their documents afterwards.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.fm_index import FMIndex
from chronolens.llm.scratch import Scratch
from chronolens.llm.text import ALNUM, U, hashed_words, texts_of, word_spans

WINDOW = 10
BLOCK = 250_000
ROUND = 8
SHARD = 1 << 19


def windows_of(text: bytes, window: int) -> Iterator[bytes]:
    """Hashes of the words of each window of an item; of a shorter item, all of its words."""
    parts = [h for _, _, h, _ in hashed_words([text], ALNUM)]
    h = np.concatenate(parts) if parts else np.zeros(0, dtype=U)
    for i in range(max(1, len(h) - window + 1) if len(h) else 0):
        yield h[i : i + window].tobytes()


class Phrases:
    """One block of the benchmark: its vocabulary, its different windows, and the items of each window."""

    def __init__(self, found: dict[bytes, set], window: int):
        """found: the items of each window, whose key is its words' hashes."""
        windows = sorted(found)
        words = [np.frombuffer(w, dtype=U) for w in windows]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, dtype=U)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.patterns = np.zeros((len(words), window), dtype=np.int64)
        for i, w in enumerate(words):
            self.patterns[i, : len(w)] = np.searchsorted(self.vocabulary, w) + 1
        self.items = [sorted(x for x in found[w] if x is not None) for w in windows]

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], window: int) -> Phrases:
        found: dict[bytes, set] = {}
        for item, text in items:
            for w in windows_of(text, window):
                found.setdefault(w, set()).add(item)
        return cls(found, window)

    def dump(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((self.vocabulary, self.lengths, self.patterns.astype(np.int32), self.items)))

    @classmethod
    def load(cls, blob: bytes) -> Phrases:
        out = cls({}, 0)
        out.vocabulary, out.lengths, patterns, out.items = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        out.patterns = patterns.astype(np.int64)
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that no phrase has."""
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def shards(self, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexed texts, with the word number of each symbol (-1 for gaps)."""
        known = ids > 0
        new = np.zeros(len(ids) + 1, dtype=bool)
        new[at] = True  # a document begins
        starts = np.flatnonzero(known & (new[:-1] | np.concatenate(([True], ~known[:-1]))))
        ends = np.flatnonzero(known & (new[1:] | np.concatenate((~known[1:], [True])))) + 1
        shortest, longest = int(self.lengths.min()), int(self.lengths.max())
        enough = ends - starts >= shortest
        part: list[np.ndarray] = []
        size = 0
        for a, b in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            while a < b:
                end = min(b, a + SHARD)
                part.append(np.arange(a, end))
                part.append(np.array([-1]))
                size += end - a + 1
                a = b if end == b else end - longest + 1
                if size >= SHARD:
                    where = np.concatenate(part)
                    yield np.where(where < 0, 0, ids[where]), where
                    part, size = [], 0
        if part:
            where = np.concatenate(part)
            yield np.where(where < 0, 0, ids[where]), where

    def occurrences(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word number and phrase of every occurrence in a group of documents."""
        firsts, which = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if len(h) and len(self.lengths):
            for symbols, where in self.shards(self.ids(h), at):
                index = FMIndex(symbols, len(self.vocabulary))
                phrase, low, high = index.search(self.patterns, self.lengths)
                if len(phrase):
                    n = high - low
                    rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    firsts.append(where[index.locate(rows)])
                    which.append(np.repeat(phrase, n))
        return np.concatenate(firsts), np.concatenate(which)


def _windows(blocks: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                own = sorted(set(windows_of(text, window)))
                for a in range(0, len(own), 50_000):
                    part = own[a : a + 50_000]
                    where = [int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") % blocks for w in part]
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], names=["block", "words", "item"])

    return run


def _gather(window: int):
    def run(table: pa.Table) -> pa.Table:
        found: dict[bytes, set] = {}
        for words, item in zip(table.column("words").to_pylist(), table.column("item").to_pylist(), strict=True):
            found.setdefault(words, set()).add(item)
        return pa.table([table.column("block")[:1], pa.array([Phrases(found, window).dump()], pa.binary())], names=["block", "phrases"])

    return run


def phrase_rounds(benchmark: DataFrame, scratch: Scratch, item_col: str, text_col: str, window: int, block: int = BLOCK) -> list[DataFrame]:
    """The benchmark's blocks (block, phrases), ROUND of them in each table; none for a benchmark without words."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.floor(F.octet_length("text") / 4) + 1), F.lit(0))).first()[0]  # no fewer than the windows, but for very short words
    blocks = max(1, -(-size // block))
    made = scratch.write(rows.mapInArrow(_windows(blocks, window), "block int, words binary, item string").groupBy("block").applyInArrow(_gather(window), "block int, phrases binary"))
    return [made.where((F.col("block") >= a) & (F.col("block") < a + ROUND)) for a in range(0, blocks, ROUND)]


def broadcasts(blocks: DataFrame) -> list:
    """Each of at most ROUND blocks as a broadcast; the driver holds one at a time."""
    return [blocks.sparkSession.sparkContext.broadcast(bytes(r["phrases"])) for r in blocks.select("phrases").toLocalIterator()]


NOTHING = hashlib.sha256(b"").hexdigest()


def _occurrences(blocks: list[Phrases], h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, list]]]]:
    """For each block: first words and lengths of the occurrences in a group of documents, and the items of its documents."""
    for phrases in blocks:
        starts, which = phrases.occurrences(h, at)
        rows = np.searchsorted(at, starts, side="right") - 1
        pairs = np.unique(np.stack((rows, which), axis=1), axis=0).tolist()
        yield starts, phrases.lengths[which], [(row, phrases.items[phrase]) for row, phrase in pairs]


def _cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words are inside a span."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + lengths, -1)
    return np.cumsum(cover[:-1]) > 0


def _scan(blocks: list[Phrases], texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[int, set]]]:
    """For groups of rows: first, last, hit flags of all words, offsets of the rows' words, items by row."""
    for first, last, h, at in hashed_words(texts, ALNUM):
        hit = np.zeros(len(h), dtype=bool)
        items: dict[int, set] = {}
        for starts, lengths, found in _occurrences(blocks, h, at):
            hit |= _cover(len(h), starts, lengths)
            for row, own in found:
                items.setdefault(first + row, set()).update(own)
        yield first, last, hit, at, items


def _spans(blobs: list):
    """Rows (key, starts, lengths, items) of the documents that a round's blocks hit, from (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Phrases.load(b.value) for b in blobs]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: dict[int, list] = {}
            for first, _, h, at in hashed_words(texts_of(batch.column(1)), ALNUM):
                for starts, lengths, found in _occurrences(blocks, h, at):
                    rows = np.searchsorted(at, starts, side="right") - 1
                    for row in np.unique(rows).tolist():
                        own = rows == row
                        old = out.setdefault(first + row, [[], [], set()])
                        old[0] += (starts[own] - at[row]).tolist()
                        old[1] += lengths[own].tolist()
                    for row, items in found:
                        out[first + row][2].update(items)
            rows = sorted(out.items())
            columns = [[keys[i] for i, _ in rows], *([x[j] for _, x in rows] for j in range(2)), [sorted(x[2]) for _, x in rows]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "starts", "lengths", "items"])

    return run


def _given(texts: list[bytes], starts: list, lengths: list, items: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[int, set]]]:
    """As _scan, from spans that were found before."""
    for first, last, h, at in hashed_words(texts, ALNUM):
        hit = np.zeros(len(h), dtype=bool)
        own: dict[int, set] = {}
        for row in range(first, last):
            if starts[row]:
                a, b = int(at[row - first]), int(at[row - first + 1])
                hit[a:b] = _cover(b - a, np.array(starts[row], dtype=np.int64), np.array(lengths[row], dtype=np.int64))
                own[row] = set(items[row])
        yield first, last, hit, at, own


def _searched(docs: DataFrame, text_at: int, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, use, schema, block: int) -> DataFrame:
    """docs through use(batch, scans), where scans are those of its texts; columns of docs go by number."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rounds = phrase_rounds(benchmark, scratch, item_col, item_text_col, window, block)
    if len(rounds) == 1:
        blobs = broadcasts(rounds[0])

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [Phrases.load(b.value) for b in blobs]
            for batch in batches:
                texts = texts_of(batch.column(text_at))
                yield use(batch, texts, _scan(blocks, texts))

        return docs.mapInArrow(once, schema)
    keyed = scratch.write(docs.withColumn("key", F.monotonically_increasing_id()))
    found = None
    for blocks in rounds:
        blobs = broadcasts(blocks)
        part = scratch.write(keyed.select("key", docs.columns[text_at]).mapInArrow(_spans(blobs), "key long, starts array<long>, lengths array<long>, items array<string>"))
        for b in blobs:
            b.destroy()
        found = part if found is None else found.unionAll(part)
    each = found.groupBy("key").agg(F.collect_list(F.struct("starts", "lengths", "items")).alias("r"))  # one of each round
    part = lambda c: F.flatten(F.transform("r", lambda x: x[c])).alias(c)
    merged = each.select("key", part("starts"), part("lengths"), part("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text_at))
            starts, lengths, items = (c.to_pylist() for c in batch.columns[-3:])
            own = batch.select(list(range(batch.num_columns - 3)))
            yield use(own, texts, _given(texts, starts, lengths, items))

    return keyed.join(merged, "key", "left").select(*docs.columns, "starts", "lengths", "items").mapInArrow(merge, schema)


def _report(batch: pa.RecordBatch, texts: list[bytes], scans) -> pa.RecordBatch:
    words, hits, counts, digests = [], [], [], []
    for first, last, hit, at, items in scans:
        sums = np.concatenate(([0], np.cumsum(hit)))
        words += np.diff(at).tolist()
        hits += (sums[at[1:]] - sums[at[:-1]]).tolist()
        for row in range(first, last):
            own = sorted(items.get(row, ()))
            counts.append(len(own))
            digests.append(hashlib.sha256(",".join(own).encode()).hexdigest() if own else NOTHING)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["id", "n_words", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; a benchmark that is empty
    or has no words hits nothing.  Items with a null id mark words as hit but
    aren't counted; items with equal ids count once.  Rows that repeat are
    reported as often; other columns, of any name, are not read; no rows give
    no rows.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = _searched(source, 1, benchmark, item_col, item_text_col, window, _report, "id long, n_words long, n_hit long, n_items long, items_sha256 string", block)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def without_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words and what stands between the words of a run."""
    starts, ends = word_spans(np.frombuffer(text.lower(), dtype=np.uint8), ALNUM)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def _clean(position: int):
    def use(batch: pa.RecordBatch, texts: list[bytes], scans) -> pa.RecordBatch:
        fresh: dict[int, bytes] = {}
        gone: set[int] = set()
        for first, last, hit, at, _ in scans:
            for row in range(first, last):
                own = hit[at[row - first] : at[row - first + 1]]
                if own.all() and len(own):
                    gone.add(row)
                elif own.any():
                    fresh[row] = without_spans(texts[row], own)
        if fresh or gone:
            column = batch.column(position).to_pylist()
            for row, text in fresh.items():
                column[row] = text.decode()
            batch = pa.RecordBatch.from_arrays([pa.array(column, x.type) if i == position else x for i, x in enumerate(batch.columns)], schema=batch.schema)
            if gone:
                batch = batch.filter(pa.array([i not in gone for i in range(len(column))]))
        return batch

    return use


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with the spans of benchmark windows cut out of their texts.

    Documents that consist of hit words only are left out; all others stay,
    unchanged if nothing is hit (null texts too), with all their columns,
    whatever their names.  Rows that repeat are treated alike.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    return _searched(inner, at, benchmark, item_col, item_text_col, window, _clean(at), inner.schema, block).toDF(*names)
