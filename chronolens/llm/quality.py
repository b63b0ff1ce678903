"""Quality rules by distribution divergence.

Two histograms of a document, of its character classes and of its language's
common words, are held against the language's reference by the Jensen-Shannon
distance (base 2, so 0 to 1).  The references are the corpus's own, gathered
over all documents of a language.  Guards: a histogram is judged only when the
document and the reference have enough in it.

Texts are read once: each gives a row of a few dozen counts, and references,
distances and verdicts follow from these rows.  Sums are combined in the tasks
before they move; references stay a table, joined by language, so their number
has no limit and Spark broadcasts them only as far as their size allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.scratch import Scratch
from chronolens.llm.text import SPACES, U, WORD, hashed_words, mix, span_hashes, texts_of, word_spans

# Function words of the languages that are judged by words.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with be by are this from",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}
# Character classes.
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "symbol", "punctuation", "other")

MIN_WORDS = 50  # base rule, and guard of the word histogram
MIN_CHARS = 200  # guard of the character histogram
MIN_REFERENCE = 10_000  # counts that a reference needs to be used
TRIM = 0.2  # documents this far from the first reference have no part in the second
CHAR_DISTANCE = 0.15, 1.5  # a document of n characters may be at 0.15 + 1.5 / sqrt(n): short ones vary more
WORD_DISTANCE = 0.4, 2.0  # likewise, of n words

_CLASS = np.full(128, 4, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(SYMBOLS)] = 3
_CLASS[list(SPACES)] = 6  # outside words: not counted


@cache
def _classes_beyond() -> np.ndarray:
    """The class of every code point: beyond ASCII, letters and marks are "other", numbers are digits, all else is punctuation."""
    kinds = {"L": 5, "M": 5, "N": 2}
    out = np.fromiter((kinds.get(category(chr(c))[0], 4) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[:128] = _CLASS
    return out


def class_counts(text: bytes) -> np.ndarray:
    """Code points of a text's words by class."""
    if text.isascii():
        return np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7)[:6]
    out = np.zeros(7, dtype=np.int64)
    whole = text.decode("utf-8", "replace")
    for a in range(0, len(whole), 1 << 20):
        out += np.bincount(_classes_beyond()[np.frombuffer(whole[a : a + (1 << 20)].encode("utf-32-le"), dtype="<u4")], minlength=7)
    return out[:6]


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def word_tables(words: dict[str, str]) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """By language: sorted hashes of its common words as written in lower case, capitals, or with a first capital; the slot of each; slots."""
    out = {}
    for lang, text in words.items():
        slots = {form.encode(): i for i, w in enumerate(text.split()) for form in (w.title(), w.upper(), w)}
        buf = np.frombuffer(b" ".join(slots), dtype=np.uint8)
        h = span_hashes(buf, *word_spans(buf, WORD))
        order = np.argsort(h)
        out[lang] = h[order], np.array(list(slots.values()))[order], len(text.split())
    return out


def word_histogram(h: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Counts of the common words, and of all others last."""
    hashes, slots, n = table
    at = np.searchsorted(hashes, h)
    at[at == len(hashes)] = 0
    out = np.bincount(slots[at[hashes[at] == h]], minlength=n + 1)
    out[n] = len(h) - int(out.sum())
    return out


def windows(h: np.ndarray, width: int = 3) -> np.ndarray:
    """Hashes of the windows of width words that begin at each word of a group of texts."""
    n = len(h) - width + 1
    w = np.zeros(max(n, 0), dtype=U)
    for i in range(width if n > 0 else 0):
        w += mix(h[i : i + n] + U(i + 1)) * U(2 * i + 3)
    return w


def repeated(w: np.ndarray, width: int = 3) -> int:
    """Words inside windows that are found twice or more, from the windows of one text."""
    s = np.sort(w)
    if not (s[1:] == s[:-1]).any():
        return 0
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(w), dtype=bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    cover = np.zeros(len(w) + width, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int(np.count_nonzero(np.cumsum(cover)))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def profile(texts: list[bytes], langs: list, tables: dict) -> tuple[np.ndarray, np.ndarray, list]:
    """For each text: the base counts, its character classes, and the histogram of its language's common words (None without a table)."""
    counts = np.zeros((len(texts), 5), dtype=np.int64)
    classes = np.zeros((len(texts), 6), dtype=np.int64)
    common: list = [None] * len(texts)
    for first, last, h, at in hashed_words(texts, WORD, lower=False):
        w = windows(h)
        for row in range(first, last):
            a, b = int(at[row - first]), int(at[row - first + 1])
            classes[row] = class_counts(texts[row])
            if langs[row] in tables:
                common[row] = word_histogram(h[a:b], tables[langs[row]])
            counts[row] = b - a, 0, 0, duplicate_lines(texts[row]), repeated(w[a : b - 2]) if b - a > 3 else 0
    counts[:, 1], counts[:, 2] = classes.sum(axis=1), classes[:, 3]
    return counts, classes, common


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the counts q; 0 for rows without counts."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(q / q.sum(), p.shape)
    m = (p + q) / 2
    part = lambda x: np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0), axis=1)
    return np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))


def limit(x: tuple[float, float], n: np.ndarray) -> np.ndarray:
    return x[0] + x[1] / np.sqrt(np.maximum(n, 1))


PROFILE = f"id long, lang string, {STATS}, classes array<long>, common array<long>"
_KINDS = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]


def _table(ids: pa.Array, langs: list, texts: list[bytes], tables: dict) -> pa.RecordBatch:
    counts, classes, common = profile(texts, langs, tables)
    columns = [ids, langs, *(counts[:, i].copy() for i in range(5)), classes.tolist(), [None if x is None else x.tolist() for x in common]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in PROFILE.split(", ")])


def _profiles(words: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = word_tables(words)
        for batch in batches:
            yield _table(batch.column(0), batch.column(1).to_pylist(), texts_of(batch.column(2)), tables)

    return run


def profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str, words: dict[str, str]) -> DataFrame:
    """One row of counts for each row of docs."""
    columns = [F.col(f"`{c}`").cast(t).alias(n) for c, t, n in ((id_col, "long", "id"), (lang_col, "string", "lang"), (text_col, "string", "text"))]
    return docs.select(*columns).mapInArrow(_profiles(words), PROFILE)


def _summed(rows: DataFrame, words: dict[str, str]) -> DataFrame:
    """By language, the summed histograms; null where there is too little in one."""
    slots = max((len(x.split()) + 1 for x in words.values()), default=0)
    sums = rows.groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))], *[F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(slots)])
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    enough = lambda x: F.when(total(x) >= MIN_REFERENCE, x)
    chars = F.array(*[F.coalesce(f"c{i}", F.lit(0).cast("long")) for i in range(len(CLASSES))])
    common = F.filter(F.array(*[F.col(f"w{i}") for i in range(slots)]), lambda x: x.isNotNull()) if slots else F.array().cast("array<long>")
    return sums.select("lang", enough(chars).alias("ref_chars"), enough(common).alias("ref_words")).where("ref_chars IS NOT NULL OR ref_words IS NOT NULL")


def _joined(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows with their language's references; a null language has its own."""
    refs = refs.withColumnRenamed("lang", "ref_lang")
    return rows.join(refs, rows["lang"].eqNullSafe(refs["ref_lang"]), "left").drop("ref_lang")


def _by_reference(counts: pa.Array, refs: pa.Array, judged: np.ndarray) -> np.ndarray:
    """Distance of each row's counts to its reference; NaN where a guard forbids judging or there is none."""
    out = np.full(len(counts), np.nan)
    groups: dict[tuple, list[int]] = {}
    own, wanted = counts.to_pylist(), refs.to_pylist()
    for i in np.flatnonzero(judged).tolist():
        if wanted[i] is not None and own[i] is not None:
            groups.setdefault(tuple(wanted[i]), []).append(i)
    for ref, rows in groups.items():
        out[rows] = distances(np.array([own[i] for i in rows], dtype=float), np.array(ref, dtype=float))
    return out


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose characters aren't far from the reference."""
    for batch in batches:
        sums = np.array([sum(x) for x in batch.column("classes").to_pylist()])
        far = _by_reference(batch.column("classes"), batch.column("ref_chars"), sums >= MIN_CHARS) > TRIM
        yield batch.select(["lang", "classes", "common"]).filter(pa.array(~far))


def references(rows: DataFrame, scratch: Scratch, words: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """By language, from rows of counts: ref_chars (one count for each class) and ref_words (common words, then the rest).

    First over all rows, then again over those whose characters are within
    TRIM of the first, so that junk doesn't blur the reference.  A histogram of
    fewer than MIN_REFERENCE counts is no reference.
    """
    first = scratch.write(_summed(rows, words))
    near = _joined(rows.select("lang", "classes", "common"), first).mapInArrow(_inside, "lang string, classes array<long>, common array<long>")
    return scratch.write(_summed(near, words))


NAMES = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
RULES = f"id long, {STATS}, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Verdicts on rows of counts with their references."""
    n_words, repeats = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
    sums = np.array([sum(x) for x in batch.column("classes").to_pylist()], dtype=np.int64)
    chars = _by_reference(batch.column("classes"), batch.column("ref_chars"), sums >= MIN_CHARS)
    vocabulary = _by_reference(batch.column("common"), batch.column("ref_words"), n_words >= MIN_WORDS)
    failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
    kept = ~failed & ~(chars > limit(CHAR_DISTANCE, sums)) & ~(vocabulary > limit(WORD_DISTANCE, n_words))
    columns = [batch.column(c) for c in ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(kept), *(pa.array(x, mask=np.isnan(x)) for x in (chars, vocabulary))], names=NAMES)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from map(judged, batches)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """One row for each row of docs: id, the base counts, base_failed, kept, and the two distances (null where a guard forbids judging).

    Null and empty texts have no words, so they fail the base rule.  A null or
    unknown language is judged by what reference it has: its own characters if
    the corpus has MIN_REFERENCE of them, else by the base rule alone.  Rows
    that repeat are judged, and counted in the references, as often.  Other
    columns, of any name, are not read; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(profiles(docs, id_col, text_col, lang_col, words))
    return _joined(rows, references(rows, scratch, words)).mapInArrow(_judge, RULES).withColumnRenamed("id", id_col)


def _filter(words: dict[str, str], text_at: int, lang_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = word_tables(words)
        for batch in batches:
            n = batch.num_columns - 3  # lang, ref_chars, ref_words
            rows = _table(pa.nulls(batch.num_rows, pa.int64()), batch.column(lang_at).cast(pa.string()).to_pylist(), texts_of(batch.column(text_at)), tables)
            found = judged(pa.RecordBatch.from_arrays([*rows.columns, *batch.columns[n + 1 :]], names=[*rows.schema.names, "ref_chars", "ref_words"]))
            yield batch.select(list(range(n))).filter(found.column("kept"))

    return run


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns, whatever their names; documents are not shuffled while the references are small."""
    names = docs.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scratch = Scratch(docs.sparkSession, "quality")
    columns = [F.lit(None).cast("long").alias("id"), F.col(f"c{lang_at}").alias("lang"), F.col(f"c{text_at}").alias("text")]
    refs = references(scratch.write(profiles(inner.select(*columns), "id", "text", "lang", words)), scratch, words)
    met = _joined(inner.withColumn("lang", F.col(f"c{lang_at}").cast("string")), refs)
    return met.mapInArrow(_filter(words, text_at, lang_at), inner.schema).toDF(*names)
