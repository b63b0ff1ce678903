"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles, as 64-bit hashes.  The
shingles are dealt into ``k`` blocks; XOR-ing the hashes of a block gives its
parity word, so two sketches differ in at most as many blocks as the sets have
differing shingles.  Sets with Jaccard similarity of at least 3/4 and sizes
n, m differ in at most ``D = (n + m)/7`` shingles (a third of the smaller,
two sevenths of the larger), so with enough blocks some
non-empty block must agree: the pigeonhole join.  ``k`` is fixed for each pair
of neighbouring size bands (sizes of linked sets are within 4/3), and each
document emits only its first ``D + 1`` block keys in the order of their hash
(the prefix principle), which still meet.  Candidates are then verified on
their whole sets.

Exactness.  Block keys of a document can be useless if too many of its blocks
are empty.  A document is *short of blocks* at a level when the bound no longer
forces a non-empty common block.  Everything emits at level 0, where shingles
found in very many documents are left out (this keeps common passages from
making candidates); what is short there emits at level 1 with all shingles,
then at level 2 with another dealing, and what is short everywhere emits plain
shingles.  A linked pair meets at the first level where one of the two isn't
short, since both have emitted there.

Skew.  Equal sets are collapsed in the tasks.  A key that many documents of a
task hold leaves the task once, with its local centre; keys meet in small
packed blobs; each key yields a star of candidate links, never all its pairs.
Components of the verified links follow.  Keys whose members are still in
different components are looked at again, in pairs of bounded blocks: bit
sketches (parities again) refuse what their Hamming distance can, and a forest
of what they allow remains.  Whole sets then decide within the clusters of
links and allowed links, again in pairs of bounded blocks; only links that
join components leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolens.llm import components
from chronolens.llm.planes import pack, unpack
from chronolens.llm.scratch import Scratch
from chronolens.llm.text import U, groups, hashed_words, mix, texts_of

WIDTH = 5
FLUSH_KEYS = 1_200_000
HOT_LOCAL = 8  # a shingle is reported by a task that finds it in so many different sets
HOT_TOTAL = 48  # and left out at level 0 when reported so often in all
HOT_LIST = 200_000  # at most so many are left out; results don't depend on it
REF_BITS = U((1 << 48) - 1)
LEVELS = 3
BLOCK_SETS, BLOCK_ITEMS = 2_048, 2_000_000  # sets, and shingles in them, of a block of a candidate cluster
SHARED_SETS, SHARED_BLOCKS = 256, 8  # a cluster of fewer sets is still cut into up to so many blocks of so many sets, for tasks to share its pairs
SPREAD = 1.25  # blocks for each shingle in which two sets can differ


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text that has a word."""
    for first, last, h, at in hashed_words(texts):
        n = len(h) - WIDTH + 1
        s = np.zeros(max(n, 0), dtype=U)
        for i in range(WIDTH):
            if n > 0:
                s += mix(h[i : i + n] + U(i + 1)) * U(2 * i + 3)
        s = mix(s)
        for row in range(last - first):
            a, b = int(at[row]), int(at[row + 1])
            if b - a >= WIDTH:
                x = np.sort(s[a : b - WIDTH + 1])
                yield first + row, x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                short = U(b - a)
                for i, word in enumerate(h[a:b].tolist()):
                    short = mix(np.array([short], dtype=U) * U(0x9E3779B97F4A7C15) + U(word) + U(i))[0]
                yield first + row, np.array([short], dtype=U)


def signature(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) + U(len(s))], dtype=U))[0])


def sketch_bits(n: int) -> int:
    """Four to eight bits for each shingle, a power of two."""
    return 1 << min(16, max(6, (4 * n - 1).bit_length()))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each bit; a longer sketch folds to a shorter one by XOR of its halves."""
    bits = sketch_bits(len(s))
    slot = (mix(s ^ U(0x5EED)) & U(bits - 1)).astype(np.int64)
    odd = np.bincount(slot, minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def folded(x: np.ndarray, words: int) -> np.ndarray:
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def signed(x) -> np.ndarray:
    return np.asarray(x, dtype=U).view(np.int64)


def bands(limit: int) -> list[int]:
    """First sizes of the bands; linked sizes are in the same or neighbouring bands."""
    out = [1]
    while out[-1] <= limit:
        out.append(4 * out[-1] // 3 + 1)
    return out


class Sketcher:
    """Block keys of one set."""

    def __init__(self, hot: np.ndarray):
        self.hot = hot
        self.starts = bands(1 << 34)

    def keys(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        band = int(np.searchsorted(self.starts, n, side="right")) - 1
        rare = s
        if len(self.hot):
            at = np.searchsorted(self.hot, s)
            at[at == len(self.hot)] = 0
            rare = s[self.hot[at] != s]
        out = []
        # as the smaller of a pair, or of either size in its own band: (n + 4n/3) / 7; as the larger: (n + n) / 7 at most
        for joint, most in ((band, n // 3), (band - 1, 2 * n // 7)):
            if joint >= 0:
                last = self.starts[joint + 1] - 1
                k = int(math.ceil(SPREAD * (last // 3))) + 1
                for level in range(LEVELS):
                    found, short = self.level(rare if level == 0 else s, joint, k, most, level)
                    out.append(found)
                    if not short:
                        break
                else:
                    single = np.sort(mix(s ^ U(0xC3C3 + joint * 8 + LEVELS)))
                    out.append(single[: n - (3 * n + 3) // 4 + 1])
        return np.concatenate(out)

    @staticmethod
    def level(s: np.ndarray, joint: int, k: int, most: int, level: int) -> tuple[np.ndarray, bool]:
        if level > 1:
            s = np.sort(mix(s + U(level * 0x51ED2701)))
        if not len(s):
            return s, True
        block = (s >> U(32)) * U(k) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        parity = np.bitwise_xor.reduceat(mix(s ^ U(0x1234567)), starts)
        keys = np.sort(mix(parity + block[starts] * U(0x9E3779B97F4A7C15) + U((joint * 8 + level) * 0x632BE5AB)))
        return keys[: most + 1], (k - len(starts)) >= k - most


NOTED = ["kind", "id", "mark", "n", "sig", "sketch"]
SALTS = 16  # a component with many different texts gets its smallest id over so many tasks


def _fingerprint():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def common() -> Iterator[pa.RecordBatch]:
            if pool:
                h, c = np.unique(np.concatenate(pool), return_counts=True)
                h, c = h[c >= HOT_LOCAL], c[c >= HOT_LOCAL]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), dtype=np.int8)), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.array(c.astype(np.int64)), pa.array(signed(h)), pa.nulls(len(h), pa.binary())], names=NOTED)

        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            n, sig = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=U)
            sketches: list[bytes | None] = [None] * len(texts)
            for row, s in shingle_sets(texts):
                n[row], sig[row] = len(s), signature(s)
                if int(sig[row]) not in seen:
                    seen.add(int(sig[row]))
                    sketches[row] = sketch(s).tobytes()  # of equal sets, the first of the task is enough
                    pool.append(s)
                    size += len(s)
                    if size > FLUSH_KEYS:
                        yield from common()
                        pool, size = [], 0
                        seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), dtype=np.int8)), ids.cast(pa.int64()), batch.column(2), pa.array(n), pa.array(signed(sig)), pa.array(sketches, pa.binary())], names=NOTED)
        yield from common()

    return run


BLOBS = "p int, kind int, keys binary, refs binary, centres binary"


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal sorted keys, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)])) if len(keys) else np.zeros(1, dtype=np.int64)


def stars(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys with their smallest ref; and a row (key, ref, smallest) for each different ref of the keys that have several."""
    order = np.argsort(keys)
    keys, refs = keys[order], refs[order]
    at = runs_of(keys)
    lengths = np.diff(at)
    least = np.minimum.reduceat(refs, at[:-1]) if len(keys) else refs
    many = np.flatnonzero(np.repeat(lengths > 1, lengths))
    k, r, c = keys[many], refs[many], np.repeat(least, lengths)[many]
    order = np.lexsort((r, k))
    k, r, c = k[order], r[order], c[order]
    if len(k):
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
        k, r, c = k[new], r[new], c[new]
        ends = runs_of(k)
        several = np.repeat(np.diff(ends) > 1, np.diff(ends))
        k, r, c = k[several], r[several], c[several]
    return keys[at[:-1]], least, k, r, c


def _emit(hot, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(hot.value)
        keys: list[np.ndarray] = []
        refs: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            k, least, gk, gr, gc = stars(np.concatenate(keys) & ~U(0xFF), np.concatenate(refs))
            p = ((k >> U(32)) * U(parts) >> U(32)).astype(np.int64)
            cuts = np.searchsorted(p, np.arange(parts + 1))
            rows = [(i, 0, pack(k[a:b], 1, 8), pack(least[a:b], 0, 6), None) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            for a in range(0, len(gk), 50_000):
                rows.append((int(mix(gk[a : a + 1] + gr[a : a + 1])[0] % U(parts)), 1, *(pack(x[a : a + 50_000], 0, 8) for x in (gk, gr, gc))))
            for a in range(0, len(rows), 256):
                columns = list(zip(*rows[a : a + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[2:])], names=["p", "kind", "keys", "refs", "centres"])

        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in groups(texts):
                for _, s in shingle_sets(texts[a:b]):
                    sig = signature(s)
                    if sig in seen:
                        continue
                    seen.add(sig)
                    own = sketcher.keys(s)
                    keys.append(own)
                    refs.append(np.full(len(own), U(sig) & REF_BITS, dtype=U))
                    size += len(own)
                    if size > FLUSH_KEYS:
                        yield from flush()
                        keys, refs, size = [], [], 0
                        seen.clear()
        yield from flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Stars of one part: those that the tasks found, and those of the keys that several tasks sent."""
    keys, refs, gk, gr, gc = [], [], [], [], []
    for kind, k, r, c in zip(*(table.column(x).to_pylist() for x in ("kind", "keys", "refs", "centres")), strict=True):
        if kind:
            for to, blob in ((gk, k), (gr, r), (gc, c)):
                to.append(unpack(blob, 0, 8))
        else:
            keys.append(unpack(k, 1, 8))
            refs.append(unpack(r, 0, 6))
    if keys:
        _, _, k, r, c = stars(np.concatenate(keys), np.concatenate(refs))
        gk.append(k)
        gr.append(r)
        gc.append(c)
    return pa.table([signed(np.concatenate(x) if x else []) for x in (gk, gr, gc)], names=["k", "ref", "centre"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted classes, from (sig, text)."""
    for batch in batches:
        sigs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for a, b in groups(texts):
            rows = [(sigs[a + row], s.tobytes()) for row, s in shingle_sets(texts[a:b]) if int(signed([signature(s)])[0]) == sigs[a + row]]
            if rows:
                found, blobs = zip(*rows, strict=True)
                found = np.array(found, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found.view(U) & REF_BITS)), pa.array(found), pa.array(blobs, pa.binary())], names=["ref", "sig", "items"])


def _pairs(sizes: np.ndarray, sketches: list[np.ndarray], sides: np.ndarray, same: bool, labels: list[int], accept) -> list[tuple[int, int]]:
    """Pairs of rows in different components whose sketches allow a link and that accept takes; each joins their components.

    Rows must come by size. same: the two blocks are one; else only pairs across count.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    by_width: dict[int, np.ndarray] = {}
    lengths = np.array([len(x) for x in sketches])
    for row in range(len(sizes)):
        last = int(np.searchsorted(sizes, 4 * sizes[row] // 3, side="right"))
        near = np.arange(row + 1, last)
        if not same:
            near = near[sides[row + 1 : last] != sides[row]]
        at = find(labels[row])
        near = near[np.fromiter((find(labels[x]) != at for x in near.tolist()), bool, len(near))]
        if not len(near):
            continue
        width = int(lengths[row])  # rows are by size, so sketches ahead are as long or longer
        if width not in by_width:
            by_width[width] = np.stack([folded(x, width) if len(x) >= width else np.zeros(width, dtype=U) for x in sketches])
        for a in range(0, len(near), 4096):
            part = near[a : a + 4096]
            apart = np.bitwise_count(by_width[width][part] ^ by_width[width][row]).sum(axis=1, dtype=np.int64)
            for x in part[7 * apart <= sizes[row] + sizes[part]].tolist():
                if find(labels[x]) != find(labels[row]) and accept(row, x):
                    out.append((row, x))
                    root[find(labels[x])] = find(labels[row])
    return out


def _edges(found: list[tuple[int, int]], names: list[int]) -> pa.Table:
    return pa.table([pa.array([names[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _allowed(table: pa.Table) -> pa.Table:
    """A forest of the links that sketches allow, among the members of one key in one pair of blocks."""
    order = np.argsort(table.column("n").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    refs, labels = table.column("ref").to_pylist(), table.column("label").to_pylist()
    sketches = [np.frombuffer(x, dtype=U) for x in table.column("sketch").to_pylist()]
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    return _edges(_pairs(table.column("n").to_numpy(), sketches, table.column("own").to_numpy(), same, labels, lambda a, b: True), refs)


def _among(table: pa.Table) -> pa.Table:
    """Links that join components, among the members of a cluster in one pair of blocks: sketches first, then whole sets."""
    wanted = table.column("sig").to_pylist()
    rows = [(len(s), row, s) for row, s in shingle_sets(texts_of(table.column("text").combine_chunks())) if int(signed([signature(s)])[0]) == wanted[row]]
    rows.sort(key=lambda x: x[:2])
    table = table.take(pa.array([x[1] for x in rows], pa.int64()))
    sets = [x[2] for x in rows]
    same = not rows or table.column("i")[0].as_py() == table.column("j")[0].as_py()
    found = _pairs(np.array([x[0] for x in rows], dtype=np.int64), [sketch(s) for s in sets], table.column("own").to_numpy(), same, table.column("label").to_pylist(), lambda a, b: linked(sets[a], sets[b]))
    return _edges(found, table.column("sig").to_pylist())


def dealt(rows: DataFrame, group: str, shared_blocks: int = 1) -> DataFrame:
    """rows (group, ref, n, ...) with i, j, own: each group cut into blocks of bounded size, each row once for each pair of blocks that it is in."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    shared = F.least(F.col("m") / SHARED_SETS, F.lit(float(shared_blocks)))
    blocks = sizes.select(group, F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("t") / BLOCK_ITEMS, shared)).alias("blocks"))
    own = rows.join(blocks, group).withColumn("own", F.pmod(F.xxhash64("ref"), "blocks"))
    zero = F.lit(0).cast("long")
    one = own.where("blocks = 1").drop("blocks").withColumns({"i": zero, "j": zero})
    more = own.where("blocks > 1").withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    return one.unionByName(more.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other"))


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    if 3 * max(len(p), len(q)) > 4 * min(len(p), len(q)):
        return False
    both = np.concatenate((p, q))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= 75 * (len(both) - common)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow a link."""
    for batch in batches:
        n, m = (batch.column(i).to_pylist() for i in (2, 3))
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
            width = min(len(x), len(y))
            if 3 * max(n[i], m[i]) <= 4 * min(n[i], m[i]) and 7 * int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64)) <= n[i] + m[i]:
                keep.append(i)
        if keep:
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in (0, 1)], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        keep = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if linked(np.frombuffer(p.as_buffer(), dtype=U), np.frombuffer(q.as_buffer(), dtype=U))]
        if keep:
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep)), b.take(pa.array(keep))], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id.

    Two texts link when their shingle sets have a Jaccard similarity of at
    least 0.75; component_id is the smallest id reachable by links.  Null and
    wordless texts have n_shingles 0 and only their own id.  Rows that repeat
    are returned as often.  A null id is returned with the component's smallest
    id that isn't null, or null.  No rows give no rows.  Other columns, of any
    name, are not read.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _located(source).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _located(source: DataFrame) -> DataFrame:
    """Of each row of source (id, text): id, mark (a hash of the text), n (shingles), label (of its component; null without words), component_id."""
    spark = source.sparkSession
    scratch = Scratch(spark, "ngram-join")
    parts = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    noted = scratch.write(source.select("id", "text", F.xxhash64("text").alias("mark")).mapInArrow(_fingerprint(), "kind tinyint, id long, mark long, n long, sig long, sketch binary"))
    counted = noted.where("kind = 0").select("id", "mark", "n", "sig")
    common = noted.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TOTAL).orderBy(F.desc("n"), "sig").limit(HOT_LIST).toPandas()
    hot = spark.sparkContext.broadcast(np.sort(common["sig"].to_numpy(dtype=np.int64).view(U)))
    classes = counted.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"))

    blobs = source.select("text").mapInArrow(_emit(hot, parts), BLOBS)
    members = scratch.write(blobs.groupBy("p").applyInArrow(_meet, "k long, ref long, centre long"))
    del blobs
    scratch.free_shuffles()

    def fetch(refs: DataFrame) -> DataFrame:
        """The sets of these classes, made again from a text of each."""
        wanted = classes.withColumn("ref", F.col("sig").bitwiseAND(F.lit((1 << 48) - 1))).join(refs, "ref", "left_semi").select("id", "sig")
        texts = source.join(wanted, source["id"].eqNullSafe(wanted["id"])).select("sig", "text")
        sets = scratch.write(texts.mapInArrow(_sets, "ref long, sig long, items binary"))
        scratch.free_shuffles()
        return sets

    def check(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of refs that link, as signatures: sketches first, then whole sets."""
        left, right = (drawn.select(F.col("ref").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        pairs = scratch.write(pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near, "a long, b long"))
        sets = fetch(pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct())
        left, right = (sets.select(F.col("ref").alias(f"ref_{x}"), F.col("sig").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
        both = pairs.select(F.col("a").alias("ref_a"), F.col("b").alias("ref_b")).join(right, "ref_b").join(left, "ref_a").select("a", "b", "items_a", "items_b")
        links = scratch.write(both.mapInArrow(_verify, "a long, b long").distinct())
        scratch.drop(sets, pairs)
        return links

    ref_of = F.col("sig").bitwiseAND(F.lit((1 << 48) - 1)).alias("ref")
    drawn = noted.where("sketch IS NOT NULL").groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).select(ref_of, "n", "sketch")
    star = members.where("ref <> centre").select(F.least("ref", "centre").alias("a"), F.greatest("ref", "centre").alias("b")).distinct()
    star = scratch.write(star)
    links = check(star)
    scratch.free_shuffles()
    labels = components.connected(scratch, links)

    # Keys whose members are in several components, one of those with the same members: which links do sketches allow?
    by_ref = labels.select(F.col("node").bitwiseAND(F.lit((1 << 48) - 1)).alias("ref"), "label")
    placed = members.select("k", "ref").distinct().join(by_ref, "ref", "left").select("k", "ref", F.coalesce("label", "ref").alias("label"))
    split = placed.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("ref")).alias("x"), F.bit_xor(F.hash("ref")).alias("y")).where("low <> high")
    split = split.groupBy("x", "y").agg(F.min("k").alias("k")).select("k")
    open_ = scratch.write(placed.join(split, "k", "left_semi"))
    asked = dealt(open_.join(drawn.select("ref", "n"), "ref"), "k").join(drawn.select("ref", "sketch"), "ref")
    allowed = scratch.write(asked.groupBy("k", "i", "j").applyInArrow(_allowed, "a long, b long").distinct())
    scratch.drop(members, open_)
    scratch.free_shuffles()

    # Clusters of links and allowed links that span components: whole sets decide, in pairs of bounded blocks.
    if not allowed.isEmpty():
        low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 48) - 1)).alias(c)
        clusters = components.connected(scratch, links.select(low("a"), low("b")).unionAll(allowed)).withColumnsRenamed({"node": "ref", "label": "cluster"})
        own = classes.withColumn("ref", ref_of).join(clusters, "ref").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        spread = own.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cluster")
        asked = dealt(scratch.write(own.join(spread, "cluster", "left_semi")).withColumnRenamed("id", "own_id"), "cluster", SHARED_BLOCKS)
        texts = source.join(asked, source["id"].eqNullSafe(F.col("own_id"))).select("cluster", "i", "j", "own", "label", "sig", "text")
        links = scratch.write(links.unionAll(texts.groupBy("cluster", "i", "j").applyInArrow(_among, "a long, b long")))
        del texts, asked
        scratch.free_shuffles()
        labels = components.connected(scratch, links)
    scratch.drop(star, allowed)

    # only texts with a link have a label; of these, each component's smallest id goes to all its texts, salted
    linked_ = classes.join(labels.withColumnRenamed("node", "sig"), "sig").select("sig", "id", "label", F.pmod("sig", F.lit(SALTS)).alias("salt"))
    first = linked_.groupBy("label").agg(F.min("id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    where = linked_.join(first, ["label", "salt"]).select("sig", "label", "component_id")
    alone = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left_anti").select("sig", F.col("sig").alias("label"), F.col("id").alias("component_id"))
    known = counted.where("n > 0").join(where.unionAll(alone), "sig").select("id", "mark", "n", "label", "component_id")
    return known.unionAll(counted.where("n = 0").select("id", "mark", "n", F.lit(None).cast("long").alias("label"), F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with one row of each component: of its rows whose id isn't null, the one with the smallest id.

    Where rows of that id have several texts of the component, a hash of the
    text decides, and among rows equal in id and text a hash of all their
    columns.  Rows without words make no component: of those equal in id and
    text, one stays.  Rows with a null id stay, for nothing tells which of them
    a component's row is.  Columns may have any names.
    """
    names = docs.columns
    whole = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ids, text = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}").cast("string")
    found = _located(whole.select(ids.alias("id"), text.alias("text"))).where("id IS NOT NULL")
    kept = found.where("n > 0").groupBy("label").agg(F.min(F.struct("id", "mark")).alias("k")).select("k.id", "k.mark").unionAll(found.where("n = 0").select("id", "mark").distinct())
    met = whole.withColumns({"__id": ids, "__mark": F.xxhash64(text)}).join(kept.select(F.col("id").alias("__id"), F.col("mark").alias("__mark")), ["__id", "__mark"])
    copy = F.row_number().over(Window.partitionBy("__id", "__mark").orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in whole.columns])))
    once = met.withColumn("__copy", copy).where("__copy = 1").select(*whole.columns)
    return once.unionAll(whole.where(ids.isNull())).toDF(*names)
