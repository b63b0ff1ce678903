"""Packing into length buckets that waste the least padding.

Documents become sequences of at most ``max_len`` tokens.  A dynamic programme
over the global histogram of sequence lengths (at most max_len bins, whatever
the corpus) chooses the ``n_buckets`` boundaries with the smallest sum of
padding; every sequence is padded to its bucket's boundary, and batches of at
most ``budget`` padded tokens form inside each bucket.

Sequences of a bucket are numbered without gathering a bucket anywhere: each
(bucket, shard) is numbered on its own, and the shards' counts, a small
table, give the offsets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolens.llm.scratch import Scratch

MAX_LEN = 2048
BUCKETS = 12
BUDGET = 16_384


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column: each, with the white space after it, becomes one character."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets buckets over sorted lengths, with the least total padding.

    Of equally good choices, the one with the earlier last cut at every step.
    """
    x, c = np.array(lengths, dtype=np.int64), np.array(counts, dtype=np.int64)
    n = len(x)
    if not n:
        return []
    k = min(n_buckets, n)
    total = np.concatenate(([0], np.cumsum(c)))
    mass = np.concatenate(([0], np.cumsum(c * x)))
    big = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, big)
    best[0] = 0
    cuts = []
    for _ in range(k):
        now, cut = np.full(n + 1, big), np.zeros(n + 1, dtype=np.int64)
        for i in range(1, n + 1):  # lengths j..i-1 share a bucket of length x[i-1]
            cost = best[:i] + x[i - 1] * (total[i] - total[:i]) - (mass[i] - mass[:i])
            cut[i] = int(np.argmin(cost))
            now[i] = cost[cut[i]]
        cuts.append(cut)
        best = now
    out, i = [], n
    for cut in reversed(cuts):
        if i:
            out.append(int(x[i - 1]))
            i = int(cut[i])
    return sorted(out)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, n_buckets: int = BUCKETS, budget: int = BUDGET, tokens=None, shards: int | None = None) -> DataFrame:
    """One row for each sequence: id, piece, n_tokens, bucket_len, batch, slot.

    tokens: the column with a document's token count; its words if not given.
    A document of over max_len tokens becomes pieces 0, 1, ... of max_len and a
    rest, so nothing is cut away.  Documents without tokens (null, empty) have
    no sequence.  Batches are numbered from 0 in each bucket, by shard, id and
    piece; rows that repeat are packed as often.  No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    shards = shards or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    count = word_count(F.col(text_col).cast("string")) if tokens is None else tokens.cast("long")
    counted = docs.select(F.col(id_col).cast("long").alias("id"), count.alias("n"))
    pieces = counted.where("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {max_len}"))).alias("piece"))
    pieces = scratch.write(pieces.select("id", "piece", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece") * max_len).alias("n_tokens")))
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).orderBy("n_tokens").collect()  # at most max_len rows
    bounds = boundaries([r["n_tokens"] for r in histogram], [r["c"] for r in histogram], n_buckets)
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    placed = pieces.withColumn("bucket_len", F.element_at(F.filter(table, lambda b: b >= F.col("n_tokens")), 1)).withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    counts = placed.groupBy("bucket_len", "shard").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("bucket_len", "shard", F.coalesce(F.sum("c").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("id", "piece", "n_tokens")) - 1
    numbered = placed.withColumn("local", local).join(offsets, ["bucket_len", "shard"])
    index = F.col("before") + F.col("local")
    per_batch = F.expr(f"greatest(1, {int(budget)} div bucket_len)")
    return numbered.select(F.col("id").alias(id_col), "piece", "n_tokens", "bucket_len", F.floor(index / per_batch).alias("batch"), F.pmod(index, per_batch).alias("slot"))
