"""Connected components of a table of links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.scratch import Scratch


def connected(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): for each node with a link, the smallest node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. ("Connected
    Components in MapReduce and Beyond", 2014) until the links form stars.
    Each step is a minimum by node, combined before the shuffle, and a join;
    links at most halve their distance to the root in each round, so rounds
    grow with the logarithm of the longest chain.
    """
    edges = scratch.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.write(small)
        now = _state(after)
        scratch.drop(edges)
        edges = after
        if now == state:
            break
        state = now
    stars = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return scratch.write(stars.unionAll(stars.select(F.col("label").alias("node"), "label").distinct()))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.hash("v", "u")), F.lit(0))).first())
