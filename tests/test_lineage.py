"""Lineage and next id where ids repeat: from 10,000 customers on, the SQL's four-character ids are shared."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolens.operators import registry
from chronolens.plans import catalog


@pytest.fixture(scope="module")
def many(spark, small, tmp_path_factory):
    """Customers whose ids are cut, with a gap (a parent that isn't there) and repeated keys."""
    folder = str(tmp_path_factory.mktemp("many"))
    keys = spark.range(9995, 10004).union(spark.range(995, 1002)).union(spark.range(20, 23)).union(spark.range(0, 60)).where("id <> 30").select(F.col("id").alias("c_custkey"))
    keys.withColumn("c_name", F.format_string("Customer#%09d", "c_custkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


def both(spark, many, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{many}/customer.parquet/*.parquet'")
    own, other = catalog.QUERIES[name](spark, many), con.sql(catalog.SQL[name])
    return Counter(map(tuple, own.select(*other.columns).collect())), Counter(other.fetchall())


def test_lineage_of_repeated_ids(spark, many, monkeypatch):
    own, other = both(spark, many, "hypothesis_lineage")
    assert max(other.values()) > 20 and own == other
    monkeypatch.setattr(registry, "CHAINS", 7)
    assert both(spark, many, "hypothesis_lineage") == (other, other)


def test_lineage_of_any_depth(spark):
    rows = [(f"H-{i:04d}", f"H-{i - 1:04d}" if i > 1 else None) for i in range(1, 41)] + [("H-0100", "H-0099"), ("H-0101", "H-0100"), (None, None)]
    own = spark.createDataFrame(rows, "hypothesis_id string, parent_id string")
    odd = {("H-0100", "H-0100", 0), ("H-0101", "H-0100", 1), (None, None, 0)}
    assert set(map(tuple, registry.lineage(own).collect())) == {(f"H-{i:04d}", "H-0001", i - 1) for i in range(1, 41)} | odd
    assert set(map(tuple, registry.lineage(own, generations=3).collect())) == {(f"H-{i:04d}", f"H-{max(1, i - 3):04d}", min(3, i - 1)) for i in range(1, 41)} | odd


@pytest.mark.parametrize("last, want", [(8, "H-0010"), (998, "H-1000"), (9997, "H-9999"), (9998, "H-1000"), (9999, "H-1000"), (12000, "H-1000"), (None, None)])
def test_next_id_is_cut_as_in_the_sql(spark, tmp_path, last, want):
    keys = spark.range(max(0, last - 3000), last + 1) if last is not None else spark.range(0)
    keys.select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    own, other = both(spark, tmp_path, "next_hypothesis_id")
    assert own == other == Counter([(want,)])


def test_registry_does_not_cut_ids(tmp_path):
    (tmp_path / "H-9999.json").write_text("{}")
    assert registry.Hypotheses(tmp_path).next_id() == "H-10000"
