from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolens.operators import pit

DAY = datetime(2024, 1, 1)


def facts(spark):
    rows = [("A", datetime(2024, 3, 31), 10.0), ("A", datetime(2024, 6, 30), 11.0), ("B", datetime(2024, 3, 31), 20.0), (None, datetime(2024, 3, 31), 1.0)]
    df = spark.createDataFrame(rows, "entity string, event_time timestamp_ntz, value double")
    return pit.add_pit(df, "event_time", pit.statutory_knowable("10-Q"), F.lit(DAY))


def test_lag_and_snapshot(spark):
    df = facts(spark)
    assert df.where("entity = 'B'").first()["knowable_at"] == datetime(2024, 5, 15)
    seen = lambda at: {(r["entity"], r["value"]) for r in pit.snapshot(df, at, values=["value"]).collect()}
    assert seen("2024-05-14 00:00:00") == set()
    assert seen("2024-05-15 00:00:00") == {("A", 10.0), ("B", 20.0)}
    assert seen("2024-09-01 00:00:00") == {("A", 11.0), ("B", 20.0)}
    assert pit.snapshot(df, "1990-01-01 00:00:00").columns == ["entity", "event_time", "value", "knowable_at", "retrieved_at"]


def test_impossible_rows_and_unknown_forms(spark):
    df = facts(spark)
    pit.validate_pit(df)
    with pytest.raises(pit.PITViolation):
        pit.validate_pit(df.withColumn("knowable_at", F.lit(DAY).cast("timestamp_ntz")))
    with pytest.raises(pit.PITViolation):
        pit.validate_pit(df.drop("knowable_at"))
    with pytest.raises(KeyError):
        pit.statutory_knowable("10-X")


row = st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(0, 6)))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, max_size=8), st.lists(row, max_size=8))
def test_asof_join_against_brute_force(spark, left, right):
    left = [(k, t, i) for i, (k, t) in enumerate(left)]
    right = [(k, t, i) for i, (k, t) in enumerate(right)]
    a = spark.createDataFrame(left, "k string, t long, v long")
    b = spark.createDataFrame(right, "k string, t long, v long")
    got = {r["v"]: (r["t_r"], r["v_r"]) for r in pit.asof_join(a, b, "t", "t", "k").collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        fits = [(u, j) for q, u, j in right if k is not None and q == k and t is not None and u is not None and u <= t]
        if not fits:
            assert got[i] == (None, None)
        else:
            assert got[i][0] == max(u for u, _ in fits)
            assert got[i] in fits


def test_asof_checks_the_right_side(spark):
    left = spark.createDataFrame([("A", DAY + timedelta(days=400))], "entity string, date timestamp_ntz")
    assert pit.asof_join(left, facts(spark), "date", by="entity").first()["value"] == 11.0
    with pytest.raises(pit.PITViolation):
        pit.asof_join(left, facts(spark).withColumn("knowable_at", F.lit(DAY).cast("timestamp_ntz")), "date", by="entity")
