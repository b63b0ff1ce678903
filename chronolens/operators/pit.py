"""Point-in-time operators: stamps, checks, snapshots and backward as-of joins on knowable time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days from the end of a period until a filing of this form must be public.
FILING_LAG_DAYS = {"13F-HR": 45, "NPORT-P": 60, "10-Q": 45, "10-K": 90, "4": 2, "SC 13D": 10, "SC 13G": 45, "COT": 3}


class PITViolation(ValueError):
    """A frame lacks its stamps, or knows something before it happened."""


def lag_days(form: Column) -> Column:
    """The statutory lag of a form; NULL if the form is unknown."""
    pairs = [F.lit(x) for form_days in FILING_LAG_DAYS.items() for x in form_days]
    return F.create_map(*pairs)[form]


def statutory_knowable(form: str) -> Callable[[Column], Column]:
    """Event time to knowable time for one form; an unknown form raises KeyError."""
    days = FILING_LAG_DAYS[form]
    return lambda event: event + F.make_dt_interval(F.lit(days))


def add_pit(df: DataFrame, event_time: str | Column, knowable_at, retrieved_at: str | Column | None = None, validate: bool = True) -> DataFrame:
    """df with event_time, knowable_at and retrieved_at.

    Each is a column name, a Column, or (knowable_at) a function of the event
    time.  retrieved_at is now if not given.  validate reads df until the first
    row that was knowable before it happened, and raises PITViolation; without
    it the plan stays lazy.
    """
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    event = as_column(event_time)
    known = knowable_at(event) if callable(knowable_at) and not isinstance(knowable_at, Column) else as_column(knowable_at)
    stamped = df.withColumns({"event_time": event, "knowable_at": known, "retrieved_at": F.current_timestamp() if retrieved_at is None else as_column(retrieved_at)})
    return validate_pit(stamped) if validate else stamped


def pit_violations(df: DataFrame) -> DataFrame:
    """Rows that were knowable before they happened; rows with a null stamp pass."""
    return df.where(F.col("knowable_at") < F.col("event_time"))


def validate_pit(df: DataFrame, name: str = "frame") -> DataFrame:
    """df itself; raises PITViolation if stamps are missing or a row is impossible. Reads df until the first such row."""
    missing = [c for c in ("event_time", "knowable_at") if c not in df.columns]
    if missing:
        raise PITViolation(f"{name}: missing {missing}")
    if not pit_violations(df).isEmpty():
        raise PITViolation(f"{name}: knowable_at before event_time")
    return df


def snapshot(vintages: DataFrame, asof: str | Column, key: str = "entity", values: list[str] | None = None) -> DataFrame:
    """What was known at a time: the latest row of each key with knowable_at <= asof.

    Ties go by event_time, then retrieved_at (if there is one), then the row's
    hash.  Rows with a null key are left out.  The aggregation keeps one row of
    each key in each task before it shuffles.
    """
    at = F.to_timestamp_ntz(F.lit(asof)) if isinstance(asof, str) else asof
    known = vintages.where((F.col("knowable_at") <= at) & F.col(key).isNotNull())
    order = [F.col(c) for c in ("knowable_at", "event_time", "retrieved_at") if c in vintages.columns]
    whole = F.struct(*[F.col(f"`{c}`") for c in vintages.columns])
    latest = known.groupBy(key).agg(F.max_by(whole, F.struct(*order, F.xxhash64(F.to_json(whole)))).alias("__row")).select("__row.*")
    return latest.select(key, "event_time", "knowable_at", *values) if values is not None else latest


def time_range(rows: DataFrame, time: str, n: int) -> Column:
    """The number of the range that a time lies in, of n ranges with about as many rows each; equal times share one, null is in the first."""
    if n <= 1:
        return F.lit(0)
    kind = rows.schema[time].dataType
    marks = rows.agg(F.percentile_approx(time, [i / n for i in range(1, n)], 10 * n).cast("array<string>").alias("m")).first()["m"]
    return F.aggregate(F.array(*[(F.col(time) >= F.lit(m).cast(kind)).cast("int") for m in sorted(set(marks or []))] or [F.lit(0)]), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str = "knowable_at", by: list[str] | str | None = None, suffix: str = "_r", check: bool = True, ranges: int | None = None) -> DataFrame:
    """Backward as-of join, left outer: to each left row the last right row of the same key with right_time <= left_time.

    One union and one window pass instead of a range join: both sides are
    sorted together by key and time, and each left row takes the last right row
    before it.  Rows are never paired, so the plan is one shuffle of both
    sides.  Right rows of equal time go by event_time and retrieved_at if
    present, then by a hash of the row.  Right columns that left has too get
    the suffix; left rows with a null key or time find nothing.

    ranges: time is cut into so many ranges at quantiles, each sorted on its
    own; the last right row of each range, one row, is carried to the ranges
    after it.  Without a key that is how the work is dealt (by default into as
    many ranges as there are shuffle partitions); with keys it splits those
    that hold most of the rows.
    """
    if check and right_time == "knowable_at":
        validate_pit(right, "right")
    keys = [by] if isinstance(by, str) else list(by or [])
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in keys}
    # one data column for each side, so that the union's rows stay narrow in types
    l_row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    r_row = F.struct(*[F.col(f"`{c}`").alias(names[c]) for c in names], F.lit(True).alias("__met"))
    tie = F.struct(*[F.col(c) for c in ("event_time", "retrieved_at") if c in right.columns], F.xxhash64(F.to_json(r_row)))
    key = lambda: [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)] or [F.lit(0).alias("__k0")]
    lefts = left.select(*key(), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), l_row.alias("__l"))
    rights = right.where(F.col(right_time).isNotNull()).select(*key(), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), r_row.alias("__r"), tie.alias("__tie"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    n = ranges or (1 if keys else int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.withColumn("__range", time_range(both, "__t", n))
    group = [f"__k{i}" for i in range(max(1, len(keys)))]
    order = Window.partitionBy(*group, "__range").orderBy("__t", "__side", "__tie")
    met = both.withColumn("__m", F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__side = 1")
    if n > 1:  # one row for each key and range, with the last right row of the ranges before it
        latest = both.groupBy(*group, "__range").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__t", "__tie"))).alias("__r"))
        before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried = latest.select(*[F.col(c).alias(f"{c}_c") for c in (*group, "__range")], F.last("__r", ignorenulls=True).over(before).alias("__c"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_c")) for c in (*group, "__range")]
        met = met.join(carried, reduce(lambda a, b: a & b, same), "left").withColumn("__m", F.coalesce("__m", "__c"))
    usable = F.col("__t").isNotNull()
    for i in range(len(keys)):
        usable = usable & F.col(f"__k{i}").isNotNull()
    out = met.withColumn("__m", F.when(usable, F.col("__m")))
    return out.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(c) for c in names.values()])
