"""URL filters by a temporal list join, in DataFrame operations only.

Dated list entries (a domain is added to or removed from a list) become
validity intervals.  A capture is blocked if, on the day it was fetched, an
entry for its host or for a domain above it was valid.  Captures are reduced
to their different (host, day) pairs before anything moves; each pair meets
the intervals of its domains by an equality join with a range condition on
time, and the verdicts go back to the captures.  That equality join with a range
condition is the as-of join: intervals of one (domain, list) don't overlap, so
of each at most one row, the entry active at fetch time, meets a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL: without scheme, user, port, path and final dot. Null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and the domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame, domain_col: str = "domain", list_col: str = "list_name", action_col: str = "action", date_col: str = "dated") -> DataFrame:
    """Rows (domain, list_name, valid_from, valid_to): valid on days from valid_from until before valid_to (null: still valid).

    action is 'add' or 'remove'; of several entries for a domain on one day the
    addition wins.  Entries without a domain, a day or a known action say nothing.
    """
    events = entries.select(
        F.regexp_replace(F.lower(F.trim(F.col(domain_col))), r"^(\*?\.)+|\.+$", "").alias("domain"),
        F.col(list_col).cast("string").alias("list_name"),
        F.col(date_col).cast("date").alias("day"),
        (F.lower(F.col(action_col)) == "add").alias("adds"),
    ).where(F.col("domain").isNotNull() & (F.col("domain") != "") & F.col("day").isNotNull() & F.lower(F.col(action_col)).isin("add", "remove"))
    daily = events.groupBy("domain", "list_name", "day").agg(F.max("adds").alias("adds"))
    key = Window.partitionBy("domain", "list_name").orderBy("day")
    turns = daily.withColumn("before", F.lag("adds").over(key)).where(F.col("before").isNull() | (F.col("before") != F.col("adds")))
    spans = turns.withColumn("valid_to", F.lead("day").over(key))
    return spans.where("adds").select("domain", "list_name", F.col("day").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """The rows of captures with ``host``, ``blocked``, ``matched_domain`` and ``matched_list``.

    Of several valid entries the most specific domain is reported, then the
    first list by name.  A null or malformed URL, or a null fetch time, isn't
    blocked.  Columns of captures that have one of these names are replaced; all
    others travel in one struct, so no name of theirs can clash.  Rows that
    repeat are judged as often; no rows give no rows; an empty list blocks none.
    """
    added = ["host", "blocked", "matched_domain", "matched_list"]
    names = [c for c in captures.columns if c not in added]
    own = captures.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{fetched_col}`").cast("date").alias("day"), F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    pairs = own.where(F.col("host").isNotNull() & F.col("day").isNotNull()).select("host", "day").distinct()
    asked = pairs.select("host", "day", F.explode(domains_of(F.col("host"))).alias("domain"))
    valid = asked.join(intervals(entries), "domain").where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    best = F.min(F.struct((-F.length("domain")).alias("size"), F.col("list_name"), F.col("domain")))
    verdicts = valid.groupBy("host", "day").agg(best.alias("best")).select("host", "day", F.col("best.domain").alias("matched_domain"), F.col("best.list_name").alias("matched_list"))
    met = own.join(verdicts, ["host", "day"], "left")
    kept = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]
    return met.select(*kept, "host", F.col("matched_domain").isNotNull().alias("blocked"), "matched_domain", "matched_list")
