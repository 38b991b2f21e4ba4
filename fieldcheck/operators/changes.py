"""New and changed interviews, by a hash of their action logs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.semantics import in_list, shown

TRACKER = "interview__id string, event_string string, event_hash string"
#: A log as a multiset: its number of events, and two sums of independent hashes of 60 bits.
DIGESTS = "interview__id string, n_events bigint, sum_a decimal(29,0), sum_b decimal(29,0)"
PARTS = ("date", "time", "action", "originator", "role")
#: Fixed value: the action code of a completed interview.
COMPLETED = 1


def _events(actions: DataFrame, events: Iterable) -> DataFrame:
    """interview__id and e, the parts of each event of the given actions; a null part reads NA."""
    return actions.where(in_list(F.col("action"), events)).select("interview__id", F.struct(*[shown(F.col(c)).alias(c) for c in PARTS]).alias("e"))


def _text(e: Column) -> Column:
    return F.concat_ws("|", *[e[c] for c in PARTS])


def hashed_events(actions: DataFrame, events: Iterable = (COMPLETED,)) -> DataFrame:
    """(interview__id, a, b): the first and the next 15 hexadecimal digits of the MD5 of each event, as numbers."""
    rows = _events(actions, events).select("interview__id", F.md5(_text(F.col("e")).cast("binary")).alias("h"))
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("bigint")
    return rows.select("interview__id", part(1).alias("a"), part(16).alias("b"))


def summed_events(hashed: DataFrame) -> DataFrame:
    """DIGESTS rows of ``hashed_events``: sums, so with partial aggregation, and streaming too."""
    total = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    return hashed.groupBy("interview__id").agg(F.count("*").alias("n_events"), total("a").alias("sum_a"), total("b").alias("sum_b"))


def event_digests(actions: DataFrame, events: Iterable = (COMPLETED,)) -> DataFrame:
    """DIGESTS rows: per interview a hash of its events of the given actions that doesn't depend on their order.

    No log is ever held in a row. Equal events count as often as they occur. Logs that differ have equal digests with a chance of about 2 ** -120.
    """
    return summed_events(hashed_events(actions, events))


def added_digests(*parts: DataFrame) -> DataFrame:
    """Digests of logs whose events come in several parts: the digest of all events is the sum of those of the parts."""
    rows = reduce(DataFrame.unionByName, parts)
    sums = [F.sum(c).cast("decimal(29,0)").alias(c) for c in ("sum_a", "sum_b")]
    return rows.groupBy("interview__id").agg(F.sum("n_events").alias("n_events"), *sums)


def updated_by_digest(old: DataFrame, new: DataFrame) -> DataFrame:
    """interview__id of those in ``new`` that ``old`` lacks or has with another digest; vanished ones are ignored."""
    columns = ("n_events", "sum_a", "sum_b")
    before = old.select("interview__id", F.struct(*columns).alias("_old"))
    return new.join(before, "interview__id", "left").where(~F.struct(*columns).eqNullSafe(F.col("_old"))).select("interview__id")


def event_hashes(actions: DataFrame, events: Iterable = (COMPLETED,)) -> DataFrame:
    """TRACKER rows: per interview its events of the given actions in order, as one string and as its SHA-256.

    Order is by date, time, then the other parts, so it doesn't depend on the order of rows. A null part reads NA. A
    string is as long as its interview's log, all of which is held in one row; ``event_digests`` needs no such row.
    """
    log = F.array_join(F.transform(F.array_sort(F.collect_list("e")), _text), "||")
    out = _events(actions, events).groupBy("interview__id").agg(log.alias("event_string"))
    return out.withColumn("event_hash", F.sha2("event_string", 256))


def updated_interviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """interview__id of those in ``new`` that ``old`` lacks or has with another hash; vanished ones are ignored."""
    before = old.select("interview__id", F.col("event_hash").alias("old_hash"))
    return new.join(before, "interview__id", "left").where("old_hash is null or old_hash <> event_hash").select("interview__id")
