"""Completeness, statistics and filters of a survey's tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status codes that count as completed.
COMPLETED, APPROVED_BY_SUPERVISOR, APPROVED_BY_HEADQUARTERS = 100, 120, 130


#: Bits of a sieve for each interview, the most that it has, and interviews from which on there is one.
SIEVE_BITS, SIEVE_MOST, SIEVED = 8, 1 << 27, 100_000


def sieve(interviews: DataFrame, n: int) -> Column:
    """Whether a row may be of the ``n`` given interviews: true for theirs, false for most others. One bit for each hash of an id, in one array that a subquery makes."""
    words = 1 << max(0, min(n * SIEVE_BITS, SIEVE_MOST).bit_length() - 6)
    place = F.pmod(F.xxhash64("interview__id"), F.lit(words << 6))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    filled = interviews.where("interview__id is not null").select(place.alias("place")).groupBy(F.expr("cast(place div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = filled.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    whole = filled.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()
    return F.get(bits, F.shiftright(place, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))) != 0


def filter_tables(tables: dict[str, DataFrame], interviews: DataFrame, sieved: bool = False) -> dict[str, DataFrame]:
    """Every table with the rows of the given interviews only.

    With ``sieved``, many interviews, which are counted then and should be stored, go through a sieve first, so that few rows of others are shuffled to them.
    """
    ids = interviews.select("interview__id").distinct()
    n = interviews.count() if sieved else 0
    few = (lambda df: df.where(sieve(interviews, n))) if n >= SIEVED else lambda df: df
    return {name: few(df).join(ids, "interview__id", "left_semi") for name, df in tables.items()}


def completed(main: DataFrame, statuses: Iterable[int], complete: str) -> DataFrame:
    """Interviews of a status whose row meets ``complete``: interview__id, interview__key, interview_complete, interview__status."""
    rows = main.where(F.col("interview__status").isin(*statuses)).where(F.expr(complete))
    return rows.select("interview__id", "interview__key", F.lit(1).alias("interview_complete"), "interview__status")


def interview_stats(diagnostics: DataFrame) -> DataFrame:
    """interview__id, interview__key, NotAnswered, WithComments, Invalid."""
    return diagnostics.select(
        "interview__id",
        "interview__key",
        F.col("n_questions_unanswered").alias("NotAnswered"),
        F.col("questions__comments").alias("WithComments"),
        F.col("entities__errors").alias("Invalid"),
    )
