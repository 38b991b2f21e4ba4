"""Measures derived from a table's columns or from another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.semantics import ratio

#: Days of each unit of time; other codes leave the amount as it is.
DAYS = {1: 1, 2: 7, 3: 14, 4: 30, 5: 90, 6: 365.25}
#: Detailed animal codes of each group.
ANIMAL_GROUPS = {1: (11, 12, 13), 2: (21, 22), 3: (31,), 4: (41, 42, 43), 5: (51, 52, 53), 6: (61,), 7: (71,), 8: (81,)}


def daily(amount: Column, unit: Column) -> Column:
    """The amount per day."""
    rate = amount.cast("double")
    out = F.when(F.lit(False), rate)
    for code, days in DAYS.items():
        out = out.when(unit == code, rate / days)
    return out.otherwise(rate)


def with_daily_rates(df: DataFrame, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Add columns: name -> (amount, unit)."""
    return df.withColumns({name: daily(F.col(amount), F.col(unit)) for name, (amount, unit) in rates.items()})


def with_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Add columns: name -> (numerator, denominator): unit prices, hourly rates, amounts per area."""
    return df.withColumns({name: ratio(F.col(a), F.col(b)) for name, (a, b) in ratios.items()})


def recoded(column: Column, groups: dict[int, tuple]) -> Column:
    """The group of a code, null for codes of none."""
    out = F.when(F.lit(False), F.lit(0))
    for group, codes in groups.items():
        out = out.when(column.isin(*codes), F.lit(group))
    return out


def with_group_sum(df: DataFrame, key: str, source: DataFrame, code: str, amount: str, groups: dict[int, tuple], out: str, per_interview: bool = True) -> DataFrame:
    """Add the sum of ``amount`` over the source rows of the row's group, within its interview unless ``per_interview`` is False.

    Nulls count as nothing; a group without source rows gives null.
    """
    keys = ["interview__id"] if per_interview else []
    sums = source.withColumn("_group", recoded(F.col(code), groups)).groupBy(*keys, "_group").agg(F.coalesce(F.sum(F.col(amount).cast("double")), F.lit(0.0)).alias(out))
    match = [df[k] == sums[k] for k in keys] + [df[key] == sums["_group"]]
    joined = df.join(sums, match, "left")
    return joined.select(*[df[c] for c in df.columns], sums[out])


def with_parent(df: DataFrame, parent: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Add columns of the parent row (as a plot's area to its crops)."""
    return df.join(parent.select(*keys, *columns), keys, "left")
