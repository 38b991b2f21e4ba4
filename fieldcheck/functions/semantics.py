"""Rules for missing, infinite and not-a-number values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ratio(value: Column, quantity: Column) -> Column:
    """value / quantity; over zero it is infinite with the sign of value, and null for 0 / 0 or a null."""
    value, quantity = value.cast("double"), quantity.cast("double")
    over_zero = F.when(value > 0, F.lit(INF)).when(value < 0, F.lit(-INF))
    return F.when(quantity == 0, over_zero).otherwise(F.try_divide(value, quantity))


def number(value: Column) -> Column:
    """The value as a double, not-a-number as null."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def baseline_log(value: Column) -> Column:
    """Logarithm of positive values, null for all others."""
    return F.when(value > 0, F.ln(value))


def checked_log(value: Column) -> Column:
    """Logarithm where zero is minus infinity, so that it lies below any lower bound; negative values are null."""
    return F.when(value == 0, F.lit(-INF)).when(value > 0, F.ln(value))


def in_list(value: Column, values: Iterable) -> Column:
    """Whether the value is listed; a null isn't, and nothing is in an empty list."""
    values = list(values)
    return F.coalesce(value.isin(values), F.lit(False)) if values else F.lit(False)


def group_key(columns: Iterable[Column], plain: bool = False) -> Column:
    """One string that is equal exactly if all parts are, nulls included; ``[]`` for no parts. ``plain`` parts, as numbers, have nothing to escape: the string is the same."""
    parts = [c.cast("string") for c in columns]
    if plain and parts:
        quoted = [F.coalesce(F.concat(F.lit('"'), p, F.lit('"')), F.lit("null")) for p in parts]
        return F.concat(F.lit("["), *[x for q in quoted for x in (F.lit(","), q)][1:], F.lit("]"))
    return F.to_json(F.array(*parts)) if parts else F.lit("[]")


def any_true(conditions: Iterable[Column]) -> Column:
    """OR of conditions with unknowns: true if one is true, else null if one is null."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_true(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def shown(value: Column) -> Column:
    """The value as text, a null as NA."""
    return F.coalesce(value.cast("string"), F.lit("NA"))
