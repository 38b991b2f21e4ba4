"""Attributes: one number per interview and feature.

Every operator gives ATTRIBS rows: interview__id, interview__key, attrib_name, attrib_val (double), attrib_vars.
With ``cases`` (interview__id, interview__key) there is one row for each of them, counts and flags being 0 for an
interview without rows; without it, one for each interview in the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.semantics import any_true

IDS = ("interview__id", "interview__key")
#: What list questions hold for no answer, besides null.
MISSING = ("##N/A##", "")


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name has a match of the pattern, whatever its case."""
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def _attribs(df: DataFrame, value: Column, name: str, variables: str) -> DataFrame:
    return df.select(*IDS, F.lit(name).alias("attrib_name"), value.cast("double").alias("attrib_val"), F.lit(variables).alias("attrib_vars"))


def _per_interview(df: DataFrame, value: Column, cases: DataFrame | None, empty: float | None) -> DataFrame:
    found = df.groupBy(*IDS).agg(value.alias("v"))
    if cases is None:
        return found
    every = cases.select(*IDS).distinct()
    return every.join(found.drop("interview__key"), "interview__id", "left").withColumn("v", F.coalesce(F.col("v"), F.lit(empty)))


def _condition(where: str | Column) -> Column:
    return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))


def _count(where: str | Column) -> Column:
    return F.sum(_condition(where).cast("long")).cast("double")


def _any(where: str | Column) -> Column:
    return F.max(_condition(where).cast("double"))


def _sum(var: str) -> Column:
    return F.coalesce(F.sum(F.col(var).cast("double")), F.lit(0.0))


def _count_vars(df: DataFrame, var_pattern: str, var_val: float = 1) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce((F.col(c) == var_val).cast("int"), F.lit(0)) for c in matching(df, var_pattern)], F.lit(0))


def _any_vars(df: DataFrame, var_pattern: str, var_val: float = 1) -> Column:
    return F.coalesce(any_true(F.col(c) == var_val for c in matching(df, var_pattern)), F.lit(False)).cast("int")


def _count_list(df: DataFrame, var_pattern: str, missing: Iterable[str] = MISSING) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce((~F.col(c).isin(*missing)).cast("int"), F.lit(0)) for c in matching(df, var_pattern)], F.lit(0))


def count_obs(df: DataFrame, where: str | Column, name: str, variables: str, cases: DataFrame | None = None) -> DataFrame:
    """Rows that meet the condition."""
    return _attribs(_per_interview(df, _count(where), cases, 0.0), F.col("v"), name, variables)


def any_obs(df: DataFrame, where: str | Column, name: str, variables: str, cases: DataFrame | None = None) -> DataFrame:
    """1 if a row meets the condition, else 0."""
    return _attribs(_per_interview(df, _any(where), cases, 0.0), F.col("v"), name, variables)


def sum_vals(df: DataFrame, var: str, name: str, variables: str | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Sum of a column; nulls count as nothing."""
    return _attribs(_per_interview(df, _sum(var), cases, 0.0), F.col("v"), name, variables or var)


def count_vars(df: DataFrame, var_pattern: str, name: str, var_val: float = 1, variables: str | None = None) -> DataFrame:
    """Columns of the row that equal a value."""
    return _attribs(df, _count_vars(df, var_pattern, var_val), name, variables or var_pattern)


def any_vars(df: DataFrame, var_pattern: str, name: str, var_val: float = 1, variables: str | None = None) -> DataFrame:
    """1 if a column of the row equals a value, else 0."""
    return _attribs(df, _any_vars(df, var_pattern, var_val), name, variables or var_pattern)


def count_list(df: DataFrame, var_pattern: str, name: str, missing: Iterable[str] = MISSING, variables: str | None = None) -> DataFrame:
    """Text columns of the row that hold an answer."""
    return _attribs(df, _count_list(df, var_pattern, missing), name, variables or var_pattern)


def extract_attribute(df: DataFrame, var: str, name: str, variables: str | None = None) -> DataFrame:
    """A column as it is."""
    return _attribs(df, F.col(var), name, variables or var)


def create_attribute(df: DataFrame, where: str | Column, name: str, variables: str) -> DataFrame:
    """1 if the row meets the condition, else 0."""
    return _attribs(df, _condition(where).cast("int"), name, variables)


OPERATORS = {
    "count_obs": count_obs, "any_obs": any_obs, "sum_vals": sum_vals, "count_vars": count_vars, "any_vars": any_vars,
    "count_list": count_list, "extract_attribute": extract_attribute, "create_attribute": create_attribute,
}


def from_spec(tables: dict[str, DataFrame], operator: str, table: str, **arguments) -> DataFrame:
    """Apply an operator by its name to a table by its name."""
    if operator not in OPERATORS:
        raise ValueError(f"no attribute operator {operator!r}; there are {sorted(OPERATORS)}")
    if table not in tables:
        raise ValueError(f"no table {table!r}; there are {sorted(tables)}")
    return OPERATORS[operator](tables[table], **arguments)


@dataclass(frozen=True)
class Spec:
    """An attribute as data: an operator of OPERATORS, its table, and its arguments but for frames, name and variables."""

    operator: str
    table: str
    name: str
    arguments: tuple[tuple[str, object], ...]
    variables: str | None = None


def spec(operator: str, table: str, name: str, variables: str | None = None, **arguments) -> Spec:
    return Spec(operator, table, name, tuple(arguments.items()), variables)


#: Operators on the rows of an interview, by the number of a row and its aggregate, and those on one row, by their value.
_ROSTER = {
    "count_obs": (lambda where: _condition(where).cast("double"), F.sum),
    "any_obs": (lambda where: _condition(where).cast("double"), F.max),
    "sum_vals": (lambda var: F.col(var).cast("double"), F.sum),
}
_ROW = {
    "count_vars": _count_vars,
    "any_vars": _any_vars,
    "count_list": _count_list,
    "extract_attribute": lambda df, var: F.col(var),
    "create_attribute": lambda df, where: _condition(where).cast("int"),
}


def planned(tables: dict[str, DataFrame], specs: list[Spec], cases: str = "households") -> DataFrame:
    """ATTRIBS rows of all specs, each table being read once: one aggregate over the rows of all rosters, joined to the cases, and one unpivoting at the end.

    Every row of the table of cases gets every attribute, those of rosters without rows being 0; it has one row per interview. Operators on one row apply to
    the table of cases only.
    """
    unknown = sorted({s.table for s in specs} - set(tables)) or sorted({s.operator for s in specs} - set(OPERATORS))
    if unknown:
        raise ValueError(f"no table or operator {unknown}; there are {sorted(tables)} and {sorted(OPERATORS)}")
    apart = [s.name for s in specs if s.operator in _ROW and s.table != cases]
    if apart:
        raise ValueError(f"operators on one row apply to {cases!r}: {apart}")
    homes = tables[cases]
    column = {s: f"_{n}" for n, s in enumerate(specs)}
    own = [s for s in specs if s.operator in _ROW]
    wide = homes.select(*IDS, *[_ROW[s.operator](homes, **dict(s.arguments)).cast("double").alias(column[s]) for s in own])
    rosters = [s for s in specs if s.operator in _ROSTER]
    if rosters:
        parts = []
        for table in dict.fromkeys(s.table for s in rosters):
            mine = {s: _ROSTER[s.operator][0](**dict(s.arguments)) for s in rosters if s.table == table}
            parts.append(tables[table].select("interview__id", *[mine.get(s, F.lit(None).cast("double")).alias(column[s]) for s in rosters]))
        found = reduce(DataFrame.unionByName, parts).groupBy("interview__id").agg(*[_ROSTER[s.operator][1](column[s]).alias(column[s]) for s in rosters])
        wide = wide.join(found, "interview__id", "left")
    values = [
        F.struct(
            F.lit(s.name).alias("attrib_name"),
            (F.coalesce(column[s], F.lit(0.0)) if s.operator in _ROSTER else F.col(column[s])).alias("attrib_val"),
            F.lit(s.variables or dict(s.arguments).get("var") or dict(s.arguments).get("var_pattern")).alias("attrib_vars"),
        )
        for s in specs
    ]
    return wide.select(*IDS, F.explode(F.array(*values)).alias("a")).select(*IDS, "a.*")


#: Questions on meals away from home.
MEALS = ("hh07_q03", "hh07_q05", "hh07_q07", "hh07_q09", "hh07_q011", "hh07_q13", "hh07_q15")
#: Attribute, table and question of goods bought in a period.
PURCHASES = (
    ("any_nf_cons_7d", "non_food_7_days", "hh09a_q02"),
    ("any_nf_cons_30d", "non_food_30_days", "hh09b_q02"),
    ("any_nf_cons_6m", "non_food_6_months", "hh09c_q02"),
    ("any_nf_cons_12m", "non_food_12_months", "hh09d_q02"),
)


def attribute_specs(tables: dict[str, DataFrame]) -> list[Spec]:
    """The survey's attributes; which columns ask about meals depends on the members' table."""
    meals = "|".join(MEALS)
    away = " or ".join(f"`{c}` = 1" for c in matching(tables["members"], meals)) or "false"
    return [
        spec("count_obs", "members", "n_heads", "hh01_q03", where="hh01_q03 = 1"),
        spec("any_obs", "members", "any_food_away_from_home", meals, where=away),
        spec("count_vars", "households", "n_foods_at_home", var_pattern="hh08_q04__"),
        *(spec("any_obs", table, name, var, where=f"{var} = 1") for name, table, var in PURCHASES),
        spec("any_vars", "households", "any_assets", var_pattern="hh14_q02__"),
    ]


def create_attributes(tables: dict[str, DataFrame]) -> DataFrame:
    """All attributes of a survey; every household has every one, also without a row in the roster."""
    return planned(tables, attribute_specs(tables))
