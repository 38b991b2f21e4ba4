"""Logical issues from attributes, unanswered questions, and the union of all issues."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import messages

#: What an issue's type asks for.
REJECT, COMMENT, SYSTEM, REVIEW = 1, 2, 3, 4


@dataclass(frozen=True)
class Rule:
    """Interviews whose attributes meet a condition have an issue."""

    attributes: tuple[str, ...]
    where: str
    message: str
    type: int = REJECT


def _issue(df: DataFrame, type_: Column, desc: Column, comment: Column, variables: Column) -> DataFrame:
    return df.select(
        "interview__id",
        "interview__key",
        type_.cast("int").alias("issue_type"),
        desc.alias("issue_desc"),
        comment.alias("issue_comment"),
        variables.alias("issue_vars"),
        F.lit(None).cast("string").alias("issue_loc"),
    )


def attribute_issues(attribs: DataFrame, rules: list[Rule], language: str = "en") -> DataFrame:
    """Issues of all rules: attributes become columns in one aggregate with a row per interview, then every rule is a condition on its row.

    An attribute that an interview doesn't have is null, and so are conditions on it.
    """
    names = sorted({a for r in rules for a in r.attributes})
    values = [F.first(F.when(F.col("attrib_name") == a, F.col("attrib_val")), ignorenulls=True).alias(a) for a in names]
    wide = attribs.where(F.col("attrib_name").isin(names)).groupBy("interview__id", "interview__key").agg(*values)
    hits = [
        F.when(
            F.expr(r.where),
            F.struct(
                F.lit(r.type).alias("type"),
                F.lit(messages.text(f"{r.message}.desc", language)).alias("desc"),
                F.lit(messages.text(f"{r.message}.comment", language)).alias("comment"),
                F.lit(", ".join(r.attributes)).alias("vars"),
            ),
        )
        for r in rules
    ]
    found = wide.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return _issue(found, F.col("hit.type"), F.col("hit.desc"), F.col("hit.comment"), F.col("hit.vars"))


LOGICAL = [
    Rule(("n_heads",), "n_heads = 0", "no_head"),
    Rule(("n_heads",), "n_heads > 1", "several_heads"),
    Rule(("any_food_away_from_home", "n_foods_at_home"), "any_food_away_from_home = 0 and n_foods_at_home = 0", "no_food"),
    Rule(
        ("any_nf_cons_7d", "any_nf_cons_30d", "any_nf_cons_6m", "any_nf_cons_12m"),
        "any_nf_cons_7d = 0 and any_nf_cons_30d = 0 and any_nf_cons_6m = 0 and any_nf_cons_12m = 0",
        "no_non_food",
    ),
    Rule(("any_assets",), "any_assets = 0", "no_assets"),
]


def unanswered_issues(cases: DataFrame, stats: DataFrame, allowed: int = 0, language: str = "en") -> DataFrame:
    """An issue for each complete interview with more than ``allowed`` questions without an answer; the comment holds their number."""
    joined = cases.where("interview_complete = 1").select("interview__id", "interview__key").join(stats.select("interview__id", "NotAnswered"), "interview__id")
    comment = F.concat(F.lit(messages.text("unanswered.comment", language) + " "), F.col("NotAnswered").cast("string"))
    return _issue(joined.where(F.col("NotAnswered") > allowed), F.lit(REJECT), F.lit(messages.text("unanswered.desc", language)), comment, F.lit(None).cast("string"))


def all_issues(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
