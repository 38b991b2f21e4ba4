"""Queries on thresholds and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.semantics import ratio
from fieldcheck.functions.text import number_text, with_label
from fieldcheck.operators import select
from fieldcheck.operators.messages import text
from fieldcheck.operators.outliers import Check, flagged, identify_outliers, thresholds
from fieldcheck.plans.survey_tables import HOUSEHOLDS, ROSTER, frame, sql, table

#: SQL of the same table; unit_price is a line's price over its quantity.
LINES = f"(select *, l_extendedprice / l_quantity as unit_price, nullif(l_returnflag, 'A') as flag from {sql(ROSTER)})"


def lines(spark, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, ROSTER)
    return rows.withColumn("unit_price", ratio(F.col("l_extendedprice"), F.col("l_quantity"))).withColumn("flag", F.expr("nullif(l_returnflag, 'A')"))


def _outliers(check: Check, completed: bool = False):
    """Outliers among all lines, or among those of completed interviews, against all lines."""

    def run(spark, sf_dir: str) -> DataFrame:
        full = lines(spark, sf_dir)
        done = select.completed(frame(spark, sf_dir, HOUSEHOLDS), [select.COMPLETED], "interview_result = 1") if completed else None
        target = select.filter_tables({"lines": full}, done)["lines"] if completed else full
        found = flagged(target, full, [check], ["interview__id", "line__id"])
        return found.select(
            "interview__id", "line__id", F.round("raw", 6).alias("value"), "n_obs", F.round("med", 6).alias("med"), F.round("ll", 6).alias("ll"), F.round("ul", 6).alias("ul")
        )

    return run


def _outliers_sql(check: Check, completed: bool = False) -> str:
    var, keys = check.var, list(check.by)
    gone = f"coalesce({var} in ({', '.join(map(str, check.exclude))}), false)" if check.exclude else "false"
    base = f"case when not {gone} {f'and {var} > 0' if check.transform == 'log' else ''} then {'ln(' + var + ')' if check.transform == 'log' else var} end"
    seen = f"case when {var} = 0 then cast('-inf' as double) when {var} > 0 then ln({var}) end" if check.transform == "log" else var
    same = " and ".join(f"t.{k} is not distinct from g.{k}" for k in keys) or "true"
    above, below = "v > ul", "(v < ll and ll < ul)"
    rule = {"upper": above, "lower": below, "both": f"({above} or {below})"}[check.bounds]
    listed = "".join(f"{k}, " for k in keys)
    group = f"group by {', '.join(keys)}" if keys else ""
    done = f"and interview__id in (select interview__id from {sql(HOUSEHOLDS)} where interview__status = 100 and interview_result = 1)" if completed else ""
    return f"""
with base as (select {listed}{base} as v from {LINES}),
g as (select {listed}count(v) as n_obs, median(v) as med, median(v) - {check.n_mad} * 1.4826 * mad(v) as ll, median(v) + {check.n_mad} * 1.4826 * mad(v) as ul from base {group})
select interview__id, line__id, round({var}, 6) as value, n_obs, round(med, 6) as med, round(ll, 6) as ll, round(ul, 6) as ul
from (select t.*, {seen} as v from {LINES} t where not {gone} {done}) t join g on {same}
where n_obs >= {check.min_obs} and {rule}"""


CHECKS = {
    "outliers_upper": Check("unit_price", ("l_partkey",)),
    "outliers_lower": Check("l_discount", ("l_returnflag", "l_linestatus"), bounds="lower"),
    "outliers_both": Check("unit_price", ("l_suppkey",), bounds="both"),
    "outliers_exclude": Check("l_quantity", ("l_suppkey",), exclude=(1, 2, 3, 50), transform="none", n_mad=1),
    "outliers_nolog": Check("l_extendedprice", ("l_partkey",), transform="none"),
    "outliers_null_group": Check("l_tax", ("flag", "l_linestatus"), n_mad=1),
    "outliers_global": Check("unit_price", bounds="both", n_mad=1),
}

BY = Check("unit_price", ("l_partkey",))
ALL = Check("unit_price")


def _thresholds(check: Check):
    def run(spark, sf_dir: str) -> DataFrame:
        found = thresholds(lines(spark, sf_dir), [check])
        return found.select("key", "n_obs", *[F.round(c, 6).alias(c) for c in ("med", "mad", "ll", "ul")])

    return run


def _thresholds_sql(key: str, group: str) -> str:
    return f"""
select {key} as key, n_obs, round(med, 6) as med, round(m, 6) as mad, round(med - 2 * m, 6) as ll, round(med + 2 * m, 6) as ul
from (select {"l_partkey, " if group else ""}count(v) as n_obs, median(v) as med, 1.4826 * mad(v) as m from (select *, ln(unit_price) as v from {LINES}) {group})"""


#: Four measures with different groups, in one pass.
MULTI = [
    Check("unit_price", ("l_partkey",)),
    Check("l_quantity", ("l_suppkey",), transform="none", n_mad=1),
    Check("l_extendedprice", n_mad=1),
    Check("l_tax", ("flag", "l_linestatus"), bounds="lower"),
]


def outliers_multi_spec(spark, sf_dir: str) -> DataFrame:
    """Four checks of one table in one pass (I4)."""
    rows = lines(spark, sf_dir)
    found = flagged(rows, rows, MULTI, ["interview__id", "line__id"])
    return found.select("check_id", "interview__id", "line__id", F.round("raw", 6).alias("value"), "n_obs", F.round("ul", 6).alias("ul"))


def _multi_sql() -> str:
    return " union all ".join(f"select '{k.id}' as check_id, interview__id, line__id, value, n_obs, ul from ({_outliers_sql(k)})" for k in MULTI)


def _issues(spark, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("interview__id", "interview__key", "line__id", "l_partkey", "unit_price")
    return identify_outliers(rows, rows, [BY])


def outlier_issue_rows(spark, sf_dir: str) -> DataFrame:
    """Issues of the interview, with their texts."""
    return _issues(spark, sf_dir).where("issue_loc is null")


def outlier_question_rows(spark, sf_dir: str) -> DataFrame:
    """Issues that comment on the question, with its place in the roster."""
    return _issues(spark, sf_dir).where("issue_loc is not null")


def _issue_sql(loc: str) -> str:
    return f"""
select interview__id, concat('K', interview__id) as interview__key, 2 as issue_type, '{text("outlier.desc").format(var="unit_price")}' as issue_desc,
       '{text("outlier.comment").format(var="unit_price")} ' || format('{{:,.2f}}', raw) || ' ({text("outlier.limit")} ' || format('{{:,.2f}}', exp(ul)) || ', n = ' || n_obs || ')' as issue_comment,
       'unit_price' as issue_vars, {loc} as issue_loc
from (select t.interview__id, t.line__id, t.unit_price as raw, n_obs, ul
      from {LINES} t join (select l_partkey, count(*) as n_obs, median(ln(unit_price)) + 2 * 1.4826 * mad(ln(unit_price)) as ul from {LINES} group by l_partkey) g
        on t.l_partkey = g.l_partkey
      where n_obs >= 30 and ln(t.unit_price) > ul)"""


def label_decode(spark, sf_dir: str) -> DataFrame:
    """Nations of customers by their labels; codes above 20 have none."""
    labels = table(spark, sf_dir, "nation").where("n_nationkey <= 20").select(F.lit("c_nationkey").alias("variable"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return with_label(table(spark, sf_dir, "customer"), labels, "c_nationkey", "c_nationkey", "label").select("c_custkey", "label")


def _number_format(language: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "orders").select("o_orderkey", number_text(F.col("o_totalprice"), language).alias("price"))

    return run


QUERIES = {name: _outliers(check) for name, check in CHECKS.items()} | {
    "outliers_completed": _outliers(CHECKS["outliers_both"], completed=True),
    "mad_thresholds_by": _thresholds(BY),
    "mad_thresholds_global": _thresholds(ALL),
    "outliers_multi_spec": outliers_multi_spec,
    "outlier_issue_rows": outlier_issue_rows,
    "outlier_question_rows": outlier_question_rows,
    "label_decode": label_decode,
    "number_format_en": _number_format("en"),
    "number_format_fr": _number_format("fr"),
}

SQL = {name: _outliers_sql(check) for name, check in CHECKS.items()} | {
    "outliers_completed": _outliers_sql(CHECKS["outliers_both"], completed=True),
    "mad_thresholds_by": _thresholds_sql("""'["' || l_partkey || '"]'""", "group by l_partkey"),
    "mad_thresholds_global": _thresholds_sql("'[]'", ""),
    "outliers_multi_spec": _multi_sql(),
    "outlier_issue_rows": _issue_sql("cast(null as varchar)"),
    "outlier_question_rows": _issue_sql("'[' || line__id || ']'"),
    "label_decode": "select c_custkey, coalesce(n_name, cast(c_nationkey as varchar)) as label from customer left join (select * from nation where n_nationkey <= 20) n on c_nationkey = n_nationkey",
    "number_format_en": "select o_orderkey, format('{:,.2f}', o_totalprice) as price from orders",
    "number_format_fr": "select o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', ' ,') as price from orders",
}
