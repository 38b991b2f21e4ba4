"""Queries on versions, changes, attributes, issues and derived measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import attributes as A
from fieldcheck.operators import changes, derive, issues, select
from fieldcheck.operators.messages import text
from fieldcheck.plans.survey_tables import ACTIONS, HOUSEHOLDS, ROSTER, STATS, WIDE, frame, sql, table, wide_lines
from fieldcheck.sources import archive, versions

H, R = sql(HOUSEHOLDS), sql(ROSTER)


def homes(spark, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, HOUSEHOLDS)


def roster(spark, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, ROSTER)


# versions and archives ---------------------------------------------------------------------------------------------


def union_versions(spark, sf_dir: str) -> DataFrame:
    """Two versions of the roster, one without a column."""
    rows = roster(spark, sf_dir).select("interview__id", "line__id", "l_quantity", "l_tax")
    return versions.union_versions([rows.where("line__id % 2 = 0").drop("l_tax"), rows.where("line__id % 2 = 1")])


def data_freshness(spark, sf_dir: str) -> DataFrame:
    """Modification time of the newest file of orders."""
    return versions.data_timestamp(table(spark, sf_dir, "orders"))


_NAME = """
case when l_orderkey % 4 = 0 then concat('t', cast(line__id as {t}), '.dta')
     when l_orderkey % 4 = 1 then case when line__id = 1 then 'export__readme.txt' when line__id = 2 then 'v2/' else concat('v', cast(line__id as {t}), '/main.dta') end
     when l_orderkey % 4 = 2 then concat('part', cast(line__id as {t}), '.zip')
     else concat(lower(l_returnflag), case when l_returnflag = 'R' then '.zip' else '.dta' end) end"""
_TYPE = "case when l_orderkey % 4 = 1 and line__id = 2 then 'directory' else 'file' end"


def archive_class(spark, sf_dir: str) -> DataFrame:
    """Every order as an archive, its lines as entries; orders without lines are empty archives."""
    manifest = roster(spark, sf_dir).select(F.col("interview__id").alias("archive"), F.expr(_NAME.format(t="string")).alias("filename"), F.expr(_TYPE).alias("type"))
    return archive.archive_class(homes(spark, sf_dir).select(F.col("interview__id").alias("archive")), manifest)


ARCHIVE_SQL = f"""
with m as (select interview__id as archive, {_NAME.format(t="varchar")} as f, {_TYPE} as type from {R}),
k as (select archive, bool_and(f like '%.dta' and not contains(rtrim(f, '/'), '/')) as d,
             bool_and(type = 'directory' or (f like '%.dta' and contains(f, '/')) or regexp_matches(f, 'export__readme|Questionnaire/')) as o,
             bool_and(f like '%.zip' and not contains(f, '/')) as z from m group by archive)
select h.interview__id as archive, case when coalesce(d, true) then 'dta_files' when o then 'folders' when z then 'zips' end as archive_class
from {H} h left join k on k.archive = h.interview__id"""

# changes and filters -----------------------------------------------------------------------------------------------


def actions(spark, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, ACTIONS)
    return rows.select(
        "interview__id", "action", "originator", "user_id", "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), F.expr("nullif(user_id % 3, 2)").alias("role"),
    )


def _hash_sql(where: str = "true") -> str:
    part = "strftime(ts, '%Y-%m-%d') || '|' || strftime(ts, '%H:%M:%S') || '|' || action || '|' || originator || '|' || coalesce(cast(nullif(user_id % 3, 2) as varchar), 'NA')"
    order = "strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M:%S'), action, originator"
    return f"""(select interview__id, string_agg({part}, '||' order by {order}) as event_string, sha256(string_agg({part}, '||' order by {order})) as event_hash
from {sql(ACTIONS)} where action in ('purchase', 'signup') and {where} group by interview__id)"""


EVENTS = ("purchase", "signup")


def event_hash(spark, sf_dir: str) -> DataFrame:
    """Action logs of users as strings and hashes."""
    return changes.event_hashes(actions(spark, sf_dir), EVENTS)


def updated_interviews(spark, sf_dir: str) -> DataFrame:
    """Users whose log differs from a tracker that knows some users' whole log, of others only what was before 2024-01-15, and some not at all."""
    rows = actions(spark, sf_dir)
    old = changes.event_hashes(rows.where("(ts < timestamp_ntz '2024-01-15 00:00:00' or user_id % 4 = 1) and user_id % 10 <> 0"), EVENTS)
    return changes.updated_interviews(old, changes.event_hashes(rows, EVENTS))


def filter_interviews(spark, sf_dir: str) -> DataFrame:
    """Roster rows of completed interviews."""
    done = select.completed(homes(spark, sf_dir), [select.COMPLETED], "interview_result <= 2")
    return select.filter_tables({"roster": roster(spark, sf_dir)}, done)["roster"].select("interview__id", "line__id", "l_partkey")


def completed_cases(spark, sf_dir: str) -> DataFrame:
    """Interviews of two statuses with a complete result."""
    return select.completed(homes(spark, sf_dir), [select.COMPLETED, select.APPROVED_BY_SUPERVISOR], "interview_result = 1")


def interview_stats(spark, sf_dir: str) -> DataFrame:
    """Counts of diagnostics."""
    return select.interview_stats(frame(spark, sf_dir, STATS))


# attributes --------------------------------------------------------------------------------------------------------


def _attr_sql(source: str, value: str, name: str, variables: str) -> str:
    return f"select interview__id, interview__key, '{name}' as attrib_name, cast({value} as double) as attrib_val, '{variables}' as attrib_vars from {source}"


def _roster_sql(value: str) -> str:
    return f"(select h.interview__id, h.interview__key, coalesce(v, 0) as v from {H} h left join (select interview__id, {value} as v from {R} group by interview__id) r on r.interview__id = h.interview__id)"


ATTRIBUTES = {
    "attr_count_obs": (
        lambda s, d: A.count_obs(roster(s, d), "l_quantity > 25", "n_large", "l_quantity", homes(s, d)),
        _attr_sql(_roster_sql("count(*) filter (l_quantity > 25)"), "v", "n_large", "l_quantity"),
    ),
    "attr_any_obs": (
        lambda s, d: A.any_obs(roster(s, d), F.col("l_discount") == 0.1, "any_tenth", "l_discount", homes(s, d)),
        _attr_sql(_roster_sql("max(case when l_discount = 0.1 then 1 else 0 end)"), "v", "any_tenth", "l_discount"),
    ),
    "attr_sum_vals": (
        lambda s, d: A.sum_vals(roster(s, d), "l_quantity", "quantity", cases=homes(s, d)),
        _attr_sql(_roster_sql("sum(l_quantity)"), "v", "quantity", "l_quantity"),
    ),
    "attr_count_vars": (
        lambda s, d: A.count_vars(wide_lines(s, d), "^LN__", "n_lines"),
        _attr_sql(WIDE, " + ".join(f"coalesce(ln__{k}, 0)" for k in range(1, 8)), "n_lines", "^LN__"),
    ),
    "attr_any_vars": (
        lambda s, d: A.any_vars(wide_lines(s, d), "ln__[1-3]", "any_line", 0),
        _attr_sql(WIDE, "case when ln__1 = 0 or ln__2 = 0 or ln__3 = 0 then 1 else 0 end", "any_line", "ln__[1-3]"),
    ),
    "attr_count_list": (
        lambda s, d: A.count_list(wide_lines(s, d), "note__", "n_notes"),
        _attr_sql(WIDE, " + ".join(f"case when note__{k} <> '##N/A##' then 1 else 0 end" for k in range(1, 8)), "n_notes", "note__"),
    ),
    "attr_extract": (
        lambda s, d: A.extract_attribute(homes(s, d), "o_totalprice", "price"),
        _attr_sql(H, "o_totalprice", "price", "o_totalprice"),
    ),
    "attr_create": (
        lambda s, d: A.from_spec({"households": homes(s, d)}, "create_attribute", "households", where="o_totalprice > 200000", name="costly", variables="o_totalprice"),
        _attr_sql(H, "case when o_totalprice > 200000 then 1 else 0 end", "costly", "o_totalprice"),
    ),
}

_HOME_COLUMNS = {
    "hh08_q04__1": "case when interview_result = 1 then 1 else 0 end",
    "hh08_q04__2": "case when o_orderkey % 5 = 0 then 1 end",
    "hh14_q02__1": "case when interview__status = 100 then 1 else 0 end",
    "hh14_q02__2": "case when o_orderkey % 3 = 0 then 1 end",
}
_MEMBER_COLUMNS = {"hh01_q03": "line__id"} | {v: f"case when l_quantity = {40 + k} then 1 when l_tax = 0 then cast(null as int) else 0 end" for k, v in enumerate(A.MEALS)}
_BOUGHT = {"non_food_7_days": ("hh09a_q02", "R"), "non_food_30_days": ("hh09b_q02", "A"), "non_food_6_months": ("hh09c_q02", "N"), "non_food_12_months": ("hh09d_q02", "R")}


def survey(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as households, lines as members and purchases, under the survey's names."""
    lines = roster(spark, sf_dir)
    bought = {t: lines.where(f"l_returnflag = '{flag}'").selectExpr("interview__id", "interview__key", f"cast(l_discount > 0.07 as int) as {var}") for t, (var, flag) in _BOUGHT.items()}
    return {
        "households": homes(spark, sf_dir).selectExpr("interview__id", "interview__key", *(f"{x} as {c}" for c, x in _HOME_COLUMNS.items())),
        "members": lines.selectExpr("interview__id", "interview__key", *(f"{x} as {c}" for c, x in _MEMBER_COLUMNS.items())),
        **bought,
    }


def attributes_long(spark, sf_dir: str) -> DataFrame:
    """All attributes of the survey."""
    return A.create_attributes(survey(spark, sf_dir))


_MEALS = "|".join(A.MEALS)
ATTRIBUTES_SQL = " union all ".join(
    [
        _attr_sql(_roster_sql("count(*) filter (line__id = 1)"), "v", "n_heads", "hh01_q03"),
        _attr_sql(_roster_sql("max(case when l_quantity between 40 and 46 then 1 else 0 end)"), "v", "any_food_away_from_home", _MEALS),
        _attr_sql(H, "case when interview_result = 1 then 1 else 0 end + case when o_orderkey % 5 = 0 then 1 else 0 end", "n_foods_at_home", "hh08_q04__"),
        *(
            _attr_sql(_roster_sql(f"max(case when l_returnflag = '{_BOUGHT[t][1]}' and l_discount > 0.07 then 1 else 0 end)"), "v", name, var)
            for name, t, var in A.PURCHASES
        ),
        _attr_sql(H, "case when interview__status = 100 or o_orderkey % 3 = 0 then 1 else 0 end", "any_assets", "hh14_q02__"),
    ]
)

# issues ------------------------------------------------------------------------------------------------------------


def logical_issues(spark, sf_dir: str) -> DataFrame:
    """The five logical checks."""
    return issues.attribute_issues(attributes_long(spark, sf_dir), issues.LOGICAL)


def _rule_sql(rule: issues.Rule) -> str:
    return f"""select interview__id, interview__key, {rule.type} as issue_type, '{text(rule.message + ".desc")}' as issue_desc, '{text(rule.message + ".comment")}' as issue_comment,
'{", ".join(rule.attributes)}' as issue_vars, cast(null as varchar) as issue_loc from wide where {rule.where}"""


_PIVOT = ", ".join(f"max(attrib_val) filter (attrib_name = '{a}') as {a}" for a in sorted({a for r in issues.LOGICAL for a in r.attributes}))
_WIDE_ATTRIBS = f"with wide as (select interview__id, interview__key, {_PIVOT} from ({ATTRIBUTES_SQL}) group by interview__id, interview__key)"
LOGICAL_SQL = f"{_WIDE_ATTRIBS} {' union all '.join(_rule_sql(r) for r in issues.LOGICAL)}"


def unanswered_issues(spark, sf_dir: str) -> DataFrame:
    """Users with more than 10 questions left open."""
    stats = select.interview_stats(frame(spark, sf_dir, STATS))
    cases = stats.select("interview__id", "interview__key", F.when(F.col("Invalid") > 0, 1).otherwise(0).alias("interview_complete"))
    return issues.unanswered_issues(cases, stats, 10)


UNANSWERED_SQL = f"""select interview__id, interview__key, 1 as issue_type, '{text("unanswered.desc")}' as issue_desc,
'{text("unanswered.comment")} ' || n_questions_unanswered as issue_comment, cast(null as varchar) as issue_vars, cast(null as varchar) as issue_loc
from {sql(STATS)} where entities__errors > 0 and n_questions_unanswered > 10"""


def all_issues(spark, sf_dir: str) -> DataFrame:
    """Logical and unanswered issues together."""
    return issues.all_issues(logical_issues(spark, sf_dir), unanswered_issues(spark, sf_dir))


# derived measures --------------------------------------------------------------------------------------------------


def daily_rates(spark, sf_dir: str) -> DataFrame:
    """Prices per day, the line number being the unit of time."""
    rows = derive.with_daily_rates(roster(spark, sf_dir), {"rate": ("l_extendedprice", "line__id")})
    return rows.select("interview__id", "line__id", F.round("rate", 6).alias("rate"))


def unit_price(spark, sf_dir: str) -> DataFrame:
    """Ratios, also over zero."""
    rows = derive.with_ratios(roster(spark, sf_dir), {"price": ("l_extendedprice", "l_discount"), "none": ("l_tax", "l_discount")})
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 6))
    return rows.select("interview__id", "line__id", finite("price").alias("price"), (F.col("price") == float("inf")).alias("unbounded"), finite("none").alias("none"))


def group_recode_sum(spark, sf_dir: str) -> DataFrame:
    """Quantities of an order's lines by group of line numbers, attached to the order's own group."""
    source = roster(spark, sf_dir).withColumn("code", F.col("line__id") * 10 + 1)
    out = derive.with_group_sum(homes(spark, sf_dir), "interview_result", source, "code", "l_quantity", derive.ANIMAL_GROUPS, "quantity")
    return out.select("interview__id", "interview_result", "quantity")


def ratio_after_join(spark, sf_dir: str) -> DataFrame:
    """A line's price over its order's."""
    rows = derive.with_parent(roster(spark, sf_dir), homes(spark, sf_dir), ["interview__id"], ["o_totalprice"])
    rows = derive.with_ratios(rows, {"share": ("l_extendedprice", "o_totalprice")})
    return rows.select("interview__id", "line__id", F.round("share", 6).alias("share"))


_DAYS = " ".join(f"when {k} then l_extendedprice / {d}" for k, d in derive.DAYS.items())

QUERIES = {name: run for name, (run, _) in ATTRIBUTES.items()} | {
    f.__name__: f
    for f in (
        union_versions, data_freshness, archive_class, event_hash, updated_interviews, filter_interviews, completed_cases, interview_stats,
        attributes_long, logical_issues, unanswered_issues, all_issues, daily_rates, unit_price, group_recode_sum, ratio_after_join,
    )
}

SQL = {name: text_ for name, (_, text_) in ATTRIBUTES.items()} | {
    "union_versions": f"select interview__id, line__id, l_quantity, cast(null as double) as l_tax from {R} where line__id % 2 = 0 union all select interview__id, line__id, l_quantity, l_tax from {R} where line__id % 2 = 1",
    "archive_class": ARCHIVE_SQL,
    "event_hash": f"select * from {_hash_sql()}",
    "updated_interviews": f"""select n.interview__id from {_hash_sql()} n left join {_hash_sql("(ts < timestamp '2024-01-15' or user_id % 4 = 1) and user_id % 10 <> 0")} o on n.interview__id = o.interview__id
where o.event_hash is null or o.event_hash <> n.event_hash""",
    "filter_interviews": f"select interview__id, line__id, l_partkey from {R} where interview__id in (select interview__id from {H} where interview__status = 100 and interview_result <= 2)",
    "completed_cases": f"select interview__id, interview__key, 1 as interview_complete, interview__status from {H} where interview__status in (100, 120) and interview_result = 1",
    "interview_stats": f'select interview__id, interview__key, n_questions_unanswered as "NotAnswered", questions__comments as "WithComments", entities__errors as "Invalid" from {sql(STATS)}',
    "attributes_long": ATTRIBUTES_SQL,
    "logical_issues": LOGICAL_SQL,
    "unanswered_issues": UNANSWERED_SQL,
    "all_issues": f"{LOGICAL_SQL} union all {UNANSWERED_SQL}",
    "daily_rates": f"select interview__id, line__id, round(case line__id {_DAYS} else l_extendedprice end, 6) as rate from {R}",
    "unit_price": f"""select interview__id, line__id, case when l_discount <> 0 then round(l_extendedprice / l_discount, 6) end as price,
case when l_discount = 0 and l_extendedprice = 0 then null else l_discount = 0 end as unbounded, case when l_discount <> 0 then round(l_tax / l_discount, 6) end as none from {R}""",
    "group_recode_sum": f"""select h.interview__id, interview_result, quantity from {H} h
left join (select interview__id, line__id, sum(l_quantity) as quantity from {R} group by interview__id, line__id) r on r.interview__id = h.interview__id and r.line__id = h.interview_result""",
    "ratio_after_join": f"select r.interview__id, line__id, round(l_extendedprice / o_totalprice, 6) as share from {R} r left join {H} h on h.interview__id = r.interview__id",
}
