"""Queries on whole surveys: all checks in one plan, texts and labels, logs as sums, sketches, versions, indicators, and validation runs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.stored import own_folder, stored
from fieldcheck.functions.templates import placeholders, with_labels
from fieldcheck.operators import catalog, changes, check_texts, decisions, report, run, sketches
from fieldcheck.operators.messages import text
from fieldcheck.operators.outliers import Check, long_measures
from fieldcheck.operators.thresholds import with_limits
from fieldcheck.plans import case_queries as C
from fieldcheck.plans import decision_queries as D
from fieldcheck.plans import outlier_queries as O
from fieldcheck.plans.survey_tables import HOUSEHOLDS, ROSTER, frame, sql, table
from fieldcheck.sources import versions

H, R = sql(HOUSEHOLDS), sql(ROSTER)

# all checks of a survey --------------------------------------------------------------------------------------------

_LINE = "cast(l_orderkey as {text}) as interview__id, concat('K', cast(l_orderkey as {text})) as interview__key"
#: The given tables under the questionnaire's names: table -> SQL of its rows.
TABLES = {
    "households": """
select cast(o_orderkey as {text}) as interview__id, concat('K', cast(o_orderkey as {text})) as interview__key,
       cast(substring(o_orderpriority, 1, 1) as int) as admin1, case o_orderstatus when 'F' then 1 when 'P' then 2 else 3 end as urb_rur,
       o_totalprice as hh12_q06, cast(substring(o_orderpriority, 1, 1) as int) as hh12_q06b, floor(o_totalprice / 1000) as hh12_q09,
       cast(substring(o_orderpriority, 1, 1) as int) as hh13_q02, o_totalprice as hh13_q04
from orders""",
    "r_assets": f"select {_LINE}, l_linenumber as r_assets__id, l_quantity as hh14_q03, l_extendedprice as hh14_q05, l_extendedprice * l_discount as hh14_q06 from lineitem",
    "food_consumption_at_home": f"""
select {_LINE}, l_suppkey as food_consumption_at_home__id, l_quantity as hh08_q05_amount, l_linenumber as hh08_q05_unit, l_quantity as hh08_q10_amount,
       case l_linestatus when 'F' then 1 else 2 end as hh08_q10_unit, l_extendedprice as hh08_q11
from lineitem""",
    "r_income": """
select cast(c_custkey as {text}) as interview__id, concat('K', cast(c_custkey as {text})) as interview__key, c_nationkey as r_income__id, c_acctbal as hh17_q03 from customer""",
    "services_roster": """
select cast(p_partkey as {text}) as interview__id, concat('K', cast(p_partkey as {text})) as interview__key, p_size as services_roster__id,
       p_retailprice as hh03a_q31, p_size as hh03a_q33
from part""",
    "ag_assets": """
select cast(s_suppkey as {text}) as interview__id, concat('K', cast(s_suppkey as {text})) as interview__key, 1 as ag_assets__id, s_acctbal as ag15_q05, s_acctbal as ag15_q06
from supplier""",
    "r_aglabor_nonhh": """
select cast(user_id as {text}) as interview__id, concat('K', cast(user_id as {text})) as interview__key, length(event_type) as r_aglabor_nonhh__id,
       value as ag13_q03, value as ag13_q06, length(event_type) as ag13_q05b
from events""",
}
#: Derived measures in SQL.
_DERIVED = {
    "daily_elec_exp": f"(case hh12_q06b {' '.join(f'when {k} then hh12_q06 / {d}' for k, d in ((1, 1), (2, 7), (3, 14), (4, 30), (5, 90), (6, 365.25)))} else hh12_q06 end)",
    "unit_purchase_price": "(hh08_q11 / hh08_q10_amount)",
    "hourly_rate": "(ag13_q06 / ag13_q05b)",
}


def _known(name: str) -> list[Check]:
    """The catalogue's checks of a table for whose columns there are stand-ins."""
    have = {w.strip(",)") for w in TABLES[name].split()}
    return [k for k in catalog.CHECKS[name] if all(c in have or c in _DERIVED for c in (k.var, *k.by))]


CHECKS = {name: _known(name) for name in TABLES}

LABELS = """
select 'r_income' as dataset, 'r_income__id' as variable, n_nationkey as code, n_name as label from nation where n_nationkey <> 7
union all select 'r_assets', 'r_assets__id', r_regionkey, r_name from region
union all select 'food_consumption_at_home', 'hh08_q05_unit', r_regionkey, lower(r_name) from region
union all select 'food_consumption_at_home', 'food_consumption_at_home__id', n_nationkey, n_name from nation"""


def survey(spark, sf_dir: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    return {name: frame(spark, sf_dir, TABLES[name]) for name in names}


def labels(spark, sf_dir: str) -> DataFrame:
    return spark.sql(LABELS.replace("from nation", "from {nation}").replace("from region", "from {region}"), nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))


def _survey_outliers(language: str):
    def query(spark, sf_dir: str) -> DataFrame:
        tables = survey(spark, sf_dir)
        return catalog.outlier_issues(tables, tables, CHECKS, language, labels(spark, sf_dir))

    query.__doc__ = f"""All checks of {len(TABLES)} tables in one plan, texts in {language!r}, roster items and units by their labels (I3, I4, M2, J9)."""
    return query


# Every check of the catalogue: tables of the questionnaire by rule, each from one of the given tables.

#: Given table, its key, the column that measures are taken from, and the one that codes are.
_BASES = (
    ("customer", "c_custkey", "c_acctbal", "c_nationkey"),
    ("part", "p_partkey", "p_retailprice", "p_size"),
    ("orders", "o_orderkey", "o_totalprice", "cast(substring(o_orderpriority, 1, 1) as int)"),
)
EVERY = {**catalog.CHECKS, **catalog.LAND_CHECKS}


def _whole_table(name: str, base: tuple[str, str, str, str]) -> str:
    """SQL of a table with all columns that its checks read: codes, denominators above zero, and measures that differ by a factor."""
    given, key, measure, code = base
    checks = EVERY[name]
    derived = {**catalog.DAILY.get(name, {}), **catalog.RATIOS.get(name, {})}
    used = {k.var for k in checks}
    inputs = [c for var, of in derived.items() if var in used for c in of]
    below = {of[1] for var, of in derived.items() if var in used}
    codes = dict.fromkeys([*(b for k in checks for b in k.by), *(f for k in checks for _, f, _ in placeholders(check_texts.what(k.var, "en")) if f)])
    if name in ("plots", "crops"):
        codes = {"r_parcel__id": None, "r_plot__id": None, **codes}
    values = [c for c in dict.fromkeys([*(k.var for k in checks if k.var not in derived), *inputs]) if c not in codes and not (name == "crops" and c == "ag02_q07_size")]
    columns = [f"{code} as {c}" for c in codes if c not in below] + [f"{code} + 1 as {c}" for c in values if c in below]
    columns += [f"{measure} * {n + 1} as {c}" for n, c in enumerate(v for v in values if v not in below)]
    return f"select cast({key} as {{text}}) as interview__id, concat('K', cast({key} as {{text}})) as interview__key, {', '.join(columns)} from {given}"


WHOLE = {name: _whole_table(name, _BASES[0 if name in ("plots", "crops") else n % len(_BASES)]) for n, name in enumerate(EVERY)}


def catalogue_outliers(spark, sf_dir: str) -> DataFrame:
    """All 80 checks of the questionnaire and 9 on plots and crops, over 21 tables, in one plan (I4)."""
    tables = {name: frame(spark, sf_dir, text_) for name, text_ in WHOLE.items()}
    return catalog.outlier_issues(tables, tables, EVERY, "en", labels(spark, sf_dir))


def _derived_sql(name: str) -> dict[str, str]:
    days = " ".join(f"when {k} then {{0}} / {d}" for k, d in ((1, 1), (2, 7), (3, 14), (4, 30), (5, 90), (6, 365.25)))
    out = {var: f"(case {unit} {days.format(amount)} else {amount} end)" for var, (amount, unit) in catalog.DAILY.get(name, {}).items()}
    return out | {var: f"({a} / {b})" for var, (a, b) in catalog.RATIOS.get(name, {}).items()}


def _whole_sql() -> str:
    source = {name: sql(text_) for name, text_ in WHOLE.items()}
    source["crops"] = f"(select c.*, ag02_q07_size from {source['crops']} c join {source['plots']} p using (interview__id, r_parcel__id, r_plot__id))"
    return f"with lab as ({LABELS}) " + " union all ".join(_check_sql(t, k, "en", "", WHOLE[t], source[t], _derived_sql(t)) for t, some in EVERY.items() for k in some)


def _sql_text(template: str, fields: dict[str, str], language: str) -> str:
    """A template as an SQL expression."""
    out = []
    for before, field, form in placeholders(template):
        out.append("'" + before.replace("'", "''") + "'")
        if field:
            x = fields[field]
            shape = {"number": "'{:,.2f}'", "whole": "'{:,.0f}'"}.get(form)
            plain = f"format({shape}, cast({x} as double))" if shape else x
            out.append(f"translate({plain}, ',.', ' ,')" if shape and language == "fr" else plain)
    return " || ".join(out)


def _check_sql(name: str, k: Check, language: str, only: str, columns: str, source: str, derived: dict[str, str]) -> str:
    """Issues of one check. ``columns`` is the select that names the table's columns, ``source`` the table, ``derived`` has its derived measures."""
    var = derived.get(k.var, k.var)
    same = " and ".join(f"t.{b} is not distinct from g.{b}" for b in k.by) or "true"
    keys = "".join(f"{b}, " for b in k.by)
    ids = [w for w in re.findall(r" as (\w+__id)\b", columns) if w != "interview__id"]
    loc = " || ', ' || ".join(f"t.{i}" for i in ids)
    template = check_texts.what(k.var, language)
    coded = {f for _, f, _ in placeholders(template) if f}
    label = lambda c: f"coalesce((select label from lab where dataset = '{name}' and variable = '{c}' and code = t.{c}), cast(t.{c} as varchar))"
    what = _sql_text(template, {c: label(c) for c in coded}, language)
    fields = {"what": f"({what})", "value": "raw", "n_obs": "cast(n_obs as varchar)", "med": "exp(med)", "ll": "exp(ll)", "ul": "exp(ul)", "var": f"'{k.var}'", "by": f"'{', '.join(k.by) or '-'}'"}
    fields |= {"transform": f"'{k.transform}'", "bounds": f"'{k.bounds}'", "n_mad": f"'{k.n_mad:g}'", "min_obs": f"'{k.min_obs}'", "exclude": "'-'"}
    desc = _sql_text(check_texts.DESC[language], fields, language)
    comment = _sql_text(check_texts.COMMENT[language], fields | {"n_obs": "n_obs"}, language)
    rows = f"""select t.interview__id, t.interview__key, 2 as issue_type, {desc} as issue_desc, {comment} as issue_comment, '{k.var}' as issue_vars, {f"'[' || {loc} || ']'" if ids else "cast(null as varchar)"} as loc
from (select *, {var} as raw from {source}) t
join (select {keys}count(*) as n_obs, median(v) as med, median(v) - {k.n_mad} * 1.4826 * mad(v) as ll, median(v) + {k.n_mad} * 1.4826 * mad(v) as ul
      from (select *, ln({var}) as v from {source} where {var} > 0) {"group by " + ", ".join(k.by) if k.by else ""}) g on {same}
where n_obs >= {k.min_obs} and raw > 0 and ln(raw) > ul {only}"""
    same = "interview__id, interview__key, issue_type, issue_desc, issue_comment, issue_vars"
    return f"select {same}, cast(null as varchar) as issue_loc from ({rows}) union all select {same}, loc from ({rows})"


def _outliers_sql(language: str, names=tuple(TABLES), only: str = "") -> str:
    return f"with lab as ({LABELS}) " + " union all ".join(_check_sql(t, k, language, only, TABLES[t], sql(TABLES[t]), _DERIVED) for t in names for k in CHECKS[t])


def decode_columns(spark, sf_dir: str) -> DataFrame:
    """Three coded columns of lines by their labels, with one subquery (J9); some codes have none."""
    codes = frame(spark, sf_dir, _DECODED)
    marks = spark.sql(_DECODE_LABELS.replace("from nation", "from {nation}").replace("from region", "from {region}"), nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))
    named = with_labels(codes, marks, "lines", {"line": "line__id", "supplier": "l_suppkey", "size": "l_quantity"})
    return named.select("interview__id", "line__id", "line", "supplier", "size")


_DECODED = "select cast(l_orderkey as {text}) as interview__id, l_linenumber as line__id, l_suppkey, l_quantity from lineitem"
_DECODE_LABELS = """
select 'lines' as dataset, 'line__id' as variable, r_regionkey as code, r_name as label from region
union all select 'lines', 'l_suppkey', n_nationkey, n_name from nation
union all select 'lines', 'l_quantity', n_nationkey, lower(n_name) from nation
union all select 'others', 'line__id', n_nationkey, n_name from nation"""
_DECODE_SQL = f"""
with lab as ({_DECODE_LABELS})
select interview__id, line__id, coalesce(a.label, cast(line__id as varchar)) as line, coalesce(b.label, cast(l_suppkey as varchar)) as supplier,
       coalesce(c.label, cast(cast(l_quantity as bigint) as varchar)) as size
from {sql(_DECODED)} left join (select * from lab where dataset = 'lines' and variable = 'line__id') a on a.code = line__id
left join (select * from lab where variable = 'l_suppkey') b on b.code = l_suppkey left join (select * from lab where variable = 'l_quantity') c on c.code = l_quantity"""

# action logs as sums -----------------------------------------------------------------------------------------------


def _plain(digests: DataFrame) -> DataFrame:
    return digests.select("interview__id", "n_events", F.col("sum_a").cast("string").alias("sum_a"), F.col("sum_b").cast("string").alias("sum_b"))


def event_digest(spark, sf_dir: str) -> DataFrame:
    """Action logs of users as sums of hashes, the log of each user coming in two parts."""
    rows = C.actions(spark, sf_dir)
    early = F.col("date") < "2024-01-15"
    return _plain(changes.added_digests(changes.event_digests(rows.where(early), C.EVENTS), changes.event_digests(rows.where(~early), C.EVENTS)))


_EVENT = "strftime(ts, '%Y-%m-%d') || '|' || strftime(ts, '%H:%M:%S') || '|' || action || '|' || originator || '|' || coalesce(cast(nullif(user_id % 3, 2) as varchar), 'NA')"
_DIGEST_SQL = f"""
select interview__id, count(*) as n_events, cast(sum(cast('0x' || substr(h, 1, 15) as bigint)) as varchar) as sum_a, cast(sum(cast('0x' || substr(h, 16, 15) as bigint)) as varchar) as sum_b
from (select interview__id, md5({_EVENT}) as h from {sql(C.ACTIONS)} where action in ('purchase', 'signup')) group by interview__id"""


def updated_by_digest(spark, sf_dir: str) -> DataFrame:
    """The users that updated_interviews finds, by sums instead of whole logs."""
    rows = C.actions(spark, sf_dir)
    old = changes.event_digests(rows.where("(ts < timestamp_ntz '2024-01-15 00:00:00' or user_id % 4 = 1) and user_id % 10 <> 0"), C.EVENTS)
    return changes.updated_by_digest(old, changes.event_digests(rows, C.EVENTS))


# sketches ----------------------------------------------------------------------------------------------------------

SKETCHED = [Check("unit_price", ("l_suppkey",)), Check("l_extendedprice"), Check("l_quantity", ("l_returnflag",), transform="none")]


def sketched_medians(spark, sf_dir: str) -> DataFrame:
    """Groups of three checks, their medians from sketches of two halves of the interviews, merged: whether the rank of each is within its bound (G1).

    The rank is within if the values below the median are no more than half plus RANK_ERROR, and those up to it no fewer than half less
    RANK_ERROR, one value apart.
    """
    rows = O.lines(spark, sf_dir)
    first = F.col("interview__id") < "4"
    halves = [stored(sketches.threshold_sketches(some, SKETCHED)) for some in (rows.where(first), rows.where(~first))]
    found = sketches.sketched_thresholds(sketches.merged_sketches(*halves), SKETCHED)
    values = long_measures(rows, SKETCHED, [], checked=False).where("value is not null")
    ranks = with_limits(values, found, ["check_id", "key"]).groupBy("check_id", "key").agg(
        F.first("n_obs").alias("n_obs"), F.count("*").alias("n"), F.count_if(F.col("value") < F.col("med")).alias("below"), F.count_if(F.col("value") <= F.col("med")).alias("upto")
    )
    e = sketches.RANK_ERROR
    within = (F.col("n") == F.col("n_obs")) & (F.col("below") <= (0.5 + e) * F.col("n") + 1) & (F.col("upto") >= (0.5 - e) * F.col("n") - 1)
    return ranks.select("check_id", "key", "n_obs", within.alias("within"))


def _sketched_sql() -> str:
    parts = []
    for k in SKETCHED:
        key = "'[' || " + " || ',' || ".join(f"""'"' || {b} || '"'""" for b in k.by) + " || ']'" if k.by else "'[]'"
        parts.append(f"select '{k.id}' as check_id, {key} as key, count(*) as n_obs, true as within from {O.LINES} {'group by ' + ', '.join(k.by) if k.by else ''}")
    return " union all ".join(parts)


# versions and indicators -------------------------------------------------------------------------------------------


def union_widened(spark, sf_dir: str) -> DataFrame:
    """Three versions of the roster whose answer is a whole number, a number and a text, and whose amount is a whole number or a number."""
    rows = C.roster(spark, sf_dir)
    one = rows.where("line__id < 3").selectExpr("interview__id", "line__id", "cast(line__id as smallint) as answer", "line__id as amount")
    two = rows.where("line__id in (3, 4)").selectExpr("interview__id", "cast(line__id as bigint) as line__id", "l_discount as answer", "l_tax as amount")
    three = rows.where("line__id > 4").selectExpr("interview__id", "line__id", "l_returnflag as answer", "null as amount")
    return versions.union_versions([one, two, three])


_WIDENED_SQL = f"""
select interview__id, cast(line__id as bigint) as line__id,
       case when line__id < 3 then cast(line__id as varchar) when line__id < 5 then cast(l_discount as varchar) else l_returnflag end as answer,
       case when line__id < 3 then cast(line__id as double) when line__id < 5 then l_tax end as amount
from {R}"""

_HOLE = "ts >= {t} '2024-01-08 00:00:00' and ts < {t} '2024-01-15 00:00:00'"


def weekly_indicators(spark, sf_dir: str) -> DataFrame:
    """Rows and values of events by week and type, without those of one week: value, running total, change."""
    events = table(spark, sf_dir, "events").where(f"not ({_HOLE.format(t='timestamp_ntz')})")
    found = report.weekly_indicators(events, "ts", {"n": F.lit(1), "errors": F.when(F.col("event_type") == "error", 1).otherwise(0)}, ("event_type",))
    return found.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


_WEEKLY_SQL = f"""
with e as (select cast(date_trunc('week', ts) as date) as week, event_type, count(*) as n, count(*) filter (event_type = 'error') as errors
           from events where not ({_HOLE.format(t="timestamp")}) group by all),
w as (select unnest(generate_series((select min(week) from e), (select max(week) from e), interval 7 day))::date as week),
f as (select w.week, k.event_type, coalesce(n, 0) as n, coalesce(errors, 0) as errors
      from w cross join (select distinct event_type from e) k left join e on e.week = w.week and e.event_type = k.event_type)
select strftime(week, '%Y-%m-%d') as week, event_type, n, errors,
       cast(sum(n) over t as bigint) as n_total, n - lag(n) over t as n_change, cast(sum(errors) over t as bigint) as errors_total, errors - lag(errors) over t as errors_change
from f window t as (partition by event_type order by week)"""


def period_indicators(spark, sf_dir: str) -> DataFrame:
    """Events in three periods, one of which has none."""
    periods = spark.createDataFrame([("2024-01-05", "2024-01-11"), ("2024-01-10", "2024-01-20"), ("2023-12-01", "2023-12-07")], "a string, b string")
    periods = periods.select(F.to_date("a").alias("period_start"), F.to_date("b").alias("period_end"))
    found = report.period_indicators(table(spark, sf_dir, "events"), "ts", {"n": F.lit(1), "errors": (F.col("event_type") == "error").cast("int")}, periods)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("period_start", "period_end")})


_PERIOD_SQL = """
select strftime(a, '%Y-%m-%d') as period_start, strftime(b, '%Y-%m-%d') as period_end, count(ts) as n, count(*) filter (event_type = 'error') as errors
from (values (date '2024-01-05', date '2024-01-11'), (date '2024-01-10', date '2024-01-20'), (date '2023-12-01', date '2023-12-07')) p(a, b)
left join events on cast(ts as date) between a and b group by a, b"""

# decisions by message, whole runs ----------------------------------------------------------------------------------


def persistent_messages(spark, sf_dir: str) -> DataFrame:
    """How many of an order's messages were sent before, one by one (K4)."""
    t = D.Tables(spark, sf_dir)
    sent = t.households.selectExpr("interview__id", "cast(null as string) as variable", "3 as role", f"{_SENT} as comment")
    return decisions.sent_before(sent, D.reject_messages(spark, sf_dir))


_SENT = "case when o_orderkey % 3 = 0 then 'Check NO ## Check AF' when o_orderkey % 3 = 1 then 'Check NO' end"
_SENT_SQL = f"""{D._CTE},
said as (select distinct interview__id, trim(m) as m from (select interview__id, unnest(string_split(reject_comment, ' ## ')) as m from msg where action = 'reject')),
old as (select distinct interview__id, trim(m) as m from (select interview__id, unnest(string_split({_SENT}, ' ## ')) as m from households)),
n as (select s.interview__id, count(*) as n_messages, count(o.m) as n_sent from said s left join old o on o.interview__id = s.interview__id and o.m = s.m group by s.interview__id)
select msg.interview__id, reject_comment, interview__status, coalesce(n_messages, 0) as n_messages, coalesce(n_sent, 0) as n_sent, coalesce(n_sent, 0) > 0 as persists
from msg left join n on n.interview__id = msg.interview__id where action = 'reject'"""

#: Tables of the run besides those of the checks: the log of an interview is the shipping of its lines.
_LOG = """
select cast(l_orderkey as {text}) as interview__id, l_shipdate, l_returnflag as originator, l_linenumber as role
from lineitem"""
_DIAGNOSTICS = """
select cast(o_orderkey as {text}) as interview__id, concat('K', cast(o_orderkey as {text})) as interview__key,
       case when o_orderstatus = 'P' then 2 else 0 end as n_questions_unanswered, 0 as questions__comments, 0 as entities__errors
from orders"""
_FIRST = text("no_assets.comment").replace("'", "''")
_REMARKS = f"""
select cast(o_orderkey as {{text}}) as interview__id,
       case when o_orderstatus = 'F' then 'n_heads' end as variable, case when o_totalprice > 250000 then 3 else 1 end as role,
       case when o_totalprice > 300000 then '{_FIRST} ## Something else' else 'We know' end as comment
from orders where o_totalprice > 200000"""
_CUT = "1995-06-17 00:00:00"
RUN_TABLES = ("households", "r_assets", "food_consumption_at_home")
SETTINGS = run.Settings(checks={t: CHECKS[t] for t in RUN_TABLES})


def run_tables(spark, sf_dir: str) -> dict[str, DataFrame]:
    """A survey with all that a run reads; households, which are joined, are stored."""
    logical = C.survey(spark, sf_dir)
    homes = C.homes(spark, sf_dir)
    more = survey(spark, sf_dir, RUN_TABLES)
    answers = homes.selectExpr("interview__id", "interview__status", "interview_result", *(f"{x} as {c}" for c, x in C._HOME_COLUMNS.items()))
    log = frame(spark, sf_dir, _LOG).select(
        "interview__id", "l_shipdate", "originator", "role", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit("00:00:00").alias("time"), F.lit(1).alias("action")
    )
    return (
        logical
        | more
        | {"households": stored(more["households"].join(answers, "interview__id"))}
        | {run.ACTIONS: log, run.DIAGNOSTICS: frame(spark, sf_dir, _DIAGNOSTICS), run.COMMENTS: frame(spark, sf_dir, _REMARKS)}
    )


def validate_run(spark, sf_dir: str) -> DataFrame:
    """Decisions of a second run, after a first one that knew only what was logged before a day: interviews that changed since (all steps, published twice)."""
    tables = run_tables(spark, sf_dir)
    log = tables[run.ACTIONS]
    folder = f"{own_folder(spark)}/run-{uuid.uuid4().hex}"
    early = {**tables, run.ACTIONS: log.where(f"l_shipdate < timestamp_ntz '{_CUT}'")}
    run.validate(spark, early, folder, "first", SETTINGS)
    return run.decided_rows(run.validate(spark, tables, folder, "second", SETTINGS))


_RUN_SQL = f"""
with households as {H}, changed as (select distinct interview__id from {sql(_LOG)} where l_shipdate >= timestamp '{_CUT}'),
cases as (select interview__id, interview__key, interview__status from households where interview__status in (100, 120, 130) and interview_result = 1 and interview__id in (select * from changed)),
iss as (select * from ({C.LOGICAL_SQL}) where interview__id in (select interview__id from cases)
        union all select * from ({_outliers_sql("en", RUN_TABLES, "and t.interview__id in (select interview__id from cases)")})
        union all select c.interview__id, c.interview__key, 1, '{text("unanswered.desc")}', '{text("unanswered.comment")} ' || n_questions_unanswered, null, null
                  from {sql(_DIAGNOSTICS)} d join cases c on c.interview__id = d.interview__id where n_questions_unanswered > 0),
com as {sql(_REMARKS)},
spoke as (select distinct interview__id from com c where role <> 3 and (variable is null or exists (
  select 1 from iss i where i.interview__id = c.interview__id and list_contains(string_split(i.issue_vars, ', '), c.variable)))),
flag as (select interview__id, bool_or(issue_type = 1) as bad, bool_or(issue_type = 4) as look from iss group by interview__id),
dec as (select c.*, case when bad and s.interview__id is null then 'reject' when bad or look then 'review' end as action
        from cases c join flag f on f.interview__id = c.interview__id left join spoke s on s.interview__id = c.interview__id),
txt as (select interview__id, string_agg(distinct issue_comment, ' ## ' order by issue_comment) as reject_comment from iss where issue_type <> 2 group by interview__id),
msg as (select d.interview__id, reject_comment, interview__status, action from dec d left join txt on txt.interview__id = d.interview__id where action is not null),
said as (select interview__id, trim(m) as m from (select interview__id, unnest(string_split(reject_comment, ' ## ')) as m from msg)),
old as (select interview__id, trim(m) as m from (select interview__id, unnest(string_split(comment, ' ## ')) as m from com where role = 3 and variable is null)),
again as (select distinct s.interview__id from said s join old o on o.interview__id = s.interview__id and o.m = s.m)
select case when action = 'review' then 'review' when interview__id in (select * from again) then 'follow_up' else 'reject' end as decision, interview__id, reject_comment, interview__status
from msg"""

QUERIES = {f"survey_outliers_{k}": _survey_outliers(k) for k in check_texts.LANGUAGES} | {
    f.__name__: f
    for f in (
        catalogue_outliers, decode_columns, event_digest, updated_by_digest, sketched_medians, union_widened, weekly_indicators, period_indicators, persistent_messages, validate_run,
    )
}

SQL = {f"survey_outliers_{k}": _outliers_sql(k) for k in check_texts.LANGUAGES} | {
    "catalogue_outliers": _whole_sql(),
    "decode_columns": _DECODE_SQL,
    "event_digest": _DIGEST_SQL,
    "updated_by_digest": C.SQL["updated_interviews"],
    "sketched_medians": _sketched_sql(),
    "union_widened": _WIDENED_SQL,
    "weekly_indicators": _WEEKLY_SQL,
    "period_indicators": _PERIOD_SQL,
    "persistent_messages": _SENT_SQL,
    "validate_run": _RUN_SQL,
}
