"""Queries on decisions, rejection lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import decisions, report
from fieldcheck.plans.survey_tables import HOUSEHOLDS, ROSTER, frame, sql, table

H, R = sql(HOUSEHOLDS), sql(ROSTER)
REJECT = [1, 3]

#: Lines of a large quantity or a special discount are issues of their order.
_ISSUES = """
select interview__id, interview__key,
       case when l_quantity > 48 then 1 when l_quantity > 45 then 2 when l_discount = 0.1 and l_tax = 0.08 then 4 end as issue_type,
       concat('Lines of kind ', l_returnflag) as issue_desc, concat('Check ', l_returnflag, l_linestatus) as issue_comment,
       case when l_returnflag = 'R' then 'l_tax, l_quantity' else 'l_discount' end as issue_vars, concat('[', cast(line__id as {text}), ']') as issue_loc
from roster where l_quantity > 45 or (l_discount = 0.1 and l_tax = 0.08)"""

#: Some orders have comments: on the whole, on a variable, or an earlier message of headquarters.
_COMMENTS = """
select interview__id,
       case when o_orderkey % 4 = 1 then 'l_tax' when o_orderkey % 4 = 2 then 'other' end as variable,
       case when o_orderkey % 4 = 3 then 3 else 1 end as role,
       case when o_orderkey % 8 = 3 then 'Check AF' else 'Check RO' end as comment
from households where o_orderkey % 5 < 3"""

_STATS = "select interview__id, interview__key, 0 as NotAnswered, 0 as WithComments, case when o_orderkey % 50 = 0 then 1 else 0 end as Invalid from households"


class Tables:
    """Cases, issues, comments and statistics made of orders and lines."""

    def __init__(self, spark, sf_dir: str) -> None:
        self.households, roster = frame(spark, sf_dir, HOUSEHOLDS), frame(spark, sf_dir, ROSTER)
        of = lambda text: spark.sql(text.format(text="string").replace("from roster", "from {roster}").replace("from households", "from {households}"), roster=roster, households=self.households)
        self.issues, self.comments, self.stats = of(_ISSUES), of(_COMMENTS), of(_STATS)
        self.cases = self.households.select("interview__id", "interview__key", "interview__status")

    def commented(self) -> DataFrame:
        return decisions.has_comments(self.comments, self.issues, self.cases)

    def decided(self) -> DataFrame:
        return decisions.decide(self.cases, self.issues, REJECT, self.commented(), self.stats)


def has_comments(spark, sf_dir: str) -> DataFrame:
    """Orders with a comment that counts (K1)."""
    return Tables(spark, sf_dir).commented()


def decide(spark, sf_dir: str) -> DataFrame:
    """What to do with each order (K2)."""
    return Tables(spark, sf_dir).decided()


def reject_messages(spark, sf_dir: str) -> DataFrame:
    """Messages of orders to reject."""
    t = Tables(spark, sf_dir)
    return decisions.rejection_messages(t.decided().where("action = 'reject'"), t.issues)


def persistent(spark, sf_dir: str) -> DataFrame:
    """Whether the message was sent before (K4)."""
    return decisions.persistent(Tables(spark, sf_dir).comments, reject_messages(spark, sf_dir))


def _decision(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return decisions.create_decisions(t.cases, t.issues, t.comments, t.stats, REJECT)[name]

    return run


_CTE = f"""
with households as {H}, roster as {R}, iss as ({_ISSUES.format(text="varchar")}), com as ({_COMMENTS}), st as ({_STATS}),
cases as (select interview__id, interview__key, interview__status from households),
spoke as (select distinct interview__id from com c where role <> 3 and (variable is null or exists (
  select 1 from iss i where i.interview__id = c.interview__id and list_contains(string_split(i.issue_vars, ', '), c.variable)))),
flag as (select interview__id, bool_or(issue_type in (1, 3)) as bad, bool_or(issue_type = 4) as look from iss group by interview__id),
dec as (select c.*, case when (coalesce(bad, false) or Invalid > 0) and s.interview__id is null then 'reject' when coalesce(bad, false) or Invalid > 0 or coalesce(look, false) then 'review' end as action
        from cases c left join flag f on f.interview__id = c.interview__id left join spoke s on s.interview__id = c.interview__id left join st on st.interview__id = c.interview__id),
txt as (select interview__id, string_agg(distinct issue_comment, ' ## ' order by issue_comment) as reject_comment from iss where issue_type <> 2 group by interview__id),
msg as (select d.interview__id, reject_comment, interview__status, action from dec d left join txt on txt.interview__id = d.interview__id where action is not null),
per as (select interview__id, reject_comment, interview__status, exists (select 1 from com c where c.interview__id = m.interview__id and variable is null and role = 3 and c.comment = m.reject_comment) as persists
        from msg m where action = 'reject')
"""
_WITH_ISSUES = "c.interview__id, c.interview__key, c.interview__status, issue_type, issue_desc, issue_comment, issue_vars, issue_loc from cases c join iss i on i.interview__id = c.interview__id"
_CHOSEN = {"to_reject": "select interview__id from per where not persists", "to_review": "select interview__id from dec where action = 'review'", "to_follow_up": "select interview__id from per where persists"}
_TYPES = {"to_reject": "issue_type in (1, 3, 2)", "to_review": "issue_type in (1, 3, 4)", "to_follow_up": "true"}

DECISIONS = [f"{k}_{part}" for k in _CHOSEN for part in ("ids", "issues", "api")]


def _decision_sql(name: str) -> str:
    kind, part = name.rsplit("_", 1)
    chosen = _CHOSEN[kind]
    if part == "issues":
        return f"{_CTE} select {_WITH_ISSUES} where c.interview__id in ({chosen}) and {_TYPES[kind]}"
    if part == "api":
        return f"{_CTE} select interview__id, reject_comment, interview__status from msg where interview__id in ({chosen})"
    columns = "interview__id, interview__key" + (", interview__status" if kind != "to_follow_up" else "")
    return f"{_CTE} select {columns} from cases where interview__id in ({chosen})"


#: A rejection list as edited by hand, with wrong ids, statuses and texts in some rows.
_EDITED = """
select case when o_orderkey % 11 = 0 then concat('x', md5(cast(o_orderkey as {text}))) else md5(cast(o_orderkey as {text})) end as interview__id,
       case when o_orderkey % 13 = 0 then '  ' else o_orderpriority end as reject_comment,
       case when o_orderkey % 17 = 0 then 99 when o_orderstatus = 'F' then 100 when o_orderstatus = 'P' then 120 else 130 end as interview__status
from orders"""


def reject_list_violations(spark, sf_dir: str) -> DataFrame:
    """Faults of an edited list."""
    return decisions.list_violations(frame(spark, sf_dir, _EDITED))


def reject_worklist(spark, sf_dir: str) -> DataFrame:
    """Rows of an edited list to act on (K7)."""
    return decisions.rejection_worklist(frame(spark, sf_dir, _EDITED), [100, 120])


# reports -----------------------------------------------------------------------------------------------------------

_RUNS = """
select o_orderkey as run, cast(o_orderdate as date) as run_date,
       case when o_orderkey % 6 = 0 then '2024-03-04' when o_orderkey % 6 = 1 then 'soon' when o_orderkey % 6 = 2 then '2024-03-20' end as start_text,
       case when o_orderkey % 6 = 3 then null else '2024-03-10' end as end_text
from orders"""


def report_period(spark, sf_dir: str) -> DataFrame:
    """Periods of runs on the dates of orders, some with given dates."""
    rows = frame(spark, sf_dir, _RUNS)
    first, last = report.report_period(F.col("start_text"), F.col("end_text"), F.col("run_date"))
    return rows.select("run", F.date_format(first, "yyyy-MM-dd").alias("period_start"), F.date_format(last, "yyyy-MM-dd").alias("period_end"))


def _period_sql(source: str) -> str:
    return f"""
select run, case when given then case when s <= e then s end when isodow < 5 then monday - 7 else monday end as period_start,
       case when given then case when s <= e then e end when isodow < 5 then monday - 1 else run_date end as period_end
from (select run, run_date, cast(date_trunc('week', run_date) as date) as monday, isodow(run_date) as isodow,
             cast(try_strptime(start_text, '%Y-%m-%d') as date) as s, cast(try_strptime(end_text, '%Y-%m-%d') as date) as e,
             try_strptime(start_text, '%Y-%m-%d') is not null and try_strptime(end_text, '%Y-%m-%d') is not null as given from {source})"""


def issues_by_period(spark, sf_dir: str) -> DataFrame:
    """Issues by the reporting period of each month's first run, the day of an issue being its order's."""
    t = Tables(spark, sf_dir)
    runs = t.households.select(F.date_trunc("month", "o_orderdate").cast("date").alias("run_date")).distinct()
    first, last = report.report_period(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("run_date"))
    periods = runs.select(first.alias("period_start"), last.alias("period_end"))
    days = t.issues.join(t.households.select("interview__id", F.col("o_orderdate").cast("date").alias("day")), "interview__id")
    found = report.in_periods(days, periods, "day").groupBy("period_start").agg(F.count("*").alias("n_issues"))
    return found.select(F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "n_issues")


def top_issues(spark, sf_dir: str) -> DataFrame:
    """The two most frequent issues."""
    return report.top_issues(Tables(spark, sf_dir).issues, 2)


def issues_by_team(spark, sf_dir: str) -> DataFrame:
    """Issues by supervisor: the customer's nation is the interviewer, its region the supervisor."""
    t = Tables(spark, sf_dir)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    who = t.households.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    team = nation.where("n_nationkey <> 7").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("UserName"), F.col("r_name").alias("SupervisorName"))
    return report.issues_by_team(t.issues, who.select("interview__id", F.col("n_name").alias("originator")), team)


def weekly_trend(spark, sf_dir: str) -> DataFrame:
    """Events per week."""
    return report.weekly_trend(table(spark, sf_dir, "events"), "ts").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n")


QUERIES = {name: _decision(name) for name in DECISIONS} | {
    f.__name__: f
    for f in (
        has_comments, decide, reject_messages, persistent, reject_list_violations, reject_worklist, report_period, issues_by_period, top_issues, issues_by_team, weekly_trend,
    )
}

SQL = {name: _decision_sql(name) for name in DECISIONS} | {
    "has_comments": f"{_CTE} select interview__id from spoke",
    "decide": f"{_CTE} select * from dec",
    "reject_messages": f"{_CTE} select interview__id, reject_comment, interview__status from msg where action = 'reject'",
    "persistent": f"{_CTE} select * from per",
    "reject_list_violations": f"""with e as {sql(_EDITED)}
select interview__id, 'interview__id' as violation from e where not regexp_matches(interview__id, '{decisions.ID_PATTERN}')
union all select interview__id, 'interview__status' from e where interview__status not in (100, 120, 130)
union all select interview__id, 'reject_comment' from e where trim(reject_comment) = ''""",
    "reject_worklist": f"select * from {sql(_EDITED)} where interview__status in (100, 120)",
    "report_period": f"select run, strftime(period_start, '%Y-%m-%d') as period_start, strftime(period_end, '%Y-%m-%d') as period_end from ({_period_sql(sql(_RUNS))})",
    "issues_by_period": f"""{_CTE}
select strftime(period_start, '%Y-%m-%d') as period_start, count(*) as n_issues
from ({_period_sql("(select distinct 0 as run, cast(date_trunc('month', o_orderdate) as date) as run_date, cast(null as varchar) as start_text, cast(null as varchar) as end_text from orders)")}) p
join (select cast(o_orderdate as date) as day from iss join households h on h.interview__id = iss.interview__id) d on day between period_start and period_end
group by period_start""",
    "top_issues": f"{_CTE} select issue_desc, count(*) as n_issues from iss group by issue_desc order by n_issues desc, issue_desc limit 2",
    "issues_by_team": f"""{_CTE}
select r_name as "SupervisorName", issue_desc, count(*) as n_issues, count(distinct iss.interview__id) as n_interviews
from iss join households h on h.interview__id = iss.interview__id join customer on c_custkey = o_custkey
left join (select * from nation where n_nationkey <> 7) n on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey group by all""",
    "weekly_trend": "select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(*) as n from events group by 1",
}
