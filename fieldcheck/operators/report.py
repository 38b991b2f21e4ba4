"""Report periods and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report_period(start: Column, end: Column, run_date: Column, boundary_day: int = 5) -> tuple[Column, Column]:
    """Start and end date of the period that a run on ``run_date`` reports.

    Given dates (text of the form 2024-01-31) hold if both can be read. Else both are inferred: up to the day before
    ``boundary_day`` (Monday is 1) it is the week before, Monday to Sunday, from then on this week up to the run. A
    start behind its end gives null for both.
    """
    if not 1 <= boundary_day <= 7:
        raise ValueError(f"a day of the week is between 1 and 7, not {boundary_day}")
    first, last = (F.try_to_date(F.trim(c), "yyyy-MM-dd") for c in (start, end))
    given = first.isNotNull() & last.isNotNull()
    monday = F.date_trunc("week", run_date).cast("date")
    early = F.weekday(run_date) + 1 < boundary_day
    out_first = F.when(given, F.when(first <= last, first)).otherwise(F.when(early, F.date_sub(monday, 7)).otherwise(monday))
    out_last = F.when(given, F.when(first <= last, last)).otherwise(F.when(early, F.date_sub(monday, 1)).otherwise(run_date.cast("date")))
    return out_first, out_last


def in_periods(issues: DataFrame, periods: DataFrame, day: str) -> DataFrame:
    """Rows with each period that their day lies in: periods are spelled out to days, so the join is on equal days."""
    days = periods.withColumn("_day", F.explode(F.expr("sequence(period_start, period_end)")))
    return issues.join(days, issues[day] == days["_day"]).drop("_day")


def top_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent descriptions; ties by description."""
    return issues.groupBy("issue_desc").agg(F.count("*").alias("n_issues")).orderBy(F.desc("n_issues"), "issue_desc").limit(k)


def issues_by_team(issues: DataFrame, interviewers: DataFrame, team: DataFrame) -> DataFrame:
    """(SupervisorName, issue_desc, n_issues, n_interviews); interviews of unknown interviewers under a null name.

    ``interviewers`` has interview__id and originator, ``team`` UserName and SupervisorName.
    """
    who = interviewers.select("interview__id", "originator").join(team.select(F.col("UserName").alias("originator"), "SupervisorName"), "originator", "left")
    joined = issues.join(who, "interview__id", "left")
    return joined.groupBy("SupervisorName", "issue_desc").agg(F.count("*").alias("n_issues"), F.countDistinct("interview__id").alias("n_interviews"))


def weekly_trend(events: DataFrame, ts: str) -> DataFrame:
    """(week, n): rows per week, by the date of its Monday."""
    return events.groupBy(F.date_trunc("week", F.col(ts)).cast("date").alias("week")).agg(F.count("*").alias("n"))


def weekly_indicators(events: DataFrame, ts: str, indicators: dict[str, Column], by: tuple[str, ...] = (), last: tuple[str, str] | None = None) -> DataFrame:
    """Per week, of each group of ``by``, every indicator's value, its running total and its change to the week before: columns name, name_total, name_change.

    ``indicators`` has the value that a row adds. Weeks go from the earliest one of all rows to the latest one (or between the two dates of ``last``, outer rows left
    out), for every group that has rows; a week without rows, or with nulls only, has the value 0. The first week has no change. Rows without a time are left out.
    Rows are summed up before anything else, so what follows holds one row per week and group.
    """
    week = F.date_trunc("week", F.col(ts)).cast("date")
    found = events.where(F.col(ts).isNotNull()).groupBy(week.alias("week"), *by).agg(*[F.sum(c).alias(name) for name, c in indicators.items()])
    if last:
        first, end = (F.date_trunc("week", F.lit(d).cast("date")).cast("date") for d in last)
        found = found.where(F.col("week").between(first, end))
        ends = found.groupBy(*by).agg(F.lit(1).alias("_one")).select(*by, first.alias("_from"), end.alias("_to"))
    else:
        # every group gets the ends of all groups, by way of a window over the weeks that are left
        whole = Window.partitionBy(F.lit(0))
        ends = found.groupBy(*by).agg(F.min("week").alias("_from"), F.max("week").alias("_to"))
        ends = ends.select(*by, F.min("_from").over(whole).alias("_from"), F.max("_to").over(whole).alias("_to"))
    spine = ends.select(*by, F.explode(F.sequence("_from", "_to", F.expr("interval 7 days"))).alias("week"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    joined = spine.alias("s").join(found.alias("f"), [F.col("s.week") == F.col("f.week"), *same], "left")
    filled = joined.select("s.week", *[f"s.{c}" for c in by], *[F.coalesce(f"f.{name}", F.lit(0)).alias(name) for name in indicators])
    order = Window.partitionBy(*by).orderBy("week")
    more = [x for name in indicators for x in (F.sum(name).over(order).alias(f"{name}_total"), (F.col(name) - F.lag(name).over(order)).alias(f"{name}_change"))]
    return filled.select("*", *more)


def period_indicators(events: DataFrame, day: str, indicators: dict[str, Column], periods: DataFrame) -> DataFrame:
    """(period_start, period_end, name of each indicator): sums over the rows whose day lies in each period, 0 for a period without rows. A row counts in every period that its day lies in."""
    per_day = events.groupBy(F.col(day).cast("date").alias("_day")).agg(*[F.sum(c).alias(name) for name, c in indicators.items()])
    days = periods.select("period_start", "period_end").distinct().withColumn("_on", F.explode(F.expr("sequence(period_start, period_end)")))
    joined = days.join(per_day, F.col("_on") == F.col("_day"), "left")
    return joined.groupBy("period_start", "period_end").agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in indicators])
