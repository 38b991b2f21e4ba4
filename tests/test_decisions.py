import datetime

import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import decisions as D
from fieldcheck.operators import report
from fieldcheck.operators.outliers import ISSUES
from fieldcheck.sources import versions

CASES = [(c, c.upper(), 100) for c in "abcdefg"]
ROWS = [
    ("a", "A", 1, "d", "bad", "v, w", None), ("a", "A", 1, "d", "bad", "v, w", None), ("a", "A", 2, "d", "look", "z", "[1]"),
    ("b", "B", 1, "d", "bad", "v", None), ("c", "C", 1, "d", "bad", "v", None), ("d", "D", 4, "d", "odd", "v", None),
    ("e", "E", 2, "d", "look", "v", "[1]"), ("g", "G", 1, "d", "bad", "v", None), ("g", "G", 1, "d", "also", "v", None),
]
COMMENTS = [("b", "v", 1, "because"), ("a", "other", 1, "x"), ("c", None, 3, "bad"), ("g", None, 3, "bad"), ("e", None, 1, "fine")]


@pytest.fixture(scope="module")
def made(spark):
    cases = spark.createDataFrame(CASES, "interview__id string, interview__key string, interview__status int")
    issues = spark.createDataFrame(ROWS, ISSUES)
    comments = spark.createDataFrame(COMMENTS, "interview__id string, variable string, role int, comment string")
    stats = cases.select("interview__id", F.when(F.col("interview__id") == "f", 2).otherwise(0).alias("Invalid"))
    return cases, issues, comments, stats


def ids(df):
    return sorted(r["interview__id"] for r in df.collect())


def test_comments_that_count(made):
    cases, issues, comments, _ = made
    assert ids(D.has_comments(comments, issues, cases)) == ["b", "e"]


def test_nine_tables(made):
    cases, issues, comments, stats = made
    got = D.create_decisions(cases, issues, comments, stats, [1, 3])
    assert ids(got["to_reject_ids"]) == ["a", "f", "g"]  # f for its invalid answers
    assert ids(got["to_review_ids"]) == ["b", "d"]
    assert ids(got["to_follow_up_ids"]) == ["c"]
    api = {r["interview__id"]: r["reject_comment"] for r in got["to_reject_api"].collect()}
    assert api == {"a": "bad", "f": None, "g": "also ## bad"}
    assert ids(got["to_reject_issues"]) == ["a", "a", "a", "g", "g"]
    assert ids(got["to_review_issues"]) == ["b", "d"]
    assert [tuple(r) for r in got["to_follow_up_api"].select(*D.API).collect()] == [("c", "bad", 100)]
    assert ids(got["to_follow_up_issues"]) == ["c"]
    assert tuple(got["to_reject_api"].columns) == D.API


def test_system_errors_only_if_they_reject(made):
    cases, issues, comments, stats = made
    decided = D.decide(cases, issues, [1], D.has_comments(comments, issues, cases), stats)
    assert {r["interview__id"]: r["action"] for r in decided.collect()}["f"] is None


def test_rejection_lists(spark, tmp_path):
    good = "0123456789abcdef0123456789abcdef"
    rows = [(good, "why", 100), ("xyz", "why", 100), (good, " ", 99), (None, None, None)]
    df = spark.createDataFrame(rows, versions.REJECTIONS)
    got = sorted((r[0] or "", r[1]) for r in D.list_violations(df).collect())
    assert got == sorted([("xyz", "interview__id"), (good, "interview__status"), (good, "reject_comment"), ("", "interview__id"), ("", "interview__status"), ("", "reject_comment")])
    assert D.rejection_worklist(df, [100]).count() == 2
    with pytest.raises(ValueError, match="order"):
        D.list_violations(df.select("reject_comment", "interview__id", "interview__status"))
    path = versions.write_table(df.limit(2), str(tmp_path), "list", "csv")
    assert ids(versions.read_rejections(spark, path)) == [good, "xyz"]
    wrong = versions.write_table(df.select("interview__status", "interview__id", "reject_comment"), str(tmp_path), "wrong", "csv")
    with pytest.raises(ValueError, match="order"):
        versions.read_rejections(spark, wrong)


def period(spark, start, end, day, boundary=5):
    df = spark.createDataFrame([(start, end, day)], "s string, e string, d date")
    a, b = report.report_period(F.col("s"), F.col("e"), F.col("d"), boundary)
    return tuple(str(x) for x in df.select(a, b).first())


def test_report_periods(spark):
    wednesday, friday, sunday = (datetime.date(2024, 3, k) for k in (27, 29, 31))
    assert period(spark, None, None, wednesday) == ("2024-03-18", "2024-03-24")
    assert period(spark, "x", "2024-01-01", friday) == ("2024-03-25", "2024-03-29")
    assert period(spark, None, None, sunday) == ("2024-03-25", "2024-03-31")
    assert period(spark, " 2024-01-05", "2024-01-09 ", wednesday) == ("2024-01-05", "2024-01-09")
    assert period(spark, "2024-01-09", "2024-01-05", wednesday) == ("None", "None")
    assert period(spark, None, None, wednesday, 3) == ("2024-03-25", "2024-03-27")
    with pytest.raises(ValueError):
        report.report_period(F.lit(None), F.lit(None), F.lit(None), 8)


def test_top_issues_break_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "issue_desc string")
    assert [tuple(r) for r in report.top_issues(df, 2).collect()] == [("c", 2), ("a", 1)]
