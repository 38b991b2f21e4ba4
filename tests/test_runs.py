"""Whole runs: digests and their stream, sketches, publishing, one plan for all tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from fieldcheck.functions import stored as S
from fieldcheck.operators import attributes, catalog, changes, decisions, report, run, sketches
from fieldcheck.operators.outliers import Check, long_measures
from fieldcheck.plans import run_queries as Q
from fieldcheck.sources import publish as P
from fieldcheck.sources import versions
from fieldcheck.streaming import actions as stream
from tests.plans import shuffled_rows

LOG = "interview__id string, date string, time string, action int, originator string, role int"
IDS = "interview__id string, interview__key string"
SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# digests -----------------------------------------------------------------------------------------------------------

EVENTS = [("a", "d1", "t1", 1, "o", 1), ("a", "d2", "t0", 1, None, 1), ("a", "d0", "t9", 5, "o", 1), ("b", "d1", "t1", 1, "o", 1), ("c", "d1", "t1", 1, "o", 2), (None, "d", "t", 1, "o", 1)]


def digest(spark, rows):
    return changes.event_digests(spark.createDataFrame(rows, LOG))


def test_digests_are_sums(spark):
    whole = rows_of(digest(spark, EVENTS))
    assert whole == rows_of(digest(spark, EVENTS[::-1]))
    assert {r[0]: r[1] for r in whole} == {"a": 2, "b": 1, "c": 1, None: 1}
    assert rows_of(changes.added_digests(digest(spark, EVENTS[:1]), digest(spark, EVENTS[1:4]), digest(spark, EVENTS[4:]))) == whole
    twice = {r[0]: r for r in rows_of(digest(spark, EVENTS * 2))}
    assert all(twice[r[0]][1:] == (2 * r[1], 2 * r[2], 2 * r[3]) for r in whole)
    assert digest(spark, []).count() == 0 and ", ".join(f"{n} {t}" for n, t in digest(spark, []).dtypes) == changes.DIGESTS


def test_the_same_changes_as_by_whole_logs(spark):
    old, new = EVENTS[:5], [*EVENTS[:3], ("b", "d3", "t1", 1, "o", 1), EVENTS[3], ("n", "d1", "t1", 1, "o", 1)]
    want = changes.updated_interviews(*(changes.event_hashes(spark.createDataFrame(x, LOG)) for x in (old, new)))
    got = changes.updated_by_digest(digest(spark, old), digest(spark, new))
    assert rows_of(got) == rows_of(want) == [("b",), ("n",)]
    assert changes.updated_by_digest(digest(spark, []), digest(spark, new)).count() == 3


def test_digests_hold_no_log_in_a_row(spark):
    plan = digest(spark, EVENTS)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan and plan.count("HashAggregate") >= 2


# stream ------------------------------------------------------------------------------------------------------------


def test_stream_reads_new_files_only_and_counts_repeats_once(spark, tmp_path):
    log, state, out = (f"{tmp_path}/{x}" for x in ("log", "state", "out"))
    batches = [EVENTS[:2] + EVENTS[3:4], [EVENTS[4], ("a", "d0", "t0", 1, "late", 1), EVENTS[0]], EVENTS[:2] + EVENTS[3:4], [("b", "d9", "t", 7, "o", 1)]]
    changed, read = [], []
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(log)
        before = {r[0]: r[1:] for r in map(tuple, stream.load_digests(spark, out).collect())} if changed else {}
        query = stream.watch_digests(spark, log, state, stream.save_digests(out))
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        after = {r[0]: r[1:] for r in map(tuple, stream.load_digests(spark, out).collect())}
        changed.append(sorted(k for k in after if after[k] != before.get(k)))
    assert changed == [["a", "b"], ["a", "c"], [], []]
    assert read == [len(rows) for rows in batches]  # no batch reads what an earlier one has read
    seen = dict.fromkeys(x for rows in batches for x in rows)
    assert rows_of(stream.load_digests(spark, out)) == rows_of(digest(spark, list(seen)))


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    handle = stream.save_digests(f"{tmp_path}/out")
    for rows in (EVENTS[:1], EVENTS[:2]):
        handle(digest(spark, rows), 0)
    assert [r["n_events"] for r in stream.load_digests(spark, f"{tmp_path}/out").collect()] == [2]


# sketches ----------------------------------------------------------------------------------------------------------


def test_merged_sketches_are_as_good_as_whole_ones(spark):
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("interview__id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 100 != 7, F.exp(F.randn(5) * 3)).alias("v")
    )
    checks = [Check("v", ("g",)), Check("v", n_mad=3)]
    parts = [sketches.threshold_sketches(rows.where(f"id % 7 in {some}"), checks) for some in ("(0)", "(1, 2)", "(3, 4, 5, 6)")]
    values = {}
    for check, key, v in long_measures(rows, checks, [], checked=False).where("value is not null").select("check_id", "key", "value").collect():
        values.setdefault((check, key), []).append(v)
    for some in (sketches.merged_sketches(*parts), sketches.threshold_sketches(rows, checks)):
        for r in sketches.sketched_thresholds(some, checks).collect():
            own = values[r["check_id"], r["key"]]
            off = lambda x, of: abs(sum(v <= x for v in of) / len(of) - 0.5)
            away = [abs(v - r["med"]) for v in own]
            assert r["n_obs"] == len(own) and off(r["med"], own) <= sketches.RANK_ERROR + 1 / len(own)
            assert off(r["mad"] / 1.4826, away) <= 2 * sketches.RANK_ERROR + 2 / sketches.STEPS
            n_mad = 3 if r["key"] == "[]" else 2
            assert r["ul"] == pytest.approx(r["med"] + n_mad * r["mad"]) and r["ll"] == pytest.approx(r["med"] - n_mad * r["mad"])


def test_sketches_of_small_and_odd_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 100.0), ("b", None), (None, 2.0), ("c", float("inf"))], "g string, v double")
    found = sketches.sketched_thresholds(sketches.threshold_sketches(rows, [Check("v", ("g",), transform="none")]), [Check("v", ("g",), transform="none")])
    got = {r["key"]: (r["n_obs"], r["med"]) for r in found.collect()}
    assert got == {'["a"]': (3, 4.0), "[null]": (1, 2.0), '["c"]': (1, float("inf"))}


# versions, indicators, attributes ----------------------------------------------------------------------------------


def test_ranks_of_sketched_medians_are_counted_where_the_rows_are(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(4000, numPartitions=4).select(
        n.alias("l_orderkey"), (n % 50).alias("l_partkey"), (n % 40).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), (n % 50 + 1.0).alias("l_quantity"), (n + 1.0).alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), F.lit(0.1).alias("l_tax"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.current_timestamp().alias("l_shipdate"),
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        found = Q.sketched_medians(spark, str(tmp_path))
        assert sum(shuffled_rows(found)) < 1000  # of 12,000 values
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["n_obs"], r["within"]) for r in found.collect()} == {(100, True), (4000, True)}


def test_versions_of_different_types(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    one = spark.createDataFrame([(1, 5, True, "x")], "id int, a int, b boolean, c string").withMetadata("a", {"label": "first"})
    two = spark.createDataFrame([(2, 2.5, 7, None)], "id long, a double, b int, c string")
    three = spark.sql("select 3 as id, 'text' as a, null as c, array(1) as d")
    got = versions.union_versions([one, two, three])
    assert dict(got.dtypes) == {"id": "bigint", "a": "string", "b": "string", "c": "string", "d": "array<int>"}
    assert rows_of(got) == [(1, "5", "true", "x", None), (2, "2.5", "7", None, None), (3, "text", None, None, [1])]
    assert got.schema["a"].metadata == {"label": "first"}
    assert rows_of(versions.widening_report(spark, [one, two, three])) == [
        ("a", 1, "int", "string"), ("a", 2, "double", "string"), ("b", 1, "boolean", "string"), ("b", 2, "int", "string"), ("c", 3, "void", "string"), ("id", 1, "int", "bigint"), ("id", 3, "int", "bigint"),
    ]
    assert versions.widening_report(spark, [one]).count() == 0


def test_weeks_without_rows(spark):
    rows = [("x", "2024-01-01 10:00:00", 2), ("x", "2024-01-22 00:00:00", 5), ("x", "2024-01-28 23:59:59", 1), ("y", "2024-01-09 00:00:00", 4), ("y", None, 9), (None, "2024-01-15 00:00:00", 1)]
    events = spark.createDataFrame(rows, "g string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = report.weekly_indicators(events, "ts", {"v": F.col("v"), "n": F.lit(1)}, ("g",))
    x = [(str(r["week"]), r["v"], r["v_total"], r["v_change"], r["n"]) for r in got.where("g = 'x'").orderBy("week").collect()]
    assert x == [("2024-01-01", 2, 2, None, 1), ("2024-01-08", 0, 2, -2, 0), ("2024-01-15", 0, 2, 0, 0), ("2024-01-22", 6, 8, 6, 2)]
    assert got.count() == 12 and got.where("g is null").agg(F.sum("v")).first()[0] == 1
    whole = report.weekly_indicators(events, "ts", {"n": F.lit(1)}, last=("2024-01-08", "2024-02-01"))
    assert [(str(r["week"]), r["n"]) for r in whole.orderBy("week").collect()] == [("2024-01-08", 1), ("2024-01-15", 1), ("2024-01-22", 2), ("2024-01-29", 0)]
    assert report.weekly_indicators(events.where("false"), "ts", {"n": F.lit(1)}).count() == 0


def test_attributes_read_each_table_once(spark, tmp_path):
    tables = Q.C.survey(spark, SMALL)
    paths = versions.write_tables(tables, str(tmp_path))
    stored = {name: spark.read.parquet(p) for name, p in zip(tables, paths, strict=True)}
    got = attributes.create_attributes(stored)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(tables)
    assert rows_of(got) == rows_of(attributes.create_attributes(tables))
    with pytest.raises(ValueError, match="nothing"):
        attributes.planned(tables, [attributes.spec("any_obs", "nothing", "a", where="true")])
    with pytest.raises(ValueError, match="one row"):
        attributes.planned(tables, [attributes.spec("count_vars", "members", "a", var_pattern="x")])


# decisions ---------------------------------------------------------------------------------------------------------


def test_messages_sent_before(spark):
    chosen = spark.createDataFrame(
        [("a", "m1 ## m2", 100), ("b", "m2 ## m1", 100), ("c", "m1 ## new", 100), ("d", "new", 100), ("e", None, 100), ("f", "m1", 100)], "interview__id string, reject_comment string, interview__status int"
    )
    said = [("a", None, 3, "m1 ## m2"), ("b", None, 3, "m1 ## m2"), ("c", None, 3, "m0 ## m1"), ("c", None, 3, "m1"), ("d", None, 3, "newer"), ("e", None, 3, None), ("f", "v", 3, "m1"), ("f", None, 1, "m1")]
    got = decisions.sent_before(spark.createDataFrame(said, "interview__id string, variable string, role int, comment string"), chosen)
    assert {r[0]: tuple(r)[3:] for r in got.collect()} == {"a": (2, 2, True), "b": (2, 2, True), "c": (2, 1, True), "d": (1, 0, False), "e": (0, 0, False), "f": (1, 0, False)}


# publishing --------------------------------------------------------------------------------------------------------


def test_readers_see_whole_runs(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    table = lambda n: {"a": spark.range(n), "b": spark.range(10 * n)}
    assert P.current_version(spark, folder) is None and P.published(spark, folder, "a") is None
    P.publish(spark, table(1), folder, "one", ("a",))
    assert P.current_version(spark, folder) == "one" and P.published(spark, folder, "b").count() == 10
    assert spark.read.option("header", True).csv(f"{folder}/versions/one/edit/a").count() == 1

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(P, "_point", stop)
        with pytest.raises(OSError):
            P.publish(spark, table(2), folder, "two")
    assert P.current_version(spark, folder) == "one" and P.published(spark, folder, "a").count() == 1
    P.publish(spark, table(3), folder, "two")
    assert (P.current_version(spark, folder), P.published(spark, folder, "a").count(), P.published(spark, folder, "b").count()) == ("two", 3, 30)
    for wrong in ("two", "", "a/b", ".x"):
        with pytest.raises(ValueError):
            P.publish(spark, table(1), folder, wrong)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".CURRENT-")]


def survey(spark, log):
    ids = [f"i{n}" for n in range(50)]
    homes = spark.createDataFrame(
        [(i, i.upper(), 100 if n % 2 == 0 else 65, 1, 10.0 + n % 5 if n else 1e6, 1 if n % 4 else 0, 1) for n, i in enumerate(ids)], f"{IDS}, interview__status int, interview_result int, hh12_q09 double, hh08_q04__1 int, hh14_q02__1 int"
    )
    members = spark.createDataFrame([(i, i.upper(), 1, *(0,) * 7) for i in ids], f"{IDS}, hh01_q03 int, " + ", ".join(f"{m} int" for m in attributes.MEALS))
    bought = {t: spark.createDataFrame([(i, i.upper(), 1) for i in ids], f"{IDS}, {v} int") for _, t, v in attributes.PURCHASES}
    stats = spark.createDataFrame([(i, i.upper(), 0, 0, 0) for i in ids], f"{IDS}, n_questions_unanswered int, questions__comments int, entities__errors int")
    remarks = spark.createDataFrame([("i8", None, 1, "fine"), ("i12", None, 3, "ERROR: no food was eaten, neither at home nor elsewhere. ## old")], "interview__id string, variable string, role int, comment string")
    return {"households": homes, "members": members, **bought, run.DIAGNOSTICS: stats, run.COMMENTS: remarks, run.ACTIONS: spark.createDataFrame(log, LOG)}


def test_two_runs_with_a_tracker(spark, tmp_path, monkeypatch):
    folder, settings = f"file://{tmp_path}", run.Settings(checks={"households": [Check("hh12_q09")]})
    log = [(f"i{n}", "d", "t", 1, "o", 1) for n in range(40)]
    first = run.validate(spark, survey(spark, log), folder, "1", settings)
    ids = lambda df: {r[0] for r in df.select("interview__id").collect()}
    even = {f"i{n}" for n in range(0, 40, 2)}
    assert ids(first["interviews_validated"]) == even
    hungry = {f"i{n}" for n in range(0, 40, 4)}
    assert ids(first["to_reject_api"]) == hungry - {"i8", "i12"}
    assert ids(first["to_review_api"]) == {"i8"} and ids(first["to_follow_up_api"]) == {"i12"}
    assert ids(P.published(spark, folder, "to_reject_ids")) == hungry - {"i8", "i12"}
    far = first["issues"].where("issue_vars = 'hh12_q09'").collect()
    assert {r["interview__id"] for r in far} == {"i0"} and "1,000,000.00" in far[0]["issue_comment"] and far[0]["issue_comment"].startswith("light bulbs")
    edited = versions.read_rejections(spark, f"{folder}/versions/1/edit/to_reject_api")
    assert ids(edited) == hungry - {"i8", "i12"}

    assert run.validate(spark, survey(spark, log), folder, "2", settings) is None and P.current_version(spark, folder) == "1"
    more = [*log, ("i4", "d2", "t", 1, "o", 1), ("i6", "d2", "t", 5, "o", 1), ("i44", "d", "t", 1, "o", 1), ("i45", "d", "t", 1, "o", 1)]

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(P, "_point", stop)
        with pytest.raises(OSError):
            run.validate(spark, survey(spark, more), folder, "2", settings)
    assert P.current_version(spark, folder) == "1" and ids(P.published(spark, folder, "interviews_validated")) == even
    second = run.validate(spark, survey(spark, more), folder, "2", settings)
    assert ids(second["interviews_validated"]) == {"i4", "i44"}
    assert ids(P.published(spark, folder, "tracker")) == {f"i{n}" for n in range(40)} | {"i44", "i45"}
    assert run.validate(spark, survey(spark, more), folder, "3", settings) is None


# one plan for all tables -------------------------------------------------------------------------------------------


def jobs(spark, work):
    """How many Spark jobs a piece of work starts."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setJobGroup("rest", "rest")


def test_jobs_do_not_grow_with_the_tables(spark):
    tables = Q.survey(spark, SMALL)
    count = lambda names: jobs(spark, lambda: catalog.outlier_issues(tables, tables, {t: Q.CHECKS[t] for t in names}))
    assert len(Q.TABLES) >= 6 and sum(map(len, Q.CHECKS.values())) >= 12
    assert count(["r_assets"]) == count(list(Q.TABLES)) > 0


def test_stored_refuses_a_folder_of_one_machine(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://x:7077", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_folder(Session())
    assert S.shared_folder(spark).startswith("file:")


def test_stored_rows_can_be_discarded(spark):
    from pathlib import Path

    df = S.stored(spark.range(5).withColumnRenamed("id", "a b"))
    at = Path(S.own_folder(spark).removeprefix("file:"))
    assert df.count() == 5 and at.exists()
    S.discard_stored(spark)
    assert not at.exists()
    S.discard_stored(spark)
    assert S.stored(spark.range(3)).count() == 3
