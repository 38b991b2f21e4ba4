import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import attributes as A
from fieldcheck.operators import changes, derive, issues, messages, select
from fieldcheck.sources import archive, versions
from tests.plans import shuffled_rows

IDS = "interview__id string, interview__key string"


def values(df):
    return {r["interview__id"]: r["attrib_val"] for r in df.collect()}


def test_attributes_of_rows(spark):
    homes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], IDS)
    rows = spark.createDataFrame([("a", "A", 1, 2.0), ("a", "A", 1, None), ("b", "B", None, 5.0)], IDS + ", x int, y double")
    assert values(A.count_obs(rows, "x = 1", "n", "x", homes)) == {"a": 2, "b": 0, "c": 0}
    assert values(A.count_obs(rows, "x = 1", "n", "x")) == {"a": 2, "b": 0}
    assert values(A.any_obs(rows, F.col("y") > 3, "n", "y", homes)) == {"a": 0, "b": 1, "c": 0}
    assert values(A.sum_vals(rows, "y", "n", cases=homes)) == {"a": 2, "b": 5, "c": 0}


def test_attributes_of_columns(spark):
    df = spark.createDataFrame([("a", "A", 1, 0, "##N/A##", "x"), ("b", "B", None, None, None, ""), ("c", "C", 1, 1, "p", "q")], IDS + ", Q__1 int, q__2 int, t__1 string, t__2 string")
    assert values(A.count_vars(df, "^q__", "n")) == {"a": 1, "b": 0, "c": 2}
    assert values(A.any_vars(df, "^q__", "n", 0)) == {"a": 1, "b": 0, "c": 0}
    assert values(A.count_list(df, "^t__", "n")) == {"a": 1, "b": 0, "c": 2}
    assert values(A.extract_attribute(df, "q__2", "n")) == {"a": 0, "b": None, "c": 1}
    assert values(A.create_attribute(df, "q__2 = 1", "n", "q")) == {"a": 0, "b": 0, "c": 1}
    assert values(A.from_spec({"t": df}, "count_vars", "t", var_pattern="^q__", name="n")) == {"a": 1, "b": 0, "c": 2}
    with pytest.raises(ValueError, match="operator"):
        A.from_spec({"t": df}, "nothing", "t")
    with pytest.raises(ValueError, match="table"):
        A.from_spec({"t": df}, "count_vars", "u")


def test_unanswered(spark):
    cases = spark.createDataFrame([("a", "A", 1), ("b", "B", 1), ("c", "C", 0)], IDS + ", interview_complete int")
    stats = spark.createDataFrame([("a", 0), ("b", 3), ("c", 3)], "interview__id string, NotAnswered int")
    assert [(r[0], r["issue_comment"][-1]) for r in issues.unanswered_issues(cases, stats).collect()] == [("b", "3")]
    assert issues.unanswered_issues(cases, stats, 3).count() == 0


def test_messages(spark):
    assert messages.text("no_head.desc", "fr") != messages.text("no_head.desc")
    with pytest.raises(KeyError, match="no message"):
        messages.text("nothing")
    with pytest.raises(KeyError, match="de"):
        messages.text("no_head.desc", "de")
    df = spark.createDataFrame([("no_head.desc",), ("nothing",)], "path string")
    every = messages.catalogue(spark)
    assert [r["path"] for r in messages.missing_messages(df, every, "path", "en").collect()] == ["nothing"]
    assert messages.missing_messages(df, every, "path", "de").count() == 2
    assert {r["t"] for r in messages.with_message(df, every, "path", "en", "t").collect()} == {messages.text("no_head.desc"), None}
    assert all(set(t) == set(messages.LANGUAGES) for t in messages.TEXTS.values())


def test_daily_rates_and_groups(spark):
    df = spark.createDataFrame([("a", 90.0, u) for u in (1, 2, 3, 4, 5, 6, 7, None)], "interview__id string, x double, u int")
    got = [r[0] for r in df.select(derive.daily(F.col("x"), F.col("u"))).collect()]
    assert got == pytest.approx([90, 90 / 7, 90 / 14, 3, 1, 90 / 365.25, 90, 90])
    animals = spark.createDataFrame([("a", 11, 2), ("a", 12, 3), ("b", 13, 7), ("a", 99, 5), ("a", 21, None)], "interview__id string, k int, n int")
    costs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 8), ("b", 1)], "interview__id string, g int")
    total = lambda per: {(r[0], r[1]): r[2] for r in derive.with_group_sum(costs, "g", animals, "k", "n", derive.ANIMAL_GROUPS, "s", per).collect()}
    assert total(True) == {("a", 1): 5, ("a", 2): 0, ("a", 8): None, ("b", 1): 7}
    assert total(False) == {("a", 1): 12, ("a", 2): 0, ("a", 8): None, ("b", 1): 12}


LOG = "interview__id string, date string, time string, action int, originator string, role int"


def test_hashes_and_changes(spark):
    rows = [("a", "d1", "t1", 1, "o", 1), ("a", "d2", "t0", 1, None, 1), ("a", "d0", "t9", 5, "o", 1), ("b", "d1", "t1", 1, "o", 1), ("c", "d1", "t1", 1, "o", 2)]
    old = changes.event_hashes(spark.createDataFrame(rows, LOG))
    assert {r[0]: r[1] for r in old.collect()}["a"] == "d1|t1|1|o|1||d2|t0|1|NA|1"
    assert sorted(old.collect()) == sorted(changes.event_hashes(spark.createDataFrame(rows[::-1], LOG)).collect())
    new = changes.event_hashes(spark.createDataFrame([*rows[:3], ("b", "d3", "t1", 1, "o", 1), rows[3], ("n", "d1", "t1", 1, "o", 1)], LOG))
    assert sorted(r[0] for r in changes.updated_interviews(old, new).collect()) == ["b", "n"]
    assert changes.updated_interviews(old.where("false"), new).count() == 3


def test_completed_and_filtered(spark):
    main = spark.createDataFrame([("a", "A", 100, 1), ("b", "B", 120, 2), ("c", "C", 65, 1), ("d", "D", 130, None)], IDS + ", interview__status int, r int")
    done = select.completed(main, [100, 120, 130], "r = 1")
    assert [tuple(r) for r in done.collect()] == [("a", "A", 1, 100)]
    got = select.filter_tables({"m": main, "x": main.select("interview__id")}, done.unionByName(done))
    assert {k: df.count() for k, df in got.items()} == {"m": 1, "x": 1}
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        select.completed(main, [100], "nothing = 1")


def test_many_interviews_go_through_a_sieve(spark, monkeypatch):
    """Few rows of others are shuffled to the interviews, and none of theirs is lost."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 != 3, F.col("id").cast("string")).alias("interview__id"), "id")
    some = spark.range(0, 20_000, 40).select(F.when(F.col("id") != 80, F.col("id").cast("string")).alias("interview__id"))
    want = sorted(r["id"] for r in rows.join(some, "interview__id", "left_semi").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = {}
        for least in (501, 500):
            monkeypatch.setattr(select, "SIEVED", least)
            own = select.filter_tables({"x": rows}, some, sieved=True)["x"]
            assert sorted(r["id"] for r in own.collect()) == want
            sent[least] = sum(shuffled_rows(own))
        assert sent[500] < sent[501] / 3
        assert select.filter_tables({"x": rows}, some.where("false"), sieved=True)["x"].count() == 0
        monkeypatch.setattr(select, "SIEVE_MOST", 64)
        assert sorted(r["id"] for r in select.filter_tables({"x": rows}, some, sieved=True)["x"].collect()) == want
        monkeypatch.setattr(select, "SIEVED", 0)
        assert select.filter_tables({"x": rows}, some.where("false"), sieved=True)["x"].count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_archives(spark):
    entries = {
        "dta": [("a.dta", "file"), ("b.dta", "file")],
        "dirs": [("v1/", "directory"), ("v1/a.dta", "file"), ("export__readme.txt", "file"), ("Questionnaire/q.pdf", "file")],
        "zips": [("a.zip", "file")],
        "mix": [("a.zip", "file"), ("b.dta", "file")],
    }
    manifest = spark.createDataFrame([(k, f, t) for k, es in entries.items() for f, t in es], "archive string, filename string, type string")
    names = spark.createDataFrame([(k,) for k in (*entries, "empty")], "archive string")
    got = {r[0]: r[1] for r in archive.archive_class(names, manifest).collect()}
    assert got == {"dta": "dta_files", "dirs": "folders", "zips": "zips", "mix": None, "empty": "dta_files"}


def test_versions(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "id int, a string").withMetadata("a", {"label": "first"})
    two = spark.createDataFrame([(2, 5)], "id int, b int")
    one.write.parquet(f"{tmp_path}/in/v1/main.parquet")
    two.write.parquet(f"{tmp_path}/in/v2/main.parquet")
    two.write.parquet(f"{tmp_path}/in/v2/members.parquet")
    assert [n for _, n in versions.inventory(spark, f"{tmp_path}/in")] == ["main", "main", "members"]
    got = versions.combine_versions(spark, f"{tmp_path}/in")
    assert {tuple(r) for r in got["main"].collect()} == {(1, "x", None), (2, None, 5)}
    assert got["main"].schema["a"].metadata == {"label": "first"}
    assert set(versions.ingest(got | {"assignment__actions": two}, "main", "members")) == {"households", "members"}
    with pytest.raises(ValueError):
        versions.ingest(got, "main", "nobody")
    paths = versions.write_tables(got, f"{tmp_path}/out")
    assert spark.read.parquet(paths[0]).count() == 2
    assert versions.data_timestamp(spark.read.parquet(paths[0])).first()[0] is not None


def test_trackers(spark, tmp_path):
    folder = f"{tmp_path}/trackers"
    with pytest.raises(ValueError, match="no such folder"):
        versions.load_tracker(spark, folder)
    (tmp_path / "trackers").mkdir()
    assert versions.load_tracker(spark, folder).count() == 0
    new = changes.event_hashes(spark.createDataFrame([("a", "d", "t", 1, "o", 1)], LOG))
    versions.save_tracker(new, folder, "run1")
    assert versions.load_tracker(spark, folder).collect() == new.collect()
    versions.save_tracker(new, folder, "run2")
    with pytest.raises(ValueError, match="several"):
        versions.load_tracker(spark, folder)


def test_team_labels(spark):
    df = spark.createDataFrame([("1", "u", "2", "s", "Interviewer", 9)], "UserId string, UserName string, SupervisorId string, SupervisorName string, Role string, x int")
    assert versions.team_table(df).schema["UserName"].metadata == {"label": "Interviewer"}


def test_stream_of_actions(spark, tmp_path):
    from fieldcheck.streaming.actions import watch_actions

    state = {"tracker": changes.event_hashes(spark.createDataFrame([], LOG)), "seen": []}

    def handle(changed, hashes):
        ids = sorted(r[0] for r in changed.collect())
        state["seen"].append(ids)
        known = [tuple(r) for r in state["tracker"].join(hashes, "interview__id", "left_anti").collect()] + [tuple(r) for r in hashes.collect()]
        state["tracker"] = spark.createDataFrame(known, changes.TRACKER)

    for rows in ([("a", "d1", "t", 1, "o", 1), ("b", "d1", "t", 1, "o", 1)], [("a", "d2", "t", 1, "o", 1), ("b", "d2", "t", 7, "o", 1), ("c", "d1", "t", 1, "o", 1)]):
        spark.createDataFrame(rows, LOG).write.mode("append").parquet(f"{tmp_path}/log")
        watch_actions(spark, f"{tmp_path}/log", f"{tmp_path}/state", lambda: state["tracker"], handle).awaitTermination()
    assert state["seen"] == [["a", "b"], ["a", "c"]]
