import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import thresholds as T
from fieldcheck.operators.outliers import Check, flagged, identify_outliers, thresholds
from tests.plans import shuffled_rows

INF = float("inf")


def found_by(spark, path, values):
    rows = spark.createDataFrame([(k, float(v)) for k, v in values], "k string, value double").repartition(3)
    found = {"row": T.in_one_row, "rank": T.by_rank}[path](rows, ["k"])
    return {r["k"]: (r["n"], r["median"], r["deviation"]) for r in found.collect()}


def brute(values):
    med = statistics.median(values)
    away = [abs(v - med) for v in values]
    away = [d for d in away if d == d]
    return len(values), med, statistics.median(away) if away else None


@pytest.mark.parametrize("path", ["row", "rank"])
@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_median_is_exact_whatever_the_distribution(spark, path, coalesced):
    rng = random.Random(5)
    groups = {
        "one": [3.0], "two": [1.0, 4.0], "same": [2.0] * 5, "ties": [1.0, 1.0, 2.0, 2.0], "far": [10.0**k for k in range(-9, 9)],
        "crowd": [rng.random() for _ in range(200)] + [1e12], "inf": [1.0, 2.0, INF, INF, INF], "low": [-INF, -INF, 0.0, 5.0], "wide": [-1e308, 1e308, 0.0],
        "": [float(rng.randrange(3)) for _ in range(501)], "even": [float(rng.randrange(1000)) for _ in range(500)], "mirror": [-1.0, 1.0] * 40,
    }
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        got = found_by(spark, path, [(k, v) for k, vs in groups.items() for v in vs])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: brute(vs) for k, vs in groups.items()}


def test_large_and_small_groups_together(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 40)
    rng = random.Random(6)
    groups = {f"g{k}": [rng.lognormvariate(0, 2) for _ in range(n)] for k, n in enumerate((1, 39, 40, 41, 42, 333))}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, value double")
    got = {r["k"]: (r["n"], r["median"], r["deviation"]) for r in T.deviations(rows, ["k"]).collect()}
    assert got == {k: brute(vs) for k, vs in groups.items()}
    assert T.deviations(rows.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("tail", ["far", "equal"])
def test_a_hot_group_spreads_over_tasks(spark, tail):
    """One key of a million values: nearly all of them close together and one of 1e300, or most of them equal."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    value = F.when(F.col("id") == 7, 1e300).otherwise(F.exp(F.randn(3))) if tail == "far" else F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5.0)
    rows = spark.range(1_000_000).select(F.lit("[]").alias("k"), value.cast("double").alias("value"), F.col("id").alias("tie"))
    try:
        placed = T.ranged(rows, ["k"])
        sizes = sorted(r["count"] for r in placed.groupBy(F.shiftright("at", 33)).count().collect())
        (row,) = T.by_rank(rows.drop("tie"), ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and sizes[-1] <= 2 * statistics.median(sizes) and sum(sizes) == 1_000_000
    med = rows.agg(F.expr("percentile(value, 0.5)")).first()[0]
    mad = rows.agg(F.expr(f"percentile(abs(value - {med!r}d), 0.5)")).first()[0]
    assert (row["n"], row["median"], row["deviation"]) == (1_000_000, pytest.approx(med), pytest.approx(mad))


def test_a_bracket_that_misses_the_middle_costs_nothing_but_time(spark, monkeypatch):
    rng = random.Random(7)
    values = [("a", rng.random()) for _ in range(300)] + [("b", float(rng.randrange(4))) for _ in range(301)] + [("c", INF)] * 3
    monkeypatch.setattr(T, "brackets", lambda rows, keys: rows.groupBy(*keys).agg(F.count("*").alias("n"), F.lit(0.9).alias("low"), F.lit(1.0).alias("high")))
    assert found_by(spark, "rank", values) == {k: brute([v for g, v in values if g == k]) for k in "abc"}


def test_lists_of_values_go_by_one_number_not_by_the_keys(spark):
    rows = spark.createDataFrame([("c", f"g{n % 40}", float(n)) for n in range(1200)], "check_id string, key string, value double")
    plan = T.deviations(rows, ["check_id", "key"])._jdf.queryExecution().executedPlan().toString()
    lists = [line for line in plan.splitlines() if "collect_list" in line]
    assert lists and all("_group" in line and "check_id" not in line for line in lists)


@pytest.mark.parametrize("size", [10_000, 40])
def test_groups_of_the_same_number_are_kept_apart(spark, monkeypatch, size):
    seeds = []
    whole = T.numbered

    def two_alike(keys, seed):
        seeds.append(seed)
        return F.when(F.col("k") != "c", whole(keys, seed)).otherwise(F.lit(7).cast("bigint")) if seed else F.length("k").cast("bigint")

    monkeypatch.setattr(T, "numbered", two_alike)
    monkeypatch.setattr(T, "GROUP", size)
    rng = random.Random(8)
    groups = {k: [rng.random() for _ in range(n)] for k, n in (("a", 30), ("b", 60), ("c", 45))}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, value double")
    got = {r["k"]: (r["n"], r["median"], r["deviation"]) for r in T.deviations(rows, ["k"]).collect()}
    assert got == {k: brute(vs) for k, vs in groups.items()}
    assert max(seeds) == 1


def test_rows_of_a_large_group_are_not_shuffled_to_its_limits(spark, monkeypatch):
    df = lines(spark, normal("a", 3000) + [("a", 1e6)])
    assert sum(shuffled_rows(flagged(df, df, [Check("v")], []))) < 3000  # few groups
    monkeypatch.setattr(T, "GROUP", 50)
    df = lines(spark, normal("a", 3000) + [("a", 1e6)] + [x for k in range(60) for x in normal(f"g{k}", 31, k) + [(f"g{k}", 1e6)]])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    try:
        found = flagged(df, df, [Check("v", ("g",), n_mad=9)], ["g"])
        assert sum(shuffled_rows(found)) < 3000  # many groups, which are shuffled, and a large one
        assert sorted(r["g"] for r in found.collect() if r["raw"] == 1e6) == sorted(["a", *(f"g{k}" for k in range(60))])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def lines(spark, rows):
    return spark.createDataFrame([(f"i{n}", f"k{n}", n, g, v) for n, (g, v) in enumerate(rows)], "interview__id string, interview__key string, row__id int, g string, v double")


def normal(g, n, seed=1):
    rng = random.Random(seed)
    return [(g, 100 * rng.lognormvariate(0, 0.1)) for _ in range(n)]


def test_group_sizes_null_groups_and_strict_bounds(spark):
    rows = normal("a", 29) + [("a", 1e9)] + normal("b", 28) + [("b", 1e9)] + normal(None, 40, 2) + [(None, 1e9)]
    df = lines(spark, rows)
    hits = {(r["g"], r["raw"]) for r in flagged(df, df, [Check("v", ("g",), n_mad=9)], ["interview__id", "g"]).collect()}
    assert hits == {("a", 1e9), (None, 1e9)}  # b has 29 values


def test_no_deviation_flags_above_only(spark):
    df = lines(spark, [("a", 5.0)] * 40 + [("a", 6.0), ("a", 4.0)])
    hits = lambda b: {r["raw"] for r in flagged(df, df, [Check("v", ("g",), bounds=b)], []).collect()}
    assert hits("upper") == {6.0} and hits("lower") == set() and hits("both") == {6.0}


def test_zero_negative_null_and_nan(spark):
    rows = normal("a", 60) + [("a", 0.0), ("a", -3.0), ("a", None), ("a", float("nan")), ("a", INF)]
    df = lines(spark, rows)
    assert thresholds(df, [Check("v", ("g",))]).first()["n_obs"] == 61  # the infinite one counts, the others don't
    assert {r["raw"] for r in flagged(df, df, [Check("v", ("g",), n_mad=9, bounds="both")], []).collect()} == {0.0, INF}


def test_excluded_values_leave_both_sides(spark):
    rows = normal("a", 40) + [("a", 99999.0)] * 3 + [("a", 88888.0)]
    df = lines(spark, rows)
    check = Check("v", ("g",), exclude=(99999,))
    assert {r["raw"] for r in flagged(df, df, [check], []).collect() if r["raw"] > 1000} == {88888.0}


def test_target_against_all_interviews(spark):
    full = lines(spark, normal("a", 40) + [("a", 1e6)])
    target = full.where("v > 1000")
    assert flagged(target, full, [Check("v")], ["interview__id"]).count() == 1
    assert flagged(target.where("false"), full, [Check("v")], []).count() == 0


def test_issue_rows_and_places(spark):
    df = lines(spark, normal("a", 40) + [("a", 1e6)]).drop("g")
    got = [r.asDict() for r in identify_outliers(df, df, [Check("v", type=1)]).where("issue_comment like '%1,000,000.00%'").collect()]
    assert sorted((r["issue_type"], r["issue_loc"]) for r in got if r["issue_loc"]) == [(2, "[40]")]
    assert [(r["issue_type"], r["issue_vars"]) for r in got if r["issue_loc"] is None] == [(1, "v")]
    home = identify_outliers(df.drop("row__id"), df.drop("row__id"), [Check("v")], language="fr").where("issue_comment like '%1 000 000,00%'")
    assert [r["issue_loc"] for r in home.collect()] == [None, None]


def test_wrong_checks(spark):
    with pytest.raises(ValueError):
        Check("v", ("v",))
    with pytest.raises(ValueError):
        Check("v", bounds="inner")
    df = lines(spark, [("a", 1.0)])
    with pytest.raises(ValueError, match="missing"):
        flagged(df, df, [Check("w")], [])


def test_scaling_changes_nothing_in_logarithms(spark):
    df = lines(spark, normal("a", 80) + [("a", 400.0)])
    ids = lambda d: {r[0] for r in flagged(d, d, [Check("v", ("g",))], ["interview__id"]).select("interview__id").collect()}
    assert ids(df) == ids(df.withColumn("v", F.col("v") * 1000))


def test_plan_has_no_cross_join_or_python(spark):
    df = lines(spark, normal("a", 40))
    plan = flagged(df, df, [Check("v", ("g",)), Check("v")], [])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"))


def test_every_check_of_lines_has_a_query_over_all_of_them():
    from fieldcheck.plans.outlier_queries import CHECKS, QUERIES, SQL

    assert CHECKS.keys() <= QUERIES.keys()
    assert all("%" not in SQL[name] and "interview__status" not in SQL[name].split("from lineitem")[-1] for name in CHECKS)
