"""All checks over a made-up survey: every table has interviews of usual values and two of far ones, one for denominators of ratios."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import attributes, catalog, issues, outliers
from fieldcheck.operators import thresholds as T
from fieldcheck.operators.outliers import Check, flagged
from tests.plans import shuffled_rows

INPUTS = {n: {c for cols in m.values() for c in cols} for src in (catalog.DAILY, catalog.RATIOS) for n, m in src.items()}
FAR, FAR_BELOW = 41, 42


def survey(spark):
    rng = random.Random(2)
    tables = {}
    for name, checks in {**catalog.CHECKS, **catalog.LAND_CHECKS}.items():
        derived = {**catalog.DAILY.get(name, {}), **catalog.RATIOS.get(name, {})}
        keys = {b for k in checks for b in k.by} - {"hh11_q15"}
        numerators, others = {a for a, _ in derived.values()}, {b for _, b in derived.values()}
        measures = {k.var for k in checks if k.var not in derived} | numerators | ({"hh11_q15"} if name == "households" else set())
        if name == "crops":
            others.discard("ag02_q07_size")
            keys |= {"r_parcel__id", "r_plot__id"}
        if name == "plots":
            keys |= {"r_parcel__id", "r_plot__id"}
            measures.add("ag02_q07_size")
        rows = []
        for n in range(43):
            row = {"interview__id": f"i{n}", "interview__key": f"k{n}"} | dict.fromkeys(keys, 1) | {c: 2.0 for c in others}
            row |= {m: 100 * rng.lognormvariate(0, 0.05) for m in sorted(measures)}
            low = {b for _, b in derived.values()}
            if n == FAR:
                row |= {m: 1e6 for m in sorted(measures - low) if m != "hh11_q15"}
            if n == FAR_BELOW:
                row |= {m: 1e6 for m in sorted(measures & low)}
            rows.append(row)
        tables[name] = spark.createDataFrame(rows)
    return tables


def test_counts():
    assert sum(map(len, catalog.CHECKS.values())) == 80 and sum(map(len, catalog.LAND_CHECKS.values())) == 9
    assert len({(t, k.id) for t, ks in catalog.CHECKS.items() for k in ks}) == 80


def test_every_check_finds_the_far_interview(spark):
    tables = survey(spark)
    every = {**catalog.CHECKS, **catalog.LAND_CHECKS}
    some = {t: every[t] for t in ("lv_roster", "r_seed_type", "crops", "plots", "food_consumption_at_home", "members", "r_aglabor_nonhh")}
    found = catalog.outlier_issues(tables, tables, some).where(F.col("interview__id").isin(f"i{FAR}", f"i{FAR_BELOW}"))
    got = {r["issue_vars"] for r in found.select("issue_vars").distinct().collect()}
    assert got >= {k.var for ks in some.values() for k in ks}


def test_household_checks(spark):
    homes = {"households": survey(spark)["households"]}
    found = catalog.outlier_issues(homes, homes, {"households": [k for k in catalog.CHECKS["households"] if catalog.ROOMS not in k.by and k.var != catalog.ROOMS]})
    got = {r["issue_vars"] for r in found.where(F.col("interview__id") == f"i{FAR}").collect()}
    assert got == {"daily_elec_exp", "hh12_q09", "hh12_q16", "hh12_q24", "hh12_q25", "hh13_q04", "hh13_q18a", "hh15a_q18"}


def test_logical_issues(spark):
    ids = [("none",), ("one",), ("two",), ("empty",)]
    homes = spark.createDataFrame([(i, i.upper(), 1 if i == "one" else 0, 1 if i == "one" else None) for (i,) in ids], "interview__id string, interview__key string, hh08_q04__1 int, hh14_q02__1 int")
    people = [("none", 2), ("none", 3), ("one", 1), ("two", 1), ("two", 1)]
    members = spark.createDataFrame([(i, i.upper(), h, *(1 if i == "two" else 0,) * 7) for i, h in people], "interview__id string, interview__key string, hh01_q03 int, " + ", ".join(f"{m} int" for m in attributes.MEALS))
    bought = lambda var, v: spark.createDataFrame([("one", "ONE", v), ("two", "TWO", 0)], f"interview__id string, interview__key string, {var} int")
    tables = {"households": homes, "members": members} | {t: bought(v, 1 if k == 0 else 0) for k, (_, t, v) in enumerate(attributes.PURCHASES)}
    found = issues.attribute_issues(attributes.create_attributes(tables), issues.LOGICAL)
    got = {}
    for r in found.collect():
        got.setdefault(r["interview__id"], set()).add(r["issue_vars"].split(",")[0] + ("2" if "several" in r["issue_desc"] else ""))
    assert got == {
        "none": {"n_heads", "any_food_away_from_home", "any_nf_cons_7d", "any_assets"},
        "two": {"n_heads2", "any_nf_cons_7d", "any_assets"},
        "empty": {"n_heads", "any_food_away_from_home", "any_nf_cons_7d", "any_assets"},
    }


def test_logical_issues_take_one_join_whatever_the_number_of_rosters(spark):
    rosters = ("members", *(table for _, table, _ in attributes.PURCHASES))
    columns = {"members": "hh01_q03", "households": "hh14_q02__1"} | {table: var for _, table, var in attributes.PURCHASES}
    tables = {t: spark.range(9).selectExpr("cast(id as string) as interview__id", "cast(id as string) as interview__key", f"1 as {columns[t]}") for t in ("households", *rosters)}
    found = issues.attribute_issues(attributes.create_attributes(tables), issues.LOGICAL)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "pivotfirst" not in plan


def test_a_large_group_of_the_catalogue_is_not_shuffled(spark):
    rows = spark.range(4000, numPartitions=4).selectExpr("cast(id as string) as interview__id", "cast(id as string) as interview__key", "1 as t__id", "if(id = 7, 1e9, 100 + id % 10) as m")
    checks = {"t": [Check("m", ("t__id",))]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        found = catalog.outlier_issues({"t": rows}, {"t": rows}, checks)
        assert sum(shuffled_rows(found)) < 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["interview__id"] for r in found.collect()} == {"7"}


def test_unknown_column(spark):
    homes = {"households": survey(spark)["households"]}
    with pytest.raises(ValueError, match="missing"):
        catalog.outlier_issues(homes, homes, {"households": [Check("nothing")]})


ODD = "interview__id string, interview__key string, r__id int, g double, t string, v double"


def odd_rows(spark):
    """Groups of keys that look alike: null and its text, zeros of both signs, not-a-number, and one of values that are missing, infinite or left out."""
    rng = random.Random(4)
    rows = [(g, t, 100 * rng.lognormvariate(0, 0.1) * scale) for n, (g, t) in enumerate([(None, "null"), (1.0, None), (None, None), (0.0, "a"), (-0.0, "a"), (float("nan"), "a"), (1.0, "1.0")]) for scale in [7**n] * (31 + n)]
    rows += [(g, t, v) for g, t, _ in rows[:: 31 // 2] for v in (1e9, None, float("nan"), float("inf"), 0.0, -1.0, 99.0)]
    return spark.createDataFrame([(f"i{n}", f"k{n}", n, *r) for n, r in enumerate(rows)], ODD)


CHECKED = [Check("v", ("g", "t"), n_mad=9), Check("v", ("t",), exclude=(99,), bounds="both", n_mad=4), Check("v", (), transform="none", min_obs=50), Check("v", ("r__id",))]


def outliers_as_before(df, checks):
    """Outliers by the texts of keys."""
    return flagged(df, df, [replace(k, table="a") for k in checks], ["interview__id"])


def shape(rows):
    return sorted((r["check_id"], r["interview__id"], r["raw"], r["n_obs"], round(r["med"], 9), round(r["ul"], 9)) for r in rows.collect())


@pytest.mark.parametrize("ranked, joined", [(10**9, 10**9), (40, 2), (0, 0)])
def test_groups_by_number_are_those_by_text(spark, monkeypatch, ranked, joined):
    """Groups that are sorted, ranked, or some of each, and limits in one join or two."""
    df = odd_rows(spark)
    want = shape(outliers_as_before(df, CHECKED))
    monkeypatch.setattr(T, "SORTED", ranked)
    monkeypatch.setattr(T, "GROUP", joined)
    monkeypatch.setattr(catalog, "GROUP", joined)
    monkeypatch.setattr(T, "TASK", 50)
    monkeypatch.setattr(T, "PACKED", 100)
    checks = {"a": [replace(k, table="a") for k in CHECKED]}
    assert len(want) > 20 and shape(catalog.flagged_by_number({"a": df}, {"a": df}, checks, {"a": []})) == want
    nothing = df.where("false")
    assert catalog.flagged_by_number({"a": df}, {"a": nothing}, checks, {"a": []}).count() == 0


def test_groups_of_one_number_get_another_seed(spark, monkeypatch):
    df = odd_rows(spark)
    whole, seeds = outliers.numbered_columns, []

    def alike(df, checks, bits, checked, columns, seed):
        seeds.append(seed)
        found = whole(df, checks, bits, checked, columns, seed)
        return {at: {**c, "_group": F.lit(at).cast("bigint")} if seed == 0 else c for at, c in found.items()}

    for module in (outliers, catalog):
        monkeypatch.setattr(module, "numbered_columns", alike)
    checks = {"a": [replace(k, table="a") for k in CHECKED]}
    assert shape(catalog.flagged_by_number({"a": df}, {"a": df}, checks, {"a": []})) == shape(outliers_as_before(df, CHECKED))
    assert set(seeds) == {0, 1}


def test_values_are_shuffled_as_bytes(spark):
    rows = spark.range(4000, numPartitions=2).select((F.col("id") % 50).alias("_group:0"), F.col("id").cast("double").alias("value:0"))
    found = T.in_tasks([rows], 4000, [])
    assert sum(shuffled_rows(found)) == 2
    assert sorted(tuple(r) for r in found.collect())[3] == (3, 80, 1978.0, 1000.0)


def test_types_that_differ_between_tables(spark):
    full = odd_rows(spark).where("t = 'a' and g = 0").withColumn("g", F.col("r__id") % 2)
    target = full.withColumn("g", F.col("g").cast("string"))
    checks = {"a": [Check("v", ("g",), table="a", min_obs=5)]}
    found = catalog.flagged_by_number({"a": target}, {"a": full}, checks, {"a": ["g"]})
    assert shape(found) == shape(flagged(full, full, checks["a"], ["interview__id"])) != []
