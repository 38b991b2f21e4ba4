import pytest
from pyspark.sql import functions as F

from fieldcheck.functions.templates import compiled, compiled_by_key, decode_map, placeholders, with_labels
from fieldcheck.operators import catalog, check_texts


def one(spark, column):
    return spark.range(1).select(column.alias("t")).first()["t"]


def test_fields_of_the_plan_and_of_rows(spark):
    row = {"n": F.lit(1234567.891), "k": F.lit(5), "none": F.lit(None).cast("double"), "far": F.lit(float("inf"))}
    assert one(spark, compiled("{a}: {n:number} ({k}, {k:whole}) {none:number} {none} {far:number} {{x}}", "en", {"a": "it's"}, row)) == "it's: 1,234,567.89 (5, 5) NA NA ∞ {x}"
    assert one(spark, compiled("{n:number} / {n:whole}", "fr", row=row)) == "1 234 567,89 / 1 234 568"
    assert one(spark, compiled("plain", "en")) == "plain" and one(spark, compiled("", "en")) == ""
    assert one(spark, compiled("{n}{k}", "en", row=row)) == "1234567.8915"


@pytest.mark.parametrize("template", ["{unknown}", "{n:money}", "{n!r}", "{}", "{n", "n}", "{plan:number}"])
def test_wrong_templates_fail_when_compiled(spark, template):
    with pytest.raises(ValueError):
        compiled(template, "en", {"plan": 1}, {"n": F.lit(1)})


def test_wrong_language():
    with pytest.raises(ValueError, match="de"):
        compiled("x", "de")
    with pytest.raises(ValueError, match="de"):
        check_texts.what("hh12_q09", "de")


def test_every_check_has_texts_whose_placeholders_are_columns_of_its_table():
    for checks in ({**catalog.CHECKS, **catalog.LAND_CHECKS}).values():
        for k in checks:
            texts = [check_texts.what(k.var, language) for language in check_texts.LANGUAGES]
            assert all(t != k.var for t in texts) and texts[0] != texts[1]
            fields = [{f for _, f, _ in placeholders(t) if f} for t in texts]
            assert fields[0] == fields[1]
            assert fields[0] <= {*k.by, "r_assets__id"}, k  # a group's columns are in its table


def test_labels_of_many_columns(spark):
    labels = spark.createDataFrame(
        [("t", "a", 1.0, "one"), ("t", "a", 2.0, "two"), ("t", "b", 1.0, "yes"), ("t", "b", 1.0, "ay"), ("u", "a", 3.0, "other"), ("t", "c", None, "no code"), ("t", None, 1.0, "no name"), ("t", "c", 9.0, None)],
        "dataset string, variable string, code double, label string",
    )
    df = spark.createDataFrame([(1, 1, 1.0), (2, 3, 2.5), (None, None, 9.0)], "a int, b long, c double")
    got = with_labels(df, labels, "t", {"la": "a", "lb": "b", "lc": "c"})
    assert [tuple(r)[3:] for r in got.collect()] == [("one", "ay", "1"), ("two", "3", "2.5"), (None, None, "9")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["la"] for r in with_labels(df, labels.where("false"), "t", {"la": "a"}).collect()] == ["1", "2", None]


def test_a_template_for_each_row(spark):
    labels = spark.createDataFrame([("t", "a", 1, "one"), ("u", "b", 2, "two's")], "dataset string, variable string, code int, label string")
    templates = {"x": "{a} of {b}, {{é}}", "y": "no field", "z": "{b}", "w": "{b}{b}!"}
    codes = {k: {"a": ("t.a", 0), "b": ("u.b", 1)} for k in templates}
    rows = spark.createDataFrame([("x", [1.0, 2.0]), ("x", [3.0, None]), ("y", None), ("z", [1.0]), ("w", [0.0, 2.0]), ("other", [1.0, 2.0])], "k string, v array<double>")
    text = compiled_by_key(templates, codes, F.col("k"), decode_map(labels), F.col("v"))
    assert [r["t"] for r in rows.select(text.alias("t")).collect()] == ["one of two's, {é}", "3 of NA, {é}", "no field", "NA", "two'stwo's!", None]
    for wrong in ("{c}", "{a:number}"):
        with pytest.raises(ValueError):
            compiled_by_key({"x": wrong}, codes, F.col("k"), decode_map(labels), F.col("v"))


def test_the_whole_catalogue_is_registered():
    from fieldcheck.plans import run_queries as Q

    assert sum(map(len, Q.EVERY.values())) == 89 and Q.WHOLE.keys() == Q.EVERY.keys()
    assert Q.SQL["catalogue_outliers"].count("union all select interview__id") == 2 * 89 - 1
