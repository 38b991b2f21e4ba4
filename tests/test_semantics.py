from pyspark.sql import functions as F

from fieldcheck.functions import semantics as S
from fieldcheck.functions.text import number_text, with_label

INF = float("inf")


def test_ratio_over_zero(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 0.0), (1.0, None)]
    df = spark.createDataFrame(rows, "v double, q double")
    assert [r[0] for r in df.select(S.ratio(F.col("v"), F.col("q"))).collect()] == [0.5, INF, None, -INF, None, None]


def test_logs(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-2.0,), (None,), (INF,)], "v double")
    got = df.select(S.baseline_log(F.col("v")).alias("b"), S.checked_log(F.col("v")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (None, -INF), (None, None), (None, None), (INF, INF)]


def test_group_key_tells_null_from_text(spark):
    df = spark.createDataFrame([("a", None), ("a", "null"), (None, "a"), ("a", "")], "x string, y string")
    keys = [r[0] for r in df.select(S.group_key([F.col("x"), F.col("y")])).collect()]
    assert len(set(keys)) == 4 and None not in keys


def test_lists_and_conditions(spark):
    df = spark.createDataFrame([(1, True, None), (None, False, None), (3, None, None)], "v int, a boolean, b boolean")
    got = df.select(S.in_list(F.col("v"), [1, 2]), S.in_list(F.col("v"), []), S.any_true([F.col("a"), F.col("b")]), S.all_true([F.col("a"), F.col("b")])).collect()
    assert [tuple(r) for r in got] == [(True, False, True, None), (False, False, None, False), (False, False, None, None)]


def test_number_text(spark):
    df = spark.createDataFrame([(1234567.891,), (-0.5,), (None,)], "v double")
    got = df.select(number_text(F.col("v")), number_text(F.col("v"), "fr", 1)).collect()
    assert [tuple(r) for r in got] == [("1,234,567.89", "1 234 567,9"), ("-0.50", "-0,5"), (None, None)]


def test_labels(spark):
    labels = spark.createDataFrame([("u", 1.0, "kilo"), ("w", 2.0, "other")], "variable string, code double, label string")
    df = spark.createDataFrame([(1,), (2,), (None,)], "unit int")
    assert {tuple(r) for r in with_label(df, labels, "u", "unit", "text").collect()} == {(1, "kilo"), (2, "2"), (None, None)}


def test_keys_of_numbers_need_no_escapes(spark):
    df = spark.sql("select * from values (1, 2.50, 1e300d), (null, -1.00, double('nan')), (3, null, double('-infinity')), (null, null, -0.0d) as t(a, b, c)")
    for cs in (("a",), ("a", "b"), ("a", "b", "c")):
        keys = df.select(S.group_key([F.col(c) for c in cs]).alias("json"), S.group_key([F.col(c) for c in cs], plain=True).alias("plain")).collect()
        assert len(keys) == 4 and all(r["json"] == r["plain"] for r in keys)
    assert df.select(S.group_key([], plain=True)).first()[0] == "[]"
