import math
import random
import re

import numpy as np
import pytest
from common import ODD, components, documents, edited, prose
from pyspark.sql import functions as F

from fieldcheck.llm import embeddings, graph, minhash
from fieldcheck.llm.scratch import Scratch


def shingles(text, words):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def expected(texts, words, num, den):
    sets = [shingles(t, words) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [(k, len(sets[k]), c, c == k) for k, c in enumerate(components(len(sets), links))]


def texts():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 8, 40, 200, 200, 900)]
    out = [*ODD, *base, *base[:3]]
    for b in base[2:]:
        out += [edited(rng, b, k) for k in (1, 2, 3, 5, 8, 12, 20) for _ in range(3)]
    shared = prose(rng, 60)  # a passage of unrelated documents
    out += [f"{prose(rng, 50)} {shared} {prose(rng, 70)}" for _ in range(12)]
    return out


@pytest.mark.parametrize(("words", "num", "small"), [(3, 85, False), (5, 80, True)])
def test_minhash_against_all_pairs(spark, monkeypatch, words, num, small):
    if small:  # many blocks
        for name, value in (("SKETCHES", 4), ("DOCUMENTS", 5), ("SHINGLES", 600)):
            monkeypatch.setattr(minhash, name, value)
    rows = texts()
    got = minhash.near_duplicates(documents(spark, rows), words, num, 100)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, words, num, 100)


def test_minhash_odd_tables(spark):
    none = documents(spark, ["x"]).where("false")
    assert minhash.near_duplicates(none).collect() == []
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "h1": F.lit(1), "sketch": F.lit(0)})
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True)] * 2 + [(3, 2, 2, False)] * 2 + [(2, 2, 2, True), (9, 0, 9, True)], key=repr)


def test_band_count_and_registers():
    assert (1 - 0.85**minhash.ROWS) ** minhash.band_count(0.85) < minhash.MISSED
    rng = np.random.default_rng(1)
    m, n = 240, 3000
    a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    for j in (0.0, 0.5, 0.85):
        shared = round(2 * n * j / (1 + j))
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
        regs = minhash.registers([np.unique(a), np.unique(b)], m)[:, :m]
        equal = (regs[0] == regs[1]).mean()
        chance = minhash._chance(m)[int(math.log2(n)), int(math.log2(n))]
        assert abs((equal - chance) / (1 - chance) - j) < 0.12
    assert (minhash.registers([np.zeros(0, np.uint64)], m) == 255).all()


def test_minhash_plan(spark):
    plan = minhash.near_duplicates(documents(spark, texts()))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(k, k + 1) for k in range(70, 95)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, *links[:5], (7, 7)], "a long, b long")
    want = components(100, links)
    got = {r["node"]: r["component"] for r in graph.connected_components(df, Scratch(spark, "test"), "g").collect()}
    assert got == {k: want[k] for k in {x for a, b in links if a != b for x in (a, b)}}


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 8))
    near = base[rng.integers(0, 20, 60)] + rng.normal(size=(60, 8)) * 0.12
    rows = [(k, [float(np.float32(x)) for x in v], int(k % 3) if k < 110 else 0) for k, v in enumerate(np.vstack([base, near]))]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, [2 * x for x in rows[0][1]], 0)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] + [1.0] * 7, 0), (304, rows[0][1], None), (305, [], 0), (306, rows[0][1][:4], 0), (307, [float("inf")] + [1.0] * 7, 0)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_vectors_against_all_pairs(spark, monkeypatch, small):
    if small:  # many cells, blocks and parts
        for name, value in (("CELL", 6), ("BLOCK", 4), ("ASSIGN", 7), ("FIT", 20)):
            monkeypatch.setattr(embeddings, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("x"))
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    sound = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and k is not None for _, v, k in rows]
    cos = lambda a, b: np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
    linked = lambda i, j: sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= 0.93
    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j)]
    count = [sum(k in p for p in links) for k in range(len(rows))]
    want = [(rows[k][0], count[k], rows[c][0], c == k) for k, c in enumerate(components(len(rows), links))]
    assert sorted(tuple(r) for r in embeddings.near_duplicate_vectors(df).collect()) == want
    assert len(links) > 30


def test_vectors_empty_and_without_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, [1.0], 0), (5, [1.0], 0), (5, [1.0], 0)], schema)
    got = sorted((tuple(r) for r in embeddings.near_duplicate_vectors(df).collect()), key=repr)
    assert got == sorted([(None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True)], key=repr)


def test_kmeans_cells_are_unit_and_cover():
    x = np.random.default_rng(0).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embeddings.spherical_kmeans(x, 7)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and len(np.unique((x @ c.T).argmax(1))) == 7


def test_given_labels_go_through_several_cells(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    classes = rows.select(F.col("label").cast("long").alias("label"), F.lit(64).cast("long").alias("dim"), F.col("vec_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("vec"))
    cells = embeddings.in_cells(classes, 0.93)
    counts = cells.groupBy("label").agg(F.countDistinct("cell").alias("cells"), F.count_if("home").alias("homes")).collect()
    assert len(counts) == 10 and all(r["cells"] >= 2 for r in counts) and sum(r["homes"] for r in counts) == rows.count()


def test_a_hub_is_split(spark):
    """The neighbours of one node meet in several tasks, and components are those of the whole graph."""
    hub = spark.range(1, 6001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    scratch = Scratch(spark, "hub")
    near = graph._with_least(hub.unionByName(hub.select(F.col("v").alias("u"), F.col("u").alias("v"))), scratch, "x")
    assert near.where("u = 0").agg(F.count("*"), F.max("m")).first() == (6000, 1) and near.where("u > 0 and m <> 0").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = graph._with_least(hub, scratch, "y")
        sizes = [r["count"] for r in near.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1 and max(sizes) <= 6000 - graph.HUB // 2
    chain = spark.range(6000, 6010).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graph.connected_components(hub.toDF("a", "b").unionByName(chain), scratch, "z")
    assert found.count() == 6011 and found.where("component <> 0").count() == 0


def test_rows_of_one_id_are_kept_by_their_own_group(spark):
    rng = random.Random(7)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (5, a), (5, b), (7, b), (8, edited(rng, b, 1)), (9, "alone in the world"), (9, "alone in the world"), (None, a), (None, "x y z"), (None, "x y z"), (3, ""), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_doc": F.lit(1), "stays": F.lit(None), "n": F.lit(2)}).repartition(3)
    got = sorted((tuple(r) for r in minhash.deduplicated(docs).select("doc_id", "text").collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (9, "alone in the world"), (None, "x y z"), (3, ""), (3, ""), (3, None)], key=repr)
    judged = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert judged >= {(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (8, 5, False)}
    assert minhash.deduplicated(docs.where("false")).count() == 0
