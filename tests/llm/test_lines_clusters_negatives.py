"""Line dedup, centroid clustering and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from common import ODD, WORDS, documents, prose
from pyspark.sql import functions as F

from fieldcheck.llm import lines, negatives, vafile

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# lines -------------------------------------------------------------------------------------------------------------

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_lines(rows):
    """(doc_id, lines before, dropped, text) of each row; a missing doc_id is a document of its own text, behind all others."""
    whole = []
    for doc, text in rows:
        own = (text or "").split("\n")
        ident = (0, doc, "") if doc is not None else (1, None, text or "")
        whole.append((ident, own, [x.strip(" \t\n\v\f\r").translate(UPPER) for x in own]))
    holders = {}
    for ident, _, keys in whole:
        for k in keys:
            if len(k) >= 10:
                holders.setdefault(k, set()).add(ident)
    out = []
    for (ident, own, keys), (doc, text) in zip(whole, rows, strict=True):
        # documents without an id have no order that a test could know; shared lines of theirs are tested apart
        gone = [k in holders and len(holders[k]) > 1 and ident != min(holders[k]) for k in keys]
        kept = "\n".join(x for x, g in zip(own, gone, strict=True) if not g)
        out.append((doc, len(own), sum(gone), kept if text is not None else None))
    return sorted(out, key=repr)


def made_lines(rng, n):
    pool = [prose(rng, 6) for _ in range(30)] + ["short", "", "  Ünïcode Zeile ÄÖ  ", "漢字漢字漢字漢字漢字", "漢字漢字漢字漢字漢"]
    out = []
    for _ in range(n):
        some = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, 5) for _ in range(rng.randrange(0, 12))]
        some += ["All rights reserved by nobody"] * rng.choice([0, 0, 1, 3])
        some = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "  "]) for x in some]
        out.append("\n".join(some))
    return out


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_lines_against_brute_force(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    rng = random.Random(4)
    rows = [(rng.randrange(90), t) for t in made_lines(rng, 120)] + [(200 + k, t) for k, t in enumerate(ODD)]
    rows += [(5, rows[0][1]), (300, rows[0][1]), (None, "a line of its own, nowhere else"), (301, "\n".join(["the very same line"] * 3)), (302, "x\nthe very same line\ny")]
    try:
        found = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
        got = rows_of(found.select("doc_id", "n_lines", "n_dropped", "text"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == kept_lines(rows)


def test_a_line_of_most_rows_spreads_over_partitions(spark):
    """One key has nine tenths of all lines, so range partitions begin and end within it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(k, "Everybody holds this line\n" * 3 + f"only document {k} holds this") for k in range(3000)]
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        hashes = lines.line_hashes(docs)
        order = [F.col(c) for c in ("h", "check", "doc", "rid", "pos")]
        sizes = [r[0] for r in hashes.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().select("count").collect()]
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.without_repeated_lines(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    assert got.pop(0) == (4, 0, rows[0][1])
    assert got == {k: (4, 3, f"only document {k} holds this") for k in range(1, 3000)}


def test_lines_without_doc_id(spark):
    shared = "a line that several rows share"
    rows = [(None, f"{shared}\nfirst of them all"), (None, f"{shared}\nsecond of them all"), (None, f"{shared}\nsecond of them all")]
    found = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the two equal rows are one document, so either they lose the line or the other one does
    assert sorted(r["n_dropped"] for r in found) in ([0, 0, 1], [0, 1, 1])
    with_id = lines.without_repeated_lines(spark.createDataFrame([*rows, (9, shared)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in with_id} == {9: 0, None: 1}


def test_lines_of_odd_tables(spark):
    docs = documents(spark, [*ODD, "one shared line here\nb", "one shared line here\nc"]).withColumns({"keep": F.lit(7), "n_lines": F.lit("x"), "h": F.lit(1), "a b": F.lit(2)})
    got = lines.without_repeated_lines(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "h", "a b", "text", "n_lines", "n_dropped"]
    assert got.count() == len(ODD) + 2 and got.where("n_dropped > 0").select("text").collect()[0][0] == "c"
    assert lines.without_repeated_lines(docs.where("false")).count() == 0
    assert lines.without_repeated_lines(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0]["n_lines"] == 1


def test_one_very_long_text(spark):
    rng = random.Random(1)
    long = "\n".join(f"{rng.choice(WORDS)} line number {k % 70000}" for k in range(150_000))
    docs = spark.createDataFrame([(2, long), (1, "\n".join(long.split("\n")[:1000:2]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.without_repeated_lines(docs).collect()}
    first = set(long.split("\n")[:1000:2])
    assert got == {1: (500, 0), 2: (150_000, sum(x in first for x in long.split("\n")))}


def test_bitmaps_hold_one_bit_per_line(spark):
    docs = spark.createDataFrame([(1, "a shared line\nb"), (2, "x\na shared line\ny\nA SHARED LINE ")], "doc_id long, text string")
    (row,) = lines.keep_bitmaps(docs).collect()
    assert (row["_doc"], row["n_dropped"], zlib.decompress(row["keep"])) == (2, 2, bytes([0b10100000]))


# clusters ----------------------------------------------------------------------------------------------------------


def lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centre = [q for _, q in start]
    far = lambda q: [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centre]
    near = lambda q: min((d, n) for n, d in enumerate(far(q)))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for n in range(len(centre)):
            own = [q for (_, q), c in zip(kept, of, strict=True) if c == n]
            if own:
                centre[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [near(q) for _, q in kept]
    total = {n: sum(d for d, m in last if m == n) for n in range(len(centre))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, n, d, total[n], sum(total.values()), digest[n]) for (i, _), (d, n) in zip(kept, last, strict=True)), key=repr)


def made_vectors(rng, n, spread=0.05):
    heads = rng.normal(size=(12, 64)) * 0.2
    x = heads[rng.integers(0, 12, n)] + rng.normal(size=(n, 64)) * spread
    return [(k, [float(v) for v in row]) for k, row in enumerate(x)]


VECTORS = "vec_id long, embedding array<double>"


def test_clusters_against_brute_force(spark):
    rows = made_vectors(np.random.default_rng(3), 700)
    rows += [(None, rows[0][1]), (3, rows[5][1]), (900, None), (901, []), (902, [0.0] * 63), (903, [None] * 64), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (906, [0.0] * 64), (907, [-0.01] * 64)]
    got = rows_of(vafile.centroid_clusters(spark.createDataFrame(rows, VECTORS).repartition(5)))
    assert got == lloyd(rows)


def test_ties_and_few_vectors(spark):
    few = [(k, [float(k % 2)] + [0.0] * 63) for k in range(5)]
    assert rows_of(vafile.centroid_clusters(spark.createDataFrame(few, VECTORS))) == lloyd(few)
    same = [(k, [0.5] * 64) for k in range(40)]
    assert rows_of(vafile.centroid_clusters(spark.createDataFrame(same, VECTORS))) == lloyd(same)
    # whole numbers between centroids are as far from one as from the other
    grid = [(k, [float(k % 7)] * 2 + [0.0] * 62) for k in range(300)]
    assert rows_of(vafile.centroid_clusters(spark.createDataFrame(grid, VECTORS))) == lloyd(grid)


def test_no_vectors(spark):
    for rows in ([], [(None, [0.0] * 64)], [(1, None)]):
        got = vafile.centroid_clusters(spark.createDataFrame(rows, VECTORS))
        assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components(spark):
    rows = made_vectors(np.random.default_rng(8), 60) + [(100, [2.0**20] * 64), (101, [1e300] + [0.0] * 63), (102, [-(2.0**21)] * 64)]
    got = vafile.centroid_clusters(spark.createDataFrame(rows, VECTORS))
    assert rows_of(got) == lloyd([r for r in rows if r[0] != 101])


def test_intervals_hold_the_distances_and_spare_vectors(spark):
    rng = np.random.default_rng(5)
    x = np.floor(64 * np.array([v for _, v in made_vectors(rng, 2000, 0.02)])).astype(np.int64)
    edges = [np.concatenate([[c.min()], (u := np.unique(np.quantile(c, np.arange(1, 16) / 16).astype(int)))[u > c.min()], [c.max()]]) for c in x.T]
    centroids = x[rng.choice(len(x), 16, replace=False)]
    t, codes = vafile.Tables(edges, centroids), vafile.coded(x, edges)
    low = sum(t.low[d][codes[:, d]] for d in range(32))
    high = sum(t.high[d][codes[:, d]] for d in range(32))
    real = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (low <= real).all() and (real <= high).all() and (t.distances(x) == real).all()
    may = t.candidates(codes)
    assert may[np.arange(len(x)), real.argmin(1)].all()
    rows = made_vectors(rng, 3000, 0.02)
    fetched = []
    vafile.centroid_clusters(spark.createDataFrame(rows, VECTORS), fetched).count()
    assert len(fetched) == 3 and fetched[0] == 3000 and max(fetched[1:]) < 2400


# negatives ---------------------------------------------------------------------------------------------------------


def mined(rows):
    kept = []
    for n, (i, x, label) in enumerate(rows):
        if label is not None and x is not None and i is not None and all(v is not None and math.isfinite(v) for v in x):
            kept.append((n, i, label, [math.floor(256 * float(v)) for v in x]))
    out = []
    for n, i, label, q in kept:
        if i % 100:
            continue
        others = [(-sum(a * b for a, b in zip(q, p, strict=True)), j, m, lab) for m, j, lab, p in kept if m != n and len(p) == len(q)]
        for s, j, _, _ in sorted(o for o in others if o[3] == label)[:5]:
            near = sorted(o for o in others if o[3] != label and 80 * -s <= 100 * -o[0] <= 100 * -s)[:5]
            out += [(i, j, k, o[1], -s, -o[0]) for k, o in enumerate(near, 1)]
    return sorted(out, key=repr)


LABELLED = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("small", [False, True])
def test_negatives_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and packs
        monkeypatch.setattr(negatives, "CANDIDATES", 64)
        monkeypatch.setattr(negatives, "ANCHORS", 2)
        monkeypatch.setattr(negatives, "PACK", 10)
    rng = np.random.default_rng(2)
    rows = [(k * 5, x, int(rng.integers(0, 3))) for k, x in made_vectors(rng, 400, 0.03)]
    rows += [(7000, [0.0] * 64, 1), (7001, [0.0] * 64, 2), (7100, None, 1), (7200, [0.1] * 64, None), (7300, [float("nan")] * 64, 1), (7400, [None] * 64, 1), (None, [0.1] * 64, 1)]
    rows += [(7500, [0.5, -0.5], 1), (7501, [0.5, -0.4], 1), (7502, [0.45, -0.4], 2), (7600, [], 1), (7601, [], 1), (7602, [], 2), rows[0], (8000, rows[0][1], rows[0][2])]
    got = rows_of(negatives.hard_negatives(spark.createDataFrame(rows, LABELLED).withColumns({"row": F.lit(1), "score": F.lit("x"), "label2": F.lit(None)}).repartition(3)))
    assert got == mined(rows) and len(got) > 50


def test_no_anchors_and_empty_tables(spark):
    for rows in ([], [(1, [0.1] * 4, 1), (2, [0.1] * 4, 2)], [(100, [0.1] * 4, 1)]):
        got = negatives.hard_negatives(spark.createDataFrame(rows, LABELLED))
        assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_packed_products_are_exact_at_every_width():
    rng = np.random.default_rng(0)
    for top in (1, 300, 2**14, 2**26, 2**29):
        x = rng.integers(-top, top + 1, (137, 9))
        anchors = rng.integers(-top, top + 1, (5, 9))
        packed = negatives.Packed(x, int(np.abs(anchors).sum(1).max()))
        for a in anchors:
            assert (packed.scores(a.tolist()) == x @ a).all()
    assert len({negatives.Packed(np.array([[-t, t]]), 2 * t).width for t in (1, 2**20, 2**31)}) == 3


def test_large_components(spark):
    big = 2.0**20
    rows = [(100, [big, 1.0], 1), (1, [big, 0.5], 1), (2, [big * 0.9, 0.0], 2), (3, [1e200, 0.0], 2)]
    got = rows_of(negatives.hard_negatives(spark.createDataFrame(rows, LABELLED)))
    assert got == mined(rows[:3]) and len(got) == 1


def test_labels_move_on(spark):
    df = spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None)], LABELLED)
    assert [r["label"] for r in negatives.relabelled(df).collect()] == [0, 9, None]


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_centroid_clustering", "op13_hard_negatives"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from fieldcheck.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", got._jdf.queryExecution().toString())
    assert rows_of(got.select(*columns)) == sorted(want.fetchall(), key=repr)
