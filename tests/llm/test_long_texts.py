"""One text of over a million words, through every operator on documents."""

import random

import pytest
from common import WORDS, documents, prose
from pyspark.sql import functions as F

from fieldcheck.llm import bpe, contamination, lines, minhash, quality, secrets, spans


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    out = []
    for k in range(1_100_000):
        out.append(rng.choice(WORDS) + str(k % 9973) + rng.choice(["", "", "", ".", "\n"]))
    passage = prose(rng, 70)
    long = " ".join(out) + f" {passage} token=abcdefgh12345678"
    assert len(long.split()) > 1_100_000
    return [f"start {passage} end", long, long + " one more"], passage


def test_a_long_text_through_all(spark, texts):
    rows, passage = texts
    docs = documents(spark, rows)
    near = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(docs, 3, 85, 100).collect()}
    assert [near[k][0] for k in range(3)] == [0, 1, 1] and near[1][1] > 1_000_000
    bench = spark.createDataFrame([("i", " ".join(passage.split()[5:40]))], "item_id string, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in contamination.contaminated(docs, bench).collect()}
    assert hits[0] == hits[1] == hits[2] > 30
    found = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in secrets.secret_spans(docs).collect()}
    assert found[0] == [] and found[1] == found[2] == [(0, rows[1].index("token="))]
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, quality.fit(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))).collect())
    kept = {r["doc_id"]: (len(r["text"].split()), r["words_removed"]) for r in spans.without_repeats(docs).collect()}
    assert kept[0][1] == 0 and 12 <= kept[1][1] < 100_000 and kept[2][1] >= 1_100_000
    cut = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.without_repeated_lines(docs).collect()}
    assert cut[1][0] == cut[2][0] > 200_000 and cut[0] == (1, 0) and cut[2][1] > cut[1][1] == 0


def test_tokens_of_a_long_text(spark, texts):
    docs = documents(spark, texts[0][1:2])
    (row,) = bpe.encoded(docs.select("doc_id", "text")).withColumn("same", F.col("decoded_sha256") == F.sha2("text", 256)).collect()
    assert row["same"] and row["n_tokens"] > 2_000_000
