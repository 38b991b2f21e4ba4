"""Hard-negative mining with Kronecker-packed products: one wide integer holds a component of many candidates."""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import dealt, whole_groups
from .scratch import Scratch
from .tables import table

#: What components are multiplied by; anchors are the rows whose vec_id is divisible by the second number.
SCALE, EVERY = 256, 100
#: Positives of an anchor, negatives of a positive, and the least share of the positive's score in per cent.
POSITIVES, NEGATIVES, SHARE = 5, 5, 80
#: Candidates and anchors of a task's block, and candidates in one wide integer.
CANDIDATES, ANCHORS, PACK = 16384, 512, 2048


class Packed:
    """Candidates' components in wide integers: integer d of a pack holds component d of up to PACK candidates, each in a field of its own.

    Components are biased to be at least 0. A field has room for any sum of products with an anchor whose components' sizes sum up to ``reach``,
    and for a sign.
    """

    def __init__(self, vectors: np.ndarray, reach: int) -> None:
        self.bias = -int(vectors.min(initial=0))
        top = int(vectors.max(initial=0)) + self.bias
        bits = (reach * top).bit_length() + 2
        self.width = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)  # bytes of a field
        self.sizes, self.packs, self.middles = [], [], []
        for at in range(0, len(vectors), PACK):
            part = vectors[at : at + PACK] + self.bias
            self.sizes.append(len(part))
            self.packs.append([self._packed(part[:, d]) for d in range(part.shape[1])])
            self.middles.append(int.from_bytes((1 << (8 * self.width - 1)).to_bytes(self.width, "little") * len(part), "little"))

    def _packed(self, column: np.ndarray) -> int:
        if self.width in (4, 8):
            return int.from_bytes(column.astype(f"<u{self.width}").tobytes(), "little")
        return int.from_bytes(b"".join(int(v).to_bytes(self.width, "little") for v in column), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of all candidates with an anchor: one multiplication per component and pack, then the fields are taken apart.

        Fields start from the middle of their range, so none borrows from the next one.
        """
        out, shift = [], (1 << (8 * self.width - 1)) + self.bias * sum(anchor)
        for size, pack, middle in zip(self.sizes, self.packs, self.middles, strict=True):
            data = (sum(map(mul, anchor, pack)) + middle).to_bytes(size * self.width, "little")
            if self.width == 4:
                out.append(np.frombuffer(data, "<u4").astype(np.int64) - shift)
            else:
                fields = (int.from_bytes(data[k : k + self.width], "little") - shift for k in range(0, len(data), self.width))
                out.append(np.fromiter(fields, np.int64, size))
        return np.concatenate(out)


def first_rows(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n highest scores; ties go by the smaller id, then by the smaller row."""
    at = np.arange(len(scores))
    if len(scores) > n:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    return at[np.lexsort((rows[at], ids[at], -scores[at]))][:n]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """(anchors, candidates, products) of each pair of blocks that has both: two dicts of columns, and a function from an anchor's position to its scores."""
    for rows, starts in whole_groups(batches, keys):
        plain = {name: rows.column(name).to_numpy() for name in ("row", "vec_id", "label", "dim", "anchor")}
        flat = rows.column("q").combine_chunks().flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(plain["dim"])])
        for lo, hi in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
            anchor = plain["anchor"][lo:hi]
            if anchor.all() or not anchor.any():
                continue
            x = flat[at[lo] : at[hi]].reshape(hi - lo, plain["dim"][lo])
            ones = {name: c[lo:hi][anchor] for name, c in plain.items()}
            others = {name: c[lo:hi][~anchor] for name, c in plain.items()}
            ones["goals"] = rows.column("goals").slice(lo, hi - lo).combine_chunks().filter(pa.array(anchor)).to_pylist()
            packed = Packed(x[~anchor], int(np.abs(x[anchor]).sum(1).max(initial=0)))
            own = x[anchor]
            yield ones, others, lambda k, own=own, packed=packed: packed.scores(own[k].tolist())


def _positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one label -> (anchor, row, vec_id, score): the best other rows of the block for each anchor."""
    for ones, others, scores in _groups(batches, ["dim", "label", "ab", "cb"]):
        out = []
        for k, row in enumerate(ones["row"]):
            s = scores(k)
            other = np.flatnonzero(others["row"] != row)
            best = other[first_rows(s[other], others["vec_id"][other], others["row"][other], POSITIVES)]
            out.append((np.full(len(best), row), others["row"][best], others["vec_id"][best], s[best]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "row", "vec_id", "score"])


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of all labels -> (anchor, goal, row, vec_id, score): the best rows of the block within reach of each positive score of each anchor."""
    for ones, others, scores in _groups(batches, ["dim", "ab", "cb"]):
        out = [(np.zeros(0, np.int64),) * 5]
        for k, (row, label) in enumerate(zip(ones["row"], ones["label"], strict=True)):
            s = scores(k)
            goals = ones["goals"][k]
            # every window lies between the least goal's lower and the greatest goal's upper end
            far = np.flatnonzero((others["label"] != label) & (s <= max(goals)) & (s >= -(-SHARE * min(goals) // 100)))
            for goal in goals:
                near = far[(s[far] <= goal) & (s[far] >= -(-SHARE * goal // 100))]
                best = near[first_rows(s[near], others["vec_id"][near], others["row"][near], NEGATIVES)]
                out.append((np.full(len(best), row), np.full(len(best), goal), others["row"][best], others["vec_id"][best], s[best]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "goal", "row", "vec_id", "score"])


def _paired(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates and anchors of each group of ``keys``, once per pair of their blocks (ab, cb), those of a pair together."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / CANDIDATES).alias("cbs"))
    sizes = sizes.join(anchors.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHORS).alias("abs")), keys)
    columns = ["row", "vec_id", "label", "dim", "q", "goals", "anchor", "ab", "cb"]
    theirs = (
        rows.join(sizes, keys)
        .withColumn("cb", F.expr("pmod(xxhash64(row), cbs)"))
        .withColumn("ab", F.explode(F.expr("sequence(0L, abs - 1)")))
        .withColumn("anchor", F.lit(False))
        .withColumn("goals", F.lit(None).cast("array<bigint>"))
    )
    own = (
        anchors.join(sizes, keys)
        .withColumn("ab", F.expr("pmod(xxhash64(row, 1), abs)"))
        .withColumn("cb", F.explode(F.expr("sequence(0L, cbs - 1)")))
        .withColumn("anchor", F.lit(True))
    )
    return dealt(theirs.select(*columns).unionByName(own.select(*columns)), *keys, "ab", "cb")


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, embedding, label).

    Rows whose vec_id, label or vector is null, or whose vector has a null or non-finite component, take no part; nor do those
    with a component whose square times the number of components reaches 2 ** 62 once scaled, as their scores might not fit a long. Components become floor(SCALE * x); a score is the
    integer inner product with the anchor, between vectors of one length. Higher scores come first, ties by smaller vec_id. An anchor's
    positives are its first POSITIVES other rows of the same label; for each of them the first NEGATIVES rows of another label whose score is between
    SHARE per cent of the positive's and all of it are returned (none, if the positive's score is below 0). Fewer rows are all returned. Every row counts for itself, also if it repeats another one.

    Anchors are compared with all rows in blocks of ANCHORS and CANDIDATES, dealt out by hash, so a label of any size is split; a task holds one pair of blocks,
    and returns a few best rows for each anchor, of which a window keeps the best. Positives meet rows of their label
    only. Products are exact, by ``Packed``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    q = F.expr(f"transform(embedding, x -> floor({SCALE} * cast(x as double)))")
    sound = "label is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    fits = "forall(q, x -> cast(x as double) * x * dim < 4611686018427387904d)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(F.coalesce(F.expr(sound), F.lit(False)))
    rows = rows.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), q.alias("q")).where(fits)
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    anchors = rows.where(F.col("vec_id") % EVERY == 0)

    none = F.lit(None).cast("array<bigint>")
    best = _paired(rows, anchors.withColumn("goals", none), ["dim", "label"]).mapInArrow(_positives, "anchor long, row long, vec_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    positives = scratch.table(best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= POSITIVES), "positives")

    goals = positives.where("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("goals"))  # POSITIVES at most
    sought = anchors.join(goals.withColumnRenamed("anchor", "row"), "row")
    found = _paired(rows, sought, ["dim"]).mapInArrow(_negatives, "anchor long, goal long, row long, vec_id long, score long")
    order = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "vec_id", "row")
    negatives = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    negatives = scratch.table(negatives.select("anchor", "goal", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")

    named = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("score").alias("goal"))
    named = named.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(negatives, ["anchor", "goal"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 7 get the next of ten labels."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding."""
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


OP13_SQL = f"""
with r as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (
  select a.vec_id as anchor_id, o.vec_id, a.label = o.label as alike, cast(list_inner_product(a.q, o.q) as bigint) as score
  from r a join r o on a.vec_id <> o.vec_id and len(a.q) = len(o.q) where a.vec_id % {EVERY} = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where alike),
n as (
  select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank,
         s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.alike and {SHARE} * p.score <= 100 * s.score and s.score <= p.score where p.n <= {POSITIVES})
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
