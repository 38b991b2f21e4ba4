"""MinHash near-dedup with HyperMinHash registers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, min_labels, whole_groups, with_block_pairs
from .graph import connected_components
from .scratch import Scratch, small_batches
from .shingles import shingle_sets
from .tables import table

#: Registers in a band, and the chance that a pair at the threshold shares no band.
ROWS, MISSED = 5, 1e-6
#: Largest blocks: sketches compared at once; documents and shingles confirmed at once.
SKETCHES, DOCUMENTS, SHINGLES = 4096, 1024, 2_000_000
_EMPTY = 255
#: Stands for a missing doc_id, behind all others.
NO_ID = 2**63 - 1


def band_count(threshold: float) -> int:
    """Bands of ROWS registers so that a pair at ``threshold`` shares none with a chance below MISSED."""
    return math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS))


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(documents, 2 m) bytes: each shingle falls into one of m buckets; a bucket keeps its minimum.

    The minimum of 32 bits is stored as its count of leading zeros (6 bits) and the 10 bits that follow
    the first one bit. The first m bytes hold the upper half of each register (leading zeros and two
    mantissa bits), the others the lower half. An empty bucket has 255 in both.
    """
    size = np.array([len(s) for s in sets])
    least = np.full(len(sets) * m, 1 << 32, np.int64)
    if size.sum():
        s = np.concatenate(sets)
        bucket = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, np.repeat(np.arange(len(sets)) * m, size) + bucket, (s & np.uint64(0xFFFFFFFF)).astype(np.int64))
    mantissa, exponent = np.frexp(np.maximum(least, 1).astype(float))
    value = (np.minimum(32 - np.minimum(exponent, 32), 62) << 10) | ((mantissa * 2 - 1) * 1024).astype(np.int64)
    value[least == 1 << 32] = 0xFFFF
    value = value.reshape(-1, m)
    return np.hstack([value >> 8, value & 255]).astype(np.uint8)


@lru_cache
def _chance(m: int) -> np.ndarray:
    """[a, b]: the chance that a bucket of two unrelated sets of 2**a and 2**b shingles has equal upper bytes."""
    edge = np.concatenate([[(2.0**-z) * (1 - k / 8) for k in range(4)] for z in range(34)])  # falling
    alive = np.exp(-np.outer(2.0 ** np.arange(34) / m, edge))
    cell = np.diff(alive, axis=1, append=1.0)
    cell /= np.maximum(cell.sum(1, keepdims=True), 1e-300)
    return cell @ cell.T


def _alike(regs: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimate of pairs (i, j) is not clearly below the threshold."""
    a, b = regs[i], regs[j]
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
    equal = ((a == b) & (a != _EMPTY)).sum(1)
    return _near(equal, used, n[i], n[j], regs.shape[1], threshold)


def _near(equal: np.ndarray, used: np.ndarray, n: np.ndarray, o: np.ndarray, m: int, threshold: float) -> np.ndarray:
    """Collision-corrected Jaccard estimate, less strict by six standard errors."""
    chance = _chance(m)[np.log2(np.maximum(n, 1)).astype(int), np.log2(np.maximum(o, 1)).astype(int)]
    used = np.maximum(used, 1)
    estimate = (equal / used - chance) / (1 - chance)
    return estimate >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / used)


def _sketched(words: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            marks = [(int(s.sum(dtype=np.uint64).astype(np.int64)), int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64))) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in marks], pa.int64()),
                    pa.array([x for _, x in marks], pa.int64()),
                    pa.array([r.tobytes() for r in registers(sets, m)], pa.binary()),
                ],
                names=["doc_id", "mark", "n_shingles", "h1", "h2", "sketch"],
            )

    return run


def _likely(m: int, threshold: float):
    """Rows of a bucket next to each other -> (a, b): rows that look alike, joined as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["bkey", "bi", "bj"]):
            ids, n = rows.column("class_id").to_numpy(), rows.column("n").to_numpy()
            regs = np.frombuffer(b"".join(rows.column("upper").to_pylist()), np.uint8).reshape(-1, m)
            crossed = rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
            side = rows.column("blk").to_numpy() == rows.column("bi").to_numpy()
            sizes = np.diff(np.append(starts, len(ids)))
            group, found = np.repeat(np.arange(len(starts)), sizes), []
            few = (sizes <= 64)[group] & ~crossed
            for d in range(1, int(sizes[sizes <= 64].max(initial=0))):
                i = np.flatnonzero((group[:-d] == group[d:]) & few[:-d])
                i = i[_alike(regs, n, i, i + d, threshold)]
                found.append((i, i + d))
            for g in np.flatnonzero((sizes > 64) | crossed[starts]):
                own = np.arange(starts[g], starts[g] + sizes[g])
                left, right = (own[side[own]], own[~side[own]]) if crossed[starts[g]] else (own, own)
                for at in range(0, len(left), 512):
                    part = left[at : at + 512]
                    equal = np.zeros((len(part), len(right)), np.int16)
                    for k in range(m):
                        x, y = regs[part, k], regs[right, k]
                        equal += (x[:, None] == y[None, :]) & (x != _EMPTY)[:, None]
                    used = m - (regs[part] == _EMPTY).astype(np.float32) @ (regs[right] == _EMPTY).astype(np.float32).T
                    p, q = np.nonzero(_near(equal, used, n[part][:, None], n[right][None, :], m, threshold))
                    star = min_labels(int(sizes[g]), part[p] - starts[g], right[q] - starts[g])  # as many links as rows, not as pairs
                    hung = np.flatnonzero(star != np.arange(len(star)))
                    found.append((hung + starts[g], star[hung] + starts[g]))
            if found:
                root = min_labels(len(ids), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
                own = np.flatnonzero(ids != ids[root])
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with den * intersection >= num * union; ``right`` None: within ``left``, i < j."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    a = len(left)
    both = np.zeros((a, a if right is None else len(right)), np.float64)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(code, [at, at + width])
        there = np.zeros((len(sets), width), np.float32)
        there[owner[lo:hi], code[lo:hi] - at] = 1
        both += there[:a] @ (there[:a] if right is None else there[a:]).T
    n, o = size[:a, None], (size[:a] if right is None else size[a:])[None, :]
    ok = den * both >= num * (n + o - both)
    return np.nonzero(np.triu(ok, 1) if right is None else ok)


def _confirmed(words: int, num: int, den: int):
    """Texts of a pair of blocks next to each other -> (a, b): truly linked documents, joined as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["cluster", "bi", "bj"]):
            ids = rows.column("class_id").to_numpy()
            side = rows.column("blk").to_numpy() == rows.column("bi").to_numpy()
            crossed = rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
            a, b = [], []
            for lo, hi in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                sets = shingle_sets(rows.column("text").slice(lo, hi - lo), words)
                own = np.arange(lo, hi)
                if crossed[lo]:
                    one, two = own[side[own]], own[~side[own]]
                    if not len(one) or not len(two):
                        continue
                    i, j = linked([sets[k - lo] for k in one], [sets[k - lo] for k in two], num, den)
                    i, j = one[i], two[j]
                else:
                    i, j = linked(sets, None, num, den)
                    i, j = own[i], own[j]
                root = min_labels(hi - lo, i - lo, j - lo) + lo
                a.append(ids[own])
                b.append(ids[root])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return run


def judged(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, first) for every row of ``docs`` (doc_id, text).

    mark is a hash of the text, which with doc_id stands for a row; rows equal in both are judged alike. component_id is the smallest doc_id
    of the row's group, first the smallest (doc_id, mark) of it; both are the row's own where it is linked with nothing. See ``near_duplicates``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    threshold = num / den
    bands = band_count(threshold)
    m = bands * ROWS

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", marked())
    sketches = docs.mapInArrow(_sketched(words, m), "doc_id long, mark long, n_shingles long, h1 long, h2 long, sketch binary")
    sketches = scratch.table(sketches, "documents")
    sound = F.expr("n_shingles > 0 and doc_id is not null")
    classes = (
        sketches.where(sound)
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    )
    # numbers of rows hold only where they are stored
    classes = scratch.table(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")

    def key(b: int):
        parts = [F.substring("sketch", 1 + half * m + b * ROWS, ROWS) for half in (0, 1)]
        empty = F.hex(parts[0]) == "FF" * ROWS
        return F.when(~empty, F.xxhash64(F.lit(b), *parts))

    keyed = classes.select("class_id", F.explode(F.array_compact(F.array(*[key(b) for b in range(bands)]))).alias("bkey"))
    buckets = keyed.groupBy("bkey").agg(F.count("*").alias("size")).where("size > 1")
    members = keyed.join(buckets, "bkey").join(
        classes.select("class_id", "n", F.substring("sketch", 1, m).alias("upper")), "class_id"
    )
    members = with_block_pairs(members, F.ceil(F.col("size") / SKETCHES), F.col("class_id")).drop("size")
    likely = dealt(members, "bkey", "bi", "bj").mapInArrow(_likely(m, threshold), "a long, b long")
    clusters = connected_components(likely, scratch, "likely")
    clusters = clusters.select(F.col("node").alias("class_id"), F.col("component").alias("cluster"))

    of = clusters.join(classes.select("class_id", "n", "least.doc_id", "least.mark"), "class_id")
    sizes = of.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / DOCUMENTS), F.ceil(F.sum("n") / SHINGLES)).alias("blocks")
    )
    # a class needs one text; rows equal in doc_id and mark are rare, and only those are looked through for one
    several = scratch.table(sketches.where(sound).groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).drop("rows"), "several")
    wanted = of.select("class_id", "cluster", "doc_id", "mark").join(sizes, "cluster")
    single = wanted.join(docs.join(several, ["doc_id", "mark"], "left_anti"), ["doc_id", "mark"])
    other = wanted.join(docs.join(several, ["doc_id", "mark"], "left_semi"), ["doc_id", "mark"]).dropDuplicates(["class_id"])
    texts = with_block_pairs(single.unionByName(other).drop("doc_id", "mark"), F.col("blocks"), F.col("class_id")).drop("blocks")
    links = dealt(texts, "cluster", "bi", "bj").mapInArrow(_confirmed(words, num, den), "a long, b long")
    components = connected_components(links, scratch, "links")

    known = classes.select("h1", "h2", "class_id", "least").join(components.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.withColumn("component", F.coalesce("component", "class_id"))
    first = known.groupBy("component").agg(F.min("least").alias("first"))
    known = known.join(first, "component").select("h1", "h2", "first")
    found = sketches.where(sound).drop("sketch").join(known, ["h1", "h2"])
    rest = sketches.where(~sound).withColumn("first", F.struct("doc_id", "mark"))
    out = found.select("doc_id", "mark", "n_shingles", "first").unionByName(rest.select("doc_id", "mark", "n_shingles", "first"))
    return out.select("doc_id", "mark", "n_shingles", F.col("first.doc_id").alias("component_id"), "first")


def marked():
    """A hash of the text, null and empty ones alike."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked if their sets of distinct ``words``-word shingles have a Jaccard similarity of
    at least num / den. Words are what lies between space and the control characters 9 to 13, A-Z as
    a-z. A document of fewer words has its whole sequence as its one shingle; one without words (or a
    null text) is linked with nothing. component_id is the smallest doc_id reachable by links, kept
    says whether that is the document itself.

    Rows with equal sets become one class, numbered apart from doc_ids, so exact copies cost nothing further. Classes that share a
    band of registers are compared by their registers, in blocks; what the estimate can't rule out
    falls into one cluster, and within clusters links are confirmed on full shingle sets, in blocks too.
    Blocks return stars, not pairs. A pair at the threshold shares no band with a chance below MISSED;
    nothing is capped. Rows that repeat a doc_id are judged each by its own text. A null doc_id is
    linked with nothing and kept. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    out = judged(docs, words, num, den)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest doc_id, of several such rows that of the smallest hash of its text.

    Decisions are by row, so different texts of one doc_id go or stay each by its own group, and of rows equal in doc_id and text one stays. Rows without a doc_id come behind
    all others. Rows without words are linked with nothing and all stay.
    """
    columns, keys = docs.columns, ["_near_doc", "_near_mark"]
    rows = docs.withColumn(keys[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(keys[1], marked())
    found = judged(rows.select(F.col(keys[0]).alias("doc_id"), "text"), words, num, den)
    own = F.first(F.struct("doc_id", "mark") == F.col("first")).alias("_near_stays")
    stays = found.where("n_shingles > 0").groupBy("doc_id", "mark").agg(own, F.count("*").alias("copies")).where("not _near_stays or copies > 1")
    scratch = Scratch(docs.sparkSession, "kept")
    stays = scratch.table(stays.select(F.col("doc_id").alias(keys[0]), F.col("mark").alias(keys[1]), "_near_stays"), "marks")
    several = scratch.table(stays.where("_near_stays"), "several")
    alone = rows.join(stays, keys, "left_anti").select(*columns)
    copies = rows.join(several, keys, "left_semi").dropDuplicates(keys)
    return alone.unionByName(copies.select(*columns))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of whole documents: shingles of three words, Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)
