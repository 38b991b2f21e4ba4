"""Centroid clustering with a vector approximation file: few-bit cells decide, full vectors are fetched where they can't."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import opened
from .scratch import Scratch
from .tables import table

#: Components of a vector, what they are multiplied by, centroids, and rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Cells of a component; two cells make one byte.
CELLS = 16
#: Larger components in size would take squared distances out of a long.
LARGEST = 2**27
#: Bytes of a stored vector. Vectors to fetch that are less far apart than GAP are read at once.
_RECORD, GAP = 4 * DIMS, 256


class Tables:
    """For a set of centroids, the least and largest squared distance of each cell of each component to each centroid.

    ``edges`` has for each component (least value, first values of the cells behind the first one, largest value).
    """

    def __init__(self, edges: list[np.ndarray], centroids: np.ndarray) -> None:
        k = len(centroids)
        self.centroids = centroids
        low, high = np.zeros((DIMS, CELLS, k), np.int64), np.zeros((DIMS, CELLS, k), np.int64)
        for d, e in enumerate(edges):
            first, last = e[:-1, None], np.append(e[1:-1] - 1, e[-1])[:, None]
            c = centroids[None, :, d]
            near = np.where(c < first, first - c, np.where(c > last, c - last, 0))
            low[d, : len(first)] = near**2
            high[d, : len(first)] = np.maximum(np.abs(c - first), np.abs(c - last)) ** 2
        both = lambda t: (t[0::2, :, None] + t[1::2, None, :]).reshape(DIMS // 2, CELLS * CELLS, k)
        self.low, self.high = both(low), both(high)

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """For each code and centroid whether the centroid may be the nearest one."""
        low = np.zeros((len(codes), len(self.centroids)), np.int64)
        high = low.copy()
        for d in range(codes.shape[1]):
            low += self.low[d][codes[:, d]]
            high += self.high[d][codes[:, d]]
        return low <= high.min(axis=1, keepdims=True)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        c = self.centroids
        return (vectors * vectors).sum(1)[:, None] - 2 * (vectors @ c.T) + (c * c).sum(1)[None, :]


def coded(vectors: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte per two components: the numbers of their cells."""
    cells = np.stack([np.searchsorted(e[1:-1], vectors[:, d], side="right") for d, e in enumerate(edges)], axis=1)
    return (cells[:, 0::2] * CELLS + cells[:, 1::2]).astype(np.uint8)


class Vectors:
    """The vector files of a folder; one stays open until another one is asked for."""

    def __init__(self, folder: str) -> None:
        self.folder, self.file, self.stream = folder, None, None

    def fetch(self, file: int, numbers: np.ndarray) -> np.ndarray:
        """Vectors of a file by ascending numbers; those close to each other come with one read."""
        if file != self.file:
            files, at = opened(f"{self.folder}/{file:016x}.vec")
            self.file, self.stream = file, files.open_input_file(at)
        out, ends = [], np.flatnonzero(np.diff(numbers) > GAP) + 1
        for part in np.split(numbers, ends):
            self.stream.seek(int(part[0]) * _RECORD)
            read = np.frombuffer(self.stream.read(int(part[-1] - part[0] + 1) * _RECORD), "<i4").reshape(-1, DIMS)
            out.append(read[part - part[0]])
        return np.concatenate(out).astype(np.int64)


def _written(folder: str, edges: list[np.ndarray]):
    """Vectors -> their place in a file that the task writes, and their code. A repeated attempt writes a file of another name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = uuid.uuid4().int >> 65, 0
        files, at = opened(f"{folder}/{file:016x}.vec")
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(at) as stream:
            for batch in batches:
                n = batch.num_rows
                x = batch.column("q").flatten().to_numpy().reshape(n, DIMS)
                stream.write(x.astype("<i4").tobytes())
                codes = pa.array([c.tobytes() for c in coded(x, edges)], pa.binary())
                out = [pa.array(np.full(n, file)), pa.array(np.arange(number, number + n)), batch.column("vec_id"), codes]
                yield pa.RecordBatch.from_arrays(out, names=["file", "number", "vec_id", "code"])
                number += n

    return run


def _by_file(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(file, positions in the batch, numbers, codes) of each file of a batch."""
    files, numbers = batch.column("file").to_numpy(), batch.column("number").to_numpy()
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, DIMS // 2)
    for file in np.unique(files):
        at = np.flatnonzero(files == file)
        at = at[np.argsort(numbers[at], kind="stable")]
        yield int(file), at, numbers[at], codes[at]


def _changes(folder: str, now: Tables, before: Tables | None):
    """Codes -> (cluster, dim, total): what the sum and (dim DIMS) the size of each cluster change by when ``now`` follows ``before``; dim -1 counts vectors fetched.

    A vector is fetched only if its cells leave its cluster open on either side, or if it moves; without ``before`` all are new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fetched, vectors = np.zeros((len(now.centroids), DIMS + 1), object), 0, Vectors(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            for file, _, numbers, codes in _by_file(batch):
                sides = [(t, t.candidates(codes)) for t in (now, before) if t is not None]
                sure = [may.sum(1) == 1 for _, may in sides]
                home = [may.argmax(1) for _, may in sides]
                need = np.ones(len(codes), bool) if before is None else ~(sure[0] & sure[1] & (home[0] == home[1]))
                if not need.any():
                    continue
                x = vectors.fetch(file, numbers[need])
                fetched += len(x)
                for sign, (t, may), certain, own in zip((1, -1), sides, sure, home, strict=False):
                    cluster, unsure = own[need], ~certain[need]
                    if unsure.any():
                        far = np.where(may[need][unsure], t.distances(x[unsure]), np.iinfo(np.int64).max)
                        cluster[unsure] = far.argmin(1)
                    for c in np.unique(cluster):
                        members = x[cluster == c]
                        total[c, :DIMS] += sign * members.sum(0).astype(object)
                        total[c, DIMS] += sign * len(members)
        c, d = np.nonzero(total)
        names, types = ["cluster", "dim", "total"], pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array([int(v) for v in total[c, d]], types)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([-1], pa.int32()), pa.array([fetched], types)], names=names)

    return run


def _assigned(folder: str, now: Tables):
    """Codes -> (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for file, at, numbers, codes in _by_file(batch):
                far = np.where(now.candidates(codes), now.distances(vectors.fetch(file, numbers)), np.iinfo(np.int64).max)
                cluster[at], distance[at] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, q) of the vectors that are kept."""
    q = F.expr(f"transform(embedding, x -> floor({SCALE} * cast(x as double)))")
    sound = F.expr(f"size(embedding) = {DIMS} and forall(embedding, x -> x is not null and not isnan(x) and abs(floor({SCALE} * cast(x as double))) <= {LARGEST})")
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def cell_edges(kept: DataFrame) -> list[np.ndarray]:
    """For each component its least value, the first values of its further cells, and its largest value; cells hold about equally many vectors."""
    shares = [k / CELLS for k in range(1, CELLS)]
    rows = kept.select(F.posexplode("q").alias("dim", "x")).groupBy("dim").agg(F.min("x"), F.percentile_approx("x", shares, 1000), F.max("x")).collect()
    out = [np.zeros(2, np.int64)] * DIMS
    for dim, least, middle, largest in rows:
        inner = np.unique(np.array(middle, np.int64))
        out[dim] = np.concatenate([[least], inner[inner > least], [largest]]).astype(np.int64)
    return out


def centroid_clusters(vectors: DataFrame, fetched: list[int] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``vectors`` (vec_id, embedding) that is kept.

    Kept are vectors of DIMS components, none null or non-finite, in size below LARGEST once scaled (beyond that a squared distance would not fit a long). Components become
    floor(SCALE * x). The first centroids are the CENTROIDS vectors (all, if fewer) with the smallest hexadecimal SHA-256 of ``1:<vec_id>``;
    rows without a vec_id are clustered but start none, and rows of one vec_id go in the order of their components. In each of ROUNDS rounds every vector
    goes to the nearest centroid (the smaller number of equal ones) and each non-empty centroid becomes the floor of the mean of its
    vectors; then all are assigned once more. An inertia that doesn't fit a long is null. ``fetched`` receives for each round how many full vectors it read.

    Every task that writes vectors puts them into one file of records of equal length and keeps, as a table, their places and their approximations:
    a cell of CELLS for each component, two in a byte. A round reads the approximations only. Tables of the squared
    distances from each cell to each centroid, summed over a vector's cells, give an interval for each centroid; where the intervals leave one
    centroid and the same one as in the round before, the vector itself is never read, since the sums of clusters change only by
    vectors that move. The others are read from their file by their number. The first round reads all vectors, for the sums, and so does the last assignment,
    for the distances. Only sums per cluster and component reach the driver.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    kept = scratch.table(scaled(vectors), "kept")
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = kept.where("vec_id is not null").select(mark.alias("mark"), "q").orderBy("mark", "q").limit(CENTROIDS).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["q"] for r in start], np.int64)
    edges, folder = cell_edges(kept), f"{scratch.path}/vectors"
    codes = scratch.table(kept.mapInArrow(_written(folder, edges), "file long, number long, vec_id long, code binary"), "codes")
    scratch.drop("kept")
    place = codes.select("file", "number", "code")
    sums, before = np.zeros((len(centroids), DIMS + 1), object), None
    for _ in range(ROUNDS):
        now = Tables(edges, centroids)
        changes = place.mapInArrow(_changes(folder, now, before), "cluster int, dim int, total decimal(38,0)")
        for cluster, dim, total in changes.groupBy("cluster", "dim").agg(F.sum("total")).collect():
            if dim >= 0:
                sums[cluster, dim] += int(total)
            elif fetched is not None:
                fetched.append(int(total))
        before, centroids = now, centroids.copy()
        for c in range(len(centroids)):
            if sums[c, DIMS]:
                centroids[c] = [s // sums[c, DIMS] for s in sums[c, :DIMS]]
    found = scratch.table(codes.mapInArrow(_assigned(folder, Tables(edges, centroids)), "vec_id long, cluster int, distance long"), "assigned")
    # one row per centroid
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda v: int(v) if v < 2**63 else None
    whole = fits(sum(inertia.values()))
    rows = [(c, fits(v), whole, digest[c]) for c, v in inertia.items()]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = "(select vec_id, q, cluster, distance from (select v.vec_id, v.q, c.cluster, {far} as distance, row_number() over (partition by v.vec_id order by {far}, c.cluster) as n from v cross join {c} c) where n = 1)"
    parts = [
        f"""v as (select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q from embeddings
where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        f"c0 as (select row_number() over (order by mark) - 1 as cluster, q from (select sha256('1:' || vec_id) as mark, q from v order by mark limit {CENTROIDS}))",
    ]
    for k in range(ROUNDS):
        parts.append(f"a{k} as materialized {near.format(far=far, c=f'c{k}')}")
        parts.append(
            f"""m{k} as (select cluster, list(mean order by dim) as q from
(select cluster, dim, cast(floor(sum(x) / count(*)) as bigint) as mean from (select cluster, unnest(q) as x, generate_subscripts(q, 1) as dim from a{k}) group by cluster, dim) group by cluster)"""
        )
        parts.append(f"c{k + 1} as materialized (select c.cluster, coalesce(m.q, c.q) as q from c{k} c left join m{k} m on m.cluster = c.cluster)")
    parts.append(f"a as materialized {near.format(far=far, c=f'c{ROUNDS}')}")
    return f"""with {", ".join(parts)}
select a.vec_id, cast(a.cluster as int) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from a join c{ROUNDS} c on c.cluster = a.cluster"""


OP12_SQL = _op12_sql()
