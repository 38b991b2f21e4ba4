"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, min_labels, whole_groups
from .graph import connected_components
from .scratch import Scratch
from .tables import table

#: Vectors that a cell aims at, most cells of a label, vectors that one label's centroids are fitted on.
CELL, CELLS, FIT = 512, 1024, 16384
#: Vectors in a block, and in a task that assigns cells.
BLOCK, ASSIGN = 1024, 8192


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids. Starts from rows spread evenly over the input; an empty cell keeps its centroid."""
    centre = unit[np.linspace(0, len(unit) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (unit @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, cell, unit)
        norm = np.linalg.norm(total, axis=1)
        centre[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centre


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("class_id")
    x = np.stack(rows["vec"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = spherical_kmeans(x, min(int(rows["k"].iloc[0]), len(x)))
    return pd.DataFrame({"label": rows["label"].iloc[0], "dim": rows["dim"].iloc[0], "cell": range(len(centre)), "centre": list(centre)})


def _assigned(sin_angle: float):
    """Vectors to their own cell, and to each later cell that may hold a partner of theirs.

    y lies in cell c' only if y (c' - c) >= 0, so x of cell c with x (c - c') > sin(angle) |c - c'|
    is further from that boundary than the angle, and needs no visit.
    """

    def run(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"label": [], "dim": [], "cell": [], "home": [], "class_id": [], "copies": [], "vec": []})
        home, who = np.zeros(len(rows), int), [np.arange(len(rows))]
        cells, homes = [home], [np.ones(len(rows), bool)]
        if len(centres):
            c = np.stack(centres.sort_values("cell")["centre"].to_numpy())
            x = np.stack(rows["vec"].to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ c.T
            home = near.argmax(1)
            cells = [home]
            apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
            own = near[np.arange(len(x)), home]
            for k in range(1, len(c)):
                go = np.flatnonzero((home < k) & (own - near[:, k] <= sin_angle * apart[home, k] + 1e-9))
                who.append(go)
                cells.append(np.full(len(go), k))
                homes.append(np.zeros(len(go), bool))
        out = rows.iloc[np.concatenate(who)][["label", "dim", "class_id", "copies", "vec"]].copy()
        out["cell"], out["home"] = np.concatenate(cells), np.concatenate(homes)
        return out[["label", "dim", "cell", "home", "class_id", "copies", "vec"]]

    return run


def _compared(cosine: float):
    """Vectors of a pair of blocks next to each other -> (a, links, b): linked copies, and stars of linked vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["label", "dim", "cell", "bi", "bj"]):
            ids, copies = rows.column("class_id").to_numpy(), rows.column("copies").to_numpy()
            blk, bi, bj = (rows.column(c).to_numpy() for c in ("blk", "bi", "bj"))
            vecs = rows.column("vec").combine_chunks()
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(float)
            at = np.concatenate([[0], np.cumsum(rows.column("dim").to_numpy())])
            for lo, hi in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                dim = int(at[lo + 1] - at[lo])
                x = flat[at[lo] : at[hi]].reshape(-1, dim)
                norm = np.sqrt((x * x).sum(1))
                if bi[lo] == bj[lo]:
                    one = two = np.arange(hi - lo)
                else:
                    one, two = (np.flatnonzero(blk[lo:hi] == b) for b in (bi[lo], bj[lo]))
                close = (x[one] @ x[two].T) / (norm[one][:, None] * norm[two][None, :]) >= cosine
                if bi[lo] == bj[lo]:
                    np.fill_diagonal(close, False)
                if not close.any():
                    continue
                links = np.zeros(hi - lo, np.int64)
                links[one] += (close * copies[lo:hi][two][None, :]).sum(1)
                if bi[lo] != bj[lo]:
                    links[two] += (close * copies[lo:hi][one][:, None]).sum(0)
                i, j = np.nonzero(close)
                root = min_labels(hi - lo, one[i], two[j])
                own = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][own]), pa.array(links[own]), pa.array(ids[lo:hi][root[own]])], names=["a", "links", "b"]
                )

    return run


def in_cells(classes: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, cell, home, class_id, copies, vec): each class of ``classes`` (label, dim, class_id, copies, vec) in its own cell, and in each later cell that may hold a partner.

    A label has about as many cells as vectors fill blocks of CELL, two from two classes on, but no more than the square root of their number, and CELLS at most. More cells would pay only where vectors
    lie in clusters: the given ones hardly do, and with the square root as the number each would be copied to 30 of 71 cells, for no fewer products.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    cells = F.least(F.lit(CELLS), F.ceil(F.sqrt("n")), F.greatest(F.lit(2), F.ceil(F.col("n") / CELL)))
    sizes = sizes.withColumn("k", cells).withColumn("parts", F.ceil(F.col("n") / ASSIGN))
    picked = classes.join(sizes.where("k > 1"), ["label", "dim"]).where(F.expr(f"pmod(xxhash64(class_id), n) < {FIT}"))
    centres = picked.groupBy("label", "dim").applyInPandas(_fitted, "label long, dim long, cell long, centre array<double>")

    sent = classes.join(sizes.select("label", "dim", "parts"), ["label", "dim"]).withColumn("part", F.expr("pmod(xxhash64(class_id, 1), parts)")).drop("parts")
    centres = centres.join(sizes.select("label", "dim", "parts"), ["label", "dim"]).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).drop("parts")
    keys = ["label", "dim", "part"]
    angle = math.sin(math.acos(cosine)) if cosine > 0 else 1.0
    return sent.groupBy(*keys).cogroup(centres.groupBy(*keys)).applyInPandas(
        _assigned(angle),
        f"label long, dim long, cell long, home boolean, class_id long, copies long, vec {classes.schema['vec'].dataType.simpleString()}",
    )


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of an equal, not null label are linked if their cosine in double precision is at least
    ``cosine``. A vector that is null, empty or all zero, or holds a null or non-finite component, or whose
    label is null, is linked with nothing, as are vectors of different length. n_links counts the
    other rows linked directly, equal rows included; component_id is the smallest vec_id reachable, kept says
    whether that is the row's own. A null vec_id is linked with nothing and kept.

    Equal vectors become one class with a number of copies. In each label of two classes or more,
    spherical k-means is fitted on at most about FIT of them (the smallest hashes); every class then goes
    to its cell and to each other cell that the angle between it and the boundary doesn't rule out, so no
    link is lost. Within a cell, blocks of about BLOCK vectors are compared by one product each; tasks return counts
    and stars of linked vectors, never pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.expr(
        "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    )
    vectors = vectors.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = vectors.where("sound").drop("sound")
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    classes = scratch.table(classes.withColumn("dim", F.size("vec").cast("long")), "classes")

    assigned = scratch.table(in_cells(classes, cosine), "assigned")

    blocks = assigned.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).alias("nh"), F.ceil(F.sum((~F.col("home")).cast("long")) / BLOCK).alias("nv")
    )
    # home blocks are numbered from 0, visiting ones from nh; a task is a pair of home blocks, or a home and a visiting one
    placed = (
        assigned.join(blocks, ["label", "dim", "cell"])
        .where("nh > 0")
        .withColumn("blk", F.expr("if(home, pmod(xxhash64(class_id, 2), nh), nh + pmod(xxhash64(class_id, 2), greatest(nv, 1L)))"))
        .withColumn("other", F.explode(F.expr("if(home, sequence(0L, nh + nv - 1), sequence(0L, nh - 1))")))
        .withColumn("bi", F.least("blk", "other"))
        .withColumn("bj", F.greatest("blk", "other"))
        .select("label", "dim", "cell", "bi", "bj", "blk", "class_id", "copies", "vec")
    )
    found = dealt(placed, "label", "dim", "cell", "bi", "bj").mapInArrow(_compared(cosine), "a long, links long, b long")
    found = scratch.table(found, "links")
    components = connected_components(found.select("a", "b"), scratch, "components")

    counts = found.groupBy("a").agg(F.sum("links").alias("others"))
    known = (
        classes.select("label", "vec", "class_id", "copies")
        .join(counts.withColumnRenamed("a", "class_id"), "class_id", "left")
        .join(components.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(
            "label",
            "vec",
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    out = good.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Vectors of equal label with a cosine of 0.93 or more."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.93)
