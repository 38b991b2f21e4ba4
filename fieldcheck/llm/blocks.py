"""Comparisons within groups of any size: groups are cut into blocks, and pairs of blocks are tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_block_pairs(rows: DataFrame, blocks: Column, member: Column) -> DataFrame:
    """Repeat each row once per pair of blocks that its own block is in.

    ``blocks`` is the number of blocks of the row's group. Adds blk (the row's own block, dealt by the
    hash of ``member``), bi and bj (bi <= bj). Two members of a group meet in exactly one (bi, bj).
    """
    rows = rows.withColumn("_n", blocks.cast("long")).withColumn("blk", F.pmod(F.xxhash64(member), F.col("_n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return (
        rows.withColumn("_o", other)
        .withColumn("bi", F.least("blk", "_o"))
        .withColumn("bj", F.greatest("blk", "_o"))
        .drop("_n", "_o")
    )


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together in one partition and next to each other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, each with the positions where its groups start.

    Keys are integers without nulls. A table holds about a batch of rows, or one group if that is larger.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        at = np.flatnonzero(change)
        last = tuple(c[-1] for c in cols)
        if not len(at):
            held.append(batch)
            continue
        cut = int(at[-1])
        if cut:
            held.append(batch.slice(0, cut))
        yield _with_starts(held, keys)
        held = [batch.slice(cut)]
    if held:
        yield _with_starts(held, keys)


def _with_starts(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches)
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return table, np.flatnonzero(change)


def min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over the undirected edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
