"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Neighbours of a node that meet in one task; a node of more is split by a hash of its neighbours.
HUB = 1024


def _with_least(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges`` (u, v) with m, the smallest v of each u.

    The minimum comes from an aggregate with partial sums. Its join back is salted for nodes of more than HUB neighbours: their edges are dealt out
    over as many tasks as their number asks for, and the minimum is sent to each of those. Such nodes are few, one for HUB edges at most.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / HUB).alias("salts"))
    least = scratch.table(least, f"{name}-least")
    hubs = least.where("salts > 1").select("u", "salts")
    dealt = edges.join(hubs, "u", "left").select("u", "v", F.expr("if(salts is null, 0L, pmod(xxhash64(v), salts))").alias("salt"))
    return dealt.join(least.select("u", "m", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")), ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    ``edges`` has two long columns, a and b; direction, repeats and loops don't matter, edges with a
    null end are left out. Each round hangs every node's larger neighbours on its smallest one (large
    star), then every node and its smaller neighbours (small star), and is written to the scratch
    folder. The number of rounds grows with the logarithm of the graph. No neighbour list is ever held in a task, nor do all neighbours of a
    large node meet in one.
    """
    now = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    mark, turn = _mark(now), 0
    while mark[0]:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_least(both, scratch, f"{name}-both-{turn}")
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.table(large, f"{name}-large-{turn}")
        near = _with_least(large, scratch, f"{name}-small-{turn}")
        moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.table(moved.unionByName(near.where("v = m").select("u", "v")).distinct(), f"{name}-{turn}")
        for old in (f"{name}-{turn - 1}", f"{name}-large-{turn}", f"{name}-both-{turn}-least", f"{name}-small-{turn}-least"):
            scratch.drop(old)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a checksum that doesn't depend on their order."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
