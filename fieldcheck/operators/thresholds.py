"""Group-wise medians and scaled median absolute deviations, exact, without a large group in one task.

Groups are numbered by a hash of their keys, under a seed that keeps all of them apart, and values go by that one number: it sorts by radix and is short to
shuffle and to compare. Groups of up to GROUP values are sorted within one row each, after one shuffle. Larger ones are searched by rank: a sketch brackets
the middle, values below the bracket are counted and only those inside it are shuffled. They are dealt out by ranges of (key, value), so a group
spreads over as many tasks as its size asks for; sizes per partition and key, added up in order, tell in which one the wanted ranks are.
A group whose bracket doesn't hold them is searched as a whole.

Where rows bring the number of their group along (``deviations_by_number``), no key is built for any of them, and groups of up to SORTED values are sorted together,
many to a task, as arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcheck.functions.stored import stored
from fieldcheck.functions.workers import package_on_workers

#: Median absolute deviation of a normal distribution times this is its standard deviation.
NORMAL = 1.4826
#: Values of a group that are sorted within a row.
GROUP = 10_000
#: Values of a group that are sorted in one task beside other groups, and values of all groups of such a task, on average.
SORTED, TASK = 200_000, 500_000
#: Values that are packed at once.
PACKED = 2_000_000
#: Size of the sketch that brackets a median, and the share of ranks to either side that the bracket takes in: five times the standard error of the sketch at least.
SKETCH, BAND = 1600, 0.005
#: Bits of a place that number the rows within a partition.
_ROWS = 33


def _middle(low: Column, high: Column) -> Column:
    """The mean of two values; equal ones, infinite ones too, are their own mean."""
    return F.when(low == high, low).otherwise((low + high) / 2)


def _sorted_median(values: Column) -> Column:
    """Median of a sorted array, null for an empty one."""
    n = F.size(values)
    at = lambda k: F.get(values, k.cast("int"))
    return F.when(n > 0, _middle(at(F.floor((n - 1) / 2)), at(F.floor(n / 2))))


def in_one_row(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, deviation) of groups that each fit in a row."""
    sorted_ = values.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("v"))
    found = sorted_.select(*keys, F.size("v").cast("long").alias("n"), "v", _sorted_median(F.col("v")).alias("median"))
    away = F.sort_array(F.filter(F.transform("v", lambda x: F.abs(x - F.col("median"))), lambda d: ~F.isnan(d)))
    return found.select(*keys, "n", "median", away.alias("d")).select(*keys, "n", "median", _sorted_median(F.col("d")).alias("deviation"))


def ranged(values: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, keep, at): rows of ``values`` (keys, value, keep, and tie where values repeat) in order, ``at`` numbering the places of each partition.

    ``tie`` differs between rows, so equal values spread over partitions too; it must be stored, as a repeated task has to deal its rows out as before.
    """
    order = [*keys, "value", *(c for c in ("tie",) if c in values.columns)]
    rows = values.select(*order, *keep).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.select(*keys, "value", *keep, F.monotonically_increasing_id().alias("at")))


def brackets(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, low, high): sizes of groups, and values between which their middle ranks are very likely to be, from sketches that are aggregated in parts."""
    shares = F.array(F.lit(0.5 - BAND), F.lit(0.5 + BAND))
    found = values.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("s"))
    found = found.select(*keys, "n", F.kll_sketch_get_quantile_double("s", shares).alias("q"))
    return stored(found.select(*keys, "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))


def ranked_within(values: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """(keys, n, median) of the groups of ``bounds`` (keys, n, low, high) whose middle ranks are between low and high; others are left out.

    Values below are only counted, and equal ones between are one row with their number, dealt out by ranges. The running sum has one
    row for each partition and key; rows are numbered only in the partitions that hold a middle rank.
    """
    near = values.join(bounds, keys).where("value <= high").withColumn("value", F.when(F.col("value") >= F.col("low"), F.col("value")))
    counted = stored(near.groupBy(*keys, "value").agg(F.count("*").alias("size")))
    placed = ranged(counted.where("value is not null"), keys, ("size",)).withColumn("part", F.shiftright("at", _ROWS))
    below = counted.where("value is null").select(*keys, F.col("size").alias("below"))
    parts = placed.groupBy(*keys, "part").agg(F.sum("size").alias("some")).join(bounds.select(*keys, "n"), keys).join(below, keys, "left")
    upto = F.sum("some").over(Window.partitionBy(*keys).orderBy("part")) + F.coalesce("below", F.lit(0))
    ranks = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    wanted = parts.withColumn("before", upto - F.col("some")).withColumn("rank", F.explode(ranks)).where("rank >= before and rank < before + some")
    rows = placed.join(wanted.select(*keys, "part", "n", "before", "rank"), [*keys, "part"])
    last = F.col("before") + F.sum("size").over(Window.partitionBy(*keys, "part", "rank").orderBy("value"))
    found = rows.withColumn("last", last).where("rank < last and rank >= last - size").groupBy(*keys)
    found = found.agg(F.first("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("ranks"))
    return found.where("ranks = 2 - n % 2").select(*keys, "n", _middle(F.col("low"), F.col("high")).alias("median"))


def ranked_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median), exact: sought between the brackets, and among all values of a group whose brackets turn out not to hold its middle."""
    bounds = brackets(values, keys)
    found = stored(ranked_within(values, keys, bounds))
    missed = stored(bounds.join(found, keys, "left_anti").select(*keys, "n", F.lit(float("-inf")).alias("low"), F.lit(float("nan")).alias("high")))  # no value is above NaN
    return found if missed.isEmpty() else found.unionByName(stored(ranked_within(values, keys, missed)))


def by_rank(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, deviation) of groups of any size."""
    values = stored(values)
    med = ranked_medians(values, keys)
    away = values.join(med, keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("value")).where(~F.isnan("value"))
    return med.join(ranked_medians(away, keys).select(*keys, F.col("median").alias("deviation")), keys, "left")


def numbered(keys: list[str], seed: int) -> Column:
    """The number of a group under a seed."""
    return F.xxhash64(F.lit(seed), *keys)


def deviations(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, deviation) of ``values`` (keys, value); null values don't count, keys are not null.

    Groups are counted by their keys; where two have the same number, another seed is tried.
    """
    values = values.where("value is not null").select(*keys, "value")
    sizes = stored(values.groupBy(*keys).agg(F.count("*").alias("size")))
    for seed in count():
        groups = sizes.withColumn("_group", numbered(keys, seed))
        if groups.groupBy("_group").count().where("count > 1").isEmpty():
            break
    values = values.select(numbered(keys, seed).alias("_group"), "value")
    large = stored(groups.where(F.col("size") > GROUP).select("_group"))
    if large.isEmpty():
        found = in_one_row(values, ["_group"])
    else:
        found = in_one_row(values.join(large, "_group", "left_anti"), ["_group"]).unionByName(by_rank(values.join(large, "_group", "left_semi"), ["_group"]))
    return groups.select(*keys, "_group").join(found, "_group").select(*keys, "n", "median", "deviation")


def _packed(tasks: int, apart: list[int]):
    """From rows of numbers and values, a pair of columns for each check, to (_task, groups, values): the numbers and values of each task as bytes, those of groups ``apart`` left out."""

    def packed(held: list) -> pa.RecordBatch:
        groups, values = (np.concatenate(x) for x in zip(*held, strict=True))
        if apart:
            some = ~np.isin(groups, apart)
            groups, values = groups[some], values[some]
        task = (groups.view(np.uint64) >> np.uint64(20)) % np.uint64(tasks)
        order = np.argsort(task.astype(np.uint16 if tasks <= 1 << 16 else np.uint32), kind="stable")
        task, groups, values = task[order], groups[order], values[order]
        first = np.flatnonzero(np.r_[True, task[1:] != task[:-1]][: len(task)])
        ends = [*first[1:], len(task)]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(task[first].astype(np.int32)), cut(groups), cut(values)], ["_task", "groups", "values"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for group, value in zip(b.columns[::2], b.columns[1::2], strict=True):
                some = value.is_valid()
                held.append((group.filter(some).to_numpy(), value.filter(some).to_numpy()))
                n += len(held[-1][0])
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_group, n, median, deviation) of the packed values of a task, which holds whole groups."""
    parts = [np.frombuffer(x.as_buffer(), t) for b in batches for c, t in ((1, np.int64), (2, np.float64)) for x in b.column(c)]
    if not parts:
        return
    kinds = [[x for x in parts if x.dtype == t] for t in (np.int64, np.float64)]
    groups, values = map(np.concatenate, kinds)
    del parts, kinds

    def medians(groups, values):
        order = np.lexsort((values, groups))
        groups, values = groups[order], values[order]
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        n = np.diff(np.r_[first, len(groups)])
        low, high = values[first + (n - 1) // 2], values[first + n // 2]
        return groups, values, groups[first], n, np.where(low == high, low, (low + high) / 2)

    with np.errstate(all="ignore"):  # infinite values
        groups, values, names, n, median = medians(groups, values)
        away = np.abs(values - np.repeat(median, n))
        some = ~np.isnan(away)
        deviation = np.full(len(names), np.nan)
        if some.any():
            _, _, kept, _, found = medians(groups[some], away[some])
            deviation[np.searchsorted(names, kept)] = found
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n), pa.array(median), pa.array(deviation, mask=np.isnan(deviation))], ["_group", "n", "median", "deviation"])


def in_tasks(wide: list[DataFrame], total: int, apart: list[int]) -> DataFrame:
    """(_group, n, median, deviation) of groups that each fit in a task: ``wide`` tables have a number and a value for each of their checks, ``total`` values in all, but groups ``apart``.

    Values go to their task in bytes, so as many rows are shuffled as there are tasks on either side.
    """
    package_on_workers(wide[0].sparkSession)
    tasks = max(1, -(-total // TASK))
    packed = [df.mapInArrow(_packed(tasks, apart), "_task int, groups binary, values binary") for df in wide]
    rows = reduce(DataFrame.unionByName, packed).repartitionById(tasks, F.col("_task"))
    return rows.mapInArrow(_sorted_groups, "_group long, n long, median double, deviation double")


def deviations_by_number(
    values: Callable[[int, Collection[int] | None], DataFrame], wide: Callable[[int, Collection[int]], list[DataFrame]], mask: int
) -> tuple[int, DataFrame, set[int], set[int]]:
    """(seed, (_group, n, median, deviation), checks with groups of up to GROUP values, checks with larger ones).

    ``values`` gives (_group, _twin, value) for a seed and the numbers of checks, None for all: the number of the row's group under that seed, whose bits in ``mask`` are the
    check, and another hash of the group; ``wide`` gives the same as tables with a pair of columns for each check, of number and value. Of two groups that have the same number the other hashes differ, and another seed is tried. Null values don't count.
    Only tables with groups to be sorted, or to be searched by rank, are read for that.
    """
    for seed in count():
        rows = values(seed, None).where("value is not null").groupBy("_group")
        sizes = stored(rows.agg(F.count("*").alias("size"), (F.min("_twin") != F.max("_twin")).alias("_alike")))
        size = F.col("size")
        kinds = sizes.groupBy(F.col("_group").bitwiseAND(F.lit(mask)).alias("check")).agg(
            F.count_if("_alike").alias("alike"), F.sum(F.when(size <= SORTED, size)).alias("sorted"), F.count_if(size > SORTED).alias("ranked"), F.count_if(size <= GROUP).alias("small"), F.count_if(size > GROUP).alias("large")
        ).collect()
        if not any(k["alike"] for k in kinds):
            break
    of = lambda what: {k["check"] for k in kinds if k[what]}
    both = of("sorted") & of("ranked")
    many = stored(sizes.where(size > SORTED).select("_group")) if of("ranked") else None

    found = []
    if of("sorted") or not kinds:
        apart = [r["_group"] for r in many.where(F.col("_group").bitwiseAND(F.lit(mask)).isin(*both)).collect()] if both else []
        found.append(in_tasks(wide(seed, of("sorted") or None), sum(k["sorted"] or 0 for k in kinds), apart))
    if of("ranked"):
        rows = values(seed, of("ranked")).where("value is not null").select("_group", "value")
        found.append(by_rank(rows.join(many, "_group", "left_semi") if both else rows, ["_group"]))
    return seed, reduce(DataFrame.unionByName, found), of("small"), of("large")


def deviation_thresholds(values: DataFrame, keys: list[str], n_mad: Column) -> DataFrame:
    """(keys, n_obs, med, mad, ll, ul) of ``values`` (keys, value); null values don't count."""
    found = deviations(values, keys).withColumn("n_mad", n_mad).withColumn("mad", F.col("deviation") * NORMAL)
    return found.select(
        *keys,
        F.col("n").alias("n_obs"),
        F.col("median").alias("med"),
        "mad",
        (F.col("median") - F.col("n_mad") * F.col("mad")).alias("ll"),
        (F.col("median") + F.col("n_mad") * F.col("mad")).alias("ul"),
    )


def with_limits(rows: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the ``limits`` (keys, n_obs and more) of their group, those without any left out; no large group is read by one task.

    Limits are stored, so Spark knows their size. Groups of more than GROUP values are few, at most one for so many rows; where there are many others beside
    them, they are joined apart, so their rows are not shuffled.
    """
    limits = stored(limits)
    large = stored(limits.where(F.col("n_obs") > GROUP))
    if large.isEmpty() or limits.count() <= GROUP:
        return rows.join(limits, keys)
    small = rows.join(large.select(*keys), keys, "left_anti").join(limits.where(F.col("n_obs") <= GROUP), keys)
    return rows.join(large, keys).unionByName(small)
