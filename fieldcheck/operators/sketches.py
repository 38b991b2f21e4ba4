"""Approximate thresholds by mergeable quantile sketches, one per check and group, kept from run to run beside the tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators.outliers import Check, long_measures, of_check
from fieldcheck.operators.thresholds import NORMAL

#: Size of a sketch: one holds some thousands of values, whatever the size of its group.
K = 1600
#: Share of a group's values that the rank of a sketched median may be off by. With K = 1600 the standard error of a rank is below 0.1 %, so this is five times that at least, for a merged sketch too.
RANK_ERROR = 0.005
#: Evenly spaced quantiles that stand for a group when its deviation is sought.
STEPS = 500

SKETCHES = "check_id string, key string, n bigint, sketch binary"


def threshold_sketches(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """SKETCHES rows of the interviews in ``rows``; null values don't count. Sketches are aggregated in parts, and no group is held in a task."""
    values = long_measures(rows, checks, [], checked=False).where("value is not null")
    return values.groupBy("check_id", "key").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(K)).alias("sketch"))


def merged_sketches(*parts: DataFrame) -> DataFrame:
    """SKETCHES rows of all interviews of several parts that have no interview in common, as of earlier runs and of new interviews."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("check_id", "key").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))


def _at(sketch: Column, shares: Column) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, shares)


def sketched_thresholds(sketches: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_id, key, n_obs, med, mad, ll, ul), as ``thresholds`` gives them, from sketches.

    The rank of med is off by RANK_ERROR of the group at most (a chance event beyond five standard errors apart); small groups are exact up to the lower one of two middle values. mad is the median distance of
    STEPS evenly spaced quantiles from med, so its rank is off by twice that and one step.
    """
    shares = F.array(*[F.lit((k - 0.5) / STEPS) for k in range(1, STEPS + 1)])
    rows = sketches.select("check_id", "key", F.col("n").alias("n_obs"), _at(F.col("sketch"), F.lit(0.5)).alias("med"), _at(F.col("sketch"), shares).alias("q"))
    away = F.array_sort(F.filter(F.transform("q", lambda x: F.abs(x - F.col("med"))), lambda d: ~F.isnan(d)))
    rows = rows.withColumn("mad", F.get(away, F.floor(F.size(away) / 2).cast("int")) * NORMAL).withColumn("n_mad", of_check(checks, "check_id", [float(k.n_mad) for k in checks]))
    limits = [(F.col("med") - F.col("n_mad") * F.col("mad")).alias("ll"), (F.col("med") + F.col("n_mad") * F.col("mad")).alias("ul")]
    return rows.select("check_id", "key", "n_obs", "med", "mad", *limits)
