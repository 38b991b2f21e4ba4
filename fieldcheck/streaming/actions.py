"""Changed interviews from a stream of action-log files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldcheck.operators.changes import COMPLETED, DIGESTS, event_hashes, hashed_events, summed_events, updated_interviews

ACTIONS = "interview__id string, date string, time string, action int, originator string, role int"


def watch_actions(
    spark: SparkSession, folder: str, checkpoint: str, tracker: Callable[[], DataFrame], handle: Callable[[DataFrame, DataFrame], None], events: Iterable = (COMPLETED,)
) -> StreamingQuery:
    """Read what is new in a folder of Parquet action logs, then stop; per batch ``handle(changed, hashes)`` is called.

    A batch's interviews are compared with ``tracker()`` by all of their log in the folder, so events of one interview may come in different
    batches; so each batch reads the folder again. ``watch_digests`` keeps what it needs as state instead. ``handle`` saves the new hashes; as a batch may be repeated after a failure, it must replace rather than add.
    """
    stream = spark.readStream.schema(ACTIONS).parquet(folder)

    def each(batch: DataFrame, _: int) -> None:
        seen = batch.select("interview__id").distinct()
        whole = spark.read.schema(ACTIONS).parquet(folder).join(seen, "interview__id", "left_semi")
        hashes = event_hashes(whole, events)
        handle(updated_interviews(tracker(), hashes), hashes)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_digests(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], events: Iterable = (COMPLETED,)) -> StreamingQuery:
    """Read what is new in a folder of Parquet action logs, then stop; per batch ``handle(changed, batch)`` is called with the digests of interviews that changed.

    The state, kept below ``checkpoint``, is the sum of hashes of every interview and the hashes of its events, so a batch reads its own files only, and the
    digests that it gives are those of whole logs. An event that comes again, late or in another file, changes nothing: of equal events of one interview one counts,
    as in ``event_digests`` over distinct rows. The state holds two numbers for each event ever seen; for many of them, choose Spark's RocksDB state store, which keeps it on disk. After a failure a batch may be handled again, with the same number and rows; ``save_digests`` replaces them.
    """
    new = hashed_events(spark.readStream.schema(ACTIONS).parquet(folder), events).dropDuplicates(["interview__id", "a", "b"])
    return summed_events(new).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_digests(folder: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own below ``folder``, replacing what a failed attempt left."""

    def handle(changed: DataFrame, batch: int) -> None:
        changed.select("interview__id", "n_events", "sum_a", "sum_b").write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return handle


def load_digests(spark: SparkSession, folder: str) -> DataFrame:
    """DIGESTS rows of all batches: of each interview the latest one."""
    rows = spark.read.schema(f"{DIGESTS}, batch bigint").parquet(folder)
    last = F.max_by(F.struct("n_events", "sum_a", "sum_b"), "batch").alias("last")
    return rows.groupBy("interview__id").agg(last).select("interview__id", "last.*")
