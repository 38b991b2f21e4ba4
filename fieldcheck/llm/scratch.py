"""Tables written to the shared scratch folder, to cut lineage between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldcheck.functions.stored import own_folder

#: Rows hold whole documents, so few of them go into one Arrow batch.
DOCUMENTS_PER_BATCH = 512


class Scratch:
    """A folder of Parquet tables below the application's folder in the session's ``spark.checkpoint.dir``.

    All executors see that folder, so a lost executor costs only its running tasks; a cluster without one is refused, and one machine gets a temporary folder
    (``shared_folder``). Every run has a folder of its own. ``discard_stored`` deletes those of the whole application, once no result is read any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self._conf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to DOCUMENTS_PER_BATCH rows, if they may be larger now."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= DOCUMENTS_PER_BATCH:
        spark.conf.set(key, str(DOCUMENTS_PER_BATCH))
