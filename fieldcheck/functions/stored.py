"""Intermediate results in the shared scratch folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, with its scheme.

    Where that is unset, a temporary folder is set on a session that runs on one machine; on a cluster its executors
    would each write to a disk of their own, so it is a RuntimeError there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldcheck-"))
        base = context.getCheckpointDir()
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString().rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate results."""
    return f"{shared_folder(spark)}/fieldcheck-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet and read again, so that plans that use them twice don't compute them twice and a lost executor costs only its running tasks."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Delete all that ``stored`` has written in this application. To be called when no DataFrame made from it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
