"""Publishing the tables of a run as a whole: a version in a folder of its own, then one pointer to it.

    folder/versions/<version>/<table>   Parquet, or CSV with a header
    folder/CURRENT                      the name of the version that readers see

The pointer is replaced by one rename, so a reader sees the run before or the new one, each with all its tables. A run that fails leaves a
version that nothing points to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that is published in the folder, None before the first one."""
    at = _path(spark, f"{folder}/{POINTER}")
    if not at.getFileSystem(_conf(spark)).exists(at):
        return None
    return spark.read.text(f"{folder}/{POINTER}", wholetext=True).first()[0]


def published(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the current version; None if there is no version yet."""
    version = current_version(spark, folder)
    return None if version is None else spark.read.parquet(f"{folder}/versions/{version}/{name}")


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Write the pointer beside its place and rename it over the one before, in one step where the file system has one."""
    jvm, conf = spark._jvm, _conf(spark)
    beside, place = _path(spark, f"{folder}/.{POINTER}-{uuid.uuid4().hex}"), _path(spark, f"{folder}/{POINTER}")
    out = place.getFileSystem(conf).create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    qualified = lambda p: p.getFileSystem(conf).makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified(place).toUri(), conf).rename(qualified(beside), qualified(place), over)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: str, for_editing: tuple[str, ...] = ()) -> str:
    """Write all tables as one version and make it the current one; its folder. Tables named in ``for_editing`` are written as CSV too, below ``edit/``.

    A version is written once: what a failed attempt of the same name left is replaced, but the current version is not (ValueError).
    """
    if not version or "/" in version or version.startswith("."):
        raise ValueError(f"not a name for a version: {version!r}")
    if current_version(spark, folder) == version:
        raise ValueError(f"version {version!r} is published already in {folder}")
    at = f"{folder}/versions/{version}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    for name in for_editing:
        spark.read.parquet(f"{at}/{name}").write.mode("overwrite").option("header", True).csv(f"{at}/edit/{name}")
    _point(spark, folder, version)
    return at
