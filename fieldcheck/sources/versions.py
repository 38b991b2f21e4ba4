"""Exports of several questionnaire versions, trackers, and writers.

Paths are given by the caller and are read and written by Spark only, so they may lie in any store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.operators.changes import TRACKER
from fieldcheck.operators.decisions import API

#: System table whose rows are not about interviews.
SKIPPED = "assignment__actions"
REJECTIONS = "interview__id string, reject_comment string, interview__status int"


def _files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what lies directly in a folder; hidden names are left out. ValueError if there is no folder."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        raise ValueError(f"no such folder: {path}")
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._")


def inventory(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path, table name) of every table in the version folders below ``folder``; none if there are no folders."""
    out = []
    for version, is_folder in _files(spark, folder):
        if is_folder:
            out += [(f"{folder}/{version}/{name}", name.removesuffix(".parquet")) for name, _ in _files(spark, f"{folder}/{version}") if name.endswith(".parquet")]
    return out


#: Types from narrow to wide; every value of one has its like in those behind it. Of whole numbers beyond 2 ** 53 a double keeps the first digits.
WIDTH = ("void", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string")
WIDENED = "column string, version int, from_type string, to_type string"


def common_types(frames: list[DataFrame]) -> dict[str, str]:
    """The type that each column of the frames gets: the widest of its types in WIDTH, one that is not in there only if the others equal it or are void.

    A truth value and a number meet as text, as do a type that is not in WIDTH and another one.
    """
    found: dict[str, list[str]] = {}
    for df in frames:
        for f in df.schema:
            found.setdefault(f.name, []).append(f.dataType.simpleString())
    out = {}
    for name, types in found.items():
        some = set(types) - {"void"}
        if len(some) <= 1:
            out[name] = next(iter(some), "void")
        elif some - set(WIDTH) or "boolean" in some:
            out[name] = "string"
        else:
            out[name] = max(some, key=WIDTH.index)
    return out


def widened_columns(frames: list[DataFrame]) -> list[tuple[str, int, str, str]]:
    """(column, version from 1, its type, type after the union) of every column that a union changes."""
    common = common_types(frames)
    kinds = [(f.name, n, f.dataType.simpleString()) for n, df in enumerate(frames, 1) for f in df.schema]
    return [(name, n, kind, common[name]) for name, n, kind in kinds if kind != common[name]]


def widening_report(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """WIDENED rows of ``widened_columns``."""
    return spark.createDataFrame(widened_columns(frames), WIDENED)


def union_versions(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column that a version lacks is null there. Labels of columns (metadata) are those of the first frame that has them.

    A column whose type differs between versions gets their common type (``common_types``) before the union.
    """
    common = common_types(frames)
    frames = [df.select(*[F.col(f"`{f.name}`").cast(common[f.name]).alias(f.name, metadata=f.metadata) if f.dataType.simpleString() != common[f.name] else F.col(f"`{f.name}`") for f in df.schema]) for df in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    metadata: dict[str, dict] = {}
    for df in frames:
        for f in df.schema:
            if f.metadata and f.name not in metadata:
                metadata[f.name] = f.metadata
    for name, m in metadata.items():
        out = out.withMetadata(name, m)
    return out


def combine_versions(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables by name, each the union of its versions."""
    paths: dict[str, list[str]] = {}
    for path, name in inventory(spark, folder):
        paths.setdefault(name, []).append(path)
    return {name: union_versions([spark.read.parquet(p) for p in some]) for name, some in paths.items()}


def ingest(tables: dict[str, DataFrame], households: str, members: str) -> dict[str, DataFrame]:
    """Tables by name with the main one called households, the roster members, and without the table of assignments."""
    missing = {households, members} - set(tables)
    if missing:
        raise ValueError(f"no table {sorted(missing)}; there are {sorted(tables)}")
    names = {households: "households", members: "members"}
    return {names.get(k, k): df for k, df in tables.items() if k != SKIPPED}


def load_tracker(spark: SparkSession, folder: str) -> DataFrame:
    """The tracker of the last run: an empty one if the folder has none, ValueError for several or no folder."""
    found = [name for name, is_folder in _files(spark, folder) if is_folder]
    if len(found) > 1:
        raise ValueError(f"several trackers in {folder}: {found}")
    return spark.read.schema(TRACKER).parquet(f"{folder}/{found[0]}") if found else spark.createDataFrame([], TRACKER)


def save_tracker(tracker: DataFrame, folder: str, name: str) -> None:
    """Write a tracker into the folder; the caller removes the one before once the run has succeeded."""
    tracker.select("interview__id", "event_string", "event_hash").write.mode("errorifexists").parquet(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> str:
    """Write one table, replacing what is there; its path."""
    path = f"{folder}/{name}"
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    return [write_table(df, folder, name, kind) for name, df in tables.items()]


def data_timestamp(df: DataFrame) -> DataFrame:
    """(latest): modification time of the newest file that ``df`` reads, null for none."""
    return df.select(F.max("_metadata.file_modification_time").alias("latest"))


def read_rejections(spark: SparkSession, path: str) -> DataFrame:
    """An edited rejection list, CSV with a header; columns that don't agree with API are a ValueError."""
    header = tuple(spark.read.option("header", True).csv(path).columns)
    if header != API:
        raise ValueError(f"a rejection list has the columns {API} in this order, not {header}")
    return spark.read.option("header", True).schema(REJECTIONS).csv(path)


#: Columns of the team table and their labels.
TEAM = {"UserId": "Interviewer id", "UserName": "Interviewer", "SupervisorId": "Supervisor id", "SupervisorName": "Supervisor", "Role": "Role"}


def team_table(df: DataFrame) -> DataFrame:
    """The team's columns, with labels as metadata."""
    out = df.select(*TEAM)
    for name, label in TEAM.items():
        out = out.withMetadata(name, {"label": label})
    return out
