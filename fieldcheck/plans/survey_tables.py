"""The given tables as tables of a survey, in DataFrames and in SQL.

An order is an interview, a line of it a row of its roster, an event an entry of the action log of its user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of each table; the expressions mean the same to Spark and DuckDB.
HOUSEHOLDS = """
select cast(o_orderkey as {text}) as interview__id, concat('K', cast(o_orderkey as {text})) as interview__key,
       case o_orderstatus when 'F' then 100 when 'P' then 120 else 130 end as interview__status,
       cast(substring(o_orderpriority, 1, 1) as int) as interview_result,
       o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority
from orders"""

ROSTER = """
select cast(l_orderkey as {text}) as interview__id, concat('K', cast(l_orderkey as {text})) as interview__key,
       l_linenumber as line__id, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
from lineitem"""

ACTIONS = """
select cast(user_id as {text}) as interview__id, event_type as action, ts, props as originator, user_id
from events"""

STATS = """
select cast(user_id as {text}) as interview__id, concat('K', cast(user_id as {text})) as interview__key,
       cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as n_questions_unanswered,
       cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as questions__comments,
       cast(sum(case when event_type = 'signup' and value > 60 then 1 else 0 end) as bigint) as entities__errors
from events group by user_id"""


def sql(text: str) -> str:
    """The table for DuckDB, as a subquery."""
    return f"({text.format(text='varchar')})"


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The table for Spark."""
    name = text.split(" from ")[-1].split("\nfrom ")[-1].split()[0]
    return spark.sql(text.format(text="string").replace(f"from {name}", "from {src}"), src=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: ln__1 to ln__7 are 1 if it has a line of that number with a quantity above 25, 0 if not, null without the line; note__1 to note__7 are texts."""
    lines = frame(spark, sf_dir, ROSTER)
    big = [F.max(F.when(F.col("line__id") == k, (F.col("l_quantity") > 25).cast("int"))).alias(f"ln__{k}") for k in range(1, 8)]
    text = [F.max(F.when(F.col("line__id") == k, F.when(F.col("l_returnflag") == "N", "##N/A##").otherwise(F.col("l_returnflag")))).alias(f"note__{k}") for k in range(1, 8)]
    return lines.groupBy("interview__id", "interview__key").agg(*big, *text)


WIDE = f"""
(select interview__id, interview__key, {", ".join(f"max(case when line__id = {k} then case when l_quantity > 25 then 1 else 0 end end) as ln__{k}" for k in range(1, 8))},
        {", ".join(f"max(case when line__id = {k} then case when l_returnflag = 'N' then '##N/A##' else l_returnflag end end) as note__{k}" for k in range(1, 8))}
 from {sql(ROSTER)} group by interview__id, interview__key)"""
