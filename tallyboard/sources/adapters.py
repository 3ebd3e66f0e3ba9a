"""Typed views (tickets, work items, repositories) over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a tracker shows them: text cells, not yet normalised."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    trackers = F.array(*[F.lit(x) for x in ("Bug", "需求", "建议", "支持", "任务", "缺陷")])
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("project"),
        F.element_at(trackers, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("tracker"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "紧急").when(F.col("o_orderpriority") == "2-HIGH", "高").otherwise("普通").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "已关闭").when(F.col("o_orderstatus") == "P", "处理中").otherwise("新建").alias("status"),
        F.concat(F.lit("v"), F.year("o_orderdate"), F.lit("."), F.month("o_orderdate")).alias("version"),
        F.col("o_orderdate").alias("updated_at"), F.col("c_name").alias("assignee"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("n_name")).alias("author"),
        F.concat(F.lit("order of "), "c_name").alias("title"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat(F.lit("Clerk in "), "n_name")).alias("description"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("https://tracker.example/issues/"), "o_orderkey")).alias("source_url"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalise(raw_tickets(spark, sf_dir))


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a work item, ``position`` being a sortable struct of its insertion order."""
    stage = F.create_map(*[F.lit(x) for pair in {"AO": "awaitingApproval", "AF": "awaitingPlanApproval", "RO": "runningAI", "RF": "interrupted", "NO": "completed", "NF": "failed"}.items() for x in pair])
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("ticket_id"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("position"), stage[F.concat("l_returnflag", "l_linestatus")].alias("stage"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"))


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.element_at(segments, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("project"), F.col("s_name").alias("path"), (F.col("s_suppkey") % 10 == 3).alias("is_default"))
