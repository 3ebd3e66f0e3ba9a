"""A few tickets to show and test a board with, before anything was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, kind, priority, status, version, age in seconds. All are of one project.
ROWS = (
    (18426, "Bug", "紧急", "新建", "v3.8.0", 600), (18425, "需求", "高", "新建", "v3.8.0", 1500), (18424, "Bug", "高", "处理中", "v3.7.1", 3600),
    (18423, "Bug", "高", "新建", "v3.8.0", 3600), (18422, "建议", "普通", "待反馈", "v3.8.0", 10800), (18421, "Bug", "普通", "处理中", "v3.7.0", 18000),
    (18420, "支持", "普通", "新建", "v3.8.0", 86400), (18419, "Bug", "高", "待反馈", "v3.7.1", 86400), (18418, "任务", "普通", "新建", "v3.9.0", 172800),
)
PROJECT = "ops"
SCHEMA = "id long, kind string, priority string, status string, version string, age_s long"


def tickets(spark: SparkSession, now: str) -> DataFrame:
    """The sample tickets as they are at ``now``; they have no author and no source."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.selectExpr(
        "id", f"'{PROJECT}' AS project", "kind", "priority", "status", "version", f"TIMESTAMP '{now}' - make_dt_interval(0, 0, 0, age_s) AS updated_at",
        "'' AS assignee", "CAST(NULL AS STRING) AS author", "concat('sample ', id) AS title", "concat(kind, ' of the sample') AS description", "CAST(NULL AS STRING) AS source_url",
    )
