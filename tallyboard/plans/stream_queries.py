"""Registered queries that run streams to their end over data derived from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources.store import Store, work_folder
from ..streaming import liveness as L
from ..streaming import log_files
from ..streaming.single_flight import run_once
from ..streaming.sync_merge import SyncMerge, merge_stream

#: Seconds that a run stays fresh in ``live_runs``, and of its grace: users act a few times a week.
FRESH_S, GRACE_S = 86_400, 43_200


def run_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the signs of a run: a start, heartbeats (some of a strange worker), some results."""
    e, u = A.table(spark, sf_dir, "events"), F.col("user_id")
    ends = e.groupBy(u.alias("e_user")).agg(F.min(F.struct("ts", "event_id")).alias("first"), F.max(F.struct("ts", "event_id")).alias("last"))
    rows = e.join(ends, u == F.col("e_user"))
    first, last = F.col("event_id") == F.col("first.event_id"), F.col("event_id") == F.col("last.event_id")
    kind = F.when(first, "start").when(last & (u % 11 == 0), "result").otherwise("beat")
    return rows.select(
        u.cast("string").alias("run_id"), kind.alias("kind"), F.when(~first & (u % 17 == 0), -5).otherwise(u * 10).alias("worker_pid"),
        F.when(u % 13 == 0, "elsewhere").otherwise(u.cast("string")).alias("directory"), F.col("ts").cast("timestamp").alias("at"),
    )


def _in_order(rows: DataFrame, folder: str, parts: int = 3):
    """A stream of the rows, yielded after each part of increasing ``at`` has landed: one batch a part, in any number of files."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    width = ((high or 0) - (low or 0)) // parts + 1
    part = F.floor((F.unix_micros("at") - F.lit(low or 0)) / width)
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/signs")
    store = Store(spark, folder)
    store.fs.mkdirs(store.path("landed"))
    for i in range(parts):
        if store.exists(f"signs/part={i}"):
            store._rename(store.path(f"signs/part={i}"), store.path(f"landed/{i}"), over=False)
        yield spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/landed")


def live_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "live")
    for rows in _in_order(run_signs(spark, sf_dir), folder):
        changes = L.watch(rows, FRESH_S, GRACE_S, event_time=True)
        done = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        done.awaitTermination()
    return spark.read.schema(L.OUT).parquet(f"{folder}/out").select("run_id", "status", "raised", F.unix_millis("at").alias("at_ms"))


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three syncs through a stream, the last at a sign-in page: the tickets and the state they leave."""
    folder = work_folder(spark, "merge")
    t = A.tickets(spark, sf_dir).select("id", "status", "project")
    merge = SyncMerge(spark, f"{folder}/state", t.schema, lambda: A.work_items(spark, sf_dir).select("ticket_id", "position", "stage"))
    syncs = [
        t.filter("id % 10 <> 0").select(F.lit(1).alias("sync_no"), F.lit(False).alias("login"), F.col("id").alias("row_no"), "*"),
        t.filter("id % 10 NOT IN (1, 2)").select(F.lit(2).alias("sync_no"), F.lit(False).alias("login"), F.col("id").alias("row_no"), "*"),
        t.limit(1).select(F.lit(3).alias("sync_no"), F.lit(True).alias("login"), F.lit(0).cast("long").alias("row_no"), F.lit(None).cast("long").alias("id"), "status", "project"),
    ]
    for sync in syncs:
        sync.write.mode("append").parquet(f"{folder}/landed")
        rows = spark.readStream.schema(sync.schema).parquet(f"{folder}/landed")
        run_once(spark, f"{folder}/sync", lambda checkpoint, rows=rows: merge_stream(rows, merge, checkpoint))
    tables, settings = merge.state()
    new = tables["new_tickets"].withColumnRenamed("id", "n_id")
    out = tables["tickets"].join(new, F.col("id") == F.col("n_id"), "left")
    return out.select("id", "status", "project", F.col("n_id").isNotNull().alias("is_new"), F.lit(settings["status"]).alias("sync_status"), F.lit(settings["unread"]).alias("unread"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as the logs of sixteen runs, tailed in bounded batches and byte ranges."""
    folder = work_folder(spark, "logs")
    log_files.register(spark)
    c = A.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 16).alias("run"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    ordered = c.repartition("run").sortWithinPartitions("run", "conv_id", "turn")
    ordered.select("run", "text").write.partitionBy("run").text(f"{folder}/logs")
    size = sum(s.getLen() for s in spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/logs").getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/logs/*/*")) or [])
    options = {"path": f"{folder}/logs", "file": "part-*", "progress": f"{folder}/progress.json", "batch_bytes": str(size // 4 + 1), "range_bytes": str(size // 64 + 1)}
    rows = spark.readStream.format("log_files").options(**options).load()
    q = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("run_id string, line string, byte_offset long").parquet(f"{folder}/out")


STREAM_QUERIES = {f.__name__: f for f in (live_runs, stream_merge, log_lines)}

_LIMIT, _GRACE = FRESH_S * 1000, GRACE_S * 1000

STREAM_ORACLE_SQL = {
    "live_runs": f"""WITH e AS (
  SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS cnt FROM events
), signs AS (
  SELECT *, CASE WHEN rn = 1 THEN 'start' WHEN rn = cnt AND user_id % 11 = 0 THEN 'result' ELSE 'beat' END AS kind FROM e
), counted AS (
  SELECT * FROM signs WHERE user_id % 13 <> 0 AND (kind <> 'beat' OR user_id % 17 <> 0)
), steps AS (
  SELECT user_id, kind, ms, lead(ms) OVER w AS next_ms, lead(kind) OVER w AS next_kind, coalesce(lead(ms) OVER w - 1, (SELECT max(epoch_us(ts) // 1000) FROM events)) AS upto
  FROM counted WINDOW w AS (PARTITION BY user_id ORDER BY ms, rn)
), judged AS (
  SELECT *, kind <> 'result' AND ms + {_LIMIT} + 1 <= upto AS stale, kind <> 'result' AND ms + {_LIMIT} + 1 + {_GRACE} <= upto AS raised FROM steps
), live AS (
  SELECT * FROM (SELECT *, coalesce(bool_or(raised) OVER (PARTITION BY user_id ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM judged) WHERE NOT over
), out AS (
  SELECT user_id, 'running' AS status, false AS raised, ms AS at_ms FROM live WHERE kind = 'start'
  UNION ALL SELECT user_id, 'interrupted', false, ms + {_LIMIT} + 1 FROM live WHERE stale
  UNION ALL SELECT user_id, 'interrupted', true, ms + {_LIMIT} + 1 + {_GRACE} FROM live WHERE raised
  UNION ALL SELECT user_id, 'running', false, next_ms FROM live WHERE stale AND NOT raised AND next_kind = 'beat'
  UNION ALL SELECT user_id, 'completed', false, next_ms FROM live WHERE NOT raised AND next_kind = 'result'
  UNION ALL SELECT user_id, 'interrupted', true, ms FROM signs WHERE user_id % 13 = 0 AND kind = 'start'
)
SELECT CAST(user_id AS VARCHAR) AS run_id, status, raised, at_ms FROM out""",
    "log_lines": """WITH c AS (
  SELECT conv_id % 16 AS run, conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations
), pieces AS (
  SELECT run, conv_id, turn, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS k FROM c
), placed AS (
  SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY run ORDER BY conv_id, turn, k) AS byte_offset FROM pieces
)
SELECT CAST(run AS VARCHAR) AS run_id, rtrim(line, chr(13)) AS line, CAST(byte_offset AS BIGINT) AS byte_offset FROM placed WHERE rtrim(line, chr(13)) <> ''""",
}
