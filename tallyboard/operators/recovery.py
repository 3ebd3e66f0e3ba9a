"""Recovery after a restart: which runs to take up again, from which offset, and what becomes of their items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import jobs as J

# What a recovered item's log says, and the error of an interrupted one.
TAKEN_UP, FINISHED = "已恢复后台任务，正在继续接收日志", "后台任务已完成，正在恢复执行结果"
LOST = "未检测到仍在运行的 AI 后台进程，也没有找到完整执行结果。"
BY_PHASE = {"analysis": "analyzing", "modification": "runningAI"}


def offsets(events: DataFrame) -> DataFrame:
    """(run_id, last_offset): where each run's log goes on after a restart.

    Only events with a message to show move the offset, so what shows nothing is read again,
    which does no harm. Null runs are left out.
    """
    shown = F.col("display").isNotNull() & (F.col("display") != "")
    return events.filter(F.col("run_id").isNotNull() & shown).groupBy("run_id").agg(F.max("offset").alias("last_offset"))


def due(items: DataFrame, recovered: DataFrame | None = None, launch: str | None = None) -> DataFrame:
    """The items that a launch has to recover: those whose stage is that of a running job.

    ``recovered`` (launch_id, item_id) are those that were recovered already: each once a launch.
    """
    out = items.filter(F.col("stage").isin(*S.RECOVERABLE))
    if recovered is None:
        return out
    mine = recovered.filter(F.col("launch_id") == launch).select(F.col("item_id").alias("r_item")).distinct()
    return out.join(mine, F.col("item_id") == F.col("r_item"), "left_anti")


def recover(items: DataFrame, inspected: DataFrame, seen: DataFrame) -> DataFrame:
    """``items`` (item_id, stage, run_id, phase, last_message) with what recovery makes of them.

    ``inspected`` has run_id and status (``jobs.inspect``), ``seen`` run_id and last_offset. Added:
    outcome (recovered, completed or interrupted), new_stage, execution_state, error, message (a log
    entry, null where it would repeat the last one) and resume_at, the offset from which the run's log
    is read on, null where it is not. A job without a run, or whose run's phase does not fit its stage
    (unless it is interrupted), is interrupted; so is one whose run was not inspected. Of several
    rows of a run the greatest offset and the first status by text count.
    """
    i = inspected.groupBy(F.col("run_id").alias("i_run")).agg(F.min("status").alias("status"))
    o = seen.groupBy(F.col("run_id").alias("o_run")).agg(F.max("last_offset").alias("last_offset"))
    d = items.join(i, F.col("run_id") == F.col("i_run"), "left").join(o, F.col("run_id") == F.col("o_run"), "left")
    fits = F.col("run_id").isNotNull() & ((J.phase(F.col("stage")) == F.col("phase")) | ((F.col("stage") == "interrupted") & F.col("phase").isin(*BY_PHASE)))
    outcome = F.when(~F.coalesce(fits, F.lit(False)), "interrupted").when(F.col("status") == "running", "recovered").when(F.col("status") == "completed", "completed").otherwise("interrupted")
    d = d.withColumn("outcome", outcome)
    lost = F.col("outcome") == "interrupted"
    by_phase = F.when(F.col("phase") == "analysis", BY_PHASE["analysis"]).otherwise(BY_PHASE["modification"])
    message = F.when(~lost, F.when(F.col("outcome") == "recovered", TAKEN_UP).otherwise(FINISHED)).when(~F.col("last_message").eqNullSafe(F.lit(LOST)), LOST)
    return d.select(
        *items.columns, "outcome", F.when(lost, "interrupted").otherwise(by_phase).alias("new_stage"),
        F.when(lost & F.col("run_id").isNotNull(), "interrupted").when(~lost, F.when(F.col("outcome") == "recovered", "recovered").otherwise("reconnecting")).alias("execution_state"),
        F.when(lost, LOST).alias("error"), message.alias("message"), F.when(~lost, F.coalesce("last_offset", F.lit(0))).cast("long").alias("resume_at"),
    )
