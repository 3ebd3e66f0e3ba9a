"""Jobs around tickets: stages, reports, durable runs, repositories, captured version-control text.

Every function maps columns or tables to columns or tables. Nulls: a null stage, text or age
counts as absent; an empty table gives an empty one. Where rows tie, the lowest ``position``
wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed values of the domain: stages by the step that they reach, by phase, and with a report.
STEPS = {
    "analyzing": 0, "awaitingPlanApproval": 1, "runningAI": 2, "reviewing": 3, "awaitingApproval": 3, "committing": 4,
    "pulling": 4, "pushing": 4, "partial": 4, "updatingTicket": 5, "completed": 5,
}
PHASES = {"analyzing": "analysis", "runningAI": "modification", "reviewing": "modification"}
REPORTED = ("awaitingApproval", "reviewing", "partial", "completed")
STATUS_TEXTS = {"partial": "代码已提交，工单待重试", "completed": "交付已完成"}
STATUS_TEXT = "等待人工确认"
INTERRUPTED = "AI 后台任务已中断，你可以重新检查进程或返回配置。"
RECONNECTING, RECOVERED = "正在重新连接 AI 任务…", "已恢复后台任务，正在继续接收日志"
CLEAN, DIRTY, NO_REPOSITORY = "仓库状态正常", "仓库存在未提交改动（将保留并继续）", "所选目录不是 Git 仓库"
NO_REASONING = "AI 未按结构返回原因说明，请查看原始输出。"
MARKS = ("SUMMARY:", "REASONING:", "TESTS:", "RISKS:")
FRESH_S = 8.0
HELPER_CHARS, HASH_CHARS = 500, 8


def _by(c: Column, values: dict, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for key, value in values.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def step(stage: Column) -> Column:
    """The index of the step that a stage reaches; null for stages off the path."""
    return _by(stage, STEPS)


def phase(stage: Column) -> Column:
    return _by(stage, PHASES)


def report_status(stage: Column) -> Column:
    return _by(stage, STATUS_TEXTS, STATUS_TEXT)


def report_visible(stage: Column, has_report: Column) -> Column:
    return F.coalesce(has_report & stage.isin(*REPORTED), F.lit(False))


def progress(stage: Column, state: Column, error: Column, provider: Column, ticket_id: Column) -> Column:
    """What the job shows while it runs: the error or a fixed text if interrupted, then by the run's state."""
    default = F.concat(provider, F.lit(" 正在处理 #"), ticket_id, F.lit("，你可以在此查看实时进度。"))
    by_state = F.when(state == "reconnecting", RECONNECTING).when(state == "recovered", RECOVERED).otherwise(F.coalesce(error, default))
    return F.when(stage == "interrupted", F.coalesce(error, F.lit(INTERRUPTED))).otherwise(by_state)


def report(message: Column, prefix: str = "") -> Column:
    """struct<summary, reasoning, tests, risks> of a final message; a blank summary is the whole message.

    ``prefix`` stands before each of the four marks in the message.
    """
    marks = [prefix + m for m in MARKS]
    parts = [S.section(message, a, b) for a, b in zip(marks, marks[1:])]
    at = F.instr(message, marks[-1])
    last = F.when(at > 0, S.trim_all(F.substring(message, at + len(marks[-1]), F.lit(2**31 - 1)))).otherwise("")
    summary, reasoning, tests = parts
    return F.struct(
        F.when(summary == "", message).otherwise(summary).alias("summary"), F.when(reasoning == "", NO_REASONING).otherwise(reasoning).alias("reasoning"),
        S.list_items(tests).alias("tests"), S.list_items(last).alias("risks"),
    )


def failure_message(launch_error: Column, stderr: Column, stdout: Column) -> Column:
    return F.coalesce(launch_error, F.nullif(stderr, F.lit("")), stdout)


def inspect(runs: DataFrame, beats: DataFrame, results: DataFrame, now: Column, limit: float = FRESH_S, manifests: DataFrame | None = None) -> DataFrame:
    """``runs`` (run_id, worker_pid, directory, started_at, alive) with status and may_cancel.

    A heartbeat counts if its run and worker are the run's, a result if its run is; a run in
    a directory of another name is interrupted. Of several heartbeats the latest counts. A run may
    be cancelled while its heartbeat is fresh and, where ``manifests`` (run_id, worker_pid) are
    given, one is of its run and worker.
    """
    b = beats.groupBy(F.col("run_id").alias("b_run"), F.col("worker_pid").alias("b_pid")).agg(F.max("updated_at").alias("beat"))
    r = results.select(F.col("run_id").alias("r_run")).distinct()
    every = runs.join(b, (F.col("run_id") == F.col("b_run")) & (F.col("worker_pid") == F.col("b_pid")), "left").join(r, F.col("run_id") == F.col("r_run"), "left")
    seconds = lambda c: F.unix_micros(now) / 1e6 - F.unix_micros(c) / 1e6
    placed = F.coalesce(F.col("directory") == F.col("run_id"), F.lit(False))
    fresh = seconds(F.coalesce("beat", "started_at")) <= limit
    status = F.when(~placed, "interrupted").when(F.col("r_run").isNotNull(), "completed").when(F.col("alive") & fresh, "running").otherwise("interrupted")
    may = placed & F.col("beat").isNotNull() & (seconds(F.col("beat")) <= limit)
    if manifests is not None:
        m = manifests.select(F.col("run_id").alias("m_run"), F.col("worker_pid").alias("m_pid")).distinct()
        every = every.join(m, (F.col("run_id") == F.col("m_run")) & (F.col("worker_pid") == F.col("m_pid")), "left")
        may = may & F.col("m_run").isNotNull()
    return every.select(*runs.columns, status.alias("status"), F.coalesce(may, F.lit(False)).alias("may_cancel"))


def set_status(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """Tickets with the status that ``changes`` (id, status, sequence) gives last."""
    last = changes.groupBy(F.col("id").alias("c_id")).agg(F.max_by("status", "sequence").alias("c_status"))
    t = tickets.join(last, F.col("id") == F.col("c_id"), "left")
    return t.withColumn("status", F.coalesce("c_status", "status")).drop("c_id", "c_status")


def cancel_active(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Work items with the active one of each ticket in ``ids`` cancelled: the last by position that has not ended."""
    live = ~F.col("stage").isin(*S.ENDED)
    last = items.join(ids.select(F.col("id").alias("ticket_id")).distinct(), "ticket_id", "left_semi").filter(live)
    last = last.groupBy(F.col("ticket_id").alias("c_ticket")).agg(F.max("position").alias("c_position"))
    d = items.join(last, (F.col("ticket_id") == F.col("c_ticket")) & (F.col("position") == F.col("c_position")), "left")
    return d.withColumn("stage", F.when(F.col("c_ticket").isNotNull() & live, "cancelled").otherwise(F.col("stage"))).drop("c_ticket", "c_position")


def leave_processing(tickets: DataFrame, ids: DataFrame) -> DataFrame:
    """Tickets that leave the processing view: those being processed are new again (see ``cancel_active`` for their items)."""
    t = tickets.join(ids.select(F.col("id").alias("l_id")).distinct(), F.col("id") == F.col("l_id"), "left")
    back = F.col("l_id").isNotNull() & (F.col("status") == "处理中")
    return t.withColumn("status", F.when(back, "新建").otherwise(F.col("status"))).drop("l_id")


def import_repositories(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` and ``new`` (project, path, position); the first of a project without any is its default."""
    have = known.select(F.col("project").alias("k_project")).distinct()
    first = new.groupBy(F.col("project").alias("f_project")).agg(F.min("position").alias("f_position"))
    rows = new.join(have, F.col("project") == F.col("k_project"), "left").join(first, F.col("project") == F.col("f_project"))
    default = F.col("k_project").isNull() & (F.col("position") == F.col("f_position"))
    return known.unionByName(rows.withColumn("is_default", default).select(*known.columns))


def refresh_branch(repositories: DataFrame, found: DataFrame) -> DataFrame:
    """Repositories with the branch that was found (path, branch, sequence) where it is not empty; the last by sequence counts."""
    f = found.groupBy(F.col("path").alias("f_path")).agg(F.max_by("branch", "sequence").alias("f_branch"))
    r = repositories.join(f, F.col("path") == F.col("f_path"), "left")
    return r.withColumn("branch", F.coalesce(F.nullif("f_branch", F.lit("")), "branch")).drop("f_path", "f_branch")


def repository_of_path(items: DataFrame, repositories: DataFrame) -> DataFrame:
    """Work items with the remote of the first repository of their path, ``origin`` where there is none."""
    first = repositories.groupBy(F.col("path").alias("r_path")).agg(F.min_by("remote", "position").alias("remote"))
    return items.join(first, F.col("path") == F.col("r_path"), "left").withColumn("remote", F.coalesce("remote", F.lit("origin"))).drop("r_path")


def changed_files(porcelain: Column) -> Column:
    """The files of a porcelain status text: its lines without their first three characters."""
    return F.filter(F.transform(F.split(porcelain, "\n"), lambda x: F.substring(x, 4, 2**31 - 1)), lambda x: x != "")


def lines(text: Column) -> Column:
    """The lines that are not empty."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def repository_state(inside: Column, porcelain: Column, branch: Column, remote: Column, error: Column) -> Column:
    """struct<is_repository, is_clean, branch, remote, message> from the captured texts of a probe.

    ``error`` is what stopped the probe, null if nothing did; a remote that is not there is ''.
    """
    blank, no = F.lit(""), F.lit(False)
    ok = error.isNull() & (S.trim_all(F.coalesce(inside, blank)) == "true")
    clean = S.trim_all(F.coalesce(porcelain, blank)) == ""
    found = F.struct(F.lit(True).alias("is_repository"), clean.alias("is_clean"), S.trim_all(F.coalesce(branch, blank)).alias("branch"), S.trim_all(F.coalesce(remote, blank)).alias("remote"), F.when(clean, CLEAN).otherwise(DIRTY).alias("message"))
    none = F.struct(no.alias("is_repository"), no.alias("is_clean"), blank.alias("branch"), blank.alias("remote"), F.coalesce(error, F.lit(NO_REPOSITORY)).alias("message"))
    return F.when(ok, found).otherwise(none)


def with_lines(text: Column, more: Column) -> Column:
    """A text with the lines of an array behind it, empty ones left out; null counts as empty."""
    kept = F.array_join(F.filter(more, lambda x: x != ""), "\n")
    text = F.coalesce(text, F.lit(""))
    return F.when(kept == "", text).when(text == "", kept).otherwise(F.coalesce(F.concat(text, F.lit("\n"), kept), text))


def whole_diff(unstaged: Column, staged: Column) -> Column:
    return F.array_join(F.filter(F.array(unstaged, staged), lambda x: x != ""), "\n")


def first_option(options: Column, wanted: Column) -> Column:
    """The first option that, trimmed, is the wanted text or contains it."""
    return F.get(F.filter(options, lambda o: S.trim_all(o).contains(wanted)), F.lit(0))


def merged_environment(base: Column, override: Column) -> Column:
    """One map of two; the second wins."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def sync_state(last_synced: Column, authenticated: Column, n_tickets: Column) -> Column:
    return F.when(last_synced.isNotNull(), "synced").when(authenticated | (n_tickets > 0), "idle").otherwise("loginRequired")
