"""Registered queries of jobs, runs, repositories and providers' events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import jobs as J
from ..sources import adapters as A

NOW = "2024-01-01 00:00:00"


def stage_projections(spark, sf_dir):
    """Step, phase and report texts of every work item's stage, counted."""
    i, stage = A.work_items(spark, sf_dir), F.col("stage")
    rows = i.select(J.step(stage).cast("int").alias("step"), J.phase(stage).alias("phase"), J.report_status(stage).alias("report_status"), J.report_visible(stage, F.col("line") % 2 == 0).alias("report_visible"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def progress_texts(spark, sf_dir):
    d = A.table(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderstatus") == "F", "interrupted").otherwise("runningAI")
    state = F.when(F.col("o_orderkey") % 5 == 0, "reconnecting").when(F.col("o_orderkey") % 5 == 1, "recovered").otherwise("running")
    error = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority"))
    return d.select("o_orderkey", J.progress(stage, state, error, F.lit("Codex"), F.col("o_orderkey").cast("string")).alias("progress"))


def job_reports(spark, sf_dir):
    d, i = A.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    head = F.when(i == 0, "").when(i == 1, "JOB_SUMMARY:  \n").otherwise(F.concat(F.lit("JOB_SUMMARY: "), F.coalesce("source", F.lit("")), F.lit("\n")))
    tail = F.concat(F.when(i == 3, "").otherwise("JOB_REASONING: why\n"), F.lit("JOB_TESTS:\n- a\n\n  -b \nc\nJOB_RISKS:\n- none"))
    r = d.select("doc_id", J.report(F.concat(head, tail), "JOB_").alias("r"))
    return r.select("doc_id", "r.summary", "r.reasoning", F.array_join("r.tests", "|").alias("tests"), F.array_join("r.risks", "|").alias("risks"))


def run_inspection(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    u = F.col("user_id")
    runs = e.groupBy("user_id").agg(F.min("ts").alias("started")).select(
        u.cast("string").alias("run_id"), (u * 10).alias("worker_pid"), F.when(u % 13 == 0, "other").otherwise(u.cast("string")).alias("directory"),
        F.col("started").cast("timestamp").alias("started_at"), (u % 7 != 0).alias("alive"),
    )
    beats = e.filter("user_id % 5 <> 0").select(u.cast("string").alias("run_id"), F.when(u % 3 == 0, -1).otherwise(u * 10).alias("worker_pid"), F.col("ts").cast("timestamp").alias("updated_at"))
    results = e.filter("user_id % 11 = 0").select(u.cast("string").alias("run_id"))
    top = F.lit(NOW).cast("timestamp")
    return J.inspect(runs, beats, results, top, 86400.0 * 3).select("run_id", "status", "may_cancel")


def ticket_status_changes(spark, sf_dir):
    t = A.tickets(spark, sf_dir)
    some = t.filter("id % 3 = 0")
    changes = some.select("id", F.lit("待反馈").alias("status"), F.lit(2).alias("sequence")).unionByName(some.select("id", F.lit("已完成").alias("status"), F.lit(1).alias("sequence")))
    return J.set_status(t, changes).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def processing_left(spark, sf_dir):
    t = A.tickets(spark, sf_dir)
    return J.leave_processing(t, t.filter("id % 2 = 0").select("id")).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def repositories_imported(spark, sf_dir):
    r = A.repositories(spark, sf_dir)
    return J.import_repositories(r.filter("project NOT IN ('BUILDING', 'MACHINERY')"), r.filter("project IN ('BUILDING', 'FURNITURE')").drop("is_default").withColumn("path", F.concat(F.lit("new/"), "path"))).select("position", "project", "path", "is_default")


def branches_refreshed(spark, sf_dir):
    r = A.repositories(spark, sf_dir).withColumn("branch", F.lit("main"))
    found = r.filter("position % 2 = 0").select("path", F.explode(F.array(F.struct(F.lit(1).alias("sequence"), F.lit("old").alias("branch")), F.struct(F.lit(2).alias("sequence"), F.when(F.col("position") % 4 == 0, "").otherwise("dev").alias("branch")))).alias("f")).select("path", "f.*")
    return J.refresh_branch(r, found).select("position", "branch")


def item_remotes(spark, sf_dir):
    items = A.work_items(spark, sf_dir).select("supplier", F.concat(F.lit("Supplier#"), F.lpad("supplier", 9, "0")).alias("path"))
    repos = A.repositories(spark, sf_dir).filter("position % 3 <> 0").withColumn("remote", F.concat(F.lit("r"), "position"))
    return J.repository_of_path(items, repos).groupBy("supplier", "remote").agg(F.count("*").alias("n"))


def ticket_repositories(spark, sf_dir):
    n = A.repositories(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"))
    return A.tickets(spark, sf_dir).join(n, "project").select("id", "n")


def status_texts(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    text = F.concat(F.lit("?? "), "source", F.lit("\n M b.txt\n\nR  a -> c"))
    return d.select("doc_id", F.array_join(J.changed_files(text), "|").alias("files"), F.array_join(J.lines(text), "|").alias("lines"), J.whole_diff(F.when(F.col("doc_id") % 2 == 0, "").otherwise("u"), F.lit("s")).alias("diff"))


def option_matches(spark, sf_dir):
    """The first word of each turn that holds the beginning of its role, as a form's options are searched."""
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("options"), F.left("role", F.lit(2)).alias("wanted"))
    return c.select("conv_id", "turn", J.first_option(F.transform("options", lambda o: F.concat(F.lit(" "), o, F.lit(" "))), F.col("wanted")).alias("option"))


def merged_environments(spark, sf_dir):
    """Properties of events as environments, some overridden by a user's own."""
    e = A.table(spark, sf_dir, "events")
    base = F.map_concat(F.from_json("props", "map<string, string>"), F.create_map(F.lit("type"), F.col("event_type")))
    none = F.expr("map_from_arrays(CAST(array() AS array<string>), CAST(array() AS array<string>))")
    over = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.concat(F.lit("u"), "user_id"), F.lit("term"), F.lit("dumb"))).otherwise(none)
    entries = F.sort_array(F.transform(F.map_entries(J.merged_environment(base, over)), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return e.select("event_id", F.array_join(entries, ";").alias("environment"))


def sync_summary(spark, sf_dir):
    """Totals of a sync, its new tickets, whether any are unread, and the state that a start shows."""
    t = A.tickets(spark, sf_dir)
    new = t.filter("id % 10 NOT IN (1, 2)").join(t.filter("id % 10 <> 0").select("id"), "id", "left_anti").agg(F.count("*").alias("n_new"))
    total = t.filter("id % 10 NOT IN (1, 2)").agg(F.count("*").alias("n_tickets"), F.count_distinct(F.col("id") % 50).alias("n_pages"))
    one = total.crossJoin(new)  # one row by one row
    state = J.sync_state(F.lit(None).cast("timestamp"), F.lit(False), F.col("n_tickets"))
    return one.select("n_tickets", "n_pages", "n_new", (F.col("n_new") > 0).alias("unread"), (F.col("n_tickets") == 0).alias("needs_login"), state.alias("state"))


def interval_limits(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    columns = F.least(F.lit(4), F.greatest(F.lit(1), F.floor((F.col("p_size") * 40 - 32) / 376)))
    return p.select("p_partkey", F.least(F.lit(8), F.greatest(F.lit(1), F.col("p_size") % 12)).alias("hours"), columns.cast("int").alias("columns"), F.left("p_name", F.lit(J.HASH_CHARS)).alias("short"), F.length("p_name").alias("chars"))


def _lines(spark, sf_dir, kinds):
    c = A.table(spark, sf_dir, "conversations")
    out = F.concat(F.lit("log "), "turn")
    for i, struct in enumerate(kinds):
        out = F.when(F.col("turn") % 5 == i, F.to_json(struct)).otherwise(out)
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("offset"), out.alias("line"))


def cursor_events(spark, sf_dir):
    block = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [F.struct(F.lit("assistant").alias("type"), F.struct(F.array(block).alias("content")).alias("message")), F.struct(F.lit("tool_call").alias("type")), F.struct(F.lit("result").alias("type"), F.coalesce("text", F.lit("")).alias("result"))]
    return _lines(spark, sf_dir, kinds).withColumn("e", E.cursor_event(F.col("line"))).select("run_id", "offset", "e.display", "e.final")


def claude_events(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("t").alias("text"))
    block = F.struct(F.lit("text").alias("type"), text.alias("text"))
    kinds = [
        F.struct(F.lit("system").alias("type"), F.lit("init").alias("subtype"), F.when(F.col("conv_id") % 2 == 0, "m1").alias("model")),
        F.struct(F.lit("assistant").alias("type"), F.struct(F.array(tool, block).alias("content")).alias("message")),
        F.struct(F.lit("assistant").alias("type"), F.array(tool).alias("content")), F.struct(F.lit("result").alias("type"), text.alias("result"), (F.col("conv_id") % 3 == 0).alias("is_error")),
    ]
    return _lines(spark, sf_dir, kinds).withColumn("e", E.claude_event(F.col("line"))).select("run_id", "offset", "e.display", "e.final")


def final_or_output(spark, sf_dir):
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "display"))), lambda x: x["display"]), "\n")
    rows = claude_events(spark, sf_dir).withColumn("display", F.coalesce("display", F.lit("")))
    return E.final_messages(rows, whole)


def line_offsets(spark, sf_dir):
    """Lines of each turn with the offset behind each: the pairing of two lists by place."""
    d = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("ends"))

    def step(acc, x):
        at = acc["at"] + F.length(x) + 1
        return F.struct(at.alias("at"), F.concat(acc["ends"], F.array(at)).alias("ends"))

    ends = F.aggregate("lines", start, step, lambda acc: acc["ends"])
    return d.select("conv_id", "turn", F.inline(F.arrays_zip(F.col("lines").alias("line"), ends.alias("end_offset"))))


JOB_QUERIES = {f.__name__: f for f in (
    stage_projections, progress_texts, job_reports, run_inspection, ticket_status_changes, processing_left, repositories_imported, branches_refreshed, item_remotes,
    ticket_repositories, status_texts, option_matches, merged_environments, sync_summary, interval_limits, cursor_events, claude_events, final_or_output, line_offsets,
)}

_STAGES = """stages AS (
  SELECT l_linenumber AS line, CASE l_returnflag || l_linestatus WHEN 'AO' THEN 'awaitingApproval' WHEN 'AF' THEN 'awaitingPlanApproval' WHEN 'RO' THEN 'runningAI'
    WHEN 'RF' THEN 'interrupted' WHEN 'NO' THEN 'completed' ELSE 'failed' END AS stage FROM lineitem
)"""
_STATUS = "t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '已完成' WHEN 'P' THEN '处理中' ELSE '新建' END AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey <> 0)"
_REPOS = "r AS (SELECT s_suppkey AS position, CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS project, s_name AS path, s_suppkey % 10 = 3 AS is_default FROM supplier)"
_CLAUDE = """claude AS (
  SELECT conv_id AS run_id, turn AS "offset",
    CASE turn % 5 WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'Claude Code 已启动（m1）' ELSE 'Claude Code 已启动' END WHEN 1 THEN nullif(coalesce(text, ''), '') WHEN 2 THEN NULL
      WHEN 3 THEN CASE WHEN conv_id % 3 = 0 THEN coalesce(text, '') ELSE 'Claude Code 已完成' END ELSE 'log ' || turn END AS display,
    CASE WHEN turn % 5 = 3 THEN coalesce(text, '') END AS final FROM conversations
)"""

JOB_ORACLE_SQL = {
    "stage_projections": f"""WITH {_STAGES} SELECT CASE stage WHEN 'awaitingApproval' THEN 3 WHEN 'awaitingPlanApproval' THEN 1 WHEN 'runningAI' THEN 2 WHEN 'completed' THEN 5 END AS step,
      CASE stage WHEN 'runningAI' THEN 'modification' END AS phase, CASE stage WHEN 'completed' THEN '交付已完成' ELSE '等待人工确认' END AS report_status,
      line % 2 = 0 AND stage IN ('awaitingApproval', 'reviewing', 'partial', 'completed') AS report_visible, count(*) AS n FROM stages GROUP BY 1, 2, 3, 4""",
    "progress_texts": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN coalesce(CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END, 'AI 后台任务已中断，你可以重新检查进程或返回配置。')
      WHEN o_orderkey % 5 = 0 THEN '正在重新连接 AI 任务…' WHEN o_orderkey % 5 = 1 THEN '已恢复后台任务，正在继续接收日志' WHEN o_orderkey % 7 = 0 THEN o_orderpriority
      ELSE 'Codex 正在处理 #' || o_orderkey || '，你可以在此查看实时进度。' END AS progress FROM orders""",
    "job_reports": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'JOB_REASONING: why' || chr(10) || tail WHEN 1 THEN 'JOB_SUMMARY:  ' || chr(10) || 'JOB_REASONING: why' || chr(10) || tail
        WHEN 2 THEN coalesce(source, '') ELSE coalesce(source, '') || chr(10) || tail END AS summary,
      CASE WHEN doc_id % 4 = 3 THEN 'AI 未按结构返回原因说明，请查看原始输出。' ELSE 'why' END AS reasoning, 'a|b|c' AS tests, 'none' AS risks
      FROM documents, (SELECT 'JOB_TESTS:' || chr(10) || '- a' || chr(10) || chr(10) || '  -b ' || chr(10) || 'c' || chr(10) || 'JOB_RISKS:' || chr(10) || '- none' AS tail)""",
    "run_inspection": f"""WITH u AS (SELECT user_id, min(ts) AS started, max(ts) AS last FROM events GROUP BY user_id),
      v AS (SELECT *, CASE WHEN user_id % 5 <> 0 AND (user_id % 3 <> 0 OR user_id * 10 = -1) THEN last END AS beat FROM u),
      w AS (SELECT *, date_diff('microsecond', coalesce(beat, started), TIMESTAMP '{NOW}') <= 259200000000 AS fresh FROM v)
      SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN user_id % 13 = 0 THEN 'interrupted' WHEN user_id % 11 = 0 THEN 'completed' WHEN user_id % 7 <> 0 AND fresh THEN 'running' ELSE 'interrupted' END AS status,
        user_id % 13 <> 0 AND beat IS NOT NULL AND fresh AS may_cancel FROM w""",
    "ticket_status_changes": f"WITH {_STATUS} SELECT CASE WHEN id % 3 = 0 THEN '待反馈' ELSE status END AS status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM t GROUP BY 1",
    "processing_left": f"WITH {_STATUS} SELECT CASE WHEN id % 2 = 0 AND status = '处理中' THEN '新建' ELSE status END AS status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM t GROUP BY 1",
    "repositories_imported": f"""WITH {_REPOS} SELECT position, project, path, is_default FROM r WHERE project NOT IN ('BUILDING', 'MACHINERY')
      UNION ALL SELECT position, project, 'new/' || path, project = 'BUILDING' AND position = min(position) OVER (PARTITION BY project) FROM r WHERE project IN ('BUILDING', 'FURNITURE')""",
    "branches_refreshed": f"WITH {_REPOS} SELECT position, CASE WHEN position % 4 = 2 THEN 'dev' ELSE 'main' END AS branch FROM r",
    "item_remotes": "SELECT l_suppkey AS supplier, CASE WHEN l_suppkey % 3 <> 0 AND s_suppkey IS NOT NULL THEN 'r' || l_suppkey ELSE 'origin' END AS remote, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_name = 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') GROUP BY 1, 2",
    "ticket_repositories": f"WITH {_REPOS} SELECT o_orderkey AS id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN r ON c_mktsegment = r.project WHERE o_orderkey <> 0 GROUP BY 1",
    "status_texts": "SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN '' ELSE source || '|' END || 'b.txt|a -> c' AS files, '?? ' || coalesce(source, '') || '| M b.txt|R  a -> c' AS lines, CASE WHEN doc_id % 2 = 0 THEN 's' ELSE 'u' || chr(10) || 's' END AS diff FROM documents",
    "option_matches": "SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: ' ' || x || ' '), lambda o: contains(o, left(role, 2)))[1] AS option FROM conversations",
    "merged_environments": r"SELECT event_id, 'k=' || CASE WHEN event_id % 3 = 0 THEN 'u' || user_id || ';term=dumb' ELSE regexp_extract(props, '\d+') END || ';type=' || event_type AS environment FROM events",
    "sync_summary": f"""WITH {_STATUS}, s AS (SELECT count(*) AS n_tickets, count(DISTINCT id % 50) AS n_pages, count(*) FILTER (WHERE id % 10 = 0) AS n_new FROM t WHERE id % 10 NOT IN (1, 2))
      SELECT *, n_new > 0 AS unread, n_tickets = 0 AS needs_login, CASE WHEN n_tickets > 0 THEN 'idle' ELSE 'loginRequired' END AS state FROM s""",
    "interval_limits": "SELECT p_partkey, least(8, greatest(1, p_size % 12)) AS hours, CAST(least(4, greatest(1, floor((p_size * 40 - 32) / 376))) AS INTEGER) AS columns, left(p_name, 8) AS short, CAST(length(p_name) AS INTEGER) AS chars FROM part",
    "cursor_events": """SELECT conv_id AS run_id, turn AS "offset", CASE turn % 5 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN NULL WHEN 2 THEN 'Cursor 已完成' ELSE 'log ' || turn END AS display, CASE WHEN turn % 5 = 2 THEN coalesce(text, '') END AS final FROM conversations""",
    "claude_events": f"WITH {_CLAUDE} SELECT * FROM claude",
    "final_or_output": f"""WITH {_CLAUDE} SELECT run_id, coalesce(arg_max(final, "offset") FILTER (WHERE final <> ''), string_agg(coalesce(display, ''), chr(10) ORDER BY "offset")) AS final FROM claude GROUP BY run_id""",
    "line_offsets": "WITH p AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations), l AS (SELECT conv_id, turn, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM p) SELECT conv_id, turn, line, CAST(sum(length(line) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k) AS INTEGER) AS end_offset FROM l",
}
