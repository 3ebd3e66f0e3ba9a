"""Registered queries of snapshots, job events, page walks, chunks, recovery and control files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunk_lines as C
from ..operators import job_events as V
from ..operators import jobs as J
from ..operators import recovery as R
from ..sources import adapters as A
from ..sources import control_files as K
from ..sources import issue_pages as I
from ..sources import page_walk as W
from ..sources import snapshots as S
from ..sources.store import Tables, work_folder

NOW = "2024-01-31 00:00:00"


def documents_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text): a state document of each customer's orders; some lack newer fields, some are broken."""
    o, c = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "customer")
    k, text = F.col("o_orderkey"), F.lit("")
    kind = F.when(k % 97 == 0, "odd").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("Bug", "需求", "建议", "支持", "任务")]), (k % 5 + 1).cast("int")))
    ticket = F.struct(
        k.alias("id"), F.lit("p").alias("projectID"), F.lit("P").alias("projectName"), kind.alias("kind"), F.when(F.col("o_orderpriority") == "1-URGENT", "紧急").otherwise("普通").alias("priority"),
        F.lit("新建").alias("status"), F.col("o_orderpriority").alias("title"), text.alias("description"), text.alias("targetVersion"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"), text.alias("assignee"),
    )
    some = o.groupBy("o_custkey").agg(F.collect_list(ticket).alias("tickets"))  # the orders of one customer
    key = F.col("c_custkey")
    none = F.expr("CAST(array() AS array<string>)")
    whole = F.to_json(F.struct(
        F.coalesce("tickets", F.from_json(F.lit("[]"), some.schema["tickets"].dataType.json())).alias("tickets"), none.alias("repositories"), none.alias("workItems"),
        F.concat(F.lit("https://tracker.example/issues?page=2&c="), key).alias("knowledgeBaseURL"), F.lit("").alias("defaultTestAssignee"),
        F.when(key % 5 != 0, key % 12).alias("syncIntervalHours"), F.when(key % 3 == 0, key % 2 == 0).alias("hasAuthenticatedSession"), F.when(key % 4 == 0, "2024-01-02T03:04:05Z").alias("lastSyncedAt"),
    ))
    return c.join(some, key == F.col("o_custkey"), "left").select("c_custkey", F.when(key % 11 == 0, F.substring(whole, F.lit(1), F.length(whole) - 7)).otherwise(whole).alias("text"))


def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_of_customers(spark, sf_dir).select("c_custkey", S.decode(F.col("text")).alias("s"))
    return d.select("c_custkey", F.col("s").isNotNull().alias("whole"), S.restored(F.col("s")).alias("r")).select("c_custkey", "whole", "r.*")


def snapshot_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets saved, changed through the log, folded in, changed again: as a load gives them."""
    t = A.tickets(spark, sf_dir).select("id", F.col("id").alias("position"), "status")
    saves = S.Snapshots(spark, work_folder(spark, "saved"), {"tickets": ["id"]})
    saves.save({"tickets": t.filter("id % 4 <> 0")}, {"hours": 2})
    change = lambda rows, status, n: rows.select("id", (F.col("position") + n).alias("position"), F.lit(status).alias("status"), F.lit(n).alias("sequence"))
    saves.append("tickets", change(t.filter("id % 3 = 0"), "处理中", 1))
    saves.compact(keep=0)
    saves.append("tickets", change(t.filter("id % 6 = 0"), "待测试", 1))
    tables, settings = saves.load()
    return tables["tickets"].withColumn("hours", F.lit(settings["hours"]))


def job_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events of jobs, four orders a job: the usual course, every fourth event another action."""
    li = A.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy(F.floor(F.col("l_orderkey") / 4)).orderBy("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    actions = F.array(*[F.lit(a) for a in V.ACTIONS])
    d = li.select(F.floor(F.col("l_orderkey") / 4).alias("item_id"), F.row_number().over(order).alias("seq"), F.col("l_shipdate").cast("timestamp").alias("at"), "l_partkey", "l_suppkey")
    usual = (F.col("seq") - 1) % 11
    action = F.element_at(actions, F.when(F.col("l_partkey") % 4 == 0, F.col("l_suppkey") % len(V.ACTIONS)).otherwise(usual).cast("int") + 1)
    message = F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("supplier "), F.col("l_suppkey") % 3))
    return d.select("item_id", "seq", "at", action.alias("action"), message.alias("message"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = job_event_rows(spark, sf_dir)
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("seq") % 5 == 0, 2).otherwise(1)))  # every fifth is delivered twice
    return V.fold(e.select("*", times.alias("n"))).select("item_id", "seq", "action", "previous", "stage", "refused")


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.states_of(job_event_rows(spark, sf_dir)).select("item_id", "stage", "error", "execution_state", F.unix_seconds("updated_at").alias("updated_s"), "n_events", "n_refused")


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.logs(V.fold(job_event_rows(spark, sf_dir))).select("item_id", "seq", "message", "level")


def stage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step, phase and texts of every stage that the jobs go through, counted."""
    stage, seq = F.col("stage"), F.col("seq")
    texts = [J.step(stage).cast("int").alias("step"), J.phase(stage).alias("phase"), J.report_status(stage).alias("report_status"), J.report_visible(stage, seq % 2 == 0).alias("report_visible")]
    state = F.when(seq % 5 == 0, "reconnecting").when(seq % 5 == 1, "recovered").otherwise("running")
    progress = J.progress(stage, state, F.when(seq % 3 == 0, "an error"), F.lit("Codex"), F.lit("7")).alias("progress")
    rows = V.fold(job_event_rows(spark, sf_dir)).select("stage", *texts, progress)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


SCANS, PER_PAGE = 40, 20


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the issue pages of scans, twenty a page, landed in no order; some scans have bad pages."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    scan, k = F.col("o_orderkey") % SCANS, F.floor(F.col("o_orderkey") / SCANS)
    cell = lambda name, c: F.concat(F.lit(f"<td class={name}>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("id", F.col("o_orderkey").cast("string")), cell("priority", F.col("o_orderpriority")), cell("subject", F.concat(F.lit("order "), "o_orderkey")), F.lit("</tr>"))
    d = o.select(scan.alias("scan_id"), F.floor(k / PER_PAGE).alias("page"), F.col("o_orderkey").alias("k"), row.alias("row"))
    pages = d.groupBy("scan_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "").alias("rows"))  # twenty rows
    last = d.groupBy(F.col("scan_id").alias("l_scan")).agg(F.max("page").alias("last"))
    p = pages.join(F.broadcast(last), F.col("scan_id") == F.col("l_scan"))  # a row a scan
    url = lambda n: F.concat(F.lit("https://tracker.example/s/"), "scan_id", F.lit("?page="), n)
    back = F.when(F.col("scan_id") % 4 == 1, F.greatest(F.col("last") - 2, F.lit(0)))  # a last page that links back
    to = F.when(F.col("page") < F.col("last"), F.col("page") + 1).otherwise(back)
    link = F.coalesce(F.concat(F.lit("<a rel=next href='"), url(to), F.lit("'>next</a>")), F.lit(""))
    login = F.when((F.col("scan_id") % 10 == 3) & (F.col("page") == 1), "<form action='/login'></form>").otherwise("")
    html = F.concat(F.lit("<table class=issues><tbody>"), "rows", F.lit("</tbody></table>"), link, login)
    ok = ~((F.col("scan_id") % 10 == 7) & (F.col("page") == 2))
    return p.select("scan_id", F.xxhash64("scan_id", "page").alias("page_no"), url(F.col("page")).alias("url"), html.alias("html"), ok.alias("ok"))


def _walked(spark: SparkSession, sf_dir: str, with_rows: bool):
    """The landed pages, each read once, the walks over their links and how those ended."""
    tables = Tables(spark, "pages")
    pages = tables.write(I.read_pages(landed_pages(spark, sf_dir), keep=("scan_id", "ok"), with_rows=with_rows))
    starts = pages.select("scan_id", F.concat(F.lit("https://tracker.example/s/"), "scan_id", F.lit("?page=0")).alias("url"))
    walked = tables.write(W.walk(pages, starts))
    return pages, walked, tables.write(W.outcomes(pages, walked))


def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, with_rows=False)[2].select("scan_id", "status", "n_pages")


def scan_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.scan_rows(*_walked(spark, sf_dir, with_rows=True)).select("scan_id", "at", "id", "subject", "priority")


def chunks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, seq, data): documents cut every 61 characters, the last chunk being shorter or empty; a text is gone through once."""
    text = F.coalesce("text", F.lit(""))
    rest = F.when(F.length(text) % 61 == 0, F.array(F.lit(""))).otherwise(F.expr("CAST(array() AS array<string>)"))
    cut = F.concat(F.regexp_extract_all(text, F.lit("(?s).{1,61}"), F.lit(0)), rest)
    return A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream"), F.posexplode(cut).alias("seq", "data"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as streams of 61 characters a chunk, and their lines put together again, counted by content."""
    lines = C.lines(chunks_of_documents(spark, sf_dir))
    return lines.groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.bit_xor(F.crc32(F.col("line").cast("binary"))).alias("_x"), F.max("line").alias("last_line"), F.min("line").alias("first_line")).drop("_x")


def recovered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in running stages after a restart, with the runs of users: taken up, finished or lost."""
    li = A.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    stage = F.element_at(F.array(*[F.lit(x) for x in ("analyzing", "runningAI", "reviewing", "completed", "interrupted")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    items = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("item_id"), stage.alias("stage"), F.when(k % 6 != 0, (F.col("l_suppkey") % 20).cast("string")).alias("run_id"),
        F.when(k % 3 == 0, "analysis").otherwise("modification").alias("phase"), F.when(k % 7 == 0, R.LOST).alias("last_message"),
    )
    e = A.table(spark, sf_dir, "events").filter("user_id < 20")
    runs = e.select(F.col("user_id").cast("string").alias("run_id")).distinct()
    inspected = runs.select("run_id", F.when(F.col("run_id").cast("int") % 3 == 0, "completed").when(F.col("run_id").cast("int") % 3 == 1, "running").otherwise("interrupted").alias("status"))
    shown = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("offset"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("display"))
    done = items.filter(F.col("phase") == "analysis").select(F.lit("a").alias("launch_id"), "item_id").filter(F.col("item_id").endswith("1"))
    out = R.recover(R.due(items, done, "a"), inspected, R.offsets(shown))
    return out.groupBy("stage", "outcome", "new_stage", "execution_state", "message", "error").agg(F.count("*").alias("n"), F.sum("resume_at").alias("resume_sum"))


def control_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of users: control files written to folders, some broken, read again and inspected."""
    e, u = A.table(spark, sf_dir, "events"), F.col("user_id")
    r = e.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    run, pid = u.cast("string"), (u * 10).cast("int")
    files = {
        "manifest.json": F.to_json(F.struct(run.alias("runID"), F.when(u % 4 == 0, 7).otherwise(pid).alias("workerPID"), F.lit(5).alias("cliPID"), at("first").alias("startedAt"))),
        "heartbeat.json": F.when(u % 9 == 0, "{").otherwise(F.to_json(F.struct(run.alias("runID"), pid.alias("workerPID"), F.when(u % 10 == 0, "soon").otherwise(at("last")).alias("updatedAt")))),
        "result.json": F.when(u % 5 == 0, F.to_json(F.struct(F.when(u % 2 == 0, "other").otherwise(run).alias("runID"), F.lit(0).alias("exitCode"), at("last").alias("endedAt")))),
    }
    rows = r.select(run.alias("run_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("text")) for n, c in files.items()])).alias("f")).select("run_id", "f.*").filter("text IS NOT NULL")
    root = f"{work_folder(spark, 'runs')}/jobs"
    K.write_runs(rows, root)
    manifests, beats, results = (K.read(spark, root, k) for k in ("manifest", "heartbeat", "result"))
    runs = r.select(run.alias("run_id"), pid.cast("long").alias("worker_pid"), run.alias("directory"), F.date_trunc("second", "first").cast("timestamp").alias("started_at"), (u % 7 != 0).alias("alive"))
    same = lambda d, *more: d.filter(F.col("directory") == F.col("runID")).select(F.col("runID").alias("run_id"), *more)
    pids = F.col("workerPID").cast("long").alias("worker_pid")
    out = J.inspect(runs, same(beats, pids, F.col("updatedAt").alias("updated_at")), same(results), F.lit(NOW).cast("timestamp"), 86400.0 * 3, same(manifests, pids))
    return out.select("run_id", "status", "may_cancel")


STATE_QUERIES = {f.__name__: f for f in (snapshot_documents, snapshot_saved, job_events, job_states, job_logs, stage_texts, scan_outcomes, scan_tickets, chunk_lines, recovered_items, control_runs)}


def _sql_case(column: str, values: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_JOB = f"""WITH RECURSIVE raw AS (
  SELECT l_orderkey // 4 AS item_id, row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey) AS seq, l_shipdate AS told_at, l_partkey, l_suppkey FROM lineitem
), ev AS (
  SELECT item_id, CAST(seq AS BIGINT) AS seq, told_at, {_sql_case("CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 18 ELSE (seq - 1) % 11 END", list(V.ACTIONS))} AS action, CASE WHEN l_partkey % 7 <> 0 THEN 'supplier ' || (l_suppkey % 3) END AS message FROM raw
), rules AS (
  SELECT * FROM (VALUES ('start', '', 'preparing'), ('checked', 'preparing', 'analyzing'), ('analysed', 'analyzing', 'awaitingPlanApproval'), ('approve_plan', 'awaitingPlanApproval', 'runningAI'),
    ('modified', 'runningAI', 'reviewing'), ('reported', 'reviewing', 'awaitingApproval'), ('deliver', 'awaitingApproval', 'committing'), ('committed', 'committing', 'pulling'), ('pulled', 'pulling', 'pushing'),
    ('pushed', 'pushing', 'updatingTicket'), ('delivered', 'updatingTicket', 'completed'), ('update_failed', 'updatingTicket', 'partial'), ('retry', 'partial', 'updatingTicket'),
    ('interrupt', 'analyzing', 'interrupted'), ('interrupt', 'runningAI', 'interrupted'), ('interrupt', 'reviewing', 'interrupted'), ('interrupt', 'interrupted', 'interrupted'),
    ('recover_analysis', 'interrupted', 'analyzing'), ('recover_analysis', 'analyzing', 'analyzing'), ('recover_modification', 'interrupted', 'runningAI'),
    ('recover_modification', 'runningAI', 'runningAI'), ('recover_modification', 'reviewing', 'runningAI')) r(action, was, becomes)
), told AS (
  SELECT item_id, CAST(0 AS BIGINT) AS seq, CAST('' AS VARCHAR) AS previous, CAST('' AS VARCHAR) AS stage, false AS refused FROM ev GROUP BY item_id
  UNION ALL
  SELECT e.item_id, e.seq, t.stage, CASE WHEN e.action = 'cancel' AND t.stage <> '' THEN 'cancelled' WHEN e.action = 'fail' AND t.stage <> '' THEN 'failed' ELSE coalesce(r.becomes, t.stage) END,
    NOT (r.becomes IS NOT NULL OR (e.action IN ('cancel', 'fail') AND t.stage <> ''))
  FROM told t JOIN ev e ON e.item_id = t.item_id AND e.seq = t.seq + 1 LEFT JOIN rules r ON r.action = e.action AND r.was = t.stage
), folded AS (
  SELECT e.*, t.previous, t.stage, t.refused FROM told t JOIN ev e ON t.item_id = e.item_id AND t.seq = e.seq
)"""
_SETS, _CLEARS = "('update_failed', 'interrupt', 'cancel', 'fail')", "('analysed', 'approve_plan', 'reported', 'delivered', 'recover_analysis', 'recover_modification')"
_PAGES = f"""WITH o AS (
  SELECT o_orderkey % {SCANS} AS scan_id, (o_orderkey // {SCANS}) // {PER_PAGE} AS page, o_orderkey AS id, o_orderpriority AS priority FROM orders
), p AS (
  SELECT DISTINCT scan_id, page FROM o
), gaps AS (
  SELECT scan_id, page, row_number() OVER (PARTITION BY scan_id ORDER BY page) - 1 AS nth, max(page) OVER (PARTITION BY scan_id) AS last FROM p
), reached AS (
  SELECT scan_id, page, last FROM gaps WHERE page = nth
), n AS (
  SELECT scan_id, max(page) AS top, max(last) AS last FROM reached GROUP BY scan_id
), judged AS (
  SELECT scan_id, CASE WHEN scan_id % 10 = 3 AND top >= 1 THEN 'loginRequired' WHEN scan_id % 10 = 7 AND top >= 2 THEN 'failed' WHEN top < last THEN 'failed' ELSE 'read' END AS status,
    CASE WHEN scan_id % 10 = 3 AND top >= 1 THEN 1 WHEN scan_id % 10 = 7 AND top >= 2 THEN 2 ELSE top + 1 END AS n_pages FROM n
)"""

STATE_ORACLE_SQL = {
    "snapshot_documents": """WITH t AS (
  SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS odd FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
), w AS (
  SELECT *, odd = 0 AND c_custkey % 11 <> 0 AS whole, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 ELSE n > 0 END AS signed_in FROM t
)
SELECT c_custkey, whole, CASE WHEN NOT whole THEN 'loginRequired' WHEN c_custkey % 4 = 0 THEN 'synced' WHEN signed_in OR n > 0 THEN 'idle' ELSE 'loginRequired' END AS status,
  CAST(CASE WHEN NOT whole OR c_custkey % 5 = 0 THEN 2 ELSE least(8, greatest(1, c_custkey % 12)) END AS INTEGER) AS hours, whole AND signed_in AS authenticated,
  CASE WHEN whole THEN 'https://tracker.example/issues?c=' || c_custkey END AS url, CAST(CASE WHEN whole THEN n ELSE 0 END AS INTEGER) AS n_tickets, 0 AS n_items FROM w""",
    "snapshot_saved": """WITH t AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '已完成' WHEN 'P' THEN '处理中' ELSE '新建' END AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey <> 0
)
SELECT id, CASE WHEN id % 4 = 0 THEN id + 1 ELSE id END AS position, CASE WHEN id % 6 = 0 THEN '待测试' WHEN id % 3 = 0 THEN '处理中' ELSE status END AS status, 2 AS hours FROM t WHERE id % 4 <> 0 OR id % 3 = 0""",
    "job_events": f"{_JOB} SELECT item_id, seq, action, previous, stage, refused FROM folded",
    "job_states": f"""{_JOB}
SELECT item_id, coalesce(arg_max(stage, seq) FILTER (WHERE NOT refused), '') AS stage,
  (max({{'s': seq, 'm': message, 'set': action IN {_SETS}}}) FILTER (WHERE NOT refused AND (action IN {_SETS} OR action IN {_CLEARS}) AND seq = last_e)).m AS error,
  max(run) FILTER (WHERE seq = last_r) AS execution_state, CAST(epoch(max(told_at) FILTER (WHERE NOT refused)) AS BIGINT) AS updated_s, count(*) AS n_events, count(*) FILTER (WHERE refused) AS n_refused
FROM (
  SELECT *, max(seq) FILTER (WHERE NOT refused AND (action IN {_SETS} OR action IN {_CLEARS})) OVER (PARTITION BY item_id) AS last_e,
    max(seq) FILTER (WHERE NOT refused AND action IN ('analysed', 'approve_plan', 'reported', 'interrupt', 'recover_analysis', 'recover_modification', 'cancel', 'fail')) OVER (PARTITION BY item_id) AS last_r,
    CASE WHEN action IN ('analysed', 'reported', 'fail') THEN 'completed' WHEN action IN ('interrupt', 'cancel') THEN 'interrupted' WHEN starts_with(action, 'recover') THEN 'reconnecting' END AS run FROM folded
) GROUP BY item_id""".replace("message, 'set'", f"CASE WHEN action IN {_SETS} THEN message END, 'set'"),
    "job_logs": f"""{_JOB}, said AS (
  SELECT *, lag(message) OVER (PARTITION BY item_id ORDER BY seq) AS before FROM folded WHERE NOT refused AND message IS NOT NULL
)
SELECT item_id, seq, message, CASE WHEN action IN {_SETS} THEN 'error' ELSE 'info' END AS level FROM said WHERE NOT (action = 'interrupt' AND before IS NOT DISTINCT FROM message)""",
    "stage_texts": f"""{_JOB}
SELECT stage, CASE stage WHEN 'analyzing' THEN 0 WHEN 'awaitingPlanApproval' THEN 1 WHEN 'runningAI' THEN 2 WHEN 'reviewing' THEN 3 WHEN 'awaitingApproval' THEN 3 WHEN 'updatingTicket' THEN 5 WHEN 'completed' THEN 5
    ELSE CASE WHEN stage IN ('committing', 'pulling', 'pushing', 'partial') THEN 4 END END AS step,
  CASE WHEN stage = 'analyzing' THEN 'analysis' WHEN stage IN ('runningAI', 'reviewing') THEN 'modification' END AS phase,
  CASE stage WHEN 'partial' THEN '代码已提交，工单待重试' WHEN 'completed' THEN '交付已完成' ELSE '等待人工确认' END AS report_status,
  seq % 2 = 0 AND stage IN ('awaitingApproval', 'reviewing', 'partial', 'completed') AS report_visible,
  CASE WHEN stage = 'interrupted' THEN CASE WHEN seq % 3 = 0 THEN 'an error' ELSE 'AI 后台任务已中断，你可以重新检查进程或返回配置。' END WHEN seq % 5 = 0 THEN '正在重新连接 AI 任务…' WHEN seq % 5 = 1 THEN '已恢复后台任务，正在继续接收日志'
    WHEN seq % 3 = 0 THEN 'an error' ELSE 'Codex 正在处理 #7，你可以在此查看实时进度。' END AS progress, count(*) AS n
FROM folded GROUP BY 1, 2, 3, 4, 5, 6""",
    "scan_outcomes": f"{_PAGES} SELECT scan_id, status, CAST(n_pages AS BIGINT) AS n_pages FROM judged",
    "scan_tickets": f"{_PAGES} SELECT o.scan_id, CAST(o.page AS INTEGER) AS at, o.id, 'order ' || o.id AS subject, o.priority FROM o JOIN judged j ON o.scan_id = j.scan_id AND j.status = 'read' JOIN reached r ON o.scan_id = r.scan_id AND o.page = r.page WHERE o.id <> 0",
    "chunk_lines": r"""WITH l AS (
  SELECT doc_id AS stream, unnest(string_split_regex(coalesce(text, ''), '[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]')) AS line FROM documents
)
SELECT stream, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars, max(line) AS last_line, min(line) AS first_line FROM l WHERE line <> '' GROUP BY stream""",
    "recovered_items": f"""WITH i AS (
  SELECT l_orderkey * 10 + l_linenumber AS k, {_sql_case("l_partkey % 5", ["analyzing", "runningAI", "reviewing", "completed", "interrupted"])} AS stage, l_suppkey % 20 AS run, strftime(l_shipdate, '%Y%m%d') AS day FROM lineitem
), d AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN 'analysis' ELSE 'modification' END AS phase FROM i WHERE stage IN ('analyzing', 'runningAI', 'reviewing') AND NOT (k % 3 = 0 AND right(day, 1) = '1')
), r AS (
  SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'click') AS seen FROM events WHERE user_id < 20 GROUP BY user_id
), o AS (
  SELECT stage, phase, k, CASE WHEN k % 6 = 0 OR user_id IS NULL OR (stage = 'analyzing') <> (phase = 'analysis') THEN 'interrupted' WHEN run % 3 = 0 THEN 'completed' WHEN run % 3 = 1 THEN 'recovered' ELSE 'interrupted' END AS outcome, seen
  FROM d LEFT JOIN r ON run = user_id
)
SELECT stage, outcome, CASE WHEN outcome = 'interrupted' THEN 'interrupted' WHEN phase = 'analysis' THEN 'analyzing' ELSE 'runningAI' END AS new_stage,
  CASE WHEN outcome = 'interrupted' THEN CASE WHEN k % 6 <> 0 THEN 'interrupted' END WHEN outcome = 'recovered' THEN 'recovered' ELSE 'reconnecting' END AS execution_state,
  CASE WHEN outcome = 'recovered' THEN '{R.TAKEN_UP}' WHEN outcome = 'completed' THEN '{R.FINISHED}' WHEN k % 7 <> 0 THEN '{R.LOST}' END AS message,
  CASE WHEN outcome = 'interrupted' THEN '{R.LOST}' END AS error, count(*) AS n, CAST(sum(CASE WHEN outcome <> 'interrupted' THEN coalesce(seen, 0) END) AS BIGINT) AS resume_sum
FROM o GROUP BY 1, 2, 3, 4, 5, 6""",
    "control_runs": f"""WITH r AS (SELECT user_id AS u, date_trunc('second', min(ts)) AS started, date_trunc('second', max(ts)) AS last FROM events GROUP BY user_id),
  b AS (SELECT *, CASE WHEN u % 9 <> 0 AND u % 10 <> 0 THEN last END AS beat, u % 5 = 0 AND u % 2 = 1 AS ended FROM r),
  f AS (SELECT *, epoch(TIMESTAMP '{NOW}') - epoch(coalesce(beat, started)) <= 259200 AS fresh FROM b)
  SELECT CAST(u AS VARCHAR) AS run_id, CASE WHEN ended THEN 'completed' WHEN u % 7 <> 0 AND fresh THEN 'running' ELSE 'interrupted' END AS status, beat IS NOT NULL AND fresh AND u % 4 <> 0 AS may_cancel FROM f""",
}
