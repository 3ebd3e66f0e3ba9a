"""The registered board, sync and event queries, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as T
from ..operators import board as B
from ..operators import events as E
from ..sources import adapters as A

NOW = "2024-01-01 00:00:00"


def _board(**params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return B.BoardQuery(**params).run(A.tickets(spark, sf_dir), A.work_items(spark, sf_dir)).select("id", "project", "kind", "priority", "status", "version", "updated_at")

    return run


def normalize_tickets(spark, sf_dir):
    t = A.tickets(spark, sf_dir)
    return t.select("id", "project", "kind", "priority", "status", "version", "updated_at", "assignee", "author", "title", "description", "source_url", S.rank(F.col("priority")).cast("int").alias("sort_rank"), F.concat(F.lit("#"), "id").alias("issue_number"), F.col("kind").isin("Bug", "支持").alias("needs_author"), S.symbol(F.col("project")).alias("symbol"))


def board_search(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.filter(B.matches(F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "text"), "éreau")).select("doc_id")


def project_counts(spark, sf_dir):
    return A.tickets(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"))


def view_counts(spark, sf_dir):
    return B.view_counts(A.tickets(spark, sf_dir), A.work_items(spark, sf_dir))


def repo_counts(spark, sf_dir):
    projects = A.tickets(spark, sf_dir).select("project").distinct()
    n = A.repositories(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"))
    return projects.join(n, "project", "left").select("project", F.coalesce("n", F.lit(0)).alias("n"))


def versions_distinct(spark, sf_dir):
    return A.tickets(spark, sf_dir).select("version").distinct().orderBy(F.desc("version"))


def projects_first(spark, sf_dir):
    return B.first_projects(A.tickets(spark, sf_dir)).orderBy("project")


def display_status(spark, sf_dir):
    return B.display_status(A.tickets(spark, sf_dir), A.work_items(spark, sf_dir))


def active_item(spark, sf_dir):
    return B.active_items(A.work_items(spark, sf_dir))


def detail_item(spark, sf_dir):
    return B.detail_items(A.work_items(spark, sf_dir))


def dedup_first(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return B.first_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


def _cached(spark, sf_dir):
    return A.tickets(spark, sf_dir).filter("id % 10 <> 0")


def _synced(spark, sf_dir):
    return A.tickets(spark, sf_dir).filter("id % 10 NOT IN (1, 2)")


def sync_new(spark, sf_dir):
    return B.sync_new(_synced(spark, sf_dir), _cached(spark, sf_dir)).select("id", "status")


def sync_retained(spark, sf_dir):
    return B.sync_retained(_synced(spark, sf_dir), _cached(spark, sf_dir), A.work_items(spark, sf_dir)).select("id", "status")


def sync_merged(spark, sf_dir):
    return B.sync_merged(_synced(spark, sf_dir), _cached(spark, sf_dir), A.work_items(spark, sf_dir)).select("id", "status", "project")


def upsert_items(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("stage"))
    changes = rows.filter("id % 3 = 0").select("id", (F.col("position") + 1000000).alias("position"), F.lit("U").alias("stage"), F.lit(2).alias("sequence"))
    earlier = changes.withColumn("stage", F.lit("T")).withColumn("sequence", F.lit(1))
    return B.upsert(rows, changes.unionByName(earlier), ["id"]).select("id", "position", "stage")


def delete_rows(spark, sf_dir):
    repos = A.repositories(spark, sf_dir)
    return B.delete(repos, repos.filter("position % 4 = 0").select("position"), ["position"])


def delivered_state(spark, sf_dir):
    t = A.tickets(spark, sf_dir)
    done = t.filter("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "tester").otherwise("  ").alias("assignee"))
    return B.delivered(t, done).select("id", "status", "assignee")


def detail_enriched(spark, sf_dir):
    d, x = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "x_id")
    return d.join(x, F.col("doc_id") == F.col("x_id"), "left").select("doc_id", F.coalesce(F.nullif(F.col("lang"), F.lit("fr")), F.col("quality").cast("string")).alias("author"))


def item_ticket(spark, sf_dir):
    return A.work_items(spark, sf_dir).join(A.tickets(spark, sf_dir), F.col("ticket_id") == F.col("id")).groupBy("id", "project").agg(F.count("*").alias("n_items"))


def item_repository(spark, sf_dir):
    repos = A.repositories(spark, sf_dir)
    best = repos.groupBy("project").agg(F.min_by("path", F.struct((~F.col("is_default")).alias("d"), "position")).alias("path"))
    return A.tickets(spark, sf_dir).join(best, "project", "left").select("id", "path")


def delivery(spark, sf_dir):
    t = A.tickets(spark, sf_dir)
    return t.select("id", S.delivery_assignee(F.col("kind"), F.col("author"), F.col("assignee")).alias("assignee"), S.delivery_error(F.col("kind"), F.col("author"), F.col("source_url")).alias("error"), F.concat(F.lit("[#"), "id", F.lit("] "), "title").alias("commit_message"))


def delivery_message(spark, sf_dir):
    to = S.delivery_assignee(F.col("kind"), F.col("author"), F.col("assignee"))
    return A.tickets(spark, sf_dir).select("id", T.delivery_message(F.col("kind"), to).alias("message"))


def strip_labels(spark, sf_dir):
    d, i = A.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    lead = F.when(i == 0, "引用\n描述\n").when(i == 1, " 描述 \n\n").when(i == 2, "引用\r\n").otherwise("")
    return d.select("doc_id", T.strip_labels(F.concat(lead, F.lit("of "), "source")).alias("text"))


def strip_page_param(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", S.without_page(F.col("url")).alias("url"))


def report_sections(spark, sf_dir):
    text = F.concat(F.lit("SUMMARY: "), "source", F.lit("\nTESTS:\n- "), "lang", F.lit("\n-  b \n\nRISKS: none"))
    d = A.table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return d.select("doc_id", S.section(F.col("t"), "SUMMARY:", "TESTS:").alias("summary"), F.array_join(S.list_items(S.section(F.col("t"), "TESTS:", "RISKS:")), "|").alias("tests"))


def parse_dates(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    shape = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy年MM月dd日 HH:mm:ss")).when(F.col("o_orderkey") % 4 == 2, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select(F.col("o_orderkey").alias("id"), S.parse_date(shape, F.lit(NOW).cast("timestamp")).cast("timestamp_ntz").alias("at"))


def updated_text(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", S.updated_text(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("updated"))


def _event_lines(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("turn.completed").alias("type")))).when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.col("text")).alias("item")))).otherwise(F.concat(F.lit("log "), "turn"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("offset"), line.alias("line"))


def parse_events(spark, sf_dir):
    return _event_lines(spark, sf_dir).withColumn("e", E.codex_event(F.col("line"))).select("run_id", "offset", "e.display", "e.final")


def final_message(spark, sf_dir):
    return E.final_messages(parse_events(spark, sf_dir))


def visible_logs(spark, sf_dir):
    rows = parse_events(spark, sf_dir).filter("display IS NOT NULL")
    return E.visible(rows, ("idiot", "scum"), "The ", "display").select("run_id", "offset")


def liveness(spark, sf_dir):
    last = A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("beat"))
    top = A.table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) / 1e6 - F.unix_micros(F.col("beat").cast("timestamp")) / 1e6
    return last.crossJoin(F.broadcast(top)).select("user_id", E.liveness(F.col("user_id") % 11 == 0, F.col("user_id") % 7 != 0, F.when(F.col("user_id") % 5 != 0, age), F.col("user_id") % 2 * 7200.0, 3600.0).alias("status"))  # one row


def stage_history_invalid(spark, sf_dir):
    return E.invalid_transitions(A.work_items(spark, sf_dir))


def recoverable_jobs(spark, sf_dir):
    return A.work_items(spark, sf_dir).filter(F.col("stage").isin(*S.RECOVERABLE)).groupBy("ticket_id").agg(F.count("*").alias("n"))


from .board_queries import BOARD_QUERIES, board_oracle_sql  # noqa: E402
from .job_queries import JOB_ORACLE_SQL, JOB_QUERIES  # noqa: E402
from .state_queries import STATE_ORACLE_SQL, STATE_QUERIES  # noqa: E402
from .stream_queries import STREAM_ORACLE_SQL, STREAM_QUERIES  # noqa: E402

QUERIES = {
    **JOB_QUERIES,
    "board_processing": _board(view="processing"), "board_approval": _board(view="approval"), "board_completed": _board(view="completed"), "board_all": _board(),
    "board_text": _board(text="CLERK in nàtion_1", status="新建"), "board_version": _board(version="v1996.7"), "board_filtered": _board(view="processing", kind="Bug", priority="紧急", project="BUILDING"), "board_by_version": _board(status="新建", sort="version"), "board_by_updated": _board(status="处理中", sort="updated"),
    **{f.__name__: f for f in (
        normalize_tickets, board_search, project_counts, view_counts, repo_counts, versions_distinct, projects_first, display_status, active_item, detail_item, dedup_first, sync_new, sync_retained,
        sync_merged, upsert_items, delete_rows, delivered_state, detail_enriched, item_ticket, item_repository, delivery, delivery_message, strip_labels, strip_page_param, report_sections, parse_dates, updated_text, parse_events,
        final_message, visible_logs, liveness, stage_history_invalid, recoverable_jobs,
    )},
    **STREAM_QUERIES,
    **STATE_QUERIES,
    **BOARD_QUERIES,
}

_TICKETS = """
tickets AS (
  SELECT o_orderkey AS id, c_mktsegment AS project,
    CASE o_orderkey % 6 WHEN 0 THEN 'Bug' WHEN 1 THEN '需求' WHEN 2 THEN '建议' WHEN 3 THEN '支持' WHEN 4 THEN '任务' ELSE 'Bug' END AS kind,
    CASE o_orderpriority WHEN '1-URGENT' THEN '紧急' WHEN '2-HIGH' THEN '高' ELSE '普通' END AS priority,
    CASE o_orderstatus WHEN 'F' THEN '已完成' WHEN 'P' THEN '处理中' ELSE '新建' END AS status,
    'v' || year(o_orderdate) || '.' || month(o_orderdate) AS version, o_orderdate AS updated_at, c_name AS assignee,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE n_name END AS author, 'order of ' || c_name AS title,
    CASE WHEN o_orderkey % 4 = 0 THEN '知识库列表未提供描述，打开原工单可查看完整内容。' ELSE 'Clerk in ' || n_name END AS description,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'https://tracker.example/issues/' || o_orderkey END AS source_url
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey <> 0
)"""
_ITEMS = """
items AS (
  SELECT l_orderkey AS ticket_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS position,
    CASE l_returnflag || l_linestatus WHEN 'AO' THEN 'awaitingApproval' WHEN 'AF' THEN 'awaitingPlanApproval' WHEN 'RO' THEN 'runningAI'
      WHEN 'RF' THEN 'interrupted' WHEN 'NO' THEN 'completed' ELSE 'failed' END AS stage
  FROM lineitem
), active AS (
  SELECT ticket_id, arg_max(stage, position) AS active_stage FROM items WHERE stage NOT IN ('completed', 'cancelled', 'failed') GROUP BY ticket_id
)"""
_BOTH = f"WITH {_TICKETS}, {_ITEMS}"
_COLS = "SELECT id, project, kind, priority, status, version, updated_at FROM tickets"
_PROCESSING = " LEFT JOIN active ON id = ticket_id WHERE ((active_stage IS NOT NULL AND active_stage NOT IN ('awaitingPlanApproval', 'awaitingApproval')) OR (active_stage IS NULL AND status = '处理中'))"
_REPOS = "repos AS (SELECT s_suppkey AS position, CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS project, s_name AS path, s_suppkey % 10 = 3 AS is_default FROM supplier)"
_SYNC = _BOTH + ", cached AS (SELECT * FROM tickets WHERE id % 10 <> 0), synced AS (SELECT * FROM tickets WHERE id % 10 NOT IN (1, 2)), retained AS (SELECT * FROM cached WHERE id NOT IN (SELECT id FROM synced) AND id IN (SELECT ticket_id FROM active)) "
_EVENTS = """ev AS (
  SELECT conv_id AS run_id, turn AS "offset", CASE role WHEN 'user' THEN 'Codex 已完成本轮任务' WHEN 'assistant' THEN text ELSE 'log ' || turn END AS display,
    CASE WHEN role = 'assistant' THEN text END AS final FROM conversations
)"""

ORACLE_SQL = {
    **JOB_ORACLE_SQL,
    **STREAM_ORACLE_SQL,
    **STATE_ORACLE_SQL,
    **board_oracle_sql(_TICKETS, _ITEMS, _REPOS),
    "stream_merge": _SYNC + "SELECT id, status, project, id % 10 = 0 AS is_new, 'loginRequired' AS sync_status, true AS unread FROM (SELECT * FROM synced UNION ALL SELECT * FROM retained)",
    "board_processing": _BOTH + _COLS + _PROCESSING,
    "board_approval": _BOTH + _COLS + " JOIN active ON id = ticket_id WHERE active_stage IN ('awaitingPlanApproval', 'awaitingApproval')",
    "board_completed": _BOTH + _COLS + " WHERE status = '已完成' OR EXISTS (SELECT 1 FROM items WHERE ticket_id = id AND stage = 'completed')",
    "board_all": f"WITH {_TICKETS} {_COLS}",
    "board_text": f"WITH {_TICKETS} {_COLS} WHERE status = '新建' AND contains(strip_accents(lower(id || ' ' || title || ' ' || description)), strip_accents('clerk in nàtion_1'))",
    "board_version": f"WITH {_TICKETS} {_COLS} WHERE version = 'v1996.7'",
    "board_filtered": _BOTH + _COLS + _PROCESSING + " AND kind = 'Bug' AND priority = '紧急' AND project = 'BUILDING'",
    "board_by_version": f"WITH {_TICKETS} {_COLS} WHERE status = '新建'",
    "board_by_updated": f"WITH {_TICKETS} {_COLS} WHERE status = '处理中'",
    "normalize_tickets": f"WITH {_TICKETS} SELECT *, CASE priority WHEN '紧急' THEN 0 WHEN '高' THEN 1 ELSE 2 END AS sort_rank, '#' || id AS issue_number, kind IN ('Bug', '支持') AS needs_author, 'shippingbox' AS symbol FROM tickets",
    "board_search": "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(doc_id || ' ' || source || ' ' || text)), 'ereau')",
    "project_counts": f"WITH {_TICKETS} SELECT project, count(*) AS n FROM tickets GROUP BY project",
    "view_counts": _BOTH + f" SELECT (SELECT count(*) FROM tickets{_PROCESSING}) AS processing, (SELECT count(*) FROM items WHERE stage LIKE 'awaiting%') AS approval, (SELECT count(*) FROM items WHERE stage = 'completed') AS completed",
    "repo_counts": f"WITH {_TICKETS}, {_REPOS} SELECT p.project, count(r.path) AS n FROM (SELECT DISTINCT project FROM tickets) p LEFT JOIN repos r ON p.project = r.project GROUP BY p.project",
    "versions_distinct": f"WITH {_TICKETS} SELECT DISTINCT version FROM tickets",
    "projects_first": f"WITH {_TICKETS} SELECT project, min(id) AS first_id, count(*) AS n_tickets, 'shippingbox' AS symbol FROM tickets GROUP BY project",
    "display_status": _BOTH + " SELECT id, CASE WHEN active_stage IS NOT NULL AND active_stage NOT LIKE 'awaiting%' THEN '处理中' ELSE status END AS display_status FROM tickets LEFT JOIN active ON id = ticket_id",
    "active_item": f"WITH {_ITEMS} SELECT ticket_id, active_stage FROM active",
    "detail_item": f"WITH {_ITEMS} SELECT i.ticket_id, coalesce(max(a.active_stage), arg_max(i.stage, i.position)) AS detail_stage FROM items i LEFT JOIN active a ON i.ticket_id = a.ticket_id GROUP BY i.ticket_id",
    "dedup_first": "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1",
    "sync_new": _SYNC + "SELECT id, status FROM synced WHERE id NOT IN (SELECT id FROM cached)",
    "sync_retained": _SYNC + "SELECT id, status FROM retained",
    "sync_merged": _SYNC + "SELECT id, status, project FROM synced UNION ALL SELECT id, status, project FROM retained",
    "upsert_items": "SELECT o_orderkey AS id, o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS stage FROM orders",
    "delete_rows": f"WITH {_REPOS} SELECT * FROM repos WHERE position % 4 <> 0",
    "delivered_state": f"WITH {_TICKETS} SELECT id, CASE WHEN id % 5 = 0 THEN '待测试' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 'tester' ELSE assignee END AS assignee FROM tickets",
    "detail_enriched": "SELECT d.doc_id, coalesce(nullif(lang, 'fr'), CAST(quality AS VARCHAR)) AS author FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "item_ticket": _BOTH + " SELECT id, project, count(*) AS n_items FROM items JOIN tickets ON ticket_id = id GROUP BY id, project",
    "item_repository": f"WITH {_TICKETS}, {_REPOS}, best AS (SELECT project, path FROM repos QUALIFY row_number() OVER (PARTITION BY project ORDER BY is_default DESC, position) = 1) SELECT id, path FROM tickets LEFT JOIN best USING (project)",
    "delivery": f"WITH {_TICKETS} SELECT id, CASE WHEN kind = '需求' THEN '' WHEN kind IN ('Bug', '支持') THEN coalesce(author, '') ELSE assignee END AS assignee, CASE WHEN kind IN ('Bug', '支持') AND author IS NULL AND source_url IS NOT NULL THEN 'missingTicketAuthor' END AS error, '[#' || id || '] ' || title AS commit_message FROM tickets",
    "delivery_message": f"WITH {_TICKETS} SELECT id, CASE WHEN kind = '需求' THEN '工单已转为待测试，负责人保持不变' WHEN kind IN ('Bug', '支持') THEN CASE WHEN coalesce(author, '') = '' THEN '工单已转为待测试，未获取到创建人，负责人保持不变' ELSE '工单已转为待测试并转交给创建人 ' || author END WHEN coalesce(assignee, '') = '' THEN '工单已转为待测试，负责人保持不变' ELSE '工单已转为待测试并转交给 ' || assignee END AS message FROM tickets",
    "strip_labels": "SELECT doc_id, 'of ' || source AS text FROM documents",
    "strip_page_param": r"SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page(=|&|#|$)') THEN regexp_replace(regexp_replace(regexp_replace(url, '([?&])page(=[^&#]*)?(&|$)', '\1'), '[?&]$', ''), '[?&]#', '#') ELSE url END AS url FROM pages",
    "report_sections": "SELECT doc_id, source AS summary, lang || '|b' AS tests FROM documents",
    "parse_dates": f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 2 THEN TIMESTAMP '{NOW}' WHEN 0 THEN date_trunc('minute', o_orderdate) ELSE date_trunc('second', o_orderdate) END AS at FROM orders",
    "updated_text": f"SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '{NOW[:10]}' THEN CASE WHEN greatest(floor((epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts))) / 3600), 0) = 0 THEN '刚刚' ELSE CAST(greatest(floor((epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts))) / 3600), 0) AS BIGINT) || ' 小时前' END ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS updated FROM events",
    "parse_events": f"WITH {_EVENTS} SELECT * FROM ev",
    "final_message": f"WITH {_EVENTS} SELECT run_id, arg_max(final, \"offset\") FILTER (WHERE final <> '') AS final FROM ev GROUP BY run_id",
    "visible_logs": f"WITH {_EVENTS}, kept AS (SELECT *, lag(display) OVER (PARTITION BY run_id ORDER BY \"offset\") AS previous FROM ev WHERE display IS NOT NULL) SELECT run_id, \"offset\" FROM kept WHERE display IS DISTINCT FROM previous AND NOT contains(display, 'idiot') AND NOT contains(display, 'scum') AND NOT starts_with(display, 'The ')",
    "liveness": "SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'completed' WHEN user_id % 7 = 0 THEN 'interrupted' WHEN CASE WHEN user_id % 5 <> 0 THEN epoch_us((SELECT max(ts) FROM events)) / 1e6 - epoch_us(max(ts)) / 1e6 ELSE user_id % 2 * 7200 END <= 3600 THEN 'running' ELSE 'interrupted' END AS status FROM events GROUP BY user_id",
    "stage_history_invalid": f"WITH {_ITEMS}, steps AS (SELECT ticket_id, stage, lag(stage) OVER (PARTITION BY ticket_id ORDER BY position) AS previous FROM items) SELECT ticket_id, previous, stage, count(*) AS n FROM steps WHERE previous IS NOT NULL AND previous <> stage AND stage NOT IN ('failed', 'interrupted', 'cancelled') AND (previous, stage) NOT IN (('awaitingPlanApproval', 'runningAI'), ('interrupted', 'runningAI')) GROUP BY ticket_id, previous, stage",
    "recoverable_jobs": f"WITH {_ITEMS} SELECT ticket_id, count(*) AS n FROM items WHERE stage IN ('analyzing', 'runningAI', 'reviewing') GROUP BY ticket_id",
}
