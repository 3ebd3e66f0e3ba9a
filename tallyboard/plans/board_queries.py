"""Registered queries of what the board shows around its tickets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scalars as S
from ..functions import texts as T
from ..operators import board as B
from ..operators import jobs as J
from ..sources import adapters as A


def tickets_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with their own pages, of which some failed, some name an author and some are there twice."""
    t = A.tickets(spark, sf_dir)
    pages = t.filter("id % 3 <> 0").select("id", (F.col("id") % 5 != 1).alias("ok"), F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("page of "), "title")).alias("description"), F.when(F.col("id") % 2 == 0, "page author").alias("author"))
    return B.enriched(t, pages.unionByName(pages.filter("id % 11 = 0"))).select("id", "description", "author")


def processing_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items by stage after every second ticket left the processing view."""
    items, t = A.work_items(spark, sf_dir), A.tickets(spark, sf_dir)
    out = J.cancel_active(items, t.filter("id % 2 = 0").select("id"))
    return out.groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("ticket_id").alias("n_tickets"))


def repositories_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.repositories(spark, sf_dir)
    changes = r.filter("position % 3 = 0").select((F.col("position") * F.when(F.col("position") % 2 == 0, 1).otherwise(-1)).alias("position"), "project", F.concat(F.lit("moved/"), "path").alias("path"), "is_default", F.lit(1).alias("sequence"))
    keyed = lambda d: d.withColumn("repo", F.col("position"))
    return B.upsert(keyed(r), keyed(changes), ["repo"]).select("repo", "position", "project", "path", "is_default")


def reselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's selected order after a sync that no longer has every tenth."""
    o = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("id"))
    selected = A.table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("viewer"), "id")
    now = A.tickets(spark, sf_dir).filter("id % 10 <> 0").select("id", "status", "version")
    return B.reselected(selected, now).select("viewer", F.col("s_id").alias("selected"), "ticket.status", "ticket.version")


def board_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("viewer"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "gone").alias("project"), F.col("c_name").alias("label"))
    return B.titles(views, B.first_projects(A.tickets(spark, sf_dir)))


def board_solvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tickets(spark, sf_dir)
    done = t.filter("id % 5 = 0").select("id", F.lit("").alias("assignee"))
    return B.solvable(B.delivered(t, done)).groupBy("project", "kind").agg(F.count("*").alias("n"))


def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tickets(spark, sf_dir)
    return B.sync_totals(t.filter("id % 10 NOT IN (1, 2)"), t.filter("id % 10 <> 0"))


def landed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations behind label lines, cleaned as they land and as they are shown."""
    c, i = A.table(spark, sf_dir, "conversations"), F.col("conv_id") % 5
    text = F.translate(F.coalesce("text", F.lit("")), "\r", "")
    lead = F.when(i == 0, "引用\n描述\n").when(i == 1, "描述\n引用\n").when(i == 2, " 引用 \n\n描述\n 描述\n").when(i == 3, "引用").otherwise("")
    landed = F.concat(lead, F.lit("of "), text)
    return c.select("conv_id", "turn", T.strip_landed_labels(landed).alias("landed"), T.description(landed).alias("shown"))


def repository_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as probed folders: some are no repository, some are changed, some have no remote."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    error = F.when(k % 11 == 0, F.concat(F.lit("probe failed: "), name))
    state = J.repository_state(F.when(k % 7 == 0, "false\n").otherwise(" true\n"), F.when(k % 3 == 0, F.concat(F.lit(" M "), name, F.lit("\n"))).otherwise("\n"), F.concat(name, F.lit("\n")), F.when(k % 5 != 0, F.concat(F.lit("git@h:"), k, F.lit("\n"))), error)
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", state.alias("r")).select("s_suppkey", "r.*")


def helper_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = A.table(spark, sf_dir, "part"), F.col("p_partkey")
    more = F.array(F.when(k % 2 == 0, F.col("p_name")).otherwise(""), F.when(k % 3 == 0, F.col("p_brand")).otherwise(""))
    return p.select("p_partkey", J.with_lines(F.when(k % 5 == 0, "").otherwise(F.col("p_type")), more).alias("text"))


def project_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects, some named after what they do: the first word that a name has decides."""
    k = F.col("c_custkey")
    words = F.when(k % 5 == 0, "云上的数据").when(k % 5 == 1, "数据与移动").when(k % 5 == 2, "云").when(k % 5 == 3, "移动").otherwise("")
    return A.table(spark, sf_dir, "customer").select("c_custkey", S.symbol(F.concat("c_name", words)).alias("symbol"))


def job_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job would ask for each ticket, as checksums of the two texts."""
    ticket = {c: F.col(c) for c in ("id", "project", "kind", "priority", "title", "description")}
    helper, plan = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("version")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("change "), "title"))
    texts = P.prompt(ticket, helper, "Board", "JOB_"), P.prompt(ticket, helper, "Board", "JOB_", plan)
    return A.tickets(spark, sf_dir).select("id", *[F.md5(x.cast("binary")).alias(n) for x, n in zip(texts, ("analysis", "changes"))])


BOARD_QUERIES = {f.__name__: f for f in (tickets_enriched, processing_cancelled, repositories_upserted, reselected, board_titles, board_solvable, sync_totals, landed_labels, repository_states, helper_paths, project_symbols, job_prompts)}


def board_oracle_sql(tickets: str, items: str, repos: str) -> dict[str, str]:
    """The SQL, over the shared definitions of tickets, work items and repositories."""
    nl = "chr(10)"

    def prompt(template: str) -> str:
        out = "'" + template.replace("{workbench}", "Board").replace("{prefix}", "JOB_") + "'"
        fields = {"number": "'#' || id", "project": "project", "kind": "kind", "priority": "priority", "title": "title", "description": "description"}
        fields |= {"helper": f"CASE WHEN id % 3 = 0 THEN '{P.NO_HELPER}' ELSE version END", "plan": f"CASE WHEN id % 2 = 0 THEN 'change ' || title ELSE '{P.NO_PLAN}' END"}
        for name, value in fields.items():
            out = f"replace({out}, '{{{name}}}', {value})"
        return f"md5({out})"

    return {
        "project_symbols": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'chart.bar' WHEN 1 THEN 'iphone' WHEN 2 THEN 'cloud' WHEN 3 THEN 'iphone' ELSE 'shippingbox' END AS symbol FROM customer",
        "job_prompts": f"WITH {tickets} SELECT id, {prompt(P.ANALYSIS)} AS analysis, {prompt(P.CHANGES)} AS changes FROM tickets",
        "tickets_enriched": f"""WITH {tickets} SELECT id, CASE WHEN id % 3 <> 0 AND id % 5 <> 1 THEN CASE WHEN id % 7 = 0 THEN '' ELSE 'page of ' || title END ELSE description END AS description,
          CASE WHEN author IS NULL AND id % 3 <> 0 AND id % 5 <> 1 AND id % 2 = 0 THEN 'page author' ELSE author END AS author FROM tickets""",
        "processing_cancelled": f"""WITH {tickets}, {items}, last AS (SELECT i.ticket_id AS t, max(position) AS p FROM items i JOIN tickets k ON i.ticket_id = k.id WHERE k.id % 2 = 0 AND stage NOT IN ('completed', 'cancelled', 'failed') GROUP BY i.ticket_id)
          SELECT CASE WHEN t IS NULL THEN stage ELSE 'cancelled' END AS stage, count(*) AS n, count(DISTINCT ticket_id) AS n_tickets FROM items LEFT JOIN last ON ticket_id = t AND position = p GROUP BY 1""",
        "repositories_upserted": f"""WITH {repos}, c AS (SELECT *, CASE WHEN position % 2 = 0 THEN position ELSE -position END AS repo FROM repos WHERE position % 3 = 0)
          SELECT position AS repo, position, project, path, is_default FROM repos WHERE position % 6 <> 0 UNION ALL SELECT repo, repo, project, 'moved/' || path, is_default FROM c""",
        "reselected": f"""WITH {tickets}, s AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) SELECT c_custkey AS viewer, k AS selected, status, version
          FROM customer LEFT JOIN s ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM tickets WHERE id % 10 <> 0) t ON k = t.id""",
        "board_titles": f"WITH {tickets}, p AS (SELECT DISTINCT project FROM tickets) SELECT c_custkey AS viewer, CASE WHEN c_custkey % 3 = 0 AND project IS NOT NULL THEN c_mktsegment ELSE c_name END AS title FROM customer LEFT JOIN p ON c_mktsegment = project",
        "board_solvable": f"WITH {tickets} SELECT project, kind, count(*) AS n FROM tickets WHERE id % 5 <> 0 GROUP BY project, kind",
        "sync_totals": f"WITH {tickets} SELECT count(*) AS n_tickets, count(*) FILTER (WHERE id % 10 = 0) AS n_new, count(*) FILTER (WHERE id % 10 = 0) > 0 AS unread, count(*) = 0 AS needs_login FROM tickets WHERE id % 10 NOT IN (1, 2)",
        "landed_labels": f"""WITH c AS (SELECT conv_id, turn, conv_id % 5 AS i, 'of ' || regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[\\s\\p{{Z}}]+$', '') AS t FROM conversations)
          SELECT conv_id, turn, CASE i WHEN 1 THEN '引用' || {nl} || t WHEN 2 THEN t WHEN 3 THEN '引用' || t ELSE t END AS landed, CASE i WHEN 3 THEN '引用' || t ELSE t END AS shown FROM c""",
        "repository_states": """WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AS ok, s_suppkey % 3 <> 0 AS clean FROM supplier)
          SELECT k AS s_suppkey, ok AS is_repository, ok AND clean AS is_clean, CASE WHEN ok THEN n ELSE '' END AS branch, CASE WHEN ok AND k % 5 <> 0 THEN 'git@h:' || k ELSE '' END AS remote,
          CASE WHEN k % 11 = 0 THEN 'probe failed: ' || n WHEN NOT ok THEN '所选目录不是 Git 仓库' WHEN clean THEN '仓库状态正常' ELSE '仓库存在未提交改动（将保留并继续）' END AS message FROM s""",
        "helper_paths": f"""SELECT p_partkey, concat_ws({nl}, CASE WHEN p_partkey % 5 <> 0 THEN p_type END, CASE WHEN p_partkey % 2 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END) AS text FROM part""",
    }
