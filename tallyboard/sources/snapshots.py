"""The whole state of a board: strict reading of its JSON documents, and versioned saves.

A document is decoded as a whole or not at all: a missing required field, a value of another
type, an unknown word of a closed domain or broken JSON give null. Fields that came later have
defaults. ``Snapshots`` keeps the state as tables: each save is a new folder, and one small
pointer file, renamed into place, says which of them counts, so a save that was cut off is never
read. Changes between saves go to a log of upserts that a load applies and ``compact`` folds in.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import board as B
from .store import Store

# The words of the closed domains as documents hold them.
STAGES = {
    "准备仓库": "preparing", "AI 分析问题": "analyzing", "确认修改方案": "awaitingPlanApproval", "AI 开始编码": "runningAI", "查看报告": "reviewing", "人工确认": "awaitingApproval",
    "本地 Commit": "committing", "拉取最新代码": "pulling", "Push": "pushing", "转为待测试": "updatingTicket", "已完成": "completed", "部分完成": "partial",
    "执行已中断": "interrupted", "失败": "failed", "已取消": "cancelled",
}
PROVIDERS = ("Codex", "Cursor", "Claude Code")
PHASES, STATES = ("analysis", "modification"), ("launching", "running", "reconnecting", "recovered", "completed", "interrupted")
DEFAULT_HOURS, HOURS = 2, (1, 8)

TICKET = "id bigint, projectID string, projectName string, kind string, priority string, status string, title string, description string, targetVersion string, updatedAt string, assignee string, sourceURL string, author string"
REPOSITORY = "id string, projectID string, displayName string, path string, defaultBranch string, remoteName string, isDefault boolean"
LOG = "id string, timestamp string, message string, level string"
REPORT = "summary string, reasoning string, changedFiles array<string>, tests array<string>, risks array<string>, diff string, rawOutput string"
EXECUTION = "runID string, phase string, runDirectory string, workerPID int, startedAt string, lastOutputOffset bigint, state string"
ITEM = f"id string, ticketID bigint, provider string, repositoryPath string, branch string, helperContext string, stage string, logs array<struct<{LOG}>>, analysisPlan string, report struct<{REPORT}>, commitHash string, errorMessage string, execution struct<{EXECUTION}>, createdAt string, updatedAt string"
DOCUMENT = f"tickets array<struct<{TICKET}>>, repositories array<struct<{REPOSITORY}>>, workItems array<struct<{ITEM}>>, knowledgeBaseURL string, defaultTestAssignee string, syncIntervalHours bigint, hasAuthenticatedSession boolean, lastSyncedAt string, _broken string"
OPTIONAL = {"sourceURL", "author", "analysisPlan", "report", "commitHash", "errorMessage", "execution"}
#: A date of a document: seconds and a zone, no fraction.
DATE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$"
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def _fields(spec: str) -> list[str]:
    """The top-level names of a list of fields."""
    names, depth, start = [], 0, 0
    for i, c in enumerate(spec + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(spec[start:i].split()[0])
            start = i + 1
    return names


def _there(x: Column, spec: str) -> Column:
    """Whether all required fields are there."""
    out = x.isNotNull()
    for name in _fields(spec):
        if name not in OPTIONAL:
            out = out & x[name].isNotNull()
    return out


def is_date(c: Column) -> Column:
    return c.rlike(DATE) & F.try_to_timestamp(c).isNotNull()


def _all(xs: Column, test) -> Column:
    return F.coalesce(F.forall(xs, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _ticket_ok(t: Column) -> Column:
    return _there(t, TICKET) & t["kind"].isin(*S.KINDS) & t["priority"].isin(*S.PRIORITIES) & t["status"].isin(*S.STATUSES) & is_date(t["updatedAt"])


def _item_ok(i: Column) -> Column:
    logs = _all(i["logs"], lambda x: _there(x, LOG) & x["id"].rlike(UUID) & is_date(x["timestamp"]))
    run = i["execution"]
    execution = run.isNull() | F.coalesce(_there(run, EXECUTION) & run["runID"].rlike(UUID) & run["phase"].isin(*PHASES) & run["state"].isin(*STATES) & is_date(run["startedAt"]), F.lit(False))
    report = i["report"].isNull() | _there(i["report"], REPORT)
    words = i["id"].rlike(UUID) & i["provider"].isin(*PROVIDERS) & i["stage"].isin(*STAGES)
    return _there(i, ITEM) & words & logs & execution & report & is_date(i["createdAt"]) & is_date(i["updatedAt"])


def decode(text: Column) -> Column:
    """The struct of a document with its defaults, or null; null and empty texts give null.

    Defaults: two hours between syncs, signed in if there are tickets, never synced.
    """
    d = F.from_json(text, DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # within brackets, so that nothing may follow the document
    whole = alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull() & d["_broken"].isNull()
    for name in ("tickets", "repositories", "workItems", "knowledgeBaseURL", "defaultTestAssignee"):
        whole = whole & d[name].isNotNull()
    synced = d["lastSyncedAt"].isNull() | is_date(d["lastSyncedAt"])
    ok = whole & synced & _all(d["tickets"], _ticket_ok) & _all(d["repositories"], lambda r: _there(r, REPOSITORY) & r["id"].rlike(UUID)) & _all(d["workItems"], _item_ok)
    kept = [d[n].alias(n) for n in ("tickets", "repositories", "workItems", "knowledgeBaseURL", "defaultTestAssignee")]
    hours = F.coalesce(d["syncIntervalHours"], F.lit(DEFAULT_HOURS)).alias("syncIntervalHours")
    signed_in = F.coalesce(d["hasAuthenticatedSession"], F.size(d["tickets"]) > 0).alias("hasAuthenticatedSession")
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*kept, hours, signed_in, F.try_to_timestamp(d["lastSyncedAt"]).alias("lastSyncedAt")))


def read_documents(spark: SparkSession, path: str, decoded: bool = True) -> DataFrame:
    """(path, state) of each JSON document under ``path``; state is null where it cannot be decoded."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return d.select("path", decode(F.col("value")).alias("state")) if decoded else d


def migrated_url(url: Column, legacy: str, current: str) -> Column:
    """The current address in place of one legacy address, any other without its page."""
    return F.when(url == legacy, current).otherwise(S.without_page(url))


def restored(state: Column, legacy: str = "", current: str = "") -> Column:
    """What a start shows of a decoded state; of none that one must sign in.

    struct<status, hours, authenticated, url, n_tickets, n_items>: hours lie within 1 to 8.
    """
    status = F.when(state.isNull(), "loginRequired").when(state["lastSyncedAt"].isNotNull(), "synced").when(state["hasAuthenticatedSession"] | (F.size(state["tickets"]) > 0), "idle").otherwise("loginRequired")
    hours = F.least(F.lit(HOURS[1]), F.greatest(F.lit(HOURS[0]), F.coalesce(state["syncIntervalHours"], F.lit(DEFAULT_HOURS))))
    n = lambda name: F.when(state.isNull(), 0).otherwise(F.size(state[name])).cast("int")
    return F.struct(
        status.alias("status"), hours.cast("int").alias("hours"), F.coalesce(state["hasAuthenticatedSession"], F.lit(False)).alias("authenticated"),
        migrated_url(state["knowledgeBaseURL"], legacy, current).alias("url"), n("tickets").alias("n_tickets"), n("workItems").alias("n_items"),
    )


POINTER = "CURRENT"


class Snapshots:
    """Versions of a state (named tables and settings) under one folder.

    Tables that are upserted need a key and the columns position and, in changes, sequence.
    One writer at a time: see ``streaming.single_flight``.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]] | None = None):
        self.spark, self.store, self.keys = spark, Store(spark, root), keys or {}

    def pointer(self) -> dict | None:
        """The pointer's content, or null where there is none or it is broken."""
        try:
            p = json.loads(self.store.read(POINTER) or "null")
            return p if isinstance(p, dict) and isinstance(p.get("version"), int) and isinstance(p.get("tables"), list) else None
        except ValueError:
            return None

    def save(self, tables: dict[str, DataFrame], settings: dict, log_upto: int | None = None) -> int:
        """Writes a new version and makes it the current one; its number."""
        before = self.pointer() or {"version": 0, "log_upto": 0}
        version = before["version"] + 1
        folder = f"v-{version:012d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.store.root}/{folder}/{name}")
        upto = before["log_upto"] if log_upto is None else log_upto
        self.store.replace(POINTER, json.dumps({"version": version, "folder": folder, "tables": sorted(tables), "settings": settings, "log_upto": upto}))
        return version

    def log(self) -> list[tuple[int, str, str]]:
        """(number, table, folder) of the changes that the current version does not hold yet."""
        upto = (self.pointer() or {"log_upto": 0})["log_upto"]
        found = [(int(n.split("-")[1]), n.split("-", 2)[2], f"{self.store.root}/{n}") for n in self.store.names() if n.startswith("log-")]
        return [x for x in found if x[0] > upto]

    def append(self, table: str, changes: DataFrame) -> int:
        """Adds changes (the table's columns and sequence) to the log; they count once they are whole."""
        number = max([n for n, _, _ in self.log()], default=(self.pointer() or {"log_upto": 0})["log_upto"]) + 1
        temp = f".log-{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.store.root}/{temp}")
        self.store._rename(self.store.path(temp), self.store.path(f"log-{number:012d}-{table}"), over=False)
        return number

    def load(self) -> tuple[dict[str, DataFrame], dict] | None:
        """The tables with the log's changes applied, and the settings; null where nothing whole was saved."""
        p = self.pointer()
        if p is None or not all(self.store.exists(f"{p['folder']}/{t}/_SUCCESS") for t in p["tables"]):
            return None
        tables = {t: self.spark.read.parquet(f"{self.store.root}/{p['folder']}/{t}") for t in p["tables"]}
        for name in tables:
            logs = [f for _, t, f in self.log() if t == name]
            if logs:  # of equal sequences the later append counts
                changes = self.spark.read.parquet(*logs)
                changes = changes.withColumn("sequence", F.struct(F.col("sequence"), F.col("_metadata.file_path")))
                tables[name] = B.upsert(tables[name], changes, self.keys[name])
        return tables, p["settings"]

    def compact(self, keep: int = 1) -> int:
        """Saves the state with the log folded in, then removes what no pointer needs but ``keep`` older versions."""
        state = self.load()
        if state is None:
            raise ValueError("nothing was saved yet")
        upto = max([n for n, _, _ in self.log()], default=self.pointer()["log_upto"])
        version = self.save(*state, log_upto=upto)
        versions = [n for n in self.store.names() if n.startswith("v-") and int(n.split("-")[1]) <= version and n != self.pointer()["folder"]]
        gone = versions[: len(versions) - keep] if keep else versions
        for name in [*gone, *(n for n in self.store.names() if n.startswith("log-") and int(n.split("-")[1]) <= upto)]:
            self.store.delete(name)
        return version
