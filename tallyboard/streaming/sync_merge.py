"""Syncs of a ticket list merged as they arrive: one version of the state a batch, replays harmless.

A micro-batch holds the rows of one or more syncs (``sync_no``). Each sync replaces the cached
tickets by its own and keeps those that still have an active work item; the tickets that were not
cached before are the new ones, and replace the list of new tickets if there are any. A sync that
met a sign-in page changes no ticket. The number of the batch is saved with the state it led to, in
the same pointer, so a batch that Spark hands out again finds itself applied and does nothing.
A sync is merged once, in parts by id of about ``PART`` rows, into a scratch table from which the
tables of the state are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import board as B
from ..sources.snapshots import Snapshots
from ..sources.store import Tables

#: Rows of a sync and of the cached tickets that one task merges, besides the items of their tickets.
PART = 250_000
TABLES = ("tickets", "projects", "new_tickets")


class SyncMerge:
    """The merge as a ``foreachBatch`` function.

    Rows have ``sync_no``, ``login`` (the sync met a sign-in page) and the columns of a ticket;
    ``items`` are the work items (ticket_id, position, stage) at that time, as a function that
    gives them. A sync without tickets is a row with a null id. Of rows of one sync with one id
    the first by ``row_no`` counts. Null sync numbers are ignored.
    """

    def __init__(self, spark: SparkSession, root: str, ticket_schema: str, items):
        self.spark, self.schema, self.items = spark, ticket_schema, items
        self.snapshots = Snapshots(spark, root)

    def state(self) -> tuple[dict[str, DataFrame], dict]:
        """The tables and settings so far; empty tables and a state of its own before the first sync."""
        none = self.spark.createDataFrame([], self.schema)
        return self.snapshots.load() or ({"tickets": none, "projects": B.first_projects(none), "new_tickets": none.select("id")}, {"batch": -1, "status": "loginRequired", "unread": False, "sync_no": None})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        tables, settings = self.state()
        if batch_id <= settings["batch"]:
            return
        batch = batch.persist()
        try:
            # a list of sync numbers, not of their rows
            syncs = batch.filter("sync_no IS NOT NULL").groupBy("sync_no").agg(F.coalesce(F.bool_or("login"), F.lit(False)).alias("login"), F.count("*").alias("n")).orderBy("sync_no").collect()
            for n, s in enumerate(syncs):
                last = n == len(syncs) - 1
                tables, settings = self._apply(batch.filter(F.col("sync_no") == s["sync_no"]), s, tables, settings, batch_id if last else settings["batch"])
            if not syncs:
                self.snapshots.save(tables, {**settings, "batch": batch_id})
        finally:
            batch.unpersist()

    def _apply(self, rows: DataFrame, sync, tables: dict[str, DataFrame], settings: dict, batch: int):
        settings = {**settings, "batch": batch, "sync_no": sync["sync_no"]}
        if sync["login"]:
            settings["status"] = "loginRequired"
            self.snapshots.save(tables, settings)
            return self.snapshots.load()
        cached = tables["tickets"]
        parts = (sync["n"] + cached.count()) // PART + 1
        scratch = Tables(self.spark, "merged")
        merged = scratch.write(B.sync_applied(rows, cached, self.items(), parts))
        settings["status"] = "synced"
        new = merged.filter("is_new")
        if not new.isEmpty():
            tables, settings["unread"] = {**tables, "new_tickets": new.select("id")}, True
        self.snapshots.save({"tickets": merged.select(*cached.columns), "projects": B.first_projects(merged), "new_tickets": tables["new_tickets"]}, settings)
        scratch.store.delete("")
        return self.snapshots.load()


def merge_stream(rows: DataFrame, merge: SyncMerge, checkpoint: str):
    """Starts the merge over a streaming DataFrame of syncs and ends when all that is there is merged."""
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
