"""Board queries: active items, views, filters, search, order, counts; and sync with cached rows.

Nulls: a null stage is no stage and never active; a null status, kind or text fits no filter; null ids
join with nothing. Where rows tie the lowest id or position wins. Empty tables give empty results,
and counts of 0. Repeated rows are kept, but keys that are looked up count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def active_items(items: DataFrame) -> DataFrame:
    """(ticket_id, active_stage): the last item by position that has not ended."""
    return items.filter(~F.col("stage").isin(*S.ENDED)).groupBy("ticket_id").agg(F.max_by("stage", "position").alias("active_stage"))


def detail_items(items: DataFrame) -> DataFrame:
    """(ticket_id, stage): the active item's stage, else that of the last item of any."""
    live = ~F.col("stage").isin(*S.ENDED)
    return items.groupBy("ticket_id").agg(F.coalesce(F.max_by(F.when(live, F.col("stage")), F.when(live, F.col("position"))), F.max_by("stage", "position")).alias("detail_stage"))


def with_active(tickets: DataFrame, items: DataFrame) -> DataFrame:
    a = active_items(items).withColumnRenamed("ticket_id", "a_id")
    return tickets.join(a, F.col("id") == F.col("a_id"), "left").drop("a_id")


@dataclass(frozen=True)
class BoardQuery:
    """What the board shows; unset parameters filter nothing."""

    view: str = "all"
    project: str | None = None
    text: str = ""
    kind: str | None = None
    priority: str | None = None
    status: str | None = None
    version: str | None = None
    sort: str = "priority"

    @property
    def filters_empty(self) -> bool:
        """Whether no filter of a ticket's own fields is set; the search text is none of them."""
        return self.kind is None and self.priority is None and self.status is None and self.version is None

    def run(self, tickets: DataFrame, items: DataFrame) -> DataFrame:
        t = tickets
        for name in ("project", "kind", "priority", "status", "version"):
            value = getattr(self, name)
            t = t if value is None else t.filter(F.col(name) == value)
        if self.text:
            t = t.filter(matches(F.concat_ws(" ", "id", "title", "description"), self.text))
        return self.order(self.in_view(t, items))

    def in_view(self, t: DataFrame, items: DataFrame) -> DataFrame:
        if self.view == "all":
            return t
        if self.view == "completed":
            done = items.filter("stage = 'completed'").select(F.col("ticket_id").alias("d_id")).distinct()
            return t.join(done, F.col("id") == F.col("d_id"), "left").filter("d_id IS NOT NULL OR status = '已完成'").drop("d_id")
        waits = F.col("active_stage").isin(*S.APPROVAL)
        t = with_active(t, items)
        if self.view == "approval":
            return t.filter(waits).drop("active_stage")
        if self.view == "processing":
            return t.filter((F.col("active_stage").isNotNull() & ~waits) | (F.col("active_stage").isNull() & (F.col("status") == "处理中"))).drop("active_stage")
        return t.limit(0)

    def order(self, t: DataFrame) -> DataFrame:
        rank = S.rank(F.col("priority"))
        keys = {"priority": [rank, F.desc("updated_at")], "updated": [F.desc("updated_at")], "version": [F.desc("version"), rank]}[self.sort]
        return t.orderBy(*keys, "id")


def matches(hay, text: str):
    """Case- and accent-insensitive substring."""
    return F.contains(F.collate(hay, "UNICODE_CI_AI"), F.collate(F.lit(text), "UNICODE_CI_AI"))


def display_status(tickets: DataFrame, items: DataFrame) -> DataFrame:
    busy = F.col("active_stage").isNotNull() & ~F.col("active_stage").isin(*S.APPROVAL)
    return with_active(tickets, items).select("id", F.when(busy, "处理中").otherwise(F.col("status")).alias("display_status"))


def first_projects(tickets: DataFrame) -> DataFrame:
    """One row a project, from the ticket first seen (lowest id)."""
    p = tickets.groupBy("project").agg(F.min("id").alias("first_id"), F.count("*").alias("n_tickets"))
    return p.withColumn("symbol", S.symbol(F.col("project")))


def view_counts(tickets: DataFrame, items: DataFrame) -> DataFrame:
    """Badges: tickets being processed; work items awaiting approval and completed."""
    a = BoardQuery(view="processing").in_view(tickets, items).agg(F.count("*").alias("processing"))
    b = items.agg(F.count_if(F.col("stage").isin(*S.APPROVAL)).alias("approval"), F.count_if(F.col("stage") == "completed").alias("completed"))
    return a.crossJoin(b)  # one row by one row


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first by ``order``; a minimum adds up within tasks before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}") for c in rest]).select(*rows.columns)


def sync_new(synced: DataFrame, cached: DataFrame) -> DataFrame:
    return synced.join(cached.select("id"), "id", "left_anti")


def sync_retained(synced: DataFrame, cached: DataFrame, items: DataFrame) -> DataFrame:
    """Cached rows that the sync no longer has but that still have an active item."""
    live = active_items(items).select(F.col("ticket_id").alias("id"))
    return cached.join(synced.select("id"), "id", "left_anti").join(live, "id", "left_semi")


def sync_merged(synced: DataFrame, cached: DataFrame, items: DataFrame) -> DataFrame:
    return synced.unionByName(sync_retained(synced, cached, items))


def sync_applied(rows: DataFrame, cached: DataFrame, items: DataFrame, parts: int) -> DataFrame:
    """(columns of ``cached``, is_new): ``sync_merged`` of the first row an id by ``row_no``, and which of them are ``sync_new``.

    ``cached`` has one row an id. Rows, cached rows and the ids of active items are dealt into ``parts`` by id and
    grouped there, so that a task sorts its part once, however large the files or the session's partitions are.
    """
    columns = [c for c in cached.columns if c != "id"]
    row, kind, none = F.struct(*columns).alias("row"), cached.schema["id"].dataType, F.lit(None)
    came = rows.select("id", row, F.struct("row_no").alias("place"), F.lit(False).alias("live"))
    was = cached.select("id", row, none.cast(came.schema["place"].dataType).alias("place"), F.lit(False).alias("live"))
    live = items.filter(~F.col("stage").isin(*S.ENDED)).select(F.col("ticket_id").cast(kind).alias("id"), none.cast(came.schema["row"].dataType).alias("row"), none.cast(came.schema["place"].dataType).alias("place"), F.lit(True).alias("live"))
    every = came.unionByName(was).unionByName(live).filter("id IS NOT NULL").repartition(parts, "id")
    had = F.max(F.when(F.col("place").isNull(), F.col("row"))).alias("had")
    d = every.groupBy("id").agg(F.min_by("row", "place").alias("got"), had, F.bool_or("live").alias("live"))
    kept = F.coalesce("got", F.when(F.col("live"), F.col("had"))).alias("row")
    d = d.select("id", kept, (F.col("got").isNotNull() & F.col("had").isNull()).alias("is_new")).filter("row IS NOT NULL")
    return d.select(*["id" if c == "id" else f"row.{c}" for c in cached.columns], "is_new")


def enriched(tickets: DataFrame, details: DataFrame) -> DataFrame:
    """Tickets with what their own pages say: ``details`` has id, ok, description and author.

    A page that failed (``ok`` is not true) changes nothing. A description is taken as it is, '' where
    the page has none; an author only where the list has none. Of several pages of a ticket the
    first by description and author counts; null ids match nothing.
    """
    d = details.filter(F.col("ok")).groupBy(F.col("id").alias("d_id")).agg(F.min(F.struct(F.coalesce("description", F.lit("")).alias("description"), F.coalesce("author", F.lit("")).alias("author"))).alias("d"))
    t = tickets.join(d, F.col("id") == F.col("d_id"), "left")
    author = S.blank_to(F.col("author"), F.coalesce(F.nullif("d.author", F.lit("")), F.col("author")))
    return t.withColumn("description", F.coalesce("d.description", "description")).withColumn("author", author).drop("d_id", "d")


def reselected(selected: DataFrame, tickets: DataFrame) -> DataFrame:
    """Each selection (viewer, id) with the ticket that it means now; null where that is gone or nothing was selected."""
    mine = selected.select("viewer", F.col("id").alias("s_id"))
    kept = tickets.select(F.struct(*[F.col(c) for c in tickets.columns]).alias("ticket"), F.col("id").alias("t_id"))
    return mine.join(kept, F.col("s_id") == F.col("t_id"), "left").select("viewer", "s_id", "ticket")


def titles(views: DataFrame, projects: DataFrame) -> DataFrame:
    """``views`` (viewer, project, label) with the title shown: the selected project's name, else the view's label."""
    p = projects.select(F.col("project").alias("p_project"), F.col("project").alias("p_name")).distinct()
    return views.join(p, F.col("project") == F.col("p_project"), "left").select("viewer", F.coalesce("p_name", "label").alias("title"))


def solvable(tickets: DataFrame) -> DataFrame:
    """Tickets that may be solved: those that do not wait for tests."""
    return tickets.filter(F.col("status") != "待测试")


def sync_totals(synced: DataFrame, cached: DataFrame, unread: bool = False) -> DataFrame:
    """One row (n_tickets, n_new, unread, needs_login): the counts of a sync; unread news stay unread.

    ``cached`` are the tickets before; one must sign in where there are none after it either.
    """
    new = sync_new(synced, cached).agg(F.count("*").alias("n_new"))
    return synced.agg(F.count("*").alias("n_tickets")).crossJoin(new).select("n_tickets", "n_new", ((F.col("n_new") > 0) | F.lit(unread)).alias("unread"), (F.col("n_tickets") == 0).alias("needs_login"))  # one row by one row


def upsert(rows: DataFrame, changes: DataFrame, key: list[str], sequence: str = "sequence") -> DataFrame:
    """Changes replace rows of their key in place: ``position`` stays that of the first insert.

    Of several changes of a key the last by ``sequence`` counts; the first gives the place of a new
    key. Rows without a change are
    passed on as they are: only the keys of the changes are grouped.
    """
    columns = [c for c in rows.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in columns]), sequence).alias("_c"), F.min_by("position", sequence).alias("_first"))
    known = rows.groupBy(*key).agg(F.min("position").alias("_position")).join(last.select(*key), key, "left_semi")
    new = last.join(known, key, "left").select(*key, *[F.coalesce("_position", "_first").alias(c) if c == "position" else F.col(f"_c.{c}") for c in columns])
    return rows.join(last.select(*key), key, "left_anti").unionByName(new.select(*rows.columns))


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def delivered(tickets: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Delivered tickets wait for tests; the assignee changes only to a non-blank one."""
    d = deliveries.select(F.col("id").alias("d_id"), F.col("assignee").alias("d_assignee"))
    t = tickets.join(d, F.col("id") == F.col("d_id"), "left")
    new = S.blank_to(F.col("d_assignee"), F.col("assignee"))
    return t.withColumn("status", F.when(F.col("d_id").isNotNull(), "待测试").otherwise(F.col("status"))).withColumn("assignee", F.when(F.col("d_id").isNotNull(), new).otherwise(F.col("assignee"))).drop("d_id", "d_assignee")
