"""The rules of the board and of jobs on a few rows: orders, views, searches, nulls, ties, repeats and empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallyboard.functions import prompts as P
from tallyboard.operators import board as B
from tallyboard.operators import jobs as J
from tallyboard.sources import samples

NOW = "2024-01-10 12:00:00"
ITEM = "ticket_id long, position long, stage string"


@pytest.fixture(scope="module")
def sample(spark):
    return samples.tickets(spark, NOW)


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def test_orders(spark, sample):
    none = spark.createDataFrame([], ITEM)
    rank = {"紧急": 0, "高": 1, "普通": 2}
    rows = samples.ROWS
    by = {
        "priority": sorted(rows, key=lambda r: (rank[r[2]], r[5], r[0])), "updated": sorted(rows, key=lambda r: (r[5], r[0])),
        "version": sorted(sorted(rows, key=lambda r: (rank[r[2]], r[0])), key=lambda r: r[4], reverse=True),
    }
    for sort, want in by.items():
        assert ids(B.BoardQuery(sort=sort).run(sample, none)) == [r[0] for r in want], sort
    texts = sample.withColumn("version", F.when(F.col("id") % 2 == 0, "v3.10.0").otherwise("v3.8.0"))
    assert [i % 2 for i in ids(B.BoardQuery(sort="version").run(texts, none))] == [1] * 4 + [0] * 5  # as text, not as numbers


def test_search_and_project(spark, sample):
    none = spark.createDataFrame([], ITEM)
    assert ids(B.BoardQuery(text="18424", project="ops").run(sample, none)) == [18424]
    assert ids(B.BoardQuery(text="#18424").run(sample, none)) == []
    assert len(ids(B.BoardQuery(text="BÙG of").run(sample, none))) == 5
    assert ids(B.BoardQuery(project="other").run(sample, none)) == [] and len(ids(B.BoardQuery(text="").run(sample, none))) == 9
    assert ids(B.BoardQuery(kind="Bug", priority="高", status="新建", version="v3.8.0").run(sample, none)) == [18423]
    assert ids(B.BoardQuery(view="settings").run(sample, none)) == []
    assert B.BoardQuery(text="x", project="p").filters_empty and not B.BoardQuery(kind="Bug").filters_empty


def test_views_and_counts(spark, sample):
    items = spark.createDataFrame([(18426, 1, "completed"), (18426, 2, "runningAI"), (18425, 1, "awaitingApproval"), (18425, 0, "awaitingPlanApproval"), (18424, 1, "partial"), (18421, 1, "awaitingPlanApproval"), (18420, 1, "failed"), (18419, 3, None), (None, 1, "runningAI")], ITEM)
    view = lambda v: sorted(ids(B.BoardQuery(view=v).run(sample, items)))
    assert view("processing") == [18424, 18426] and view("approval") == [18421, 18425] and view("completed") == [18426]
    assert tuple(B.view_counts(sample, items).first()) == (2, 3, 1)  # items, not tickets, wait for approval
    shown = {r["id"]: r["display_status"] for r in B.display_status(sample, items).collect()}
    assert (shown[18426], shown[18425], shown[18421]) == ("处理中", "新建", "处理中")
    detail = {r["ticket_id"]: r["detail_stage"] for r in B.detail_items(items).collect()}
    assert (detail[18426], detail[18420], detail[18419]) == ("runningAI", "failed", None)
    assert tuple(B.view_counts(sample.limit(0), items.limit(0)).first()) == (0, 0, 0)


def test_sync_keeps_what_is_worked_on(spark, sample):
    cached, synced = sample.filter("id IN (18426, 18425)"), sample.filter("id = 18422")
    items = spark.createDataFrame([(18426, 1, "runningAI")], ITEM)
    merged = B.sync_merged(synced, cached, items)
    assert sorted(ids(merged)) == [18422, 18426] and ids(B.BoardQuery(view="processing").run(merged, items)) == [18426]
    assert tuple(B.sync_totals(synced, cached).first()) == (1, 1, True, False)
    assert tuple(B.sync_totals(cached.limit(0), cached, True).first()) == (0, 0, True, True)
    assert sorted(ids(B.sync_merged(synced.limit(0), cached, items))) == [18426]


def test_details_of_tickets(spark, sample):
    pages = spark.createDataFrame([(18426, True, "d", "a"), (18426, True, "e", "b"), (18425, False, "d", "a"), (18424, None, "d", "a"), (18423, True, None, ""), (None, True, "d", "a")], "id long, ok boolean, description string, author string")
    got = {r["id"]: (r["description"], r["author"]) for r in B.enriched(sample.withColumn("author", F.when(F.col("id") == 18423, "own").otherwise(" ")), pages).collect()}
    assert len(got) == 9 and got[18426] == ("d", "a") and got[18425] == ("需求 of the sample", " ") and got[18424][0] == "Bug of the sample" and got[18423] == ("", "own")


def test_selection_and_titles(spark, sample):
    seen = {r["viewer"]: r["ticket"] for r in B.reselected(spark.createDataFrame([("a", 18426), ("b", 1), ("c", None)], "viewer string, id long"), sample).collect()}
    assert seen["a"]["kind"] == "Bug" and seen["b"] is None and seen["c"] is None
    views = spark.createDataFrame([("a", "ops", "x"), ("b", "gone", "y"), ("c", None, "z")], "viewer string, project string, label string")
    assert {r["viewer"]: r["title"] for r in B.titles(views, B.first_projects(sample)).collect()} == {"a": "ops", "b": "y", "c": "z"}
    assert len(ids(B.solvable(B.delivered(sample, spark.createDataFrame([(18426, "t"), (18425, "")], "id long, assignee string"))))) == 7


def test_upserts(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (2, 5, "b")], "id long, position long, stage string")
    changes = spark.createDataFrame([(2, 9, "x", 1), (2, 8, "y", 2), (3, 7, "p", 1), (3, 6, "q", 2)], "id long, position long, stage string, sequence long")
    assert sorted(map(tuple, B.upsert(rows, changes, ["id"]).collect())) == [(1, 1, "a"), (2, 2, "y"), (3, 7, "q")]
    assert sorted(map(tuple, B.upsert(rows, changes.limit(0), ["id"]).collect())) == [(1, 1, "a"), (2, 2, "a"), (2, 5, "b")]
    assert sorted(map(tuple, B.delete(rows, rows.filter("id = 2").select("id"), ["id"]).collect())) == [(1, 1, "a")]


def test_probe_texts_and_lines(spark):
    rows = [("true\n", "", "b\n", "r\n", None), (" true ", " M x", "b", None, None), ("false", "", "b", "r", None), (None, None, None, None, None), ("true", "", "", "", "no such folder")]
    d = spark.createDataFrame(rows, "i string, p string, b string, r string, e string")
    got = [tuple(r["s"]) for r in d.select(J.repository_state(*[F.col(c) for c in "ipbre"]).alias("s")).collect()]
    assert got == [(True, True, "b", "r", J.CLEAN), (True, False, "b", "", J.DIRTY), *[(False, False, "", "", J.NO_REPOSITORY)] * 2, (False, False, "", "", "no such folder")]
    d = spark.createDataFrame([("", ["a", "", "b"]), ("x", [""]), ("x", ["a"]), (None, [None, "a"]), ("x", [])], "t string, m array<string>")
    assert [r["o"] for r in d.select(J.with_lines(F.col("t"), F.col("m")).alias("o")).collect()] == ["a\nb", "x", "x\na", "a", "x"]


def test_prompts(spark):
    d = spark.createDataFrame([(7, "p", "Bug", "高", "t {title}", "d", "", ""), (8, "p", "Bug", "高", None, "d", "look here", "do it")], "id long, project string, kind string, priority string, title string, description string, helper string, plan string")
    ticket = {c: F.col(c) for c in ("id", "project", "kind", "priority", "title", "description")}
    rows = d.select(P.prompt(ticket, F.col("helper"), "W", "X_").alias("a"), P.prompt(ticket, F.col("helper"), "W", "X_", F.col("plan")).alias("c")).collect()
    a, c = rows[0]["a"], rows[1]["c"]
    assert "标题：t {title}\n" in a and "#7" in a and P.NO_HELPER in a and "X_ROOT_CAUSE:" in a and "只读" in a and "通过 W 工作台" in a
    assert "标题：\n" in c and "look here\n" in c and "do it\n" in c and "X_SUMMARY:" in c and P.NO_PLAN in rows[0]["c"] and P.NO_PLAN not in c
    assert all("git push" in x for r in rows for x in r)


def test_empty_tables(spark):
    runs = spark.createDataFrame([], "run_id string, worker_pid long, directory string, started_at timestamp, alive boolean")
    beats, results = spark.createDataFrame([], "run_id string, worker_pid long, updated_at timestamp"), spark.createDataFrame([], "run_id string")
    assert J.inspect(runs, beats, results, F.current_timestamp()).count() == 0
    repos = spark.createDataFrame([], "position long, project string, path string, is_default boolean, branch string, remote string")
    assert J.import_repositories(repos.select("position", "project", "path", "is_default"), repos.select("position", "project", "path")).count() == 0
    assert J.refresh_branch(repos, spark.createDataFrame([], "path string, branch string, sequence long")).count() == 0
    assert J.repository_of_path(repos.select("path"), repos).count() == 0


def test_ties_take_the_lowest_position(spark):
    repos = spark.createDataFrame([(p, "x", path, False, "main", r) for p, path, r in [(3, "a", "three"), (1, "a", "one"), (2, "a", None)]], "position long, project string, path string, is_default boolean, branch string, remote string")
    for rows in itertools.permutations(repos.collect()):
        got = J.repository_of_path(spark.createDataFrame([("a",), ("b",), (None,)], "path string"), spark.createDataFrame(rows, repos.schema)).collect()
        assert {r["path"]: r["remote"] for r in got} == {"a": "one", "b": "origin", None: "origin"}
        break
    new = J.import_repositories(repos.filter("false").select("position", "project", "path", "is_default"), repos.select("position", "project", "path"))
    assert [(r["position"], r["is_default"]) for r in new.orderBy("position").collect()] == [(1, True), (2, False), (3, False)]
