"""Snapshots: strict documents with defaults, versioned saves, an append-only log folded in."""

import json

import pytest
from pyspark.sql import functions as F

from tallyboard.sources import snapshots as S
from tallyboard.sources.store import Store

U = "00000000-0000-0000-0000-00000000000{}"
TICKET = {"id": 1, "projectID": "p", "projectName": "P", "kind": "Bug", "priority": "高", "status": "新建", "title": "t", "description": "", "targetVersion": "v1", "updatedAt": "2024-01-02T03:04:05Z", "assignee": ""}
ITEM = {"id": U.format(1), "ticketID": 1, "provider": "Codex", "repositoryPath": "/r", "branch": "b", "helperContext": "", "stage": "AI 分析问题", "logs": [], "createdAt": "2024-01-02T03:04:05Z", "updatedAt": "2024-01-02T03:04:05Z"}
RUN = {"runID": U.format(2), "phase": "analysis", "runDirectory": "/d", "workerPID": 5, "startedAt": "2024-01-02T03:04:05Z", "lastOutputOffset": 12, "state": "running"}
BASE = {"tickets": [], "repositories": [], "workItems": [], "knowledgeBaseURL": "u?page=2", "defaultTestAssignee": ""}


def decoded(spark, *docs):
    texts = [d if isinstance(d, str) or d is None else json.dumps(d) for d in docs]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.decode(F.col("t")).alias("s"))
    return [r["s"] for r in rows.orderBy("i").collect()]


def test_defaults(spark):
    a, b, c, d = decoded(spark, BASE, {**BASE, "tickets": [TICKET]}, {**BASE, "hasAuthenticatedSession": False, "tickets": [TICKET], "syncIntervalHours": 5, "lastSyncedAt": "2024-01-02T03:04:05Z"}, {**BASE, "extra": 1})
    assert (a.syncIntervalHours, a.hasAuthenticatedSession, a.lastSyncedAt) == (2, False, None)
    assert b.hasAuthenticatedSession and b.tickets[0].sourceURL is None
    assert (c.syncIntervalHours, c.hasAuthenticatedSession) == (5, False) and c.lastSyncedAt.year == 2024 and d is not None


def test_items_with_and_without_execution(spark):
    old, new = decoded(spark, {**BASE, "workItems": [ITEM]}, {**BASE, "workItems": [{**ITEM, "execution": RUN}]})
    assert old.workItems[0].execution is None and new.workItems[0].execution.lastOutputOffset == 12


@pytest.mark.parametrize(
    "doc",
    [
        None, "", "{", "[]", "5", json.dumps(BASE)[:-3], json.dumps(BASE) + "x", {k: v for k, v in BASE.items() if k != "tickets"}, {**BASE, "tickets": None}, {**BASE, "tickets": [{**TICKET, "kind": "Other"}]},
        {**BASE, "tickets": [{**TICKET, "id": "1"}]}, {**BASE, "tickets": [TICKET, {**TICKET, "status": None}]}, {**BASE, "tickets": [None]}, {**BASE, "tickets": [{**TICKET, "updatedAt": "2024-01-02"}]},
        {**BASE, "tickets": [{**TICKET, "updatedAt": "2024-13-02T03:04:05Z"}]}, {**BASE, "workItems": [{**ITEM, "stage": "unknown"}]}, {**BASE, "workItems": [{**ITEM, "id": "x"}]},
        {**BASE, "workItems": [{**ITEM, "execution": {**RUN, "state": "odd"}}]}, {**BASE, "workItems": [{**ITEM, "logs": [{"id": U.format(3), "timestamp": "soon", "message": "", "level": "info"}]}]},
        {**BASE, "syncIntervalHours": "2"}, {**BASE, "lastSyncedAt": "yesterday"}, {**BASE, "repositories": [{"id": U.format(1)}]},
    ],
)
def test_one_bad_field_voids_the_document(spark, doc):
    assert decoded(spark, doc) == [None]


def test_a_start_without_and_with_a_state(spark):
    rows = spark.createDataFrame([(json.dumps({**BASE, "syncIntervalHours": 99}),), (json.dumps({**BASE, "tickets": [TICKET], "lastSyncedAt": "2024-01-02T03:04:05Z", "syncIntervalHours": 0}),), (None,), (json.dumps({**BASE, "hasAuthenticatedSession": True, "knowledgeBaseURL": "old"}),)], "t string")
    got = [r["s"] for r in rows.select(S.restored(S.decode(F.col("t")), "old", "new").alias("s")).collect()]
    assert [(g.status, g.hours, g.url) for g in got] == [("loginRequired", 8, "u"), ("synced", 1, "u"), ("loginRequired", 2, None), ("idle", 2, "new")]


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(BASE, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(BASE)[:40])
    got = {r["path"].rsplit("/")[-1]: r["state"] for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.json"] is not None and got["b.json"] is None


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, position long, stage string")


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, position long, stage string, sequence long")


def state(s):
    tables, settings = s.load()
    return {r["id"]: (r["position"], r["stage"]) for r in tables["items"].collect()}, settings


def test_versions_and_the_log(spark, tmp_path):
    s = S.Snapshots(spark, str(tmp_path / "s"), {"items": ["id"]})
    assert s.load() is None
    with pytest.raises(ValueError):
        s.compact()
    assert s.save({"items": items(spark, (1, 1, "a"), (2, 2, "a"))}, {"hours": 2}) == 1
    s.append("items", changes(spark, (2, 99, "b", 1), (3, 3, "b", 1)))
    s.append("items", changes(spark, (3, 98, "c", 1)))
    want = {1: (1, "a"), 2: (2, "b"), 3: (3, "c")}  # the place of the first insert stays
    assert state(s) == (want, {"hours": 2})
    assert s.compact(keep=0) == 2 and state(s) == (want, {"hours": 2}) and s.log() == []
    assert len([n for n in s.store.names() if n.startswith("v-")]) == 1
    assert s.append("items", changes(spark, (1, 1, "d", 1))) == 3 and state(s)[0][1] == (1, "d")
    s.save({"items": items(spark)}, {"hours": 3}, log_upto=3)
    assert state(s) == ({}, {"hours": 3})


def test_torn_saves_are_not_read(spark, tmp_path):
    root = str(tmp_path / "s")
    s = S.Snapshots(spark, root, {"items": ["id"]})
    s.save({"items": items(spark, (1, 1, "a"))}, {})
    items(spark, (9, 9, "z")).write.parquet(f"{root}/v-000000000002-cut/items")  # no pointer names it
    items(spark, (9, 9, "z")).write.parquet(f"{root}/.log-cut")  # not renamed into place
    assert state(s)[0] == {1: (1, "a")}
    for broken in ("", "{", '{"version": "x"}', "[]"):
        Store(spark, root).replace(S.POINTER, broken)
        assert s.load() is None


def test_control_files(spark, tmp_path):
    s = Store(spark, str(tmp_path / "c"))
    assert s.read("x") is None and s.names() == []
    assert s.create("x", "é") and not s.create("x", "other") and s.read("x") == "é"
    s.replace("x", "new")
    assert s.read("x") == "new" and s.names() == ["x"]
