"""Streams: liveness with timers, merges that survive replay, bounded tails of many logs."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyboard.operators import board as B
from tallyboard.plans import stream_queries
from tallyboard.sources.snapshots import Snapshots
from tallyboard.streaming import liveness as L
from tallyboard.streaming import log_files, sync_merge
from tallyboard.streaming.sync_merge import SyncMerge, merge_stream

SIGN = "run_id string, kind string, worker_pid long, directory string, at timestamp"


def play(signs, until, limit=8000, grace=2000):
    """Status changes of one run by the two rules alone."""
    state, out = None, []
    for at, kind, pid, placed in signs:
        if state is not None:
            state, more = L.pass_time(state, at - 1, limit, grace)
            out += more
        state, more = L.sign(state, kind, pid, placed, at)
        out += more
    if state is not None:
        out += L.pass_time(state, until, limit, grace)[1]
    return out


@pytest.mark.parametrize(
    "signs, until, want",
    [
        ([(0, "start", 1, True)], 8000, [("running", False, 0)]),  # an age of exactly the limit is fresh
        ([(0, "start", 1, True)], 8001, [("running", False, 0), ("interrupted", False, 8001)]),
        ([(0, "start", 1, True)], 60_000, [("running", False, 0), ("interrupted", False, 8001), ("interrupted", True, 10_001)]),
        ([(0, "start", 1, True), (8000, "beat", 1, True), (16_000, "beat", 1, True)], 16_001, [("running", False, 0)]),
        ([(0, "start", 1, True), (9000, "beat", 1, True)], 9001, [("running", False, 0), ("interrupted", False, 8001), ("running", False, 9000)]),
        ([(0, "start", 1, True), (5000, "beat", 2, True)], 8001, [("running", False, 0), ("interrupted", False, 8001)]),  # another worker's
        ([(0, "start", 1, True), (30_000, "beat", 1, True)], 30_001, [("running", False, 0), ("interrupted", False, 8001), ("interrupted", True, 10_001)]),
        ([(0, "start", 1, True), (1000, "exit", 1, True), (1500, "beat", 1, True)], 4000, [("running", False, 0), ("interrupted", False, 1000), ("interrupted", True, 3000)]),
        ([(0, "start", 1, True), (1000, "exit", 1, True), (2000, "result", 1, True)], 9000, [("running", False, 0), ("interrupted", False, 1000), ("completed", False, 2000)]),
        ([(0, "start", 1, False), (1, "beat", 1, True)], 9000, [("interrupted", True, 0)]),  # a folder of another name
        ([(0, "beat", 1, True), (1, "result", 1, True)], 9000, []),  # nobody started it
        ([(0, "start", 1, True), (20_000, "start", 2, True)], 20_001, [("running", False, 0), ("interrupted", False, 8001), ("interrupted", True, 10_001), ("running", False, 20_000)]),
    ],
)
def test_liveness_rules(signs, until, want):
    assert play(signs, until) == want


def test_silence_is_noticed_without_input(spark, tmp_path):
    """The clock of the machine: nothing arrives after the first files, the timer fires all the same."""
    now = spark.sql("SELECT current_timestamp()").first()[0]
    rows = [("a", "start", 1, "a", now), ("b", "start", 1, "elsewhere", now), (None, "start", 1, "a", now), ("c", "beat", None, None, now), ("a", None, 1, "a", now)]
    spark.createDataFrame(rows, SIGN).coalesce(1).write.parquet(str(tmp_path / "in"))
    changes = L.watch(spark.readStream.schema(SIGN).parquet(str(tmp_path / "in")), limit=8.0, grace=2.0)
    q = changes.writeStream.format("memory").queryName("silence").outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("silence").filter("run_id = 'a' AND raised").count() == 0:
            time.sleep(0.5)
        got = sorted((r["run_id"], r["at"], r["status"], r["raised"]) for r in spark.table("silence").collect())
    finally:
        q.stop()
    assert [(r, s, x) for r, _, s, x in got] == [("a", "running", False), ("a", "interrupted", False), ("a", "interrupted", True), ("b", "interrupted", True)]
    times = [t for r, t, _, _ in got if r == "a"]
    assert abs((times[1] - times[0]).total_seconds() - 8.001) < 1e-6 and abs((times[2] - times[1]).total_seconds() - 2) < 1e-6


def test_parts_land_whole_in_many_files(spark, tmp_path):
    """Each part is one batch, in time, and no task writes a whole part."""
    rows = spark.range(0, 900, 1, 6).select(F.col("id").cast("string").alias("run_id"), F.timestamp_seconds("id").alias("at"))
    seen = []
    for n, stream in enumerate(stream_queries._in_order(rows, str(tmp_path))):
        batch = lambda b, i: seen.append((b.count(), b.agg(F.max(F.unix_seconds("at"))).first()[0]))
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        assert len([f for f in os.listdir(tmp_path / f"landed/{n}") if f.endswith(".parquet")]) > 1
    assert seen == [(300, 299), (300, 599), (300, 899)]


T = "id long, status string, project string"


def sync(spark, folder, no, rows, login=False):
    schema = f"sync_no int, login boolean, row_no long, {T}"
    data = [(no, login, k, *r) for k, r in enumerate(rows)]
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_merge_and_replay(spark, tmp_path):
    items = spark.createDataFrame([(2, 1, "runningAI"), (3, 1, "completed")], "ticket_id long, position long, stage string")
    merge = SyncMerge(spark, str(tmp_path / "state"), T, lambda: items)
    landed, ck = str(tmp_path / "in"), str(tmp_path / "ck")

    def run(*args, **kw):
        merge_stream(sync(spark, landed, *args, **kw), merge, ck).awaitTermination()
        tables, settings = merge.state()
        return {r["id"]: r["status"] for r in tables["tickets"].collect()}, {r["id"] for r in tables["new_tickets"].collect()}, settings

    tickets, new, settings = run(1, [(1, "新建", "p"), (2, "新建", "p"), (3, "新建", "q"), (1, "again", "p")])
    assert tickets == {1: "新建", 2: "新建", 3: "新建"} and new == {1, 2, 3} and settings["status"] == "synced"
    tickets, new, settings = run(2, [(1, "处理中", "p"), (4, "新建", "r")])  # 2 is active and stays, 3 has ended and goes
    assert tickets == {1: "处理中", 2: "新建", 4: "新建"} and new == {4} and settings["unread"]
    assert {r["project"] for r in merge.state()[0]["projects"].collect()} == {"p", "r"}
    tickets, new, settings = run(3, [(1, "待测试", "p")])  # no new one: the list of new tickets stays
    assert tickets == {1: "待测试", 2: "新建"} and new == {4}
    version = merge.snapshots.pointer()["version"]
    again = spark.createDataFrame([(9, False, 0, 77, "新建", "z")], f"sync_no int, login boolean, row_no long, {T}")
    merge(again, settings["batch"])  # a batch that Spark hands out again
    assert merge.snapshots.pointer()["version"] == version
    tickets, new, settings = run(4, [(None, None, None)], login=True)
    assert tickets == {1: "待测试", 2: "新建"} and settings["status"] == "loginRequired"
    tickets, new, settings = run(5, [(None, None, None)])  # signed in, no ticket: active ones stay
    assert tickets == {2: "新建"} and settings["status"] == "synced"


def test_merged_as_in_batch(spark, tmp_path):
    items = spark.range(40).selectExpr("id AS ticket_id", "id AS position", "if(id % 3 = 0, 'runningAI', 'failed') AS stage")
    t = spark.range(60).selectExpr("id", "'新建' AS status", "concat('p', id % 7) AS project")
    cached, synced = t.filter("id < 50"), t.filter("id % 4 <> 0")
    merge = SyncMerge(spark, str(tmp_path / "state"), T, lambda: items)
    for no, rows in ((1, cached), (2, synced)):
        merge(rows.select(F.lit(no).alias("sync_no"), F.lit(False).alias("login"), F.col("id").alias("row_no"), "*"), no)
    want = {r["id"] for r in B.sync_merged(synced, cached, items).collect()}
    assert {r["id"] for r in merge.state()[0]["tickets"].collect()} == want
    assert {r["id"] for r in merge.state()[0]["new_tickets"].collect()} == {r["id"] for r in B.sync_new(synced, cached).collect()}


def test_a_sync_is_merged_once_in_parts(spark, tmp_path, monkeypatch):
    """Parts grow with the tickets, whatever the session's partitions; one sort of one exchange; repeated, null and strange ids."""
    items = spark.range(50).selectExpr("if(id = 7, NULL, id + 30) AS ticket_id", "id AS position", "CASE WHEN id % 3 = 0 THEN 'runningAI' WHEN id % 3 = 1 THEN 'failed' END AS stage").union(spark.sql("SELECT 33L, 1L, 'failed'"))
    t = spark.range(60).selectExpr("id", "if(id % 5 = 0, NULL, '新建') AS status", "concat('p', id % 7) AS project")
    cached, rows = t.filter("id < 50"), t.filter("id % 4 <> 0").selectExpr("id AS row_no", "*").union(spark.sql("SELECT 99L, 1L, 'again', 'p'")).union(spark.sql("SELECT 1L, NULL, 'none', 'p'"))
    synced = B.first_per_key(rows.filter("id IS NOT NULL"), ["id"], ["row_no"]).select(*t.columns)
    out = B.sync_applied(rows, cached, items, 9)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan and out.rdd.getNumPartitions() == 9
    assert sorted(tuple(r) for r in out.drop("is_new").na.fill("-").collect()) == sorted(tuple(r) for r in B.sync_merged(synced, cached, items).na.fill("-").collect())
    assert {r["id"] for r in out.filter("is_new").collect()} == {r["id"] for r in B.sync_new(synced, cached).collect()}
    monkeypatch.setattr(sync_merge, "PART", 10)
    merge = SyncMerge(spark, str(tmp_path / "state"), T, lambda: items)
    merge(rows.selectExpr("1 AS sync_no", "false AS login", "*"), 0)
    folder = tmp_path / "state" / merge.snapshots.pointer()["folder"] / "tickets"
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 1
    assert sorted(r["id"] for r in merge.state()[0]["tickets"].collect()) == sorted(r["id"] for r in synced.collect())


def plain_lines(data: bytes, final: bool):
    out, at = [], 0
    parts = data.split(b"\n")
    for i, raw in enumerate(parts):
        last = i == len(parts) - 1
        at += len(raw) + (not last)
        text = raw if last else raw.removesuffix(b"\r")
        if text and (final or not last):
            out.append((text.decode("utf-8", "replace"), at))
    return out


def test_ranges_give_each_line_once(tmp_path):
    rng = random.Random(5)
    for _ in range(150):
        data = b"".join(rng.choice([b"a", b"\n", b"\r\n", "é".encode(), b"long line " * rng.randint(1, 40), b"\xff"]) for _ in range(rng.randint(0, 60)))
        for width in (1, 7, 64, 1 << 20):
            path = tmp_path / "x"
            path.write_bytes(data)
            with open(path, "rb") as f:
                got = [x for a in range(0, len(data), width) for x in log_files.lines_between(f, 0, a, min(a + width, len(data)), len(data))]
            assert got == plain_lines(data, True), (data, width)


def write(folder, run, data, mode="wb", ended=False):
    os.makedirs(f"{folder}/{run}", exist_ok=True)
    with open(f"{folder}/{run}/stdout.log", mode) as f:
        f.write(data)
    if ended:
        with open(f"{folder}/{run}/result.json", "w") as f:
            f.write("{}")


def test_bounded_batches_and_restart(spark, tmp_path):
    logs, rng = str(tmp_path / "logs"), random.Random(2)
    log_files.register(spark)
    data = {f"run{i}": b"".join(f"line {i} {k} {'x' * rng.randint(0, 60)}\n".encode() for k in range(400)) for i in range(3)}
    for run, d in data.items():
        write(logs, run, d + b"rest of ")
    options = {"path": logs, "progress": str(tmp_path / "progress.json"), "batch_bytes": "6000", "range_bytes": "500"}
    batches = []

    def keep(df, batch_id):
        batches.append([tuple(r) for r in df.collect()])

    def drain():
        q = spark.readStream.format("log_files").options(**options).load().writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def by_run():
        rows = [r for b in batches for r in b]
        assert len(rows) == len(set(rows))
        return {run: sorted(((t, o) for r, t, o in rows if r == run), key=lambda x: x[1]) for run in data}

    drain()
    assert by_run() == {run: plain_lines(d + b"rest of ", False) for run, d in data.items()}
    assert len(batches) > 8 and max(sum(len(t) for _, t, _ in b) for b in batches) <= 6000
    n = len(batches)
    write(logs, "run0", b"it\nmore\n", "ab")
    write(logs, "run1", b"the end", "ab", ended=True)
    drain()  # goes on from the checkpoint; the last line of a run that ended is given as it is
    want = {"run0": plain_lines(data["run0"] + b"rest of it\nmore\n", False), "run1": plain_lines(data["run1"] + b"rest of the end", True), "run2": plain_lines(data["run2"], False)}
    assert by_run() == want and len(batches) > n
    write(logs, "run2", b"short\n")  # cut: read anew from its start
    drain()
    assert [r for b in batches[n:] for r in b][-1] == ("run2", "short", 6)


def test_log_starts_where_a_recovery_says(tmp_path):
    write(str(tmp_path), "a", b"one\ntwo\nthree")
    tail = log_files.Tail({"path": str(tmp_path), "offsets": json.dumps({"a": 4})})
    end = tail.latestOffset()
    assert end == {"a": 8}
    assert [x for p in tail.partitions(tail.initialOffset(), end) for x in tail.read(p)] == [("a", "two", 8)]
    assert log_files.Tail({"path": str(tmp_path / "none")}).latestOffset() == {}
