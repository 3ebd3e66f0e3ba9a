"""Job event folds, page walks, chunked lines, recovery, control files and single flight, against plain versions."""

import datetime
import json
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from tallyboard.operators import chunk_lines as C
from tallyboard.operators import events as E
from tallyboard.operators import job_events as V
from tallyboard.operators import jobs as J
from tallyboard.operators import recovery as R
from tallyboard.plans import state_queries
from tallyboard.sources import control_files as K
from tallyboard.sources import issue_pages as I
from tallyboard.sources import page_walk as W
from tallyboard.streaming import single_flight as X

EVENT = "item_id string, seq long, at timestamp, action string, message string"


def plain_fold(rows):
    out, stage = [], ""
    for seq, action, message in sorted(rows):
        allowed, to, _, _ = V.ACTIONS.get(action, ((), None, None, None))
        ok = stage in allowed or (allowed == V.ANY and stage != "")
        new = to if ok else stage
        out.append((seq, action, stage, new, not ok))
        stage = new
    return out


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_fold_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng, names = random.Random(block), list(V.ACTIONS)
    items = {"hot": 120, "b": 7, "c": 1, "d": 30}
    data = {k: [(i * (2 if k == "d" else 1), rng.choice([names[i % 11], rng.choice(names), "nonsense"]), f"m{i % 2}") for i in range(n)] for k, n in items.items()}
    rows = [(k, s, None, a, m) for k, es in data.items() for s, a, m in es]
    rng.shuffle(rows)
    folded = V.fold(spark.createDataFrame([*rows, *rows[:20], (None, 1, None, "start", ""), ("z", None, None, "start", "")], EVENT)).cache()
    got = folded.collect()
    assert len(got) == sum(items.values())
    for k, es in data.items():
        assert sorted((r["seq"], r["action"], r["previous"], r["stage"], r["refused"]) for r in got if r["item_id"] == k) == plain_fold(es)
    final = {r["item_id"]: r for r in V.states(folded).collect()}
    for k, es in data.items():
        plain = plain_fold(es)
        done = [x for x in plain if not x[4]]
        assert final[k]["stage"] == (done[-1][3] if done else "") and final[k]["n_refused"] == sum(x[4] for x in plain)
    kept = sorted((r["item_id"], r["seq"]) for r in V.logs(folded).collect())
    want = []
    for k, es in data.items():
        last = None
        for (seq, action, _, _, refused), (_, _, message) in zip(plain_fold(es), sorted(es)):
            if not refused:
                if not (action == "interrupt" and last == message):
                    want.append((k, seq))
                last = message
    assert kept == sorted(want)


def test_first_blocks_follow_one_stage(spark):
    """An item of one block is not tried at every stage; numbers below 0 belong to its first block."""
    e = spark.createDataFrame([(-1, "start"), (0, "checked"), (1, "analysed")], "seq long, n string")
    assert {r[0] for r in e.select(V._block(F.col("seq"))).collect()} == {0}
    does = e.agg(V._composed(F.array(F.lit(1), F.lit(2)), F.lit(0), lambda m, s: m + s), V._composed(F.array(F.lit(1)), F.lit(1), lambda m, s: m + s)).first()
    assert does[0] == [3] and does[1] == [i + 1 for i in range(len(V.STAGES))]
    rows = [("a", s, None, a, "m") for s, a in ((-1, "start"), (0, "checked"), (1, "analysed"))]
    assert [r["stage"] for r in V.fold(spark.createDataFrame(rows, EVENT)).orderBy("seq").collect()] == ["preparing", "analyzing", "awaitingPlanApproval"]


@pytest.mark.parametrize("block", [3, 1024])
def test_states_without_rows_of_events(spark, monkeypatch, block):
    """The states that the folded rows give, from one row a block; no event becomes a row again."""
    monkeypatch.setattr(V, "BLOCK", block)
    rng, names = random.Random(block), list(V.ACTIONS)
    actions = lambda i: rng.choice([names[i % 11], rng.choice(names), "nonsense", None])
    rows = [(k, i - (k == "neg"), rng.choice([None, datetime.datetime(2024, 1, rng.randint(1, 28))]), actions(i), rng.choice([None, "m", "n"])) for k, n in {"hot": 60, "neg": 9, "one": 1, "b": 25}.items() for i in range(n)]
    rows += [*rows[:7], ("none", 0, None, "cancel", "x"), (None, 1, None, "start", ""), ("z", None, None, "start", "")]
    events = spark.createDataFrame(rows, EVENT)
    got = V.states_of(events)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString() or block == 3  # only the entries of later blocks
    want = V.states(V.fold(events))
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_effects_of_events(spark):
    def state(*actions):
        rows = [("a", i, None, a, f"said {i}") for i, a in enumerate(actions)]
        return V.states(V.fold(spark.createDataFrame(rows, EVENT))).first()

    r = state("start", "checked", "interrupt")
    assert (r["stage"], r["error"], r["execution_state"]) == ("interrupted", "said 2", "interrupted")
    r = state("start", "checked", "interrupt", "recover_analysis")
    assert (r["stage"], r["error"], r["execution_state"]) == ("analyzing", None, "reconnecting")
    r = state("start", "checked", "analysed", "approve_plan")
    assert (r["stage"], r["execution_state"]) == ("runningAI", None)
    r = state("cancel", "deliver")
    assert (r["stage"], r["error"], r["n_refused"]) == ("", None, 2)
    assert V.fold(spark.createDataFrame([], EVENT)).count() == 0


PAGE = "scan_id long, url string, next_url string, page_no long, login boolean, ok boolean, rows array<struct<id long, subject string>>"


def walked(spark, pages, starts, **kw):
    p = spark.createDataFrame([(s, u, n, no, login, ok, [(i, f"t{i}") for i in ids]) for s, u, n, no, login, ok, ids in pages], PAGE)
    w = W.walk(p, spark.createDataFrame(starts, "scan_id long, url string"), **kw)
    o = W.outcomes(p, w)
    at = {}
    for r in w.collect():
        at.setdefault(r["scan_id"], {})[r["at"]] = r["url"]
    ends = {r["scan_id"]: (r["status"], r["n_pages"]) for r in o.collect()}
    rows = sorted((r["scan_id"], r["at"], r["id"]) for r in W.scan_rows(p, w, o).collect())
    return {s: [u for _, u in sorted(us.items())] for s, us in at.items()}, ends, rows


def test_walk_in_any_order_of_landing(spark):
    rng = random.Random(1)
    chain = [(1, f"u{i}", f"u{i + 1}" if i < 36 else None, rng.random() * 1000, False, True, [i, 1000]) for i in range(37)]
    pages = [(s, u, n, int(no), lg, ok, ids) for s, u, n, no, lg, ok, ids in chain]
    pages += [(2, "a", "b", 9, False, True, [1]), (2, "b", "a", 3, False, True, [2]), (2, "x", "a", 1, False, True, [3])]  # comes back; x is not reached
    pages += [(3, "a", "b", 1, False, True, [1]), (3, "b", None, 2, True, True, [2])]  # a sign-in page on the way
    pages += [(4, "a", "b", 1, False, True, [1]), (4, "b", "c", 2, False, False, [2])]  # a page that did not load
    pages += [(5, "a", "gone", 1, False, False, [1])]  # the first page is there; the next never landed
    pages += [(6, "a", None, 2, False, True, [7, 7, 0]), (6, "a", "b", 5, False, True, [8])]  # landed twice: the lower number counts
    pages += [(7, "a", None, 1, True, True, [1])]
    rng.shuffle(pages)
    at, ends, rows = walked(spark, pages, [(s, "u0" if s == 1 else "a") for s in range(1, 8)] + [(None, "a")])
    assert at[1] == [f"u{i}" for i in range(37)] and at[2] == ["a", "b"]
    assert ends == {1: ("read", 37), 2: ("read", 2), 3: ("loginRequired", 1), 4: ("failed", 1), 5: ("failed", 1), 6: ("read", 1), 7: ("loginRequired", 0)}
    assert [r for r in rows if r[0] == 1] == sorted([(1, i, i) for i in range(1, 37)] + [(1, 0, 1000)])
    assert [r for r in rows if r[0] != 1] == [(2, 0, 1), (2, 1, 2), (6, 0, 7)]


def test_walk_stops_at_its_limit(spark):
    pages = [(1, f"u{i}", f"u{i + 1}", i, False, True, [i]) for i in range(30)]
    at, ends, _ = walked(spark, pages, [(1, "u0")], most_pages=10)
    assert len(at[1]) == 10 and ends[1] == ("read", 10)
    assert walked(spark, [], [(1, "u0")])[0] == {1: ["u0"]}


def test_walk_has_no_limit_of_its_own(spark):
    """a scan of more than 200 pages is walked to its end, also where its last page links back, and a missing page beyond 200 is seen."""
    link = lambda i, n, back=None: f"u{i + 1}" if i + 1 < n else back
    pages = [(1, f"u{i}", link(i, 450), i, False, True, [i + 1]) for i in range(450)]
    pages += [(2, f"u{i}", link(i, 300, "u297"), 1000 - i, False, True, [i + 1, 1]) for i in range(300)]
    pages += [(3, f"u{i}", f"u{i + 1}", i, False, True, [i + 1]) for i in range(260)]  # page 260 never landed
    pages += [(4, f"u{i}", link(i, 400), i, i == 390, True, [i + 1]) for i in range(400)]
    random.Random(2).shuffle(pages)
    at, ends, rows = walked(spark, pages, [(s, "u0") for s in range(1, 5)])
    assert at[1] == [f"u{i}" for i in range(450)] and at[2] == [f"u{i}" for i in range(300)]
    assert ends == {1: ("read", 450), 2: ("read", 300), 3: ("failed", 260), 4: ("loginRequired", 390)}
    assert rows == [(1, i, i + 1) for i in range(450)] + [(2, i, i + 1) for i in range(300)]


def long_scans(folder):
    """Orders of four scans of 250 pages each, one order a page, but for a fifth whose page 230 is missing."""
    import duckdb

    keys = "SELECT 800 * p + s AS o_orderkey FROM range(250) a(p), (VALUES (0), (1), (3), (7), (12)) b(s) WHERE NOT (s = 12 AND p = 230)"
    duckdb.sql(f"COPY (SELECT o_orderkey, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus FROM ({keys})) TO '{folder}/orders.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    return c


def test_scan_outcomes_of_long_scans(spark, tmp_path):
    """how scans of more than 200 pages end."""
    sql = long_scans(tmp_path).execute(state_queries.STATE_ORACLE_SQL["scan_outcomes"]).fetchall()
    got = [tuple(r) for r in state_queries.scan_outcomes(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(sql) == [(0, "read", 250), (1, "read", 250), (3, "loginRequired", 1), (7, "failed", 2), (12, "failed", 230)]


def test_scan_tickets_of_long_scans(spark, tmp_path):
    """the tickets of all pages of scans of more than 200 pages."""
    duck, cols = long_scans(tmp_path), ["scan_id", "at", "id", "subject", "priority"]
    sql = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({state_queries.STATE_ORACLE_SQL['scan_tickets']})").fetchall()
    got = [tuple(r) for r in state_queries.scan_tickets(spark, str(tmp_path)).select(*cols).collect()]
    assert sorted(got) == sorted(sql) == [(s, p, 800 * p + s, f"order {800 * p + s}", "1-URGENT") for s in (0, 1) for p in range(250) if p or s]


def test_links_without_rows(spark):
    """Links and sign-in pages are read without the rows, and columns are passed on, as the walk needs them."""
    row = "<table class=issues><tbody><tr><td class=id>7</td><td class=subject><a href=/i/7>x</a></td></tr></tbody></table>"
    pages = [(1, "https://t/a", row + "<a rel=next href='?page=2'>n</a>", 5), (2, "https://t/login", row, 6), (3, None, None, None), (4, "https://t/b", "<ul class=pagination><li class='next page'><a href=/c>n</a>" + row, 7)]
    d = spark.createDataFrame(pages, "page_no long, url string, html string, scan_id long")
    whole, links = I.read_pages(d), I.read_pages(d, keep=("scan_id",), with_rows=False)
    assert links.columns == ["page_no", "url", "login", "next_url", "scan_id"]
    assert sorted((r["page_no"], r["url"], r["login"], r["next_url"]) for r in links.collect()) == sorted((r["page_no"], r["url"], r["login"], r["next_url"]) for r in whole.collect())
    assert {r["page_no"]: r["scan_id"] for r in links.collect()} == {1: 5, 2: 6, 3: None, 4: 7}


def test_lines_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    rng, whole, rows = random.Random(6), {}, []
    for s in range(12):
        text = "".join(rng.choice(["a", "bc", "\n", "\r\n", " ", "é", "long" * 9]) for _ in range(rng.randint(0, 60)))
        whole[s], at, seq = text, 0, 0
        while at < len(text):
            n = rng.randint(0, 9)
            rows.append((s, seq, text[at : at + n] if n or rng.random() < 0.5 else None))
            at, seq = at + n, seq + rng.choice([1, 1, 5])
    rng.shuffle(rows)
    chunks = spark.createDataFrame([*rows, (None, 1, "x"), (1, None, "y")], "stream long, seq long, data string")

    def found(ended):
        out = {}
        for r in C.lines(chunks, ended).collect():
            out.setdefault(r["stream"], []).append((r["seq"], r["pos"], r["line"]))
        return {s: [x[2] for x in sorted(v)] for s, v in out.items()}

    split = {s: re.split("[\n\r\u000b\u000c\u0085  ]", t) for s, t in whole.items()}
    assert found(True) == {s: ls for s, t in split.items() if (ls := [x for x in t if x])}
    assert found(False) == {s: ls for s, t in split.items() if (ls := [x for x in t[:-1] if x])}


def test_documents_are_cut_in_one_pass(spark, tmp_path):
    """Chunks as Python's slices, whatever the characters; no chunk goes through its text from the start."""
    texts = [None, "", "a" * 61, "a" * 122, "\U0001f600é\r\n\u2028" * 50, "\n" * 200, "x" * 60, "\x00\U00010000" * 61, "long " * 30_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = state_queries.chunks_of_documents(spark, str(tmp_path))
    want = {(i, k // 61, (t or "")[k : k + 61]) for i, t in enumerate(texts) for k in range(0, len(t or "") + 1, 61)}
    assert {tuple(r) for r in chunks.collect()} == want and chunks.count() == len(want)
    assert "substring" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    plan = C.lines(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # inner lines are whole where they are


def test_recovery(spark):
    items = spark.createDataFrame(
        [("a", "analyzing", "r1", "analysis", None), ("b", "runningAI", "r2", "modification", None), ("c", "reviewing", "r3", "modification", R.LOST), ("d", "analyzing", "r1", "modification", None),
         ("e", "runningAI", None, None, None), ("f", "completed", "r1", "analysis", None), ("g", "interrupted", "r1", "analysis", None), ("h", "runningAI", "r9", "modification", "x")],
        "item_id string, stage string, run_id string, phase string, last_message string",
    )
    inspected = spark.createDataFrame([("r1", "running"), ("r2", "completed"), ("r3", "interrupted")], "run_id string, status string")
    seen = R.offsets(spark.createDataFrame([("r1", 5, "x"), ("r1", 9, ""), ("r1", 12, None), (None, 3, "x")], "run_id string, offset long, display string"))
    got = {r["item_id"]: r for r in R.recover(items, inspected, seen).collect()}
    assert [(k, r["outcome"], r["new_stage"], r["resume_at"]) for k, r in sorted(got.items())] == [
        ("a", "recovered", "analyzing", 5), ("b", "completed", "runningAI", 0), ("c", "interrupted", "interrupted", None), ("d", "interrupted", "interrupted", None),
        ("e", "interrupted", "interrupted", None), ("f", "interrupted", "interrupted", None), ("g", "recovered", "analyzing", 5), ("h", "interrupted", "interrupted", None),
    ]
    assert got["c"]["message"] is None and got["h"]["message"] == R.LOST and got["a"]["error"] is None and got["e"]["execution_state"] is None
    due = {r["item_id"] for r in R.due(items).collect()}
    assert due == {"a", "b", "c", "d", "e", "h"}
    done = spark.createDataFrame([("l1", "a"), ("l0", "b"), ("l1", "a")], "launch_id string, item_id string")
    assert {r["item_id"] for r in R.due(items, done, "l1").collect()} == due - {"a"}


def test_control_files(spark, tmp_path):
    root = str(tmp_path / "jobs")
    assert K.read(spark, root, "result").count() == 0
    beat = {"runID": "r 1+%", "workerPID": 4, "updatedAt": "2024-01-02T03:04:05Z"}
    files = [("r 1+%", "heartbeat.json", json.dumps(beat)), ("r 1+%", "stdout.log", None), ("r2", "heartbeat.json", "{"), ("r3", "heartbeat.json", json.dumps({**beat, "workerPID": None})), ("r3", "result.json", json.dumps({"runID": "r3", "exitCode": 1, "endedAt": "2024-01-02T03:04:05Z"}))]
    K.write_runs(spark.createDataFrame(files, "run_id string, name string, text string"), root)
    got = K.read(spark, root, "heartbeat").collect()
    assert [(r["directory"], r["runID"], r["workerPID"], r["updatedAt"].year) for r in got] == [("r 1+%", "r 1+%", 4, 2024)]
    assert [(r["directory"], r["launchError"]) for r in K.read(spark, root, "result").collect()] == [("r3", None)]
    with pytest.raises(Exception, match="exist already"):  # a run's folder is made once, and no other of that write
        K.write_runs(spark.createDataFrame([("r4", "a", ""), ("r2", "a", "")], "run_id string, name string, text string"), root)
    assert sorted(p.name for p in (tmp_path / "jobs").iterdir()) == ["r 1+%", "r2", "r3"]


def test_many_runs_are_read_by_few_tasks(spark, tmp_path):
    """A run's small file costs neither a task nor a listing; a name may hold any sign, a folder may lack the file."""
    assert K.read(spark, str(tmp_path / "none"), "result").count() == 0
    text = '{"runID": "r", "exitCode": 0, "endedAt": "2024-01-01T00:00:00Z"}'
    names = [*(f"r{i}" for i in range(60)), "a+b %41"]
    K.write_runs(spark.createDataFrame([(n, "result.json", text) for n in names] + [("bare", "other.json", text)], "run_id string, name string, text string"), str(tmp_path / "runs"))
    got = K.read(spark, str(tmp_path / "runs"), "result")
    assert got.rdd.getNumPartitions() == 1 and sorted(r["directory"] for r in got.collect()) == sorted(names)


def test_cancel_needs_manifest_and_heartbeat(spark):
    runs = spark.createDataFrame([("a", 1, "a"), ("b", 2, "b"), ("c", 3, "c")], "run_id string, worker_pid long, directory string").withColumns({"started_at": F.lit("2024-01-01").cast("timestamp"), "alive": F.lit(True)})
    beats = runs.select("run_id", "worker_pid", F.lit("2024-01-01 00:00:02").cast("timestamp").alias("updated_at"))
    manifests = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9)], "run_id string, worker_pid long")
    out = J.inspect(runs, beats, runs.select("run_id").limit(0), F.lit("2024-01-01 00:00:10").cast("timestamp"), 8.0, manifests).collect()
    assert sorted((r["run_id"], r["status"], r["may_cancel"]) for r in out) == [("a", "running", True), ("b", "running", False), ("c", "running", False)]


def test_one_run_at_a_time(spark, tmp_path):
    root = str(tmp_path / "sync")
    now = [1000.0]
    with X.lease(spark, root, 60, lambda: now[0]):
        with pytest.raises(X.Refused):
            with X.lease(spark, root, 60, lambda: now[0]):
                pass
        now[0] += 61  # the holder is gone: it did not renew
        with X.lease(spark, root, 1000, lambda: now[0]):
            with pytest.raises(X.Refused):
                with X.lease(spark, root, 60, lambda: now[0]):
                    pass
    rows = spark.range(5)
    rows.write.parquet(str(tmp_path / "in"))
    seen, started = [], threading.Event()

    def start(checkpoint):
        def each(df, n):
            started.set()
            with pytest.raises(X.Refused):
                X.run_once(spark, root, start)
            seen.append(df.count())

        return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    X.run_once(spark, root, start)
    X.run_once(spark, root, start)  # nothing new
    assert seen == [5] and started.is_set()


def test_intervals_and_who_may_sync():
    assert [X.interval_seconds(h) for h in (None, 0, 1, 5, 8, 99, -3)] == [7200, 3600, 3600, 18000, 28800, 28800, 3600]
    assert not X.eligible(False, False, False) and X.eligible(False, False, True)
    stop = threading.Event()
    stop.set()
    assert X.run_periodically(None, "", None, 2, lambda: True, stop) == 0


def test_provider_events_of_other_shapes(spark):
    def codex(*lines):
        d = spark.createDataFrame([(i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate(lines)], "i int, line string")
        return [(r["e"]["display"], r["e"]["final"]) for r in d.select("i", E.codex_event(F.col("line")).alias("e")).orderBy("i").collect()]

    item = {"type": "item.completed", "item": {"type": "agent_message", "text": "said"}}
    assert codex(item, {"type": "item.completed", "message": "m"}, {"type": "turn.completed", "message": "m"}, {"type": "item.started", "message": "m"}, {"message": 5}, "text", "[1]") == [
        ("said", "said"), ("m", None), (E.TURN_DONE, None), (None, None), (None, None), ("text", None), ("[1]", None)
    ]
    d = spark.createDataFrame([('{"type": "result", "is_error": "true", "result": "r"}',), ('{"type": "result", "is_error": true, "result": "r"}',), ('{"type": "assistant", "message": {"content": [{"type": "text", "text": "t"}, 5]}}',)], "line string")
    assert [r["e"]["display"] for r in d.select(E.claude_event(F.col("line")).alias("e")).collect()] == ["Claude Code 已完成", "r", None]


def test_moves_that_recovery_allows(spark):
    steps = [("a", 1, "runningAI"), ("a", 2, "analyzing"), ("b", 1, "reviewing"), ("b", 2, "runningAI"), ("c", 1, "analyzing"), ("c", 2, "runningAI"), ("d", 1, "reviewing"), ("d", 2, "analyzing")]
    got = E.invalid_transitions(spark.createDataFrame(steps, "ticket_id string, position int, stage string")).collect()
    assert sorted(r["ticket_id"] for r in got) == ["a", "c", "d"]


def test_active_items_are_cancelled(spark):
    items = spark.createDataFrame([(1, 1, "runningAI"), (1, 2, "partial"), (1, 3, "failed"), (2, 1, "runningAI"), (3, 1, "completed")], "ticket_id long, position long, stage string")
    got = J.cancel_active(items, spark.createDataFrame([(1,), (3,), (9,), (1,)], "id long")).collect()
    assert sorted((r["ticket_id"], r["position"], r["stage"]) for r in got) == [(1, 1, "runningAI"), (1, 2, "cancelled"), (1, 3, "failed"), (2, 1, "runningAI"), (3, 1, "completed")]
