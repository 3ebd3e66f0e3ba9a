"""Liveness of runs on a stream: state and a timer for each run, so silence is noticed without input.

Rows are signs of a run: ``start`` (worker and folder), ``beat`` (a heartbeat of a worker), ``exit``
(its worker is gone) and ``result``. A run is fresh for ``limit`` seconds after its last beat, or its
start; then it is interrupted, and if that stands for ``grace`` seconds the interruption is raised
and the run is over until it starts anew. A result ends it as completed. Beats of another worker
do not count; a run in a folder of another name is interrupted at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT_S, GRACE_S = 8.0, 2.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run_id string, status string, raised boolean, at timestamp"
#: The state of a run: its worker, when it was last fresh and when it was found interrupted (ms; -1: not), its status.
STATE = "worker_pid long, fresh long, since long, status string"
#: Signs of one moment in the order in which they count.
RANK = {"start": 0, "beat": 1, "exit": 2, "result": 3}
OVER = ("completed", "raised")


def due(state: tuple, limit: int, grace: int) -> int | None:
    """When time alone will next change the state of a run (ms); never once it is over."""
    _, fresh, since, status = state
    if status in OVER:
        return None
    return since + grace if since >= 0 else fresh + limit + 1  # an age of the limit itself is fresh


def pass_time(state: tuple, now: int, limit: int, grace: int) -> tuple[tuple, list[tuple[str, bool, int]]]:
    """The state at ``now`` without a new sign, and the changes (status, raised, at) on the way."""
    changes = []
    while (at := due(state, limit, grace)) is not None and at <= now:
        pid, fresh, since, _ = state
        if since < 0:
            state = (pid, fresh, at, "interrupted")
            changes.append(("interrupted", False, at))
        else:
            state = (pid, fresh, since, "raised")
            changes.append(("interrupted", True, at))
    return state, changes


def sign(state: tuple | None, kind: str, pid: int, placed: bool, at: int) -> tuple[tuple | None, list[tuple[str, bool, int]]]:
    """The state after a sign, time up to it having passed, and the changes."""
    if kind == "start" and (state is None or state[3] in OVER):
        if not placed:
            return (pid, at, at, "raised"), [("interrupted", True, at)]
        return (pid, at, -1, "running"), [("running", False, at)]
    if state is None or state[3] in OVER:
        return state, []
    if kind == "result":
        return (state[0], state[1], -1, "completed"), [("completed", False, at)]
    if kind == "beat" and pid == state[0] and state[3] != "exited":
        back = [("running", False, at)] if state[2] >= 0 else []
        return (state[0], max(state[1], at), -1, "running"), back
    if kind == "exit" and pid == state[0] and state[3] != "exited":
        new = [] if state[2] >= 0 else [("interrupted", False, at)]
        return (state[0], state[1], state[2] if state[2] >= 0 else at, "exited"), new
    return state, []


class _Watch(StatefulProcessor):
    """``pass_time`` and ``sign`` with the state and timer of each run."""

    def __init__(self, limit: float, grace: float, event_time: bool):
        self.limit, self.grace, self.event_time = round(limit * 1000), round(grace * 1000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", STATE)

    def _clock(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _keep(self, old: tuple | None, state: tuple | None, fired: bool = False) -> None:
        """The state and its one timer, which is when ``due`` says; Spark itself removes one that has ``fired``."""
        if state is None or state == old:
            return
        self.state.update(state)
        was, at = (None if s is None else due(s, self.limit, self.grace) for s in (old, state))
        if was != at:
            if was is not None and not fired:
                self.handle.deleteTimer(was)
            if at is not None:
                self.handle.registerTimer(at)

    def _rows(self, key, changes) -> pd.DataFrame:
        text = [pd.Series(x, dtype=object) for x in ([key[0]] * len(changes), [c[0] for c in changes])]
        return pd.DataFrame({"run_id": text[0], "status": text[1], "raised": pd.Series([c[1] for c in changes], dtype=bool), "at": pd.to_datetime([c[2] for c in changes], unit="ms")})

    def handleInputRows(self, key, rows, timerValues):
        state, out = self.state.get(), []
        old = state = tuple(state) if state is not None else None
        # the signs of a run in one batch; a run sends one every two seconds
        signs = sorted((int(t), RANK[k], k, int(p), bool(d)) for f in rows for t, k, p, d in zip(f["ms"], f["kind"], f["worker_pid"], f["placed"]) if k in RANK)
        for at, _, kind, pid, placed in signs:
            if state is not None:
                state, changes = pass_time(state, at - 1, self.limit, self.grace)
                out += changes
            state, changes = sign(state, kind, pid, placed, at)
            out += changes
        if state is not None and not self.event_time:
            state, changes = pass_time(state, self._clock(timerValues), self.limit, self.grace)
            out += changes
        self._keep(old, state)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, out = self.state.get(), []
        if state is not None:
            old = tuple(state)
            state, out = pass_time(old, max(expiredTimerInfo.getExpiryTimeInMs(), self._clock(timerValues)), self.limit, self.grace)
            self._keep(old, state, fired=True)
        if out:
            yield self._rows(key, out)

    def close(self) -> None:
        pass


def watch(signs: DataFrame, limit: float = LIMIT_S, grace: float = GRACE_S, event_time: bool = False) -> DataFrame:
    """(run_id, status, raised, at): a streaming DataFrame of each change of a run's status.

    ``signs`` has run_id, kind, worker_pid, directory and at (timestamp). By default the clock is the
    machine's, as in a monitor; with ``event_time`` it is the watermark, so that a replay of old signs
    gives the same changes each time. Signs with a null run, kind or time are ignored, a null worker is
    -1; beats before the start of their run are ignored; repeated signs change nothing.
    """
    signs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    d = signs.filter("run_id IS NOT NULL AND kind IS NOT NULL AND at IS NOT NULL")
    if event_time:
        d = d.withWatermark("at", "0 seconds")
    placed = F.coalesce(F.col("directory") == F.col("run_id"), F.col("kind") != "start")
    d = d.select("run_id", "kind", F.coalesce(F.col("worker_pid").cast("long"), F.lit(-1)).alias("worker_pid"), placed.alias("placed"), "at", F.unix_millis("at").alias("ms"))
    return d.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Watch(limit, grace, event_time), outputStructType=OUT, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime"
    )
