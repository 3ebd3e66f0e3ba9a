"""Job events folded into states: ordered, guarded, and without a replay in one place.

An action moves an item from one stage to another if the item's stage allows it, else it is refused
and changes nothing. What a run of events does to an item is a table from the stage before to the
stage after, and such tables compose, so the fold is an aggregate: blocks of an item's events become
tables, blocks of blocks too, and the stages then flow back down to the events. No task holds more
than ``BLOCK`` events of an item at a time, however many it has. The first block of an item is entered
at the stage of none, so items of one block need no tables. The blocks are written once to a scratch table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Tables

#: Events of an item in one block, and blocks in one block of the next level.
BLOCK = 1024
NONE = ""
#: Stands for every stage of an item that there is.
ANY = ("*",)
RUNNING = ("analyzing", "runningAI", "reviewing")
# Stages, and for each action the stages that allow it, the stage
# it leads to, what becomes of the error (set, cleared or kept) and of the run's state.
STAGES = (
    NONE, "preparing", "analyzing", "awaitingPlanApproval", "runningAI", "reviewing", "awaitingApproval", "committing", "pulling", "pushing",
    "updatingTicket", "completed", "partial", "interrupted", "failed", "cancelled",
)
ACTIONS = {
    "start": ((NONE,), "preparing", "keep", None),
    "checked": (("preparing",), "analyzing", "keep", None),
    "analysed": (("analyzing",), "awaitingPlanApproval", "clear", "completed"),
    "approve_plan": (("awaitingPlanApproval",), "runningAI", "clear", "none"),
    "modified": (("runningAI",), "reviewing", "keep", None),
    "reported": (("reviewing",), "awaitingApproval", "clear", "completed"),
    "deliver": (("awaitingApproval",), "committing", "keep", None),
    "committed": (("committing",), "pulling", "keep", None),
    "pulled": (("pulling",), "pushing", "keep", None),
    "pushed": (("pushing",), "updatingTicket", "keep", None),
    "delivered": (("updatingTicket",), "completed", "clear", None),
    "update_failed": (("updatingTicket",), "partial", "set", None),
    "retry": (("partial",), "updatingTicket", "keep", None),
    "interrupt": ((*RUNNING, "interrupted"), "interrupted", "set", "interrupted"),
    "recover_analysis": (("interrupted", "analyzing"), "analyzing", "clear", "reconnecting"),
    "recover_modification": (("interrupted", "runningAI", "reviewing"), "runningAI", "clear", "reconnecting"),
    "cancel": (ANY, "cancelled", "set", "interrupted"),
    "fail": (ANY, "failed", "set", "completed"),
}


def _numbers() -> list[int]:
    """The stage after each action at each stage, one row of stages an action; refused: the same stage less 100."""
    at = {s: i for i, s in enumerate(STAGES)}
    out = []
    for allowed, to, _, _ in ACTIONS.values():
        out += [at[to] if s in allowed or (allowed == ANY and s != NONE) else i - 100 for i, s in enumerate(STAGES)]
    return out


def _number(action: str) -> Column:
    """The number of an action; -1 for one that is unknown or null."""
    return F.coalesce(*[F.when(F.col(action) == a, i) for i, a in enumerate(ACTIONS)], F.lit(-1))


def _next(action: Column, stage: Column) -> Column:
    table = F.array(*[F.lit(x) for x in _numbers()])
    return F.element_at(table, (action * len(STAGES) + stage + 1).cast("int"))


def _stay(number: Column) -> Column:
    """The stage of a number that may say refused."""
    return F.when(number < 0, number + 100).otherwise(number)


def _block(of: Column) -> Column:
    """The block of a number; the first is 0."""
    return F.greatest(F.floor(of / BLOCK), F.lit(0))


def _composed(members: Column, number: Column, step) -> Column:
    """What a sorted array of members does to each stage; the first block (``number`` 0) has an item of no stage only."""
    start = F.when(number == 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(i) for i in range(len(STAGES))]))
    return F.aggregate(members, start, lambda acc, m: F.transform(acc, lambda s: step(m, s)))


def _before(members: Column, first: Column, step) -> Column:
    """The stage before each member of a sorted array."""
    start = F.struct(first.alias("s"), F.expr("CAST(array() AS array<int>)").alias("out"))
    return F.aggregate(members, start, lambda acc, m: F.struct(step(m, acc["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"])


def _act(m: Column, s: Column) -> Column:
    """The stage after a member of a block, where that is refused the same."""
    stays = F.array(*[F.lit(i) for i in range(len(STAGES))], *[F.lit(x + 100 if x < 0 else x) for x in _numbers()])  # of unknown actions first
    return F.element_at(stays, (m["n"] + 1) * len(STAGES) + s + 1)


def _entered(events: DataFrame, key: str) -> DataFrame:
    """(k, b, es, s): the sorted events of each block of an item, once each, and the stage in which it is entered."""
    keyed = events.filter(F.col(key).isNotNull() & F.col("seq").isNotNull()).select(F.col(key).alias("k"), F.col("seq").cast("long").alias("seq"), F.struct("at", "action", "message").alias("e"))
    # one shuffle, by block, for the single events and for the blocks
    once = keyed.withColumn("b", _block(F.col("seq"))).repartition("k", "b").groupBy("k", "b", "seq").agg(F.min("e").alias("e"))
    rows = once.select("k", "b", F.struct("seq", _number("e.action").alias("n"), "e.action", "e.at", "e.message").alias("e"))

    def follow(m: Column, s: Column) -> Column:
        return F.element_at(m["does"], s + 1)

    blocks = Tables(events.sparkSession, "fold").write(rows.groupBy("k", "b").agg(F.sort_array(F.collect_list("e")).alias("es")))
    every = blocks.filter("b = 0").withColumn("s", F.lit(0))
    if not (later := blocks.filter("b > 0")).isEmpty():
        long = blocks.join(later.select("k").distinct(), "k", "left_semi")  # items of several blocks
        low = long.select("k", _block(F.col("b")).alias("bb"), F.struct("b", _composed(F.col("es"), F.col("b"), _act).alias("does")).alias("m"))
        high = low.groupBy("k", "bb").agg(F.sort_array(F.collect_list("m")).alias("ms"))
        top = high.select("k", F.struct("bb", _composed(F.col("ms"), F.col("bb"), follow).alias("does")).alias("m")).groupBy("k").agg(F.sort_array(F.collect_list("m")).alias("ms"))
        entered = top.select("k", F.inline(F.arrays_zip(F.col("ms.bb").alias("bb"), _before(F.col("ms"), F.lit(0), follow).alias("s"))))
        entered = high.join(entered, ["k", "bb"]).select("k", F.inline(F.arrays_zip(F.col("ms.b").alias("b"), _before(F.col("ms"), F.col("s"), follow).alias("s"))))
        every = every.unionByName(later.join(entered, ["k", "b"]))
    return every


def fold(events: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, seq, at, action, message, previous, stage, refused) of each event, in no order.

    ``events`` has key, seq, at, action, message; seq orders an item's events from 0 or 1 on. An event that
    was delivered twice (one key and seq) counts once, the smaller by time, action and message if
    they differ. Events with a null key or seq are left out; unknown actions are refused. An empty
    table gives an empty one.
    """
    every = _entered(events, key)
    each = every.select("k", F.inline(F.arrays_zip(F.col("es").alias("e"), _before(F.col("es"), F.col("s"), _act).alias("s"))))
    told = F.when(F.col("e.n") < 0, F.col("s") - 100).otherwise(_next(F.col("e.n"), F.col("s")))
    names = F.array(*[F.lit(x) for x in STAGES])
    name = lambda c: F.element_at(names, (c + 1).cast("int"))
    return each.select(F.col("k").alias(key), "e.seq", "e.at", "e.action", "e.message", name(F.col("s")).alias("previous"), name(_stay(told)).alias("stage"), (told < 0).alias("refused"))


def _effect(i: int) -> Column:
    return F.coalesce(*[F.when(F.col("action") == a, F.lit(e[i])) for a, e in ACTIONS.items() if e[i] is not None], F.lit(None).cast("string"))


def states(folded: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, stage, error, execution_state, updated_at, n_events, n_refused): each item after its events.

    An error is the message of the last accepted event that sets or clears it; an item whose events
    were all refused has stage ''. Everything is a maximum or a count, added up within tasks.
    """
    took = ~F.col("refused")
    error, run = _effect(2), _effect(3)
    last = lambda what, when: F.max_by(what, F.when(when, F.col("seq")))
    d = folded.withColumn("_error", error).withColumn("_run", run)
    return d.groupBy(key).agg(
        F.coalesce(last(F.col("stage"), took), F.lit(NONE)).alias("stage"),
        last(F.when(F.col("_error") == "set", F.col("message")), took & (F.col("_error") != "keep")).alias("error"),
        F.nullif(last(F.col("_run"), took & F.col("_run").isNotNull()), F.lit("none")).alias("execution_state"),
        F.max(F.when(took, F.col("at"))).alias("updated_at"), F.count("*").alias("n_events"), F.count_if("refused").alias("n_refused"),
    )


def states_of(events: DataFrame, key: str = "item_id") -> DataFrame:
    """``states`` of ``fold(events)`` without its rows: each block of an item gives one row, and these are grouped."""
    tolds = F.array(*[F.lit(i - 100) for i in range(len(STAGES))], *[F.lit(x) for x in _numbers()])  # of unknown actions first
    errors, runs = (F.array(F.lit(none), *[F.lit(e[i]) for e in ACTIONS.values()]) for i, none in ((2, "keep"), (3, None)))
    none = F.lit(None)

    def step(acc: Column, m: Column) -> Column:
        told, n = F.element_at(tolds, (m["n"] + 1) * len(STAGES) + acc["s"] + 1), m["n"] + 2
        error, run = F.element_at(errors, n), F.element_at(runs, n)
        took = told >= 0
        touched = took & (error != "keep")
        return F.struct(
            _stay(told).alias("s"), (acc["touched"] | touched).alias("touched"), F.when(touched, F.when(error == "set", m["message"])).otherwise(acc["error"]).alias("error"),
            F.when(took & run.isNotNull(), run).otherwise(acc["run"]).alias("run"), F.when(took, F.greatest(acc["at"], m["at"])).otherwise(acc["at"]).alias("at"), (acc["refused"] + F.when(took, 0).otherwise(1)).alias("refused"),
        )

    start = F.struct(F.col("s").alias("s"), F.lit(False).alias("touched"), none.cast(events.schema["message"].dataType).alias("error"), none.cast("string").alias("run"), none.cast(events.schema["at"].dataType).alias("at"), F.lit(0).alias("refused"))
    d = _entered(events, key).select("k", "b", F.aggregate("es", start, step).alias("a"), F.size("es").alias("n"))
    last = lambda what, when=F.lit(True): F.max_by(what, F.when(when, F.col("b")))
    stage = F.element_at(F.array(*[F.lit(x) for x in STAGES]), last(F.col("a.s")) + 1)
    return d.groupBy(F.col("k").alias(key)).agg(
        stage.alias("stage"), last(F.col("a.error"), F.col("a.touched")).alias("error"), F.nullif(last(F.col("a.run"), F.col("a.run").isNotNull()), F.lit("none")).alias("execution_state"),
        F.max("a.at").alias("updated_at"), F.sum("n").alias("n_events"), F.sum("a.refused").alias("n_refused"),
    )


def logs(folded: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, seq, at, message, level): the log entries that accepted events append.

    An interruption does not repeat the entry before it. Levels are error where the event sets the
    error, else info. Null messages append nothing.
    """
    said = folded.filter(~F.col("refused") & F.col("message").isNotNull())
    # the entry before: within a block of an item's events, else the last of an earlier block
    inside = F.lag("message").over(Window.partitionBy(key, "_b").orderBy("seq"))
    d = said.withColumn("_b", _block(F.col("seq"))).withColumn("_inside", inside)
    d = Tables(folded.sparkSession, "said").write(d).withColumn("_earlier", F.lit(None).cast("string"))
    if not d.filter("_b > 0").isEmpty():
        ends = d.groupBy(key, "_b").agg(F.max_by("message", "seq").alias("_last"))
        ends = ends.select(F.col(key).alias("_k"), F.col("_b").alias("_eb"), F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_earlier"))
        d = d.drop("_earlier").join(ends, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_eb")))
    again = (F.col("action") == "interrupt") & F.coalesce("_inside", "_earlier").eqNullSafe(F.col("message"))
    return d.filter(~again).select(key, "seq", "at", "message", F.when(_effect(2) == "set", "error").otherwise("info").alias("level"))
