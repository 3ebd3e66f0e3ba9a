"""Run logs and jobs: JSON event lines, final messages, liveness, stage transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed stage changes besides cancelled, failed and interrupted, open to any stage.
TRANSITIONS = (
    ("preparing", "analyzing"), ("analyzing", "awaitingPlanApproval"), ("awaitingPlanApproval", "runningAI"), ("runningAI", "reviewing"),
    ("reviewing", "awaitingApproval"), ("awaitingApproval", "committing"), ("committing", "pulling"), ("pulling", "pushing"),
    ("pushing", "updatingTicket"), ("updatingTicket", "completed"), ("updatingTicket", "partial"), ("partial", "updatingTicket"),
    # recovery, by the phase of the run
    ("interrupted", "analyzing"), ("interrupted", "runningAI"), ("reviewing", "runningAI"),
)


#: Fixed value: what a completed turn shows.
TURN_DONE = "Codex 已完成本轮任务"


def text_at(json: Column, path: str) -> Column:
    """The string at a path of a JSON line, null where there is none or it is of another type."""
    v = F.try_parse_json(json)
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def codex_event(line: Column) -> Column:
    """struct<display, final> of an event line; text that is no JSON object is shown as it is."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))
    kind, item = text_at(line, "$.type"), text_at(line, "$.item.type")
    said = F.when((kind == "item.completed") & (item == "agent_message"), text_at(line, "$.item.text"))
    none = F.lit(None).cast("string")
    shown = F.when(~is_object, line).when(said.isNotNull(), said).when(kind == "item.started", none).when(kind == "turn.completed", TURN_DONE).otherwise(text_at(line, "$.message"))
    return F.struct(shown.alias("display"), F.when(is_object, said).alias("final"))


def _blocks(v: Column, path: str) -> Column:
    """An array of JSON objects at a path; null if one element is of another type."""
    at = F.try_variant_get(v, path, "variant")
    blocks = F.try_variant_get(v, path, "array<variant>")
    return F.when(F.schema_of_variant(at).startswith("ARRAY") & F.forall(blocks, lambda b: F.schema_of_variant(b).startswith("OBJECT")), blocks)


def _text(v: Column, path: str) -> Column:
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def cursor_event(line: Column) -> Column:
    """struct<display, final>: the first block's text of an assistant, the result at the end."""
    v, kind = F.try_parse_json(line), text_at(line, "$.type")
    said = F.when((kind == "assistant") & _blocks(v, "$.message.content").isNotNull(), text_at(line, "$.message.content[0].text"))
    result = F.when(kind == "result", text_at(line, "$.result"))
    shown = F.coalesce(said, F.when(result.isNotNull(), "Cursor 已完成"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.struct(F.when(is_object, shown).otherwise(line).alias("display"), F.when(is_object, result).alias("final"))


def claude_event(line: Column) -> Column:
    """struct<display, final>: start with the model, the first text block, the result or its error."""
    v, kind = F.try_parse_json(line), text_at(line, "$.type")
    blocks = F.coalesce(_blocks(v, "$.message.content"), _blocks(v, "$.content"))
    first = F.get(F.filter(blocks, lambda b: _text(b, "$.type") == "text"), F.lit(0))
    model, result = text_at(line, "$.model"), text_at(line, "$.result")
    started = F.when(model.isNull(), "Claude Code 已启动").otherwise(F.concat(F.lit("Claude Code 已启动（"), model, F.lit("）")))
    error = F.try_variant_get(v, "$.is_error", "variant")
    failed = F.coalesce((F.schema_of_variant(error) == "BOOLEAN") & F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False))
    ended = F.when(failed, F.coalesce(result, F.lit("Claude Code 执行失败"))).otherwise("Claude Code 已完成")
    shown = F.when((kind == "system") & (text_at(line, "$.subtype") == "init"), started).when(kind == "assistant", F.nullif(_text(first, "$.text"), F.lit(""))).when(kind == "result", ended)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.struct(F.when(is_object, shown).otherwise(line).alias("display"), F.when(is_object & (kind == "result"), result).alias("final"))


def final_messages(events: DataFrame, whole: Column | None = None) -> DataFrame:
    """(run_id, final): the last non-empty final of each run; else ``whole``, an aggregate of its output, if given."""
    some = F.when(F.col("final") != "", F.col("final"))
    last = F.max_by(some, F.when(F.col("final") != "", F.col("offset")))
    return events.groupBy("run_id").agg((last if whole is None else F.coalesce(last, whole)).alias("final"))


def liveness(result: Column, alive: Column, beat_age: Column, start_age: Column, limit: float = 8.0) -> Column:
    """completed / running / interrupted; an age of exactly ``limit`` seconds still is fresh."""
    return F.when(result, "completed").when(~alive, "interrupted").when(F.coalesce(beat_age, start_age) <= limit, "running").otherwise("interrupted")


def invalid_transitions(items: DataFrame, key: str = "ticket_id") -> DataFrame:
    """(key, previous, stage, n): stage changes in order of position that no rule allows."""
    w = Window.partitionBy(key).orderBy("position")
    steps = items.withColumn("previous", F.lag("stage").over(w)).filter("previous IS NOT NULL AND previous <> stage")
    rules = steps.sparkSession.createDataFrame(TRANSITIONS, "previous string, stage string")
    open_to_any = F.col("stage").isin("cancelled", "failed", "interrupted")
    return steps.filter(~open_to_any).join(F.broadcast(rules), ["previous", "stage"], "left_anti").groupBy(key, "previous", "stage").agg(F.count("*").alias("n"))


def visible(messages: DataFrame, hidden: tuple[str, ...], prefix: str, col: str = "message", key: str = "run_id", order: str = "offset") -> DataFrame:
    """Messages that a log keeps and shows: none equal to the one before in its run, none hidden.

    Repeats are dropped as they are logged, before the hidden phrases and the prefix.
    """
    before = F.lag(col).over(Window.partitionBy(key).orderBy(order))
    out = messages.withColumn("_before", before).filter(~F.col(col).eqNullSafe(F.col("_before")) | F.col(col).isNull()).drop("_before")
    for h in hidden:
        out = out.filter(~F.col(col).contains(h))
    return out.filter(~F.col(col).startswith(prefix))
