"""Mixing sources to target weights by hash-threshold histograms, DataFrame functions only.

Every document gets a 60-bit hash of its id. A source's budget becomes a hash threshold:
documents below it are taken. The threshold comes from sums by source and hash bucket
(4,096 buckets), whose running total shows the bucket where the budget ends; only that
bucket's documents are summed again by their next 12 bits, and so on. Nothing is sorted,
a smaller budget takes a subset of a larger one, and a rerun takes the same documents.

Budgets between one and two times a source take every document once and those below the
threshold a second time.

Nulls and odd cases: a null source is a source of its own, last in order; a null text has
size 0 and is taken with 0 words; rows that repeat an id share a hash and are taken
together; an empty table gives an empty result. Input columns other than the three named
ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, rows_if_small

STEP_BITS = 12
STEPS = 5
#: Sources up to this number may be broadcast; beyond it the join is left to Spark.
SMALL_SOURCES = 5_000


def n_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of md5 of the id as text; a null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets by water level: min(cap x size, level x weight), adding up to share x all sizes.

    ``sizes`` has (source, source_size); the window over all of it sees one row a source.
    Resharing the excess by weight again and again ends at this level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    by_fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    s = (
        s.withColumn("budget", F.least(F.sum("source_size").over(whole) * F.lit(float(share)), F.sum("most").over(whole)))
        .withColumn("full", F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    )
    # The level if all sources before this one are full: it rises while they are, then falls.
    s = s.withColumn("level", F.max((F.col("budget") - F.col("full")) / F.col("w_left")).over(whole))
    return s.select("source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, cut): documents whose hash is below ``cut`` come nearest to the budget.

    ``docs`` has (source, size, h), ``budgets`` (source, budget).
    """
    left = docs
    state = budgets.withColumn("base", F.lit(0).cast("long"))
    for step in range(STEPS):
        shift = 60 - STEP_BITS * (step + 1)
        hist = left.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("rows"))
        over = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("before", F.sum("tokens").over(over) - F.col("tokens"))
        st = state.select(F.col("source").alias("s_source"), "budget", "base")
        found = hist.join(_join_side(st, scratch), F.col("source").eqNullSafe(F.col("s_source")))
        # the bucket where the running total passes what is left of the budget
        edge = found.filter("base + before <= budget AND base + before + tokens > budget").groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("base") + F.col("before")).alias("base"), "budget", "tokens", "rows")).alias("e")
        ).select("source", "e.*")
        edge = scratch.write(edge, f"edge{step}")
        if step == STEPS - 1 or edge.filter("rows > 1").isEmpty():
            break
        key = edge.select(F.col("source").alias("e_source"), "bucket")
        left = scratch.write(
            left.join(_join_side(key, scratch), F.col("source").eqNullSafe(F.col("e_source")) & (F.shiftright("h", shift) == F.col("bucket"))).select("source", "size", "h"), f"boundary{step}"
        )
        state = edge.select("source", "budget", "base")
    # The last bucket is one document, or rows of one id: in if that comes nearer to the budget.
    take = F.col("base") + F.col("tokens") - F.col("budget") < F.col("budget") - F.col("base")
    return edge.select("source", F.shiftleft(F.col("bucket") + take.cast("long"), shift).alias("cut"))


def _join_side(df: DataFrame, scratch: Scratch) -> DataFrame:
    """A table of one row a source, broadcast only when it is known to be small."""
    return F.broadcast(df) if getattr(scratch, "few_sources", False) else df


def _plan(docs: DataFrame, scratch: Scratch, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(p_source, source_size, target, whole, cut), one row a source, from (source, size, h) of all documents."""
    if not 0 < cap <= 2:
        raise ValueError("cap must be above 0 and at most 2")
    sizes = scratch.write(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "by-source")
    scratch.few_sources = rows_if_small(sizes, SMALL_SOURCES)
    goal = scratch.write(targets(sizes, weights, share, cap), "targets")
    budgets = goal.select("source", (F.col("target") - F.col("source_size") * (F.col("target") >= F.col("source_size")).cast("long")).alias("budget"))
    cuts = thresholds(docs, budgets, scratch)
    return goal.join(_join_side(cuts.withColumnRenamed("source", "c_source"), scratch), F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target",
        (F.col("target") >= F.col("source_size")).cast("int").alias("whole"),
        # no bucket passes the budget: it holds the whole source
        F.coalesce(F.col("cut"), F.lit(1 << 60)).alias("cut"),
    )


def _epochs(h: Column, whole: Column, cut: Column) -> Column:
    return F.least(whole + (h < cut).cast("int"), F.lit(2))


def _sized(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h")), "sizes")


def mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, epochs, taken): how often the mix takes each document.

    ``epochs`` is 0, 1 or 2 and ``taken`` = size x epochs; a source's sum differs from its
    target by half of one document at most.
    """
    d = _sized(docs, scratch, id_col, text_col, source_col)
    out = d.join(_join_side(_plan(d, scratch, weights, share, cap), scratch), F.col("source").eqNullSafe(F.col("p_source")))
    epochs = _epochs(F.col("h"), F.col("whole"), F.col("cut"))
    return out.select("doc_id", "size", "source_size", "target", epochs.alias("epochs"), (F.col("size") * epochs).alias("taken"))


def take(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: not at all, once or twice.

    The plan of a row's source and the hash of its id decide, so rows that repeat an id, and
    rows without one, are taken like any other and no document is joined to another.
    """
    plan = _plan(_sized(docs, scratch, id_col, text_col, source_col), scratch, weights, share, cap)
    # one struct, so that no column of the documents can clash with the plan's
    plan = plan.select(F.struct("p_source", "whole", "cut").alias("_mix"))
    epochs = _epochs(hash60(docs[id_col]), F.col("_mix.whole"), F.col("_mix.cut"))
    out = docs.join(_join_side(plan, scratch), docs[source_col].eqNullSafe(F.col("_mix.p_source")))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), epochs))).select(*[docs[c] for c in docs.columns])
