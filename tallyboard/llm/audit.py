"""How document filters act together: every order of them, step by step.

A document fails some of the filters; which ones is its mask. The documents are counted once,
by part and mask (the cells), so the orders are tried on at most 2^n cells a part, not on the
documents. A recursive common table expression then extends prefixes of filters with the letters
they lack: each row is a prefix, one mask and the bits applied so far, each level joins the mask
cells again and emits what its filter does to them. Its size depends on the number of filters
alone; the counts of the parts are joined to it at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: More filters would pass the row limit of a recursion: prefixes times masks are 1.8 million for seven.
MOST_FILTERS = 6

#: The filters are a handful of rows, so their join to the prefixes by the bits that are left is small.
WALK = """
WITH RECURSIVE filters(letter, bit) AS (VALUES {letters:spec}), walk(prefix, applied, step, bit, mask, earlier) AS (
  SELECT '', 0, 0, 0, mask, false FROM {masks}
  UNION ALL
  SELECT concat(w.prefix, f.letter), w.applied | f.bit, w.step + 1, f.bit, c.mask, (c.mask & w.applied) <> 0
  FROM walk w JOIN filters f ON (w.applied & f.bit) = 0 JOIN {masks} c ON c.mask = w.mask
)
"""


def default_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters A to D: few words, few distinct words, many capitals, a symbol of ``#$%&*|``."""
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, failures=default_failures, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters that they fail.

    Bit i of the mask is the i-th filter of ``failures``, the last bit ``copies``: the text is
    that of a smaller id, anywhere in the table. Good and toxic count those whose labels say so
    (one of them, where an id has several).

    A null text is empty, a null part ''. A row with a null id is no copy and has no label; of
    rows that share an id and a text none is a copy of the others. An empty table has no cell.
    Only ids, hashes and masks are shuffled; equal texts are added up in the tasks before.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    fails = list(failures(F.col("text"), F.col("words")).values())
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = d.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), mask.cast("int").alias("mask"))
    rows = rows.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("n"))
    # null ids match no label: they are dealt out by text
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key"), F.lit(997))).otherwise(0).cast("int"))
    said = labels.select(F.col(id_col).alias("l_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    said = said.groupBy("l_id").agg(F.coalesce(F.bool_or("g"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("t"), F.lit(False)).alias("toxic"))
    rows = rows.join(said.withColumn("l_salt", F.lit(0)), (F.col("id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    alike = rows.select("id", "part", "key", "mask", "n", *flags).groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    if copies:  # a text has a row for each part and label, so its window is small whatever its number of copies
        low = F.min("low").over(Window.partitionBy("key"))
        alike = alike.withColumn("first", F.when(F.col("low") == low, F.col("n_low")).otherwise(0) + F.col("n_null"))
        both = F.array(F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(fails))).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
        alike = alike.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return alike.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def walk_orders(cells: DataFrame, letters: str, scratch: Scratch) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row a part, order and step; bit i of a mask is the i-th letter. ``shapley`` is what the
    step's filter removes, summed over all orders. No cell gives no row.
    """
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters) or not letters.isalnum():
        raise ValueError(f"1 to {MOST_FILTERS} different letters, not {letters!r}")
    spec = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    cells = scratch.write(cells, "cells")
    spark = cells.sparkSession
    steps = spark.sql(
        WALK.replace("{letters:spec}", spec)
        + """
        SELECT c.part, w.prefix, w.step, sum(if((c.mask & w.applied) = 0, c.n, 0)) AS kept, sum(if(w.fails AND NOT w.earlier, c.n, 0)) AS removed,
          sum(if(w.fails AND w.earlier, c.n, 0)) AS redundant, sum(if(c.mask = w.bit, c.n, 0)) AS unique_fails,
          sum(if(w.fails AND NOT w.earlier, c.good, 0)) AS good_lost, sum(if(w.fails AND NOT w.earlier, c.toxic, 0)) AS toxic_lost
        FROM (SELECT *, (mask & bit) <> 0 AS fails FROM walk WHERE step > 0) w JOIN {cells} c ON c.mask = w.mask
        GROUP BY c.part, w.prefix, w.step""",
        masks=cells.select("mask").distinct(), cells=cells,
    )
    steps = scratch.write(steps, "steps")
    orders = steps.filter(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
    orders = orders.withColumnRenamed("part", "o_part")
    out = orders.join(steps, (F.col("o_part") == F.col("part")) & (F.left("filter_order", F.col("at")) == F.col("prefix")))
    mine = Window.partitionBy("part", F.right("prefix", F.lit(1)))  # one row an order
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *counts, F.sum("removed").over(mine).alias("shapley"))


def filter_interactions(docs: DataFrame, labels: DataFrame, scratch: Scratch, failures=default_failures, letters: str = "ABCDE", **columns) -> DataFrame:
    """``walk_orders`` over the ``mask_cells`` of documents; the last letter is that of copies."""
    return walk_orders(mask_cells(docs, labels, failures, letters[-1], **columns), letters, scratch)
