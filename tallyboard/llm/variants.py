"""Spelling variants: words one character apart, found by permuterm rotations.

A word is marked with a terminator and rotated: ``cat`` gives ``cat|``, ``at|c``, ``t|ca`` and
``|cat``. Words that differ by one replaced character share, for the rotation that ends in it, all
before that end; a word with one character more shares that same prefix with a whole rotation of
the shorter word. So each rotation is filed under itself and under its prefix without the last
character (unless that is the terminator), the file is sorted, and each group of equal keys is
scanned: it holds at most one word for each character there is, whatever the number of words, and
every two of its words are near. A scan emits, for each word, how many near words its group has
and the most frequent one of them.

A character dropped from a run of equal ones gives the same word wherever in the run it stood;
only the drop at the run's end counts, so each pair of near words meets in exactly one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks the end of a word; no word may hold it.
END = "\u0000"
#: How a rotation stands in its group: as itself, by its prefix, or by a prefix that counts for replacements only.
WHOLE, DROPPED, REPLACED = 0, 1, 2


def count_words(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, least_chars: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z in lower case, that are long and frequent enough.

    ``change(id, run)`` gives the word that is counted for a run. A null text has no run. Counts
    are added up within tasks before the shuffle, so a frequent word is a row a task.
    """
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(key, role, first, word, n): every rotation of each marked word, under itself and under its prefix.

    ``first`` marks one row of each word.
    """
    marked, at = F.concat("word", F.lit(END)), F.col("at")
    d = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    turned = F.concat(F.substring(marked, at + 1, F.length("word") + 1), F.substring("word", F.lit(1), at))
    dropped = F.substring(turned, F.lit(1), F.length("word"))
    same = F.substring("word", at, F.lit(1)) == F.substring(marked, at + 1, F.lit(1))
    whole = F.struct(turned.alias("key"), F.lit(WHOLE).alias("role"), (at == 0).alias("first"))
    part = F.struct(dropped.alias("key"), F.when(same, REPLACED).otherwise(DROPPED).alias("role"), F.lit(False).alias("first"))
    return d.select("word", "n", F.inline(F.when(at == 0, F.array(whole)).otherwise(F.array(whole, part)))).select("key", "role", "first", "word", "n")


def scan_groups(filed: DataFrame) -> DataFrame:
    """(word, n, near, best) for each row of ``rotations`` with near words in its group, and for first rows.

    near counts the others of the group that are one edit away; best, struct(less, word), is the one
    of largest n, of equal ones the first by code points; less is -n.
    """
    prefix = F.col("role") != WHOLE
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    group = Window.partitionBy("key")
    d = filed.withColumn("place", F.row_number().over(group.orderBy((F.col("role") == WHOLE).cast("int"), F.desc("n"), "word")))

    def over(agg, when: Column, value: Column) -> Column:
        return agg(F.when(when, value)).over(group)

    shared = {
        "best_1": over(F.min, prefix, me), "best_2": over(F.min, prefix & (F.col("place") > 1), me), "best_d": over(F.min, F.col("role") == DROPPED, me), "best_w": over(F.min, ~prefix, me),
        "n_p": over(F.count, prefix, F.lit(1)), "n_d": over(F.count, F.col("role") == DROPPED, F.lit(1)), "n_w": over(F.count, ~prefix, F.lit(1)),
    }
    d = d.select("word", "n", "first", "role", "place", *[c.alias(k) for k, c in shared.items()])
    other = F.when(F.col("place") == 1, F.col("best_2")).otherwise(F.col("best_1"))
    near = F.when(~prefix, F.col("n_d")).otherwise(F.col("n_p") - 1 + F.when(F.col("role") == DROPPED, F.col("n_w")).otherwise(0))
    best = F.when(~prefix, F.col("best_d")).when(F.col("role") == DROPPED, F.least(other, F.col("best_w"))).otherwise(other)
    return d.select("word", "n", "first", near.alias("near"), best.alias("best")).filter("near > 0 OR first")


def nearest(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best) of every word: its number of near words, and struct(less, word) of the most frequent."""
    return scan_groups(rotations(words)).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where the chain of forms of each word of ``forms`` (word, form) ends.

    Each round every word looks up where its target had come to, so the steps double; a chain is
    no longer than the logarithm of the largest count, as a form is at least twice as frequent.
    """
    at = scratch.write(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        moved = scratch.write(at.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(at)
        at = moved.select("word", "root")
        at._scratch_path = moved._scratch_path
        if not moved.filter("moved").limit(1).count():
            return at


def group_variants(words: DataFrame, scratch: Scratch, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n; each word once).

    form is the near word of largest n (ties: smallest by code points) if that n is at least
    ``ratio`` (2 or more) times the word's own, else null; root is where following forms ends, the
    word itself if it has none. Null words are left out; an empty table gives an empty result;
    words must not hold ``END``.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent, else chains might not end")
    near = scratch.write(nearest(words.select("word", "n").dropna()), "nearest")
    fits = -F.col("best.less") >= F.col("n") * ratio
    near = near.select("word", F.when(fits, F.col("best.word")).alias("form"), "n", "n_near", F.when(fits, -F.col("best.less")).alias("form_n"))
    ends = roots(near.filter("form IS NOT NULL"), scratch).withColumnRenamed("word", "r_word")
    out = near.join(ends, F.col("word") == F.col("r_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
