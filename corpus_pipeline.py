"""A corpus pipeline of five stages; each returns the columns of ``documents`` but the last.

Every stage works on all rows that the one before kept. Rows are identified by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm import mixing, packing, pii, simhash, tokens, toxicity
from tallyboard.llm.common import Scratch, crc_mod, rows_if_small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _from(scratch: Scratch, out: DataFrame) -> DataFrame:
    """A stage's result, with the scratch tables that it reads."""
    out._scratch = scratch
    return out


def _side(table: DataFrame, most: int) -> DataFrame:
    """A written table for a join with the texts: broadcast if its size allows, so that texts stay where they are."""
    return F.broadcast(table) if rows_if_small(table, most) else table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from labels as in op9.

    Null and empty texts have no sentence and stay; rows that repeat are judged each on its
    own; an empty table stays empty.
    """
    scratch = Scratch(spark, "stage1")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held), scratch)
    return _from(scratch, toxicity.keep_clean(docs.select(*COLUMNS), model))


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with a number for each row, written: ids may be null or repeat, numbers not."""
    return scratch.write(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first row, of each group linked at 0.8 by five-word shingles.

    Rows are told apart by their place, so null and repeated ids do no harm. All texts without
    a word are one group; repeated rows are copies. An empty table stays empty.
    """
    scratch = Scratch(spark, "stage2")
    rows = _numbered(docs, scratch)
    gone = simhash.similar_groups(rows, scratch, id_col="row").filter("group_id <> doc_id").select(F.col("doc_id").alias("row"))
    gone = scratch.write(gone, "gone")
    scratch.keep(rows, gone)
    return _from(scratch, rows.join(_side(gone, 1_000_000), "row", "left_anti").select(*COLUMNS))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by their kind, revealing terms generalised or removed.

    Null texts stay null; every row stays, repeated ones too; n_chars follows the text. An
    empty table stays empty.
    """
    scratch = Scratch(spark, "stage3")
    rows = _numbered(docs, scratch)
    found = pii.sanitise_spans(rows, scratch, id_col="row").filter("size(spans) > 0 OR size(terms) > 0")
    found = scratch.write(found.select(F.col("doc_id").alias("f_row"), pii.bare(F.col("spans")).alias("spans"), "terms"), "found")
    scratch.keep(rows, found)
    joined = rows.join(_side(found, 200_000), F.col("row") == F.col("f_row"), "left")
    text = F.when(F.col("f_row").isNull(), F.col("text")).otherwise(pii.mask(F.col("text"), F.col("spans"), F.col("terms")))
    return _from(scratch, joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    A null source is a source of its own; null and empty texts have size 0 and are taken with
    the rest. Rows that repeat an id are taken together. An empty table stays empty.
    """
    scratch = Scratch(spark, "stage4")
    return _from(scratch, mixing.take(docs.select(*COLUMNS), scratch))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1,024 tokens, with their ids (little-endian, of the width of the vocabulary).

    A null or empty text is one token; rows that repeat are documents of their own; null ids
    are kept. An empty table gives no piece.
    """
    scratch = Scratch(spark, "stage5")
    pieces = packing.pack(docs, scratch, tokens.vocabulary_path("byte_bpe_50k.json"), keep_ids=True).pieces
    return _from(scratch, pieces.select("doc_id", "start", "length", "sequence_id", "offset", "ids"))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("private data", mask_private), ("source mix", mix_sources), ("packing", pack_sequences)]

#: Learned models and shingle links are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's scratch tables, and the result of the stage before, go once its own is written.
    """
    results = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = results.write(out, name.replace(" ", "-"))
        results.keep(docs)
        out._scratch.clear()
    return docs
