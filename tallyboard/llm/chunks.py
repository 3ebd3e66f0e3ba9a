"""Document fingerprints by content-defined chunking with a normalised gear hash.

The gear hash of a position mixes the 32 bytes before it, so a boundary depends on its
surroundings only and chunks come back after an insertion or a shift. Chunking is
normalised: before ``NORMAL`` bytes a boundary needs more zero bits than after it, which
draws chunk lengths together. A fingerprint is the set of chunk digests with their
lengths; likeness is the share of bytes in chunks that both have (weighted resemblance),
containment the share of one side's bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

LEAST, NORMAL, MOST = 8, 24, 96
#: Zero bits that a boundary needs before and after NORMAL bytes.
STRICT, LOOSE = np.uint32((1 << 5) - 1 << 27), np.uint32((1 << 3) - 1 << 29)
GEAR = (mix64(np.arange(256, dtype=np.uint64), 99) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
PART = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


def gear(data: np.ndarray) -> np.ndarray:
    """At each position the sum of GEAR[b] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = np.zeros_like(h)
        more[k:] = h[:-k] << np.uint32(k)
        h = h + more
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks, ascending; the last is the end of the data."""
    strict, loose = [], []
    for at in range(0, len(data), PART):
        lead = min(at, 32)
        h = gear(data[at - lead : at + PART])[lead:]
        some = np.flatnonzero((h & LOOSE) == 0)
        loose.append(some + at + 1)
        strict.append(some[(h[some] & STRICT) == 0] + at + 1)
    loose, strict = np.concatenate([*loose, [1 << 62]]), np.concatenate([*strict, [1 << 62]])
    loose_list, strict_list = loose.tolist(), strict.tolist()
    n, start, i, j, ends = len(data), 0, 0, 0, []
    while n - start > LEAST:
        while strict_list[i] < start + LEAST:
            i += 1
        end = strict_list[i]
        if end >= start + NORMAL:
            while loose_list[j] < start + NORMAL:
                j += 1
            end = min(loose_list[j], start + MOST)
        if end >= n:
            break
        ends.append(end)
        start = end
    if n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunk_set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chunk digests (40 bits) of the UTF-8 bytes, ascending, and their bytes in all."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = boundaries(data)
    starts = np.r_[0, ends[:-1]]
    # a polynomial of the bytes, counted from each chunk's start, in 64-bit wrap-around
    age = np.arange(len(data)) - np.repeat(starts, ends - starts)
    value = (data.astype(np.uint64) + np.uint64(1)) * POWERS[age]
    digest = mix64(np.add.reduceat(value, starts) ^ (ends - starts).astype(np.uint64)) >> np.uint64(24)
    ids, index = np.unique(digest, return_inverse=True)
    return ids, np.bincount(index, ends - starts).astype(np.int64)


def _powers() -> np.ndarray:
    out = np.ones(MOST + 1, np.uint64)
    for i in range(1, MOST + 1):
        out[i] = out[i - 1] * _P
    return out


with np.errstate(over="ignore"):
    POWERS = _powers()


def shared_bytes(a, b) -> int:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def likeness(a, b) -> float:
    """Bytes in shared chunks over bytes in either (1 for two empty sets)."""
    total, both = int(a[1].sum() + b[1].sum()), shared_bytes(a, b)
    return both / (total - both) if total else 1.0


def containment(a, b) -> float:
    """The share of a's bytes that lie in chunks that b has too (1 for an empty set)."""
    total = int(a[1].sum())
    return shared_bytes(a, b) / total if total else 1.0


def as_text(chunks) -> str:
    """The set as hex: 10 digits of digest and the bytes in that chunk, joined by commas."""
    return ",".join([f"{d:010x}{n:x}" for d, n in zip(chunks[0].tolist(), chunks[1].tolist())])


def from_text(s: str):
    items = s.split(",") if s else []
    return np.array([int(x[:10], 16) for x in items], np.uint64), np.array([int(x[10:], 16) for x in items], np.int64)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the next (or all it has)."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 2000) -> DataFrame:
    """(doc_id, text, bucket, lead): documents in ranges by id, each with its follower's row.

    Ranges come from approximate quantiles of the ids (one column read). A range also gets
    the first row of the next range in descending order, marked ``lead``; the last range
    gets the very first row. Null texts count as empty; null ids come last.
    """
    from pyspark.ml.feature import Bucketizer

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = d.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("k"))
    n = key.count()
    cuts = sorted(set(key.approxQuantile("k", [i / (n // per_range + 1) for i in range(1, n // per_range + 1)], 0.05 / (n // per_range + 1))) if n > per_range else [])
    splits = [-float("inf"), *cuts, float("inf")]
    d = d.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double"))
    d = (Bucketizer(splits=splits, inputCol="k", outputCol="bucket").transform(d) if cuts else d.withColumn("bucket", F.lit(0.0))).withColumn("bucket", F.col("bucket").cast("int")).drop("k")
    # the first row in descending order of each range; ranges are as many as rows / per_range
    tops = d.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy(F.desc("bucket")).collect()
    if not tops:
        return d.withColumn("lead", F.lit(0))
    before = {tops[i]["bucket"]: tops[i - 1]["bucket"] for i in range(len(tops))}  # the range that precedes, cyclic
    spark = docs.sparkSession
    leads = spark.createDataFrame([(t["bucket"], t["top"], before[t["bucket"]]) for t in tops], "l_bucket int, top long, goes int")
    extra = d.join(F.broadcast(leads), (F.col("bucket") == F.col("l_bucket")) & F.col("doc_id").eqNullSafe(F.col("top")))
    extra = extra.select("doc_id", "text", F.col("goes").alias("bucket"), F.lit(1).alias("lead"))
    return d.withColumn("lead", F.lit(0)).unionByName(extra)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and its containment in that and in the next document.

    The next document has the next smaller id (equal ids: by text), after the last comes the
    first. Null texts are empty; equal texts have equal fingerprints, empty ones the empty
    fingerprint and are contained wholly. A lone document is its own next.
    """

    def row(doc_id, text, mine, after, its):
        e = edited(text, after)
        es = chunk_set(e)
        return (doc_id, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine), as_text(es), containment(mine, es), containment(mine, its))

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(stream):
        held, lead, out, size = None, None, [], 0

        def emit():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def close():
            if held is not None and lead is not None:
                out.append(row(held[1], held[2], held[3], *lead))

        for batch in stream:
            for bucket, doc_id, text, is_lead in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] != bucket:
                    close()
                    held = lead = None
                if is_lead:
                    # ranges end with their lead; of rows that repeat its id the first counts
                    if lead is None:
                        lead = (text, chunk_set(text))
                else:
                    mine = chunk_set(text)
                    if held is not None:
                        out.append(row(held[1], held[2], held[3], text, mine))
                    held = (bucket, doc_id, text, mine)
                size += len(text)
                if size > 1 << 21 and out:
                    yield emit()
                    size = 0
        close()
        if out:
            yield emit()

    d = with_next(docs, id_col, text_col).repartition("bucket").sortWithinPartitions("bucket", "lead", F.desc_nulls_last("doc_id"), "text")
    return d.select("bucket", "doc_id", "text", "lead").mapInArrow(run, SCHEMA)
