"""Language-model scores by stupid backoff over bigrams of all words, as a join with count tables.

S(w | v) = c(v w) / c(v) where the bigram occurs outside the row that is scored, else
0.4 c(w) / N; a word that occurs nowhere else counts as one. One rule holds for every count:
the row's own words and bigrams are left out (of N, too), so no text is evidence for itself.
A text starts after ``<s>``. No word and no bigram is left out of the counts.

1. Rows are dealt into blocks of bounded size. Each distinct n-gram of a block is one entry
   with its count there, so a key, however common in the corpus, has one entry a block: no
   key is hot. Entries are shuffled as arrays, one row for each block and hash bucket; as rows
   of their own they shuffle twice the bytes.
2. Within the buckets they are exploded. The count table is their sum by key, and it is
   joined back to the entries where they are: a window over the key, which needs no further
   shuffle. An n-gram of one block only has no count elsewhere and ends here.
3. Counts of the others go back to their blocks, where each token is scored and the tokens of
   a row are summed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64

BACKOFF = 0.4
#: Characters of text in one block; a longer text is a block of its own.
BLOCK_CHARS = 4 << 20
ENTRIES = "bucket int, block long, hi array<int>, lo array<smallint>, n array<int>"

BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.binary()), ("words", pa.int64())])


def _words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Block:
    """The n-grams of a block: for each token its row, word, word before and bigram, as numbers.

    ``keys`` are the 64-bit hashes of all distinct n-grams, words first (``<s>`` is number 0)
    and bigrams after them. ``counts`` are theirs in the block.
    """

    def __init__(self, texts: list[str | None]):
        ids = {b"": 0}
        number = ids.setdefault
        rows = [np.array([number(x, len(ids)) for x in _words(t)], np.int32) for t in texts]
        self.lens = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), self.lens)
        self.w = np.concatenate([np.zeros(0, np.int32), *rows])
        del rows
        word = np.fromiter((xxhash.xxh64_intdigest(x) for x in ids), np.uint64, len(ids))
        self.n_words = len(ids)
        ids.clear()
        self.starts = (np.cumsum(self.lens) - self.lens)[self.lens > 0]
        self.v = self._before(self.w, 0)
        n_words = np.bincount(self.w, minlength=len(word))
        n_words[0] = len(self.starts)
        grams, g, n_grams = np.unique(self.v.astype(np.int64) << 32 | self.w, return_inverse=True, return_counts=True)
        self.g = g.astype(np.int32)
        gram = mix64(word[grams >> 32] * np.uint64(0x9E3779B97F4A7C15) + mix64(word[grams & 0xFFFFFFFF], 1), 2)
        self.keys, self.counts = np.concatenate([word, gram]), np.concatenate([n_words, n_grams])

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the keys, the buckets that hold some, and where each begins (and the last ends)."""
        order = np.argsort(self.keys, kind="stable")
        of = (self.keys[order] >> np.uint64(64 - bits)).astype(np.int32)
        cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
        return order, of[cuts[:-1]], cuts

    def _before(self, x: np.ndarray, at_start: int) -> np.ndarray:
        """The value of each token's predecessor, ``at_start`` for the first of a row."""
        out = np.roll(x, 1)
        out[self.starts] = at_start
        return out

    def _own(self, x: np.ndarray, kinds: int) -> np.ndarray:
        """How often each token's value occurs in the token's row."""
        _, at, n = np.unique(self.row.astype(np.int64) * max(kinds, 1) + x, return_inverse=True, return_counts=True)
        return n[at]

    def score(self, counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log S, tokens that backed off) of each row, from the corpus counts of ``keys``."""
        own_w = self._own(self.w, self.n_words)
        c_g = counts[self.n_words :][self.g] - self._own(self.g, len(counts) - self.n_words)
        c_v = counts[self.v] - self._before(own_w, 1)
        c_w = np.maximum(counts[self.w] - own_w, 1)
        rest = np.maximum(total - self.lens[self.row], 1)
        seen = c_g > 0
        s = np.log(np.where(seen, c_g / np.maximum(c_v, 1), BACKOFF * c_w / rest))
        return np.bincount(self.row, s, len(self.lens)), np.bincount(self.row, ~seen, len(self.lens)).astype(np.int64)


def _pack(texts: list[str | None]) -> bytes:
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return zstandard.compress(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts), 3)


def _unpack(blob: bytes, n: int) -> list[str]:
    raw = zstandard.decompress(blob)
    ends = 8 * n + np.cumsum(np.frombuffer(raw[: 8 * n], np.int64))
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([8 * n, *ends[:-1]], ends)]


def deal_blocks(docs: DataFrame, scratch: Scratch, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, ids, texts, words): the rows of (doc_id, text) in written blocks, texts compressed."""

    def run(stream):
        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def emit():
            row = {"block": block, "ids": ids, "texts": _pack(texts), "words": sum(len(_words(t)) for t in texts)}
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for b in stream:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size = len(text) if text else 0
                if ids and held + size > block_chars:
                    yield emit()
                    block, ids, texts, held = block + 1, [], [], 0
                ids.append(doc)
                texts.append(text)
                held += size
        if ids:
            yield emit()

    return scratch.write(docs.mapInArrow(run, "block long, ids array<long>, texts binary, words long"), "blocks")


def ngram_entries(blocks: DataFrame, bits: int) -> DataFrame:
    """ENTRIES: the distinct words and bigrams of each block in 2^bits buckets by hash.

    The bucket is the top of the hash, ``hi`` and ``lo`` are the next 48 bits.
    """

    def run(stream):
        for b in stream:
            for i in range(b.num_rows):
                block, ids, blob = (c[i].as_py() for c in b.columns)
                grams = Block(_unpack(blob, len(ids)))
                order, buckets, cuts = grams.buckets(bits)
                keys, cuts = grams.keys[order] << np.uint64(bits), pa.array(cuts, pa.int32())
                columns = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32), (keys >> np.uint64(16)).astype(np.uint16).view(np.int16), grams.counts[order].astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), block)), *lists], ["bucket", "block", "hi", "lo", "n"])

    return blocks.select("block", "ids", "texts").mapInArrow(run, ENTRIES)


def counts_elsewhere(entries: DataFrame) -> DataFrame:
    """(bucket, block, at, at_high, c, c_high): of n-grams in more than one block, their counts in the others.

    ``at`` are places in the arrays of the block and bucket, ``c`` the counts of those. Both
    come as their lowest 15 bits and the rest, which is mostly 0 and so costs no shuffle.
    """
    spread = entries.repartition("bucket").select("bucket", "block", F.posexplode(F.arrays_zip("hi", "lo", "n")).alias("at", "g"))
    ngrams = spread.select("bucket", "block", "at", (F.col("g.hi").cast("long") * 65536 + F.col("g.lo")).alias("key"), "g.n")
    same = Window.partitionBy("key", "bucket")  # sorted by the key, most of which is in the sort's prefix
    joined = ngrams.withColumn("c", F.sum("n").over(same)).withColumn("blocks", F.count("*").over(same)).filter("blocks > 1")
    back = joined.select("bucket", "block", "at", (F.col("c") - F.col("n")).alias("c"))
    halves = [h for x in ("at", "c") for h in (F.collect_list(F.expr(f"CAST({x} & 32767 AS SMALLINT)")).alias(x), F.collect_list(F.expr(f"shiftright({x}, 15)")).alias(f"{x}_high"))]
    return back.groupBy("bucket", "block").agg(*halves)


def _score_block(total: int, bits: int):
    def run(texts: pa.Table, elsewhere: pa.Table) -> pa.Table:
        ids = texts.column("ids")[0].as_py()
        block = Block(_unpack(texts.column("texts")[0].as_py(), len(ids)))
        order, buckets, cuts = block.buckets(bits)
        counts = block.counts[order]
        for part in elsewhere.to_batches():
            start = cuts[np.searchsorted(buckets, part.column("bucket").to_numpy())]
            at, c = (part.column(f"{x}_high").flatten().to_numpy().astype(np.int64) << 15 | part.column(x).flatten().to_numpy() for x in ("at", "c"))
            counts[np.repeat(start, part.column("at").value_lengths().to_numpy()) + at] += c
        whole = np.zeros(len(order), np.int64)
        whole[order] = counts
        sums, backs = block.score(whole, total)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(block.lens), "n_backoff": pa.array(backs), "s": pa.array(sums)})

    return run


def score(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, n_backoff, log_score, score) of every row.

    ``log_score`` is the sum of log S over the words, ``score`` its mean. A null, empty or
    blank text has no words and scores 0. Rows that repeat an id or have none are rows of their
    own, and each is evidence for the others. Other columns are ignored, whatever their names;
    an empty table gives an empty result. Memory follows a block, or the longest text.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = deal_blocks(d, scratch, block_chars)
    n_blocks, total = blocks.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    # a bucket has about as many entries as 16 blocks; fewer where the corpus is small
    bits = max(10, math.ceil(math.log2(max(n_blocks, 1))) - 4)
    back = counts_elsewhere(ngram_entries(blocks, bits))
    rows = blocks.select("block", "ids", "texts").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score_block(total, bits), "doc_id long, n_tokens long, n_backoff long, s double")
    log_score = F.round("s", 6)
    mean = F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).otherwise(0.0)
    return rows.select("doc_id", "n_tokens", "n_backoff", log_score.alias("log_score"), mean.alias("score"))
