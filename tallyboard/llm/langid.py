"""Language identification with bit-sliced Bloom filters over letter trigrams.

The filter is one array of bitmasks: bit l of every cell that an n-gram hashes to is set
for each language l that contains the n-gram. One lookup (an AND of k cells) returns all
languages of an n-gram at once. A document counts, per language, its n-grams with that
bit; from the filter's known fill the share of false positives is taken off, and the
language with most n-grams left wins.

An n-gram belongs to a language if its rate there is at least ``1/ratio`` of its highest
rate in any language and it was seen ``min_count`` times, so stray foreign words and
wrong labels do not fill all the filters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, Scratch, batches, mix64, slices

#: Languages that one mask can hold.
MAX_LANGS = 64

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, parts) of about SLICE_CHARS characters; a longer text comes in several parts.

    Parts overlap by one character on either side, which ``trigrams`` reads as context.
    """
    for start, end in slices([len(t or "") for t in texts]):
        if end - start > 1 or len(texts[start] or "") <= SLICE_CHARS:
            yield np.arange(start, end), [t or "" for t in texts[start:end]]
        else:
            for at in range(0, len(texts[start]), SLICE_CHARS):
                yield np.array([start]), [texts[start][at : at + SLICE_CHARS]]


def trigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the letter trigrams of each part in turn, and how many each part has.

    A trigram is a letter with its neighbours; runs of other characters count as one space.
    """
    text = " " + "\n".join(x.lower() for x in parts) + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    ends = np.flatnonzero(code == 10) if all("\n" not in x for x in parts) else np.cumsum([len(x.lower()) + 1 for x in parts])
    c = np.where(is_letter, code, 32)[keep].astype(np.uint64)
    mid = np.flatnonzero(is_letter[keep])
    keys = (c[mid - 1] << np.uint64(42)) | (c[mid] << np.uint64(21)) | c[mid + 1]
    total = np.concatenate([[0], np.cumsum(is_letter)])
    at = total[np.concatenate([[0], ends])]
    return keys, np.diff(at)


def cells(keys: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    h = mix64(keys)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for j in range(hashes):
        yield ((h + np.uint64(j) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Filters:
    """Languages, the bit-sliced filter and each language's rate of false positives."""

    def __init__(self, langs: list[str], table: np.ndarray, bits: int, hashes: int):
        self.langs, self.table, self.bits, self.hashes = langs, table, bits, hashes
        fill = [float(((table >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.false = np.array([f**hashes for f in fill])

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams found for each language, and n-grams in all."""
        found = np.zeros((len(texts), len(self.langs)), np.int64)
        total = np.zeros(len(texts), np.int64)
        for rows, parts in pieces(texts):
            keys, n = trigrams(parts)
            mask = np.full(len(keys), np.uint64(2**64 - 1))
            for cell in cells(keys, self.bits, self.hashes):
                mask &= self.table[cell]
            at = np.concatenate([[0], np.cumsum(n)])
            for i in range(len(self.langs)):
                run = np.concatenate([[0], np.cumsum((mask >> np.uint64(i)) & np.uint64(1), dtype=np.int64)])
                found[rows, i] += np.diff(run[at])
            total[rows] += n
        return found, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, total = self.counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        real = np.clip((found - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0, None)
        best = real.argmax(axis=1)  # ties: the first language in order
        score = np.clip(real[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [self.langs[b] if n else "und" for b, n in zip(best, total)], np.where(total > 0, score, 0.0)


def fit(labelled: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_per_lang: int = 3000, bits: int = 17, hashes: int = 3, ratio: float = 4.0, min_count: int = 3) -> Filters:
    """Filters learned from about ``sample_per_lang`` labelled texts of each language.

    The sample is those rows of a language whose id hash lies below a share that gives
    the number wanted, so it is the same on each run. Rows with a null text or label are
    left out. Raises ValueError beyond 64 languages.
    """
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna(subset=["text", "lang"])
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(per) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(per)
    if not langs:
        return Filters([], np.zeros(1 << bits, np.uint64), bits, hashes)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_per_lang / per[lang]))])
    rank = (F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30))
    index = {lang: i for i, lang in enumerate(langs)}

    def grams(batch: pa.RecordBatch):
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(labels)):
            mine = [t for t, x in zip(texts, labels) if x == lang]
            for _, parts in pieces(mine):
                keys, n = np.unique(trigrams(parts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), index[lang], np.int32)), pa.array(n.astype(np.int64))], ["key", "lang", "n"])

    counts = rows.filter(rank < share[F.col("lang")]).select("text", "lang").mapInArrow(batches(grams), "key long, lang int, n long")
    counts = scratch.write(counts.groupBy("key", "lang").agg(F.sum("n").alias("n")), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all_n"))
    rated = counts.join(F.broadcast(totals), "lang")  # one row a language, 64 at most
    rated = rated.withColumn("rate", F.col("n") / F.col("all_n"))
    top = rated.groupBy("key").agg(F.max("rate").alias("top"))
    members = rated.join(top, "key").filter((F.col("rate") * ratio >= F.col("top")) & (F.col("n") >= min_count))
    masks = members.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, lang)")).alias("mask"))

    def to_cells(batch: pa.RecordBatch):
        keys, mask = batch.column(0).to_numpy().astype(np.uint64), batch.column(1)
        for cell in cells(keys, bits, hashes):
            yield pa.RecordBatch.from_arrays([pa.array(cell), mask], ["cell", "mask"])

    sliced = masks.mapInArrow(batches(to_cells), "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toPandas()  # 2^bits rows at most
    table = np.zeros(1 << bits, np.uint64)
    table[sliced["cell"].to_numpy()] = sliced["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Filters(langs, table, bits, hashes)


def detect(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``und`` with score 0 if no letter is found.

    Null and empty texts have no letters. Repeated rows each get their row. Very long
    texts are read in parts, whole. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2^bits masks of 8 bytes

    def run(batch: pa.RecordBatch):
        langs, score = shared.value.predict(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(batches(run), f"doc_id {kind}, lang_pred string, score double")
