"""Toxicity by multiple-instance learning: documents carry labels, sentences carry the cause.

A sentence's probability is logistic in the vocabulary features (words and word beginnings)
that it has; a document's
score is the noisy-or of its sentences, 1 - prod(1 - p). Only documents are labelled: the
gradient of their likelihood reaches the sentences, and the trained model then names the
offending ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches

SENTENCE = re.compile(r"[^.!?\n。！？]+")
WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that count as features beside the word itself.
STEMS = (4, 5, 6, 7)
#: Words whose features a worker remembers.
CACHE = 100_000


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


class Lookup(dict):
    """Vocabulary ids of a word's features, remembered for up to CACHE words."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.vocab[f] for f in features(word) if f in self.vocab)
        if len(self) < CACHE:
            self[word] = ids
        return ids

    def __reduce__(self):
        return Lookup, (self.vocab,)


def sentence_words(text: str | None, lookup: Lookup) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """Number of sentences with a word, and (start, end, vocabulary ids) of those with such a word."""
    if not text:
        return 0, []
    n, found = 0, []
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m.group().lower())
        if words:
            n += 1
            hits = {i for w in words for i in lookup[w]}
            if hits:
                found.append((m.start(), m.end(), sorted(hits)))
    return n, found


class Model:
    """Word weights and bias of a sentence's log-odds."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.vocab = {w: i for i, w in enumerate(sorted(weights))}
        self.lookup = Lookup(self.vocab)
        self.w = np.array([weights[x] for x in sorted(weights)], float)
        self.bias = bias

    def score(self, text: str | None, threshold: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and (start, end, probability) of the sentences at the threshold."""
        n, found = sentence_words(text, self.lookup)
        base = 1 / (1 + np.exp(-self.bias))
        clean = (n - len(found)) * np.log1p(-base)
        spans = []
        for start, end, ids in found:
            p = 1 / (1 + np.exp(-(self.bias + self.w[ids].sum())))
            clean += np.log1p(-min(p, 1 - 1e-12))
            if p >= threshold:
                spans.append((start, end, float(p)))
        return float(-np.expm1(clean)), spans


def fit_noisy_or(doc: np.ndarray, sent_words: list[np.ndarray], n_plain: np.ndarray, y: np.ndarray, weight: np.ndarray, n_vocab: int, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Word weights and bias that maximise the weighted likelihood of the document labels.

    doc[s] is the document of sentence s, sent_words[s] its vocabulary ids; n_plain[d]
    counts the sentences of document d without a vocabulary word. Adam on full batches.
    """
    at = np.repeat(np.arange(len(sent_words)), [len(x) for x in sent_words])
    ids = np.concatenate(sent_words) if sent_words else np.zeros(0, int)
    theta, b = np.zeros(n_vocab + 1), -4.0
    theta[-1] = b
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(at, theta[ids], len(sent_words))
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        log_clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + n_plain * np.log1p(-base)
        clean = np.exp(np.minimum(log_clean, -1e-12))
        pull = weight * np.where(y == 1, clean / np.maximum(1 - clean, 1e-12), -1.0)
        g = pull[doc] * p
        grad = np.append(np.bincount(ids, g[at], n_vocab), g.sum() + (pull * n_plain * base).sum()) / total
        grad[:-1] -= l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_per_class: int = 3000, vocab_size: int = 2000, min_docs: int = 4, min_z: float = 5.0) -> Model:
    """A model from about ``sample_per_class`` labelled documents of each class.

    Label rows with a null id or label are left out; a document with several label rows is
    toxic if one of them says so. The sample is chosen by a hash of the id and weighted
    back to the classes' shares. Without labels of both classes the score is below 1e-9 a sentence.
    The vocabulary is the ``vocab_size`` features whose document counts differ most between
    the classes, by ``min_z`` standard errors at least; equal texts count once. All that reaches the driver is bounded by these parameters.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("i"), (F.col(label_col) > 0).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    lab = scratch.write(lab, "labels")
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model({}, -40.0)
    share = F.when(F.col("y") == 1, min(1.0, sample_per_class / n[1])).otherwise(min(1.0, sample_per_class / n[0]))
    chosen = lab.filter(F.pmod(F.xxhash64("i", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30) < share)
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i")  # about 2 x sample_per_class ids
    text = scratch.write(text.groupBy("text").agg(F.min("i").alias("i"), F.max("y").alias("y")), "sample")

    def words(batch: pa.RecordBatch):
        out_w, out_y = [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mine = {f for w in set(WORD.findall((t or "").lower())) for f in features(w)}
            out_w += mine
            out_y += [y] * len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.string()), pa.array(out_y, pa.int32())], ["w", "y"])

    seen = {r["y"]: r["n"] for r in text.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model({}, -40.0)
    df = text.select("text", "y").mapInArrow(batches(words), "w string, y int").groupBy("w").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    # difference of the two rates in its standard errors
    p1, p0, p = F.col("pos") / float(seen[1]), (F.col("n") - F.col("pos")) / float(seen[0]), F.col("n") / float(seen[0] + seen[1])
    gap = F.abs(p1 - p0) / F.sqrt((p * (1 - p) + 1e-9) * (1 / seen[1] + 1 / seen[0]))
    picked = [r["w"] for r in df.filter((F.col("n") >= min_docs) & (gap >= min_z)).orderBy(gap.desc(), "w").limit(vocab_size).collect()]
    vocab = {w: i for i, w in enumerate(sorted(picked))}
    lookup = Lookup(vocab)

    def sentences(batch: pa.RecordBatch):
        plain, ys, sents = [], [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            k, found = sentence_words(t, lookup)
            plain.append(k - len(found))
            ys.append(y)
            sents.append([ids for _, _, ids in found])
        yield pa.RecordBatch.from_arrays([pa.array(plain, pa.int64()), pa.array(ys, pa.int32()), pa.array(sents, pa.list_(pa.list_(pa.int32())))], ["plain", "y", "sents"])

    rows = text.orderBy("i").select("text", "y").mapInArrow(batches(sentences), "plain long, y int, sents array<array<int>>").toArrow()
    scratch.drop(text, lab)
    plain, y = rows.column("plain").to_numpy(), rows.column("y").to_numpy()
    lists = rows.column("sents").to_pylist()
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    sent = [np.array(s) for x in lists for s in x]
    weight = np.where(y == 1, n[1] / seen[1], n[0] / seen[0])
    w, bias = fit_noisy_or(doc, sent, plain, y, weight, len(vocab))
    return Model({x: float(w[i]) for x, i in vocab.items()}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, offending) for every row; offending: array of (start, end, probability).

    A null or empty text, or one without words, scores 0. Offsets are code points of the
    whole text. Repeated rows each get their row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocab_size words
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batch: pa.RecordBatch):
        got = [shared.value.score(t, threshold) for t in batch.column(1).to_pylist()]
        spans = [[{"start": a, "end": b, "p": p} for a, b, p in x[1]] for x in got]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array(spans, span)], ["doc_id", "score", "offending"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(batches(run), f"doc_id {kind}, score double, offending array<struct<start: long, end: long, p: double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocab_size words

    def run(batch: pa.RecordBatch):
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        yield batch.filter(pa.array([shared.value.score(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(batches(run), docs.schema)
