"""Quality by a generalised additive model with pairwise interactions, of boosted shallow trees.

A text becomes a row of surface measures (lengths, shares of kinds of characters, repetition).
Each measure is cut into bins, and the model is one table of additions per measure, and one per
chosen pair of measures: a text's log-odds are the intercept plus what its bins say. Tables are
learned by cyclic boosting: round after round, one measure after the other gets a tree of at most
four leaves over its bins, fitted to what the model still has wrong and added in small steps, so
correlated measures share the credit. When that is done the pairs whose joint trees would explain
most of the rest get tables in the same way. Scoring looks up and adds, a batch at a time.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, Scratch, batches

#: The measures of a text, in the order of ``measure``.
MEASURES = (
    "log_chars", "log_words", "word_length", "capitals", "digits", "marks", "stops", "other_marks", "blanks", "line_ends", "beyond_ascii", "byte_entropy",
    "distinct_words", "top_word", "word_again", "marked_words", "shouted_words", "distinct_lines",
)


def _kinds() -> np.ndarray:
    """The kind of each byte: a row of ones and zeros per kind."""
    groups = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*|<>=^~\\{}@_", ".!?", ",;:'\"()[]-/+`", " \t\r\f\v", "\n")
    table = np.zeros((len(groups) + 1, 256))
    for i, g in enumerate(groups):
        table[i, [ord(c) for c in g]] = 1
    table[-1, 128:] = 1
    return table


KINDS = _kinds()
#: A slice of a long text ends behind a blank where one follows soon, so that words stay whole.
BLANK = re.compile(r"\s")
#: Words are cut there, for memory; in no language are they that long.
LONGEST_WORD = 4096


def _slices(text: str):
    at = 0
    while at < len(text):
        end = at + SLICE_CHARS
        if end < len(text):
            m = BLANK.search(text, end, end + LONGEST_WORD)
            end = m.end() if m else end + LONGEST_WORD
        yield text[at:end]
        at = end


def measure(text: str | None) -> list[float]:
    """The measures of a whole text; a null or empty one has zeros.

    A long text is gone through in slices, of which only counts are kept: bytes, distinct words
    and hashes of distinct lines.
    """
    counts, words, lines = np.zeros(256, np.int64), Counter(), set()
    n_chars = n_words = n_lines = again = marked = shouted = length = 0
    last = None
    for part in _slices(text or ""):
        n_chars += len(part)
        counts += np.bincount(np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        got = part.split()
        words.update(got)
        again += sum(a == b for a, b in zip(got, itertools.chain((last,), got)))
        last = got[-1] if got else last
        here = [x for x in part.split("\n") if x.strip()]
        n_lines += len(here)
        lines.update(map(hash, here))
    for w, n in words.items():
        n_words += n
        length += n * len(w)
        marked += n * (not w[-1].isalnum() and w[-1] not in ".,;:!?'\")")
        shouted += n * (len(w) > 1 and w.isupper())
    total, nw = max(int(counts.sum()), 1), max(n_words, 1)
    share = counts / total
    used = share[share > 0]
    return [
        float(np.log1p(n_chars)), float(np.log1p(n_words)), length / nw, *(KINDS @ share).tolist(), float(-(used * np.log2(used)).sum()),
        len(words) / nw, max(words.values(), default=0) / nw, again / nw, marked / nw, shouted / nw, len(lines) / max(n_lines, 1),
    ]


def measures(texts) -> np.ndarray:
    return np.array([measure(t) for t in texts], float).reshape(-1, len(MEASURES))


class Model:
    """Cuts and additions of each measure, and of pairs of measures."""

    def __init__(self, intercept: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int]] | None = None, pair_cuts: list[np.ndarray] | None = None, pair_tables: list[np.ndarray] | None = None):
        self.intercept, self.cuts, self.tables = intercept, cuts, tables
        self.pairs, self.pair_cuts, self.pair_tables = pairs or [], pair_cuts or [], pair_tables or []

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of measures: bins looked up, additions summed, for all rows at once."""
        z = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, f], "right")]
        coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.pair_cuts)]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 cuts, between different values, with about as many rows in each bin."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g, h, l2):
    return g * g / (h + l2)


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """The gain and place of the cut of binned sums that explains most; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, l2) + _gain(gr, hr, l2) - _gain(g.sum(), h.sum(), l2), 0.0)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, l2: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Additions to the bins by a tree of depth two: one cut, then one in each side."""
    edges = {0, len(g)}
    cut = _best_cut(g, h, l2, least)[1]
    if cut:
        edges |= {cut, _best_cut(g[:cut], h[:cut], l2, least)[1], cut + _best_cut(g[cut:], h[cut:], l2, least)[1]}
    out, edges = np.zeros(len(g)), sorted(edges)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def shallow_pair_tree(g: np.ndarray, h: np.ndarray, l2: float = 1.0, least: float = 2.0) -> tuple[float, np.ndarray]:
    """Gain and additions over a grid of bins: one cut of one measure, then one of the other in each side."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(gg)):
            gain, table = 0.0, np.zeros_like(gg)
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[side].sum(0), hh[side].sum(0)
                more, at = _best_cut(gs, hs, l2, least)
                gain += more + _gain(gs.sum(), hs.sum(), l2)
                for p in (slice(0, at), slice(at, None)):
                    table[side, p] = gs[p].sum() / (hs[p].sum() + l2)
            gain -= _gain(g.sum(), h.sum(), l2)
            if gain > best:
                best, out = gain, table.T if turn else table
    return best, out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int = 32, pair_bins: int = 8, n_pairs: int = 8, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.1) -> Model:
    """A model of the rows of measures with labels 0 or 1; the weights keep the classes' shares."""
    weight = weight / weight.mean()
    prior = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    z = np.full(len(y), np.log(prior / (1 - prior)))
    n = x.shape[1]
    cuts = [quantile_cuts(x[:, f], bins) for f in range(n)]
    at = [np.searchsorted(cuts[f], x[:, f], "right") for f in range(n)]
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def pull():
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(n):
            g, h = pull()
            add = rate * shallow_tree(np.bincount(at[f], g, len(tables[f])), np.bincount(at[f], h, len(tables[f])))
            tables[f] += add
            z += add[at[f]]
    coarse_cuts = [quantile_cuts(x[:, f], pair_bins) for f in range(n)]
    coarse = [np.searchsorted(coarse_cuts[f], x[:, f], "right") for f in range(n)]
    shape = [len(c) + 1 for c in coarse_cuts]

    def grid(a, b, v):
        return np.bincount(coarse[a] * shape[b] + coarse[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = pull()
    gains = [(shallow_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in itertools.combinations(range(n), 2)]
    pairs = [(a, b) for gain, a, b in sorted(gains, key=lambda t: (-t[0], t[1:]))[:n_pairs] if gain > 0]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(pairs):
            g, h = pull()
            add = rate * shallow_pair_tree(grid(a, b, g), grid(a, b, h))[1]
            pair_tables[k] += add
            z += add[coarse[a], coarse[b]]
    return Model(float(np.log(prior / (1 - prior))), cuts, tables, pairs, coarse_cuts, pair_tables)


def _measured(batch: pa.RecordBatch) -> pa.Array:
    x = measures(batch.column(1).to_pylist())
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(MEASURES)).cast(pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_class: int = 5000, **boosting) -> Model:
    """A model from about ``sample_per_class`` labelled documents of each class.

    Label rows with a null id or label are left out; an id with several is good if one says so.
    The sample is drawn by a hash of the id and weighted back to the classes' shares; equal texts
    count once. Texts are measured in tasks; what reaches the driver is a row of measures for each
    sampled text. Without labels of both classes every score is the share of good ones, smoothed.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("i"), (F.col(label_col) > 0).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    lab = scratch.write(lab, "labels")
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) == 2:
        share = F.when(F.col("y") == 1, min(1.0, sample_per_class / n[1])).otherwise(min(1.0, sample_per_class / n[0]))
        chosen = lab.filter(F.pmod(F.xxhash64("i", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30) < share)
        text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i")  # about 2 x sample_per_class ids

        def run(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _measured(batch)], ["key", "y", "x"])

        # measured where they lie; equal texts have equal measures, and one hash
        got = text.select(F.xxhash64("text").alias("key"), "text", "y").mapInArrow(batches(run), "key long, y int, x array<double>")
        rows = got.groupBy("key").agg(F.max("y").alias("y"), F.first("x").alias("x")).orderBy("key").toArrow()
        y = rows.column("y").to_numpy()
        if 0 < y.sum() < len(y):
            x = np.array(rows.column("x").to_pylist(), float)
            weight = np.where(y == 1, n[1] / y.sum(), n[0] / (len(y) - y.sum()))
            scratch.drop(lab)
            return boost(x, y, weight, **boosting)
    scratch.drop(lab)
    share = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    return Model(float(np.log(share / (1 - share))), [], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, null and empty texts and repeated rows included.

    The score depends on the text alone; other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins of a few measures

    def run(batch: pa.RecordBatch):
        x = measures(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(batches(run), f"doc_id {kind}, score double")
