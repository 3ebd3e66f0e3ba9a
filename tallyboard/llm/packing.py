"""Packing token sequences by cutting-stock column generation.

Documents are cut every ``size`` tokens; full pieces are sequences of their own, and the
remainders are packed. The linear program runs over patterns (multisets of remainder
length bins that fit a sequence) with one row a bin, so it is bounded by ``size`` whatever
the corpus; a knapsack by dynamic programming prices new columns. Its patterns are rounded
down, then up where the lengths left allow; what still is left, a few pieces a pattern, is
laid end to end and cut to fit. Documents of a bin are ranked, and a pattern takes a run of
ranks of each of its bins.

A sequence is padded to ``size`` unless its length is a power of two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, batches
from .tokens import dtype_of, encoder

#: Documents ranked within one task; their number of groups follows from the rows.
CHUNK = 20_000


def price(lengths: np.ndarray, value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits, by dynamic programming: (value, counts)."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(int(lengths[0]), size + 1):
        got = best[c - lengths[: fits[c]]] + value[: fits[c]]
        k = int(got.argmax())
        if got[k] > best[c - 1]:
            best[c], last[c] = got[k], k
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(lengths)), size
    while c > 0:
        if last[c] >= 0:
            out[last[c]] += 1
            c -= lengths[last[c]]
        else:
            c -= 1
    return float(best[size]), out


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x without BLAS, whose threads may hang in a process that has started a JVM."""
    return np.einsum("ij,j->i", a, x)


def patterns(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 5e-4, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(columns, times) of the linear program: the fewest sequences for ``demand`` of ``lengths``.

    Revised simplex steps, each with the column that the knapsack finds for the current
    prices. Ends within ``gap`` (or one sequence) of the bound by the columns or by the tokens, or after ``most`` columns.
    """
    d = demand + np.random.default_rng(0).random(len(lengths)) * 1e-5  # keeps steps from stalling
    # start: copies of one length, but two that fill a sequence together share it as far as both last
    cols = np.diag((size // lengths).astype(float))
    at, pairs = {int(n): i for i, n in enumerate(lengths)}, []
    for i, n in enumerate(lengths):
        j = at.get(size - int(n))
        if j is not None and j < i:
            k = i if d[i] <= d[j] else j
            cols[:, k] = 0
            cols[[i, j], k] = 1
            pairs.append((k, i + j - k))
    inv = np.diag([1 / cols[i, i] for i in range(len(cols))])
    for k, other in pairs:
        inv[other, k] = -inv[other, other]
    least = float((d * lengths).sum()) / size
    for step in range(most):
        y = inv.sum(axis=0)
        worth, col = price(lengths, y, size)
        now = float((y * d).sum())
        least = max(least, now / worth)
        if now - least <= max(gap * now, 1.0):
            break
        move, x = times(inv, col), times(inv, d)
        ratio = np.where(move > 1e-9, x / np.maximum(move, 1e-9), np.inf)
        out = int(ratio.argmin())
        cols[:, out] = col
        row = inv[out] / move[out]
        inv -= np.multiply.outer(move, row)
        inv[out] = row
    x = times(inv, d)
    return cols, np.maximum(x + times(inv, d - times(cols, x)), 0)


def layout(hist: pd.DataFrame, size: int, width: int = 4) -> tuple[pd.DataFrame, int, dict]:
    """Where each rank of each bin goes.

    ``hist`` has (length, n) for exact lengths; a bin holds ``width`` lengths and counts as its
    largest. Pieces are ranked within their bin, shorter ones first. Returns rows (bin, lo, hi,
    per, seq, sub, len, at): ranks lo..hi-1 lie ``per`` to a sequence from sequence ``seq`` on,
    whole; ``at`` is -1 there. Rows of a single rank with ``at`` set hold ``len`` tokens from
    ``sub`` on, at that offset. Then the number of sequences and some totals.
    """
    names = ["bin", "lo", "hi", "per", "seq", "sub", "len", "at"]
    exact = np.zeros(size + width, np.int64)
    exact[hist["length"].to_numpy(np.int64)] = hist["n"].to_numpy(np.int64)
    demand_of = exact[1 : size + 1].reshape(-1, width).sum(axis=1)
    bins = np.flatnonzero(demand_of)
    if not len(bins):
        return pd.DataFrame(columns=names).astype("int64"), 0, {"patterns": 0, "cut": 0}
    lengths, demand = (bins + 1) * width, demand_of[bins]
    cols, x = patterns(bins + 1, demand.astype(float), size // width)  # in units of a bin
    cols = np.rint(cols).astype(np.int64)
    left, used = demand.copy(), np.zeros(len(x), np.int64)
    for up in (False, True):
        for p in np.argsort(-(x - np.floor(x)) if up else -x, kind="stable"):
            a = cols[:, p]
            if (a * lengths).sum() < size - 2 * width and x[p] < 64:
                continue  # would leave a gap; its few pieces are laid end to end below
            t = min(int((left[a > 0] // a[a > 0]).min()), 1 if up else int(x[p] + 1e-6))
            if t > 0:
                left -= a * t
                used[p] += t
    rows, seq, rank = [], 0, np.zeros(len(bins), np.int64)
    for p in np.flatnonzero(used):
        for i in np.flatnonzero(cols[:, p]):
            a = cols[i, p]
            rows.append((bins[i], rank[i], rank[i] + a * used[p], a, seq, 0, 0, -1))
            rank[i] += a * used[p]
        seq += int(used[p])
    # the rest, longest first, end to end; the last sequence is cut into powers of two
    rest = []
    for i in range(len(bins))[::-1]:
        of = np.arange(bins[i] * width + 1, (bins[i] + 1) * width + 1)
        ends = np.cumsum(exact[of])
        rest += [(bins[i], r, int(of[np.searchsorted(ends, r, "right")])) for r in range(rank[i], demand[i])]
    total = sum(n for *_, n in rest)
    fills = iter([size] * (total // size) + [1 << b for b in range(size.bit_length())[::-1] if total % size >> b & 1])
    cut, at, room = 0, 0, next(fills, 0)
    for b, r, n in rest:
        sub = 0
        while sub < n:
            if at == room:
                seq, at, room = seq + 1, 0, next(fills)
            take = min(n - sub, room - at)
            rows.append((b, r, r + 1, 1, seq, sub, take, at))
            cut += take < n
            sub, at = sub + take, at + take
    seq += bool(rest)
    return pd.DataFrame(rows, columns=names).astype("int64"), seq, {"patterns": int((used > 0).sum()), "rest": len(rest), "cut": cut}


def wide_crcs(ids: bytes, dtype: np.dtype, size: int) -> list[int]:
    """The crc32 of each ``size`` ids and of the rest, as little-endian 32-bit integers."""
    wide = memoryview(np.frombuffer(ids, dtype).astype("<u4").tobytes())
    return [zlib.crc32(wide[k : k + 4 * size]) for k in range(0, len(wide), 4 * size)]


def encode_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, keep_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, crcs, parts, tail): every row's ids with ``end_id``, cut every ``size`` of them.

    ``crcs`` are the crc32 of each piece's ids as 32-bit integers, ``parts`` the whole pieces
    (none unless ``keep_ids``) and ``tail`` the rest, which may be empty, as little-endian
    integers of the vocabulary's width (2 bytes up to 65,536 ids, else 4).
    """

    def run(batch: pa.RecordBatch):
        enc = encoder(vocabulary)
        end, step = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize * size
        for i, j, blobs in enc.batches(batch.column(1), end):
            crcs = [wide_crcs(b, enc.dtype, size) for b in blobs]
            parts = [[b[k : k + step] for k in range(0, len(b) - step + 1, step)] if keep_ids else [] for b in blobs]
            tails = [b[len(b) // step * step :] for b in blobs]
            lens = pa.array([len(b) // enc.dtype.itemsize for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lens, pa.array(crcs, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.binary())), pa.array(tails, pa.binary())], ["doc_id", "n", "crcs", "parts", "tail"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(batches(run), "doc_id long, n long, crcs array<long>, parts array<binary>, tail binary")


class Packed:
    """The plan of a packing: ``pieces`` is lazy, ``tokens`` the table of encoded documents."""

    def __init__(self, pieces: DataFrame, totals: dict):
        self.pieces, self.totals = pieces, totals


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, end_id: int = 0, size: int = 1024, width: int = 4, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Packed:
    """Pieces (row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids where they are kept.

    ``ids`` are little-endian binary of the vocabulary's width. A null or empty text is one token, ``end_id``. Null ids keep their rows; rows that repeat
    an id are documents of their own. An empty table gives no piece. ``size`` is a power of two,
    ``width`` the lengths of one histogram bin: about half of it is padding for each remainder.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    tokens = scratch.write(encode_pieces(docs, vocabulary, end_id, size, keep_ids, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    t = tokens.select("row", "doc_id", "n", "crcs")
    count = t.count()
    groups = max(16, -(-count // CHUNK))
    t = t.withColumn("l", F.col("n") % size).withColumn("full", F.expr(f"n DIV {size}")).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(groups)))
    order = [F.col("doc_id"), F.col("row")]
    ranked = t.withColumn("f0", F.sum("full").over(Window.partitionBy("chunk").orderBy(*order)) - F.col("full"))
    ranked = ranked.withColumn("r0", F.row_number().over(Window.partitionBy("chunk", "l").orderBy(*order)) - 1)
    ranked = scratch.write(ranked, "ranked")
    counts = ranked.groupBy("chunk", "l").agg(F.count("*").alias("c"), F.sum("full").alias("f"))
    counts = scratch.write(counts, "counts")
    # prefix sums over chunks: of each length, and of full pieces (one row a chunk)
    by_len = counts.select(F.col("chunk").alias("b_chunk"), F.col("l").alias("b_l"), (F.sum("c").over(Window.partitionBy("l").orderBy("chunk")) - F.col("c")).alias("r1"))
    by_chunk = counts.groupBy(F.col("chunk").alias("c_chunk")).agg(F.sum("f").alias("f"))
    by_chunk = by_chunk.select("c_chunk", (F.sum("f").over(Window.orderBy("c_chunk")) - F.col("f")).alias("f1"))
    total_full = counts.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    hist = counts.filter("l > 0").groupBy(F.col("l").alias("length")).agg(F.sum("c").alias("n")).toPandas()  # size - 1 rows at most
    places, n_seq, totals = layout(hist, size, width)
    # ranks within a bin go by length first: how many shorter ones a bin has
    n_of = np.zeros(size, np.int64)
    n_of[hist["length"].to_numpy(np.int64)] = hist["n"].to_numpy(np.int64)
    shorter = np.concatenate([[0], (np.cumsum(n_of[1:]) - n_of[1:])])
    start_of_bin = (np.arange(1, size) - 1) // width * width + 1
    shorter[1:] -= np.concatenate([[0], np.cumsum(n_of[1:])])[start_of_bin - 1]
    spark = docs.sparkSession
    lens = F.broadcast(spark.createDataFrame(pd.DataFrame({"s_l": np.arange(size), "shorter": shorter})))  # size rows
    placed = ranked.join(by_len, (F.col("chunk") == F.col("b_chunk")) & (F.col("l") == F.col("b_l"))).join(by_chunk, F.col("chunk") == F.col("c_chunk")).join(lens, F.col("l") == F.col("s_l"))
    placed = placed.select("row", "doc_id", "n", "crcs", "l", "full", F.expr(f"(l - 1) DIV {width}").alias("bin"), (F.col("r0") + F.col("r1") + F.col("shorter")).alias("rank"), (F.col("f0") + F.col("f1")).alias("before"))
    heads = placed.filter("full > 0")
    if keep_ids:  # one row a document on either side; tails wait until their places are known
        heads = heads.join(tokens.filter("size(parts) > 0").select(F.col("row").alias("i_row"), "parts"), F.col("row") == F.col("i_row")).drop("i_row")
    head = heads.select("row", "doc_id", "n", "before", F.posexplode(F.expr("transform(parts, (p, i) -> struct(crcs[i] AS crc, p AS ids))" if keep_ids else "slice(crcs, 1, CAST(full AS INT))")).alias("k", "piece"))
    head = head.withColumn("ids_crc32", F.col("piece.crc" if keep_ids else "piece")).select("row", "doc_id", (F.col("k") * F.lit(size).cast("long")).alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *([F.col("piece.ids").alias("ids")] if keep_ids else []))
    schema = "a_bin long, lo long, hi long, per long, seq long, sub long, len long, at long"
    table = F.broadcast(spark.createDataFrame(places.set_axis([c.split()[0] for c in schema.split(", ")], axis=1), schema) if len(places) else spark.createDataFrame([], schema))  # bounded by size
    tail = placed.filter("l > 0").join(table, (F.col("bin") == F.col("a_bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    tail = tail.select("row", "doc_id", (F.col("full") * size + F.col("sub")).alias("start"), F.when(F.col("at") < 0, F.col("l")).otherwise(F.col("len")).alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(int(total_full)) + F.col("seq") + F.expr("(rank - lo) DIV per")).alias("sequence_id"), "at", "l", "rank", "sub")
    inside = Window.partitionBy("sequence_id").orderBy("l", "rank", "row")  # a sequence: size pieces at most
    regular = tail.filter("at < 0").withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    rest = tail.filter("at >= 0").withColumn("offset", F.col("at"))
    tail = regular.unionByName(rest).drop("at", "rank")
    whole = tail.filter("length = l").drop("l", "sub")
    cut = scratch.write(tail.filter("length < l").drop("l", "ids_crc32"), "cut")  # pieces of the rest, bounded by size
    tails = tokens.select(F.col("row").alias("t_row"), "tail")
    if keep_ids:
        whole = whole.join(tails.withColumnRenamed("tail", "ids"), F.col("row") == F.col("t_row")).drop("t_row")
    width_of = dtype_of(vocabulary)
    inside = F.expr(f"substring(tail, CAST({width_of.itemsize} * sub + 1 AS INT), CAST({width_of.itemsize} * length AS INT))")
    cut = tails.join(F.broadcast(cut), F.col("t_row") == F.col("row")).withColumn("ids", inside).drop("t_row", "tail", "sub")

    def with_crc(batch: pa.RecordBatch):
        crcs = [wide_crcs(b, width_of, size)[0] for b in batch.column("ids").to_pylist()]
        yield batch.append_column("ids_crc32", pa.array(crcs, pa.int64()))

    cut = cut.mapInArrow(batches(with_crc), StructType([*cut.schema.fields, StructField("ids_crc32", LongType())]))
    pieces = head.unionByName(whole).unionByName(cut.drop(*([] if keep_ids else ["ids"])))
    return Packed(pieces, {**totals, "sequences": int(total_full) + n_seq, "documents": count})
