"""SimHash fingerprints of word shingles, links within a Hamming radius, near-duplicate groups.

A fingerprint's bit is 1 if it is set in over half of the hashes of the document's
shingles. Links are found by exact tiled comparison: exclusive-or and bit counts over
numpy tiles, where tile pairs whose population counts differ by more than the radius are
skipped. So that not all tiles meet, fingerprints meet only in groups that agree in some
bits (``blocks`` or ``bands`` below). A group above ``TILE`` is dealt out as pairs of tiles
over many tasks.

* ``near_duplicates``: 64 bits, small radius. Of ``radius + 1`` blocks of bits, two linked
  fingerprints agree in one at least, so no link is lost.
* ``similar_groups``: links texts whose sets of five-word shingles have a Jaccard
  similarity of 0.8 or more. Candidates are texts that share a band of minima of random
  functions over their sets (a pair of similarity 0.8 shares none in three of a million
  cases, more similar ones more rarely, whatever the number and length of texts) and whose
  256-bit fingerprints lie within a radius, six standard deviations beyond the mean of such
  pairs. The shingles themselves then decide each link exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, mix64, rows_if_small, sorted_groups
from .graph import connected_components, spanning

SEED = 42
#: Shingles held as bits at one time; fingerprints, and shingle sets, in one tile.
BLOCK, TILE, SET_TILE = 1 << 15, 2048, 256
#: Shingles of all sets in one tile.
TILE_SHINGLES = 1 << 20
#: Minima in a band, and bands: (1 - 0.8 ** 4) ** 24 is 3e-6.
ROWS, BANDS = 4, 24
#: Sets below this size tell too little by their bits, so their bands alone make them candidates.
FEW = 16


def shingle_hashes(text: str | None, width: int, part: int = BLOCK):
    """Arrays of XXH64 of the word shingles, repeats included, ``part`` at a time."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    hashed = xxhash.xxh64_intdigest
    if len(words) < width:
        if words:
            yield np.array([hashed(b" ".join(words), SEED)], np.uint64)
        return
    n = len(words) - width + 1
    for at in range(0, n, part):
        some = words[at : min(at + part, n) + width - 1]
        yield np.array([hashed(x, SEED) for x in map(b" ".join, zip(*[some[i:] for i in range(width)]))], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash over all shingles; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        ones += _ones(h)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    parts = [np.unique(h) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def wide_fingerprint(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` x 64 bits (0 or 1 each) from distinct shingles, each lane with its own mixing."""
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(shingles), BLOCK):
        for lane in range(lanes):
            ones[64 * lane : 64 * lane + 64] += _ones(mix64(shingles[at : at + BLOCK], lane + 1))
    return ones * 2 > len(shingles)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


SLOPES, SHIFTS = _functions()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A number for each band: the hash of the least values of its linear functions over the shingles."""
    best = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(best, (mix64(shingles[at : at + 2048], 99)[:, None] * SLOPES + SHIFTS).min(axis=0), out=best)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in best.reshape(BANDS, ROWS).T:
        key = mix64(key ^ row, 5)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long.

    A null, empty or blank text has fingerprint 0; a text with fewer than ``width`` words
    is one shingle. Repeated rows each get their row; other columns are ignored.
    """

    def run(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(batches(run), "doc_id long, fp long")


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a (n x lanes) against each of b."""
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for lane in range(1, a.shape[1]):
        d = d.astype(np.uint16) + np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
    return d


def tile_links(ids_a, a, ids_b, b, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two sets of fingerprints, tile pair by tile pair."""
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return none, none
    na, nb = np.bitwise_count(a).sum(axis=1), np.bitwise_count(b).sum(axis=1)
    oa, ob = np.argsort(na, kind="stable"), np.argsort(nb, kind="stable")
    a, ids_a, na, b, ids_b, nb = a[oa], ids_a[oa], na[oa].astype(int), b[ob], ids_b[ob], nb[ob].astype(int)
    src, dst, step = [], [], 256
    for i in range(0, len(a), step):
        lo = np.searchsorted(nb, na[i] - radius, "left")
        hi = np.searchsorted(nb, na[min(i + step, len(a)) - 1] + radius, "right")
        for j in range(lo, hi, step):
            r, c = np.nonzero(_differ(a[i : i + step], b[j : min(j + step, hi)]) <= radius)
            u, v = ids_a[i + r], ids_b[j + c]
            if (u != v).any():
                u, v = spanning(u, v)
                src.append(u)
                dst.append(v)
    return spanning(np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def _link_frames(radius: int):
    def run(frames):
        for pdf, cuts in sorted_groups(frames, ["band", "pair"]):
            ids, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
            fp = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
            got = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j - i > 1:
                    s = side[i:j]
                    m, n = (s & 1) > 0, (s & 2) > 0
                    if j - i <= 128:
                        r, c = np.nonzero(_differ(fp[i:j][m], fp[i:j][n]) <= radius)
                        u, v = ids[i:j][m][r], ids[i:j][n][c]
                        if (u != v).any():
                            got.append(spanning(u, v))
                    else:
                        got.append(tile_links(ids[i:j][m], fp[i:j][m], ids[i:j][n], fp[i:j][n], radius))
            if got:
                yield pd.DataFrame({"u": np.concatenate([x[0] for x in got]), "v": np.concatenate([x[1] for x in got])})

    return run


def dealt(rows: DataFrame, key: str, level: str, node: str, limit: int, scratch: Scratch) -> DataFrame:
    """``rows`` with (pair, side): groups of ``key`` above ``limit`` become pairs of tiles.

    A tile is (level, part), parts by hash. It meets itself, the parts of its own level and
    those of the next level. Others are one unit each: pair 0, both sides (3).
    """
    large = rows.groupBy(key, level).agg(F.count("*").alias("n")).groupBy(F.col(key).alias("l_key")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(F.col("n") > limit)
    large = scratch.write(large.select("l_key", F.ceil(F.col("most") / limit).cast("int").alias("parts")), "large")
    side = F.broadcast(large) if rows_if_small(large, 50_000) else large
    every = rows.join(side, F.col(key) == F.col("l_key"), "left")
    units = every.filter("parts IS NULL").drop("l_key", "parts").withColumn("pair", F.lit(0).cast("long")).withColumn("side", F.lit(3))
    tiles = every.filter("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    meets = "flatten(transform(sequence(0, 1), d -> transform(sequence(0, parts - 1), q -> struct({}))))"
    left = meets.format(f"{level} AS a, part AS p, {level} + d AS b, q AS r")
    right = meets.format(f"{level} - d AS a, q AS p, {level} AS b, part AS r")
    both = tiles.withColumn("meets", F.expr(left)).withColumn("side", F.lit(1)).unionByName(tiles.withColumn("meets", F.expr(right)).withColumn("side", F.lit(2)))
    both = both.withColumn("m", F.explode("meets")).filter("m.a < m.b OR m.p <= m.r")
    both = both.withColumn("pair", F.expr("1 + ((CAST(m.a AS LONG) * 512 + m.b) * 1048576 + m.p) * 1048576 + m.r"))
    return units.unionByName(both.drop("l_key", "parts", "part", "meets", "m"))


def links(rows: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """(u, v): links that join all nodes within ``radius`` bits that share a band.

    ``rows`` has (band long, node long, fp binary, ones int). Of the pairs of a tile only a
    spanning forest is returned, so rows grow with the nodes and not with their pairs.
    """
    rows = rows.withColumn("level", F.expr(f"CAST(ones DIV {radius + 1} AS INT)")).drop("ones")
    r = dealt(rows, "band", "level", "node", TILE, scratch).select("band", "pair", "node", "fp", "side")
    return r.repartition("band", "pair").sortWithinPartitions("band", "pair").mapInPandas(_link_frames(radius), "u long, v long")


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable.

    Fingerprints link at ``radius`` or fewer differing bits, all of them, by blocks. Null
    ids keep their row and never name a component unless it has no other id (then null).
    Equal fingerprints are one class and are not expanded into pairs. An empty table gives
    an empty result.
    """
    rows = scratch.write(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    bits = 64 // (radius + 1)
    keys = [F.shiftright("fp", b * bits).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(b << 58) for b in range(radius + 1)]
    # eight bytes of the fingerprint in the order of its hex digits; only equality of bits counts
    bands = classes.select(F.col("fp").alias("node"), F.expr("unhex(lpad(hex(fp), 16, '0'))").alias("b"), F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("band"))
    parts = connected_components(links(bands.withColumnRenamed("b", "fp"), scratch, radius), scratch)
    member = classes.join(parts, classes.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    member = scratch.write(member, "members")
    low = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(low, "root").select(F.col("fp").alias("c_fp"), "component_id")
    return rows.join(named, rows.fp == named.c_fp).select("doc_id", "fp", "component_id")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: a product of 0/1 matrices, exact in float32."""
    all_ids, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seen = np.bincount(col, minlength=len(all_ids)) > 1
    new = np.cumsum(seen) - 1
    row, col = row[seen[col]], new[col[seen[col]]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(seen.sum()), 8192):
        i, j = np.searchsorted(col, [at, at + 8192])
        m = np.zeros((len(sets), 8192), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        out += m @ m.T
    return out


def _verify_frames(similarity: float):
    def run(frames):
        for pdf, cuts in sorted_groups(frames, ["comp", "pair"]):
            ids, side, raw = pdf["node"].to_numpy(), pdf["side"].to_numpy(), pdf["shingles"].tolist()
            for i, j in zip(cuts[:-1], cuts[1:]):
                # in a pair of one tile with itself both sides hold each set; once is enough
                node, first = np.unique(ids[i:j], return_index=True)
                if len(node) < 2:
                    continue
                sets = [np.frombuffer(raw[i + k], np.uint64) for k in first]
                n = np.array([len(s) for s in sets], float)
                both = _shared(sets)
                a, b = np.nonzero(np.triu(both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9, 1))
                if len(a):
                    u, v = spanning(node[a], node[b])
                    yield pd.DataFrame({"u": u, "v": v})

    return run


def _verified(units: DataFrame, with_sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Exact links between the sets that meet in a unit (comp, pair); ``units`` has comp, pair, node."""
    rows = units.join(with_sets.select(F.col("node").alias("s_node"), "shingles"), F.col("node") == F.col("s_node")).select("comp", "pair", "node", F.lit(3).alias("side"), "shingles")
    out = rows.repartition("comp", "pair").sortWithinPartitions("comp", "pair").mapInPandas(_verify_frames(similarity), "u long, v long")
    return scratch.write(out, "exact")


def _merged(members: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` with ``sub`` followed along the edges of one round, which lead from each node to the smallest of its group."""
    to = edges.select(F.col("u").alias("e_u"), F.col("v").alias("e_v"))
    return scratch.write(members.join(to, F.col("sub") == F.col("e_u"), "left").select("comp", "node", "size", F.coalesce("e_v", "sub").alias("sub")), "merged")


def _parts(n, size):
    return F.greatest(F.ceil(n / SET_TILE), F.ceil(size / TILE_SHINGLES)).cast("int")


def exact_links(members: DataFrame, with_sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(u, v): links of ``similarity`` or more within each group of candidates, enough of them to join all that are linked.

    ``members`` has comp, node, size (of the set); ``with_sets`` node and shingles. A group that
    fits a tile is compared whole. In larger ones the sets of a tile meet first, then one of each group
    found so far, in tiles again, while that halves their number. What is still apart is compared in full: each set outside
    the largest group with every other, tile by tile. Sets already joined need not meet.
    """
    whole = members.groupBy(F.col("comp").alias("w_comp")).agg(_parts(F.count("*"), F.sum("size")).alias("parts"))
    units = members.join(whole, F.col("comp") == F.col("w_comp")).select("comp", F.pmod(F.xxhash64("node"), F.col("parts")).alias("pair"), "node")
    edges = _verified(units, with_sets, similarity, scratch)
    large = members.join(whole.filter("parts > 1"), F.col("comp") == F.col("w_comp"), "left_semi")
    now, n = _merged(large.withColumn("sub", F.col("node")), edges, scratch), None
    while True:
        heads = now.filter("node = sub")
        per = heads.groupBy(F.col("comp").alias("h_comp")).agg(F.count("*").alias("heads"), _parts(F.count("*"), F.sum("size")).alias("parts")).filter("heads > 1")
        apart = per.agg(F.coalesce(F.sum("heads"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(0))).first()
        if not apart[0]:
            return edges
        if n is not None and apart[0] * 2 > n:  # another round would join little more
            break
        n = apart[0]
        units = heads.join(per, F.col("comp") == F.col("h_comp")).select("comp", F.pmod(F.xxhash64("node", F.lit(n)), F.col("parts")).alias("pair"), "node")
        found = _verified(units, with_sets, similarity, scratch)
        edges, now = edges.unionByName(found), _merged(now, found, scratch)
    subs = now.groupBy("comp", "sub").agg(F.count("*").alias("n"))
    top = subs.groupBy(F.col("comp").alias("t_comp")).agg(F.max(F.struct("n", "sub")).alias("top"), F.count("*").alias("subs")).filter("subs > 1")
    d = now.join(top, F.col("comp") == F.col("t_comp")).select("comp", "node", "size", (F.col("sub") == F.col("top.sub")).alias("major"))
    tiles = d.groupBy(F.col("comp").alias("t_comp")).agg(*[_parts(F.count_if(F.col("major") == x), F.sum(F.when(F.col("major") == x, F.col("size")).otherwise(0))).alias(name) for name, x in (("minor_parts", F.lit(False)), ("major_parts", F.lit(True)))])
    d = d.join(tiles, F.col("comp") == F.col("t_comp"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("major"), F.col("major_parts")).otherwise(F.col("minor_parts"))).cast("int") + F.when(F.col("major"), F.col("minor_parts")).otherwise(0)
    upto = F.when(F.col("major"), F.col("minor_parts")).otherwise(F.col("minor_parts") + F.col("major_parts"))
    d = d.withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
    pair = F.least("tile", "other").cast("long") * (1 << 31) + F.greatest("tile", "other")
    return edges.unionByName(_verified(d.select("comp", pair.alias("pair"), "node"), with_sets, similarity, scratch))


def similar_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, lanes: int = 4, deviations: float = 6.0) -> DataFrame:
    """(doc_id, group_id) of every row: groups joined by links of ``similarity`` or more.

    group_id is the smallest id of the group. Links are between sets of distinct
    ``width``-word shingles (a shorter text is one shingle; texts without words are alike).
    Texts of equal sets are one class. Null ids keep their row. An empty table gives an empty result.
    """
    bits = 64 * lanes
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    radius = min(bits - 1, math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p))))

    def fps(batch: pa.RecordBatch):
        key, fp, ones, size, bands = [], [], [], [], []
        for t in batch.column(1).to_pylist():
            s = shingle_set(t, width)
            b = wide_fingerprint(s, lanes)
            key.append(xxhash.xxh3_128_digest(s.tobytes(), SEED))
            fp.append(np.packbits(b).tobytes())
            ones.append(int(b.sum()))
            size.append(len(s))
            bands.append(band_keys(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(fp, pa.binary()), pa.array(ones, pa.int32()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "ones", "size", "bands"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.write(d.mapInArrow(batches(fps), "doc_id long, key binary, fp binary, ones int, size long, bands array<long>"), "wide")
    # a class is a set of shingles; its node number is a hash that stays the same in a rerun
    first = [F.first(c).alias(c) for c in ("fp", "ones", "size", "bands")]
    classes = scratch.write(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), *first).withColumn("node", F.xxhash64("key")), "classes")
    of = lambda some, mark: classes.filter(some).select("node", "fp", "ones", F.explode("bands").alias("band")).withColumn("band", F.col("band").bitwiseXOR(F.lit(mark)))
    near = links(of(F.col("size") >= FEW, 0), scratch, radius)
    # a small set's partner may be a quarter larger
    small = links(of(F.col("size") < FEW * 5 // 4, 1), scratch, bits)
    candidates = connected_components(near.unionByName(small), scratch)
    candidates = candidates.withColumnRenamed("component", "comp").withColumnRenamed("node", "c_node")
    inside = scratch.write(classes.join(candidates, classes.node == F.col("c_node")).select("rep", "node", "comp", "size").filter("rep IS NOT NULL"), "inside")

    def sets(batch: pa.RecordBatch):
        blob = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blob, pa.binary())], ["node", "shingles"])

    # four longs a row: where they are few, the texts that are no candidates stay where they are
    side = F.broadcast(inside) if rows_if_small(inside, 500_000) else inside
    texts = d.join(side, F.col("doc_id") == F.col("rep")).select("node", "text").dropDuplicates(["node"])
    with_sets = scratch.write(texts.mapInArrow(batches(sets), "node long, shingles binary"), "shingle-sets")
    parts = connected_components(exact_links(inside.select("comp", "node", "size"), with_sets, similarity, scratch), scratch)
    member = classes.join(parts.withColumnRenamed("node", "p_node"), F.col("node") == F.col("p_node"), "left")
    member = scratch.write(member.select("key", "rep", F.coalesce("component", "node").alias("root")), "members")
    low = member.groupBy("root").agg(F.min("rep").alias("group_id"))
    named = member.join(low, "root").select(F.col("key").alias("c_key"), "group_id")
    scratch.drop(with_sets, inside)
    return rows.join(named, rows.key == named.c_key).select("doc_id", "group_id")
