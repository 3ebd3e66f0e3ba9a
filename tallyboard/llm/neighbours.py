"""Links between embeddings of one label by cosine, found with NN-descent.

1. Equal vectors become one class. A forest of random hyperplanes gives each class a first
   list of neighbours (all pairs of a leaf are compared).
2. NN-descent: the neighbours of each class meet one another, better ones enter the lists.
   Lists hold the ``k`` best whatever their cosine; one whose members all are links is
   saturated and may grow to ``4 k``. It ends when fewer than ``settled`` of all entries
   are new.
3. Audit: ``sample`` classes at most, chosen by hash, are compared with all vectors in blocks:
   one pass, whatever the number of links that it sees. Forests are grown, each followed by a
   descent, until the share of the sample's classes with few links (``k`` at most) whose links
   all lie within one component is ``recall`` or more, and that of the others' links, too.
   Where links are so rare that the sample holds few of them, the last forest must also have
   joined less than 1 - ``recall`` of all that is joined: trees are independent, so what
   one of them finds tells what the others have missed.
4. Within each component all pairs are compared exactly in double precision, tile by tile;
   that confirms links and counts those that no list could hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sorted_groups
from .graph import connected_components, spanning
from .simhash import dealt

LEAF, TILE = 64, 1024


def _matrix(column, kind=np.float64) -> np.ndarray:
    return np.stack(column.to_list()).astype(kind)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.multiply.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))


def _tops(ids_a, ids_b, sim, k: int, threshold: float):
    """Edges (u, v, sim): for each u its best, and links that span its group."""
    sim = np.where(ids_a[:, None] == ids_b[None, :], -2, sim)
    u, v, s = [], [], []
    n = min(k, sim.shape[1])
    best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
    r, c = np.repeat(np.arange(len(ids_a)), n), best.ravel()
    keep = sim[r, c] > -2
    u.append(ids_a[r[keep]]), v.append(ids_b[c[keep]]), s.append(sim[r, c][keep])
    a, b = np.nonzero(sim >= threshold)
    if len(a):
        x, y = spanning(ids_a[a], ids_b[b])
        u.append(x), v.append(y), s.append(np.full(len(x), np.nan))
    return np.concatenate(u), np.concatenate(v), np.concatenate(s)


def _compare(keys: list[str], k: int, threshold: float):
    """mapInPandas over sorted groups: edges between the members of each."""

    def run(frames):
        for pdf, cuts in sorted_groups(frames, keys):
            ids, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
            vec = _matrix(pdf["vec"])
            got = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                a, b = (side[i:j] & 1) > 0, (side[i:j] & 2) > 0
                if j - i > 1 and a.any() and b.any():
                    sim = _cosine(vec[i:j][a], vec[i:j][b])
                    got.append(_tops(ids[i:j][a], ids[i:j][b], sim, k, threshold))
                    if not (side[i:j] == 3).all():
                        got.append(_tops(ids[i:j][b], ids[i:j][a], sim.T, k, threshold))
            if got:
                yield pd.DataFrame({"u": np.concatenate([x[0] for x in got]), "v": np.concatenate([x[1] for x in got]), "sim": np.concatenate([x[2] for x in got])})

    return run


EDGES = "u long, v long, sim double"


def _forest(classes: DataFrame, first: int, trees: int, scratch: Scratch, k: int, threshold: float) -> DataFrame:
    """Edges from the leaves of ``trees`` trees; a leaf is a sign pattern of as many planes as the label's size asks."""

    def leaves(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            vec = _matrix(pdf["vec"])
            depth = np.ceil(np.log2(np.maximum(pdf["n"].to_numpy() / LEAF, 1))).astype(int)
            for t in range(first, first + trees):
                planes = np.random.default_rng([t, vec.shape[1]]).standard_normal((vec.shape[1], 48))
                bits = ((vec @ planes) > 0) & (np.arange(48) < depth[:, None])
                code = bits @ (1 << np.arange(48, dtype=np.int64))
                yield pd.DataFrame({"tree": t, "label": pdf["label"], "code": code, "dim": vec.shape[1], "node": pdf["node"], "vec": pdf["vec"]})

    # vectors of one length at a time share the planes
    by_dim = classes.select("node", "label", "n", "vec").mapInPandas(lambda frames: leaves(g for f in frames for _, g in f.groupby(f["vec"].map(len))), "tree int, label int, code long, dim int, node long, vec array<float>")
    rows = by_dim.select(F.xxhash64("tree", "label", "code", "dim").alias("leaf"), F.lit(0).alias("level"), "node", "vec")
    rows = scratch.write(rows, "leaves")
    units = dealt(rows, "leaf", "level", "node", TILE, scratch).select("leaf", "pair", "node", "vec", "side")
    return scratch.write(units.repartition("leaf", "pair").sortWithinPartitions("leaf", "pair").mapInPandas(_compare(["leaf", "pair"], k, threshold), EDGES), "forest")


def _lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The best ``k`` neighbours of each node, up to ``4 k`` while they are links."""
    both = edges.filter("NOT isnan(sim)").select("u", "v", "sim").unionByName(edges.filter("NOT isnan(sim)").select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    both = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    r = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return both.withColumn("r", r).filter((F.col("r") <= k) | ((F.col("r") <= 4 * k) & (F.col("sim") >= threshold))).drop("r")


def _descend(lists: DataFrame, classes: DataFrame, scratch: Scratch, k: int, threshold: float) -> DataFrame:
    """Edges between the neighbours of each node, at most ``4 k + 1`` of them."""
    members = lists.select(F.col("u").alias("hub"), F.col("v").alias("member")).unionByName(lists.select(F.col("u").alias("hub"), F.col("u").alias("member")).distinct())
    rows = members.join(classes.select(F.col("node").alias("member"), "vec"), "member").select("hub", F.col("member").alias("node"), "vec", F.lit(3).alias("side"))
    return scratch.write(rows.repartition("hub").sortWithinPartitions("hub").mapInPandas(_compare(["hub"], k, threshold), EDGES), "descent")


#: Audited classes with few links that tell the recall by themselves.
ENOUGH = 64


def _audit(classes: DataFrame, first: int, end: int, of: int, k: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Links of the classes in slices ``first`` to ``end`` of ``of``, by comparison with every vector.

    (u, v, n): n links of u where v is null. Of a class with at most ``k`` links in a batch
    all are returned, of others some that span them.
    """
    some = classes.filter(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(of)).between(first, end - 1)).select("node", "label", "vec").toPandas()
    shared = classes.sparkSession.sparkContext.broadcast(some)  # about ``sample`` vectors

    def run(frames):
        for pdf in frames:
            for (label, dim), g in pdf.groupby([pdf["label"], pdf["vec"].map(len)]):
                q = shared.value
                q = q[(q["label"] == label) & (q["vec"].map(len) == dim)]
                if len(q) and len(g):
                    a, b = q["node"].to_numpy(), g["node"].to_numpy()
                    link = (_cosine(_matrix(q["vec"]), _matrix(g["vec"])) >= threshold) & (a[:, None] != b[None, :])
                    n = link.sum(axis=1)
                    r, c = np.nonzero(link & (n <= k)[:, None])
                    x, y = np.nonzero(link & (n > k)[:, None])
                    x, y = spanning(a[x], b[y]) if len(x) else (a[:0], a[:0])
                    u, v = np.concatenate([a[r], x]), np.concatenate([b[c], y])
                    yield pd.DataFrame({"u": u, "v": pd.array(v, "Int64"), "n": 0})
                    yield pd.DataFrame({"u": a[n > 0], "v": pd.array([pd.NA] * int((n > 0).sum()), "Int64"), "n": n[n > 0]})

    return scratch.write(classes.select("node", "label", "vec").mapInPandas(run, "u long, v long, n long"), "audit")


def _few(truth: DataFrame, k: int) -> DataFrame:
    """The audited classes with 1 to ``k`` links."""
    return truth.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("n")).filter(F.col("n") <= k).select("u")


def _recall(truth: DataFrame, parts: DataFrame, k: int) -> tuple[int, int, int, int]:
    """Audited classes with few links, those of them whose links all lie within components; the other links, and those within."""
    of = truth.filter("v IS NOT NULL").select("u", "v").join(parts.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(parts.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    of = of.withColumn("hit", F.coalesce(F.col("cu") == F.col("cv"), F.lit(False)).cast("int"))
    few = _few(truth, k)
    n, hit = of.join(few, "u", "left_semi").groupBy("u").agg(F.min("hit").alias("hit")).agg(F.count("*"), F.coalesce(F.sum("hit"), F.lit(0))).first()
    m, more = of.join(few, "u", "left_anti").agg(F.count("*"), F.coalesce(F.sum("hit"), F.lit(0))).first()
    return n, hit, m, more


def _exact(threshold: float):
    """Confirmed spanning links, and (as v = null) how many rows each node is linked to."""

    def run(frames):
        for pdf, cuts in sorted_groups(frames, ["comp", "pair"]):
            ids, side, size = pdf["node"].to_numpy(), pdf["side"].to_numpy(), pdf["size"].to_numpy()
            vec = _matrix(pdf["vec"])
            for i, j in zip(cuts[:-1], cuts[1:]):
                a, b = (side[i:j] & 1) > 0, (side[i:j] & 2) > 0
                if not a.any() or not b.any():
                    continue
                ia, ib = ids[i:j][a], ids[i:j][b]
                link = (_cosine(vec[i:j][a], vec[i:j][b]) >= threshold) & (ia[:, None] != ib[None, :])
                one = set(ia.tolist()) == set(ib.tolist())
                nodes, counts = [ia], [(link * size[i:j][b][None, :]).sum(axis=1)]
                if not one:
                    nodes.append(ib), counts.append((link * size[i:j][a][:, None]).sum(axis=0))
                yield pd.DataFrame({"u": np.concatenate(nodes), "v": pd.array([pd.NA] * sum(map(len, nodes)), "Int64"), "links": np.concatenate(counts).astype(np.int64)})
                r, c = np.nonzero(link)
                if len(r):
                    u, v = spanning(ia[r], ib[c])
                    yield pd.DataFrame({"u": u, "v": pd.array(v, "Int64"), "links": 0})

    return run


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, k: int = 10, trees: int = 8, settled: float = 0.001, recall: float = 0.999, sample: int = 4096, most_forests: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows whose label or vector is null, or whose vector is empty, zero or holds null or
    non-finite components, link with nothing: 0 links, their own component. Vectors of
    different length never link. Copies of a vector are one class: they link with one another
    and share their links. Null ids are kept, with a null component unless it has other
    rows; rows that repeat an id count as vectors of their own. An empty table gives an empty result.

    ``report`` gets what the audit saw: classes, audited, linked (with few links), found, forests.
    Links that the audit saw are kept. ``most_forests`` ends the search earlier: then, if the audit
    measured too little, the classes that it did not compare are compared with all vectors, too,
    which costs the square of their number.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<float>").alias("vec"))
    fine = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("vec", lambda x: x != 0)
    # -0 and 0 are the same number
    v = v.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))))
    v = scratch.write(v, "vectors")
    classes = v.filter("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("size"), F.min("vec_id").alias("rep"))
    classes = scratch.write(classes, "classes")
    per = classes.groupBy("label").agg(F.count("*").alias("n"))
    sized = scratch.write(classes.join(per, "label"), "sized")
    n_classes = classes.count()
    slices = max(1, -(-n_classes // sample))
    truth = _audit(classes, 0, 1, slices, k, threshold, scratch)
    edges, forest, joined = None, 0, None
    while True:
        found = _forest(sized, forest * trees, trees, scratch, k, threshold)
        edges = found if edges is None else edges.unionByName(found)
        lists = scratch.write(_lists(edges, k, threshold), "lists")
        while True:
            better = edges.filter(F.isnan("sim")).unionByName(_descend(lists, classes, scratch, k, threshold))
            # the links of a list that holds 4 k of them are spanned by the edges without a cosine
            edges = scratch.write(better.unionByName(lists), "refined")
            old, lists = lists, scratch.write(_lists(edges, k, threshold), "lists")
            new = lists.join(old, ["u", "v"], "left_anti").count()
            edges = scratch.write(edges.filter("isnan(sim)").select("u", "v").distinct().withColumn("sim", F.lit(float("nan"))).unionByName(lists), "kept")
            if new <= settled * n_classes * k:
                break
        own = edges.filter(F.isnan("sim") | (F.col("sim") >= threshold - 1e-6)).select("u", "v")
        parts = connected_components(own, scratch)
        parts = scratch.write(parts, "parts")
        linked, hit, others, more = _recall(truth, parts, k)
        enough = hit >= recall * linked and more >= recall * others
        before, joined, forest = joined, parts.count() - parts.select("component").distinct().count(), forest + 1
        quiet = before is not None and joined - before <= (1 - recall) * joined
        if enough and (slices == 1 or linked >= ENOUGH or quiet) or forest == most_forests:
            break
    if not enough:
        for at in range(1, slices):
            truth = truth.unionByName(_audit(classes, at, at + 1, slices, k, threshold, scratch))
    if report is not None:
        report |= {"classes": n_classes, "audited": min(n_classes, sample), "linked": linked, "found": hit, "forests": forest}
    links = truth.filter("v IS NOT NULL").select("u", "v")
    parts = connected_components(own.unionByName(links), scratch)
    inside = sized.join(parts.withColumnRenamed("node", "p_node"), F.col("node") == F.col("p_node")).select(F.col("component").alias("comp"), "node", "vec", "size", F.lit(0).alias("level"))
    inside = scratch.write(inside, "inside")
    units = dealt(inside, "comp", "level", "node", TILE, scratch).select("comp", "pair", "side", "node", "vec", "size")
    exact = scratch.write(units.repartition("comp", "pair").sortWithinPartitions("comp", "pair").mapInPandas(_exact(threshold), "u long, v long, links long"), "exact")
    final = connected_components(exact.filter("v IS NOT NULL").select("u", "v"), scratch)
    counts = exact.filter("v IS NULL").groupBy(F.col("u").alias("n_node")).agg(F.sum("links").alias("links"))
    named = classes.join(final.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left").select("node", "size", "rep", F.coalesce("component", "node").alias("root"))
    named = scratch.write(named.join(counts, F.col("node") == F.col("n_node"), "left"), "named")
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = named.join(low, "root").select(F.col("node").alias("o_node"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = v.join(of, F.col("node") == F.col("o_node"), "left")
    comp = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
