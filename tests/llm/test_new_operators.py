"""Operators 11 to 13 against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyboard.llm import audit, quality, queries, variants
from tallyboard.llm.common import Scratch

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") if len(r) == 3 else (*r, None, "x") for r in rows], DOCS)


# -- 11: quality


def texts(rng, good, n):
    words = ["river", "stone", "walks", "under", "the", "old", "bridge", "and", "waits"]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if good:
            out.append(" ".join(w).capitalize() + ".")
        else:
            out.append([" ".join(x.upper() + "!!" for x in w), " ".join(x + "$$$" for x in w), " ".join([w[0]] * 40)][i % 3])
    return out


def test_quality_learns_and_generalises(spark):
    rng = random.Random(3)
    rows = [(i, t, "en") for i, t in enumerate(texts(rng, True, 150) + texts(rng, False, 60))]
    y = [1] * 150 + [0] * 60
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y) if i % 5] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*rows, (None, None, None), (900, "", None), (900, "", None)])
    model = quality.fit(d, labels, Scratch(spark, "t11"))
    got = quality.score(d, model).collect()
    assert len(got) == 213 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    held = [i for i in range(210) if i % 5 == 0]
    assert sum((by_id[i] >= 0.3) == y[i] for i in held) >= 40 and len(held) == 42
    again = {r["doc_id"]: r["score"] for r in quality.score(d, quality.fit(d, labels, Scratch(spark, "t11"))).collect()}
    assert again == by_id


def test_quality_of_one_class_or_none(spark):
    d = docs(spark, [(1, "a b", "en"), (2, None, "en")])
    for rows, want in (([], 0.5), ([(1, 1, 0), (2, 1, 0)], 0.75), ([(7, 0, 0)], 1 / 3)):
        model = quality.fit(d, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), Scratch(spark, "t11"))
        assert [round(r["score"], 9) for r in quality.score(d, model).collect()] == [round(want, 9)] * 2
    assert quality.score(d.limit(0), model).count() == 0


def test_measures_of_slices_are_those_of_the_whole(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Word", "näive", "x$$", "LOUD!!", "same same", "line\nline\n", "7,5"]) for _ in range(3000))
    whole = quality.measure(text)
    monkeypatch.setattr(quality, "SLICE_CHARS", 997)
    cut = quality.measure(text)
    names = [i for i, n in enumerate(quality.MEASURES) if n != "distinct_lines"]  # a line may be cut
    assert np.allclose(np.array(whole)[names], np.array(cut)[names])
    assert quality.measure(None) == quality.measure("") and all(np.isfinite(quality.measure("")))
    w = text.split()
    named = dict(zip(quality.MEASURES, whole))
    assert named["distinct_words"] == len(set(w)) / len(w) and np.isclose(named["word_length"], sum(map(len, w)) / len(w))
    assert np.isclose(named["word_again"], sum(a == b for a, b in zip(w, w[1:])) / len(w)) and np.isclose(named["capitals"], sum(c in quality_capitals for c in text) / len(text.encode()))


quality_capitals = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def test_scores_are_sums_of_bin_additions():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (400, 4)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 4)).astype(int)  # an interaction that no single measure tells
    model = quality.boost(x, y, np.ones(400), bins=8, pair_bins=8, rounds=20, pair_rounds=60)
    assert model.pairs[0] == (0, 1) and ((model.score(x) >= 0.5) == y).mean() > 0.97
    for i in range(0, 400, 37):
        z = model.intercept + sum(t[int((c <= x[i, f]).sum())] for f, (c, t) in enumerate(zip(model.cuts, model.tables)))
        z += sum(t[int((model.pair_cuts[a] <= x[i, a]).sum()), int((model.pair_cuts[b] <= x[i, b]).sum())] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert np.isclose(model.score(x[i : i + 1])[0], 1 / (1 + np.exp(-z)))


def test_shallow_trees_take_the_best_cuts():
    g, h = np.array([1.0, 1.0, -3.0, -3.0, 2.0, 2.0]), np.full(6, 4.0)
    out = quality.shallow_tree(g, h, l2=0.0, least=1.0)
    assert len(set(np.round(out, 9))) <= 4 and np.allclose(out[2:4], -0.75) and np.allclose(out[:2], 0.25) and np.allclose(out[4:], 0.5)
    assert np.allclose(quality.shallow_tree(np.zeros(1), np.ones(1)), 0)


# -- 12: spelling variants


def edits(w, alphabet):
    for i in range(len(w) + 1):
        for a in alphabet:
            yield w[:i] + a + w[i:]
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            for a in alphabet:
                yield w[:i] + a + w[i + 1 :]


def plain_variants(n):
    alphabet = set("".join(n))
    near = {w: {v for v in edits(w, alphabet) if v in n and v != w} for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def grouped(spark, n):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(words, Scratch(spark, "t12")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_dense_words(spark, seed):
    rng = random.Random(seed)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.choice([3, 3, 4, 6, 12, 25, 50, 100]) for _ in range(250)}
    assert grouped(spark, n) == plain_variants(n)


def test_variants_of_runs_of_one_letter(spark):
    n = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "baaaa": 6, "aaaab": 6, "aaa": 99, "": 5, "b": 2}
    got = grouped(spark, n)
    assert got == plain_variants(n)
    assert got["aaaaa"] == ("aaaaaa", "aaaaaaa", 3, 3, 6)  # of equal counts the first by code points, each near word once


def test_no_words(spark):
    assert grouped_empty(spark) == 0
    with pytest.raises(ValueError):
        variants.group_variants(spark.createDataFrame([("a", 1)], "word string, n long"), Scratch(spark, "t12"), ratio=1)


def grouped_empty(spark):
    return variants.group_variants(spark.createDataFrame([], "word string, n long"), Scratch(spark, "t12")).count()


def test_words_are_counted_with_the_change(spark):
    import re

    rng = random.Random(4)
    rows = [(i if i % 9 else None, " ".join(rng.choice(["Straße", "ÉCOLE", "hello", "HELLO-world", "naïve", "abc", "x1yyyyy"]) for _ in range(120)), "en") for i in range(40)]
    rows += [(77, None, None), (78, "", None)]
    want = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            want[word] = want.get(word, 0) + 1
    want = {w: c for w, c in want.items() if len(w) >= 5 and c >= 3}
    assert any(w not in ("straße", "École", "École", "hello", "world", "naïve", "yyyyy", "École") for w in want)
    assert {r["word"]: r["n"] for r in variants.count_words(docs(spark, rows), queries.drop_one_in_97).collect()} == want


# -- 13: filter interactions


def plain_audit(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    masks = []
    for i, text, lang in rows:
        t = text or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        masks.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                shapley[x] += len(gone)
                redundant = sum(x in m[1] for m in mine) - len(gone)
                out[part, order, k] = [len(left), len(gone), redundant, sum(m[1] == {x} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def audited(spark, rows, labels):
    out = audit.filter_interactions(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark, "t13"))
    cols = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = out.collect()
    by = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in got}
    assert len(by) == len(got)
    return by


def test_audit_of_mixed_documents(spark):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randint(0, k)}" for _ in range(n)) for n in (10, 199, 200, 260) for k in (3, 5000)]
    pool += [p + x for p in pool for x in (" ABCDEFGHIJKLMNOPQRSTUVW" * 3, " #")] + ["", None, "one word", "A" * 5000]
    rows = [(rng.choice([None, rng.randint(0, 60)]) if rng.random() < 0.1 else i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += rows[:5]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (None, 1, 1)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_nothing_and_of_other_filters(spark):
    assert audited(spark, [], [(1, 1, 0)]) == {}
    d = docs(spark, [(1, "a", "en"), (2, "b", "en"), (3, "b", "en")])
    cells = audit.mask_cells(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"), lambda text, words: {"x": text == "b"}, None)
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in audit.walk_orders(cells, "x", Scratch(spark, "t13")).collect()}
    assert got == {("x", 1): (1, 2)}
    for letters in ("", "AA", "ABCDEFG", "A'"):
        with pytest.raises(ValueError):
            audit.walk_orders(cells, letters, Scratch(spark, "t13"))


def test_one_text_for_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en") for i in range(300)]
    got = audited(spark, rows, [(0, 1, 0)])
    assert got["en", "EABCD", 1][:2] == [201, 99] and got["en", "AEBCD", 2][:3] == [0, 0, 99]
