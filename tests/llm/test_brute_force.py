"""Operators 1, 7 and 9 against plain versions: n-gram filters as sets, chunk boundaries byte by byte, noisy-or by hand."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyboard.llm import chunks, langid, toxicity
from tallyboard.llm.common import Scratch

from .brute import ODD, docs, odd_docs


@pytest.fixture(params=["table", "odd"])
def some_docs(request, spark):
    return docs(spark) if request.param == "table" else odd_docs(spark)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# -- 1: languages


def plain_trigrams(text):
    low = text.lower()
    return [tuple(c if c.isalpha() else " " for c in (low[i - 1] if i else " ", low[i], low[i + 1] if i + 1 < len(low) else " ")) for i in range(len(low)) if low[i].isalpha()]


def test_languages_by_sets_of_ngrams(spark):
    d = docs(spark)
    filters = langid.fit(d, Scratch(spark, "t1"), sample_per_lang=10**9, bits=20)  # so wide that false positives are few
    rows = d.select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            counts[r["lang"]].update(plain_trigrams(r["text"]))
    langs, total = sorted(counts), {x: sum(c.values()) for x, c in counts.items()}
    top = defaultdict(float)
    for x in langs:
        for g, n in counts[x].items():
            top[g] = max(top[g], n / total[x])
    member = {x: {g for g, n in counts[x].items() if n >= 3 and n / total[x] * 4 >= top[g]} for x in langs}
    assert filters.langs == langs and (filters.false < 0.01).all()
    got = {r["doc_id"]: r for r in langid.detect(d, filters).collect()}
    for r in rows:
        grams = plain_trigrams(r["text"] or "")
        share = {x: sum(g in member[x] for g in grams) / max(len(grams), 1) for x in langs}
        best = max(share.values())
        mine = got[r["doc_id"]]
        if not grams:
            assert (mine["lang_pred"], mine["score"]) == ("und", 0)
        else:
            assert abs(mine["score"] - best) < 0.02 and share[mine["lang_pred"]] > best - 0.02


def test_equal_rates_take_the_first_language(spark):
    d = spark.createDataFrame([(i, "same words here and there", x) for i in range(5) for x in ("bb", "aa", "cc")], "doc_id long, text string, lang string")
    got = langid.detect(d, langid.fit(d, Scratch(spark, "t1"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("aa", 1.0)}


# -- 7: fingerprints


def plain_chunks(text):
    """Distinct (digest, bytes) of the chunks, by one pass over the bytes with the last 32 of them in the hash."""
    data, sets, start, out = text.encode("utf-8", "surrogatepass"), Counter(), 0, []
    gear = [int(x) for x in chunks.GEAR]
    hashes = []
    for i in range(len(data)):
        h = 0
        for age in range(min(32, i + 1)):
            h += gear[data[i - age]] << age
        hashes.append(h % (1 << 32))
    strict, loose = int(chunks.STRICT), int(chunks.LOOSE)
    while start < len(data):
        end = len(data)
        for at in range(start + chunks.LEAST, len(data)):
            n, h = at - start, hashes[at - 1]
            if (n < chunks.NORMAL and h & strict == 0) or (n >= chunks.NORMAL and h & loose == 0) or n >= chunks.MOST:
                end = at
                break
        out.append((start, end))
        start = end
    for a, b in out:
        value, power = 0, 1
        for x in data[a:b]:
            value, power = (value + (x + 1) * power) % (1 << 64), power * int(chunks._P) % (1 << 64)
        z = value ^ (b - a)
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            z = (z ^ z >> 33) * c % (1 << 64)
        sets[(z ^ z >> 33) >> 24] += b - a
    return sets


def test_chunks_byte_by_byte(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "a" * 400, "12345678", "123456789", "éß文\U0001f600" * 30] + ["".join(rng.choice("abc deé\n") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    for part in (1 << 18, 64):
        monkeypatch.setattr(chunks, "PART", part)
        for t in texts:
            ids, sizes = chunks.chunk_set(t)
            assert dict(zip(ids.tolist(), sizes.tolist())) == plain_chunks(t), (part, t)


def test_likeness_of_edited_and_next_documents(some_docs):
    rows = sorted(rows_of(some_docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    short = [(i, t if len(t) < 3000 else None) for i, t in rows]
    got = Counter(tuple(r) for r in chunks.compare_with_edits(some_docs).collect())
    kept = {}

    def sets(t):
        return kept.setdefault(t, plain_chunks(t))

    def inside(a, b):
        total = sum(a.values())
        return sum(min(n, b[x]) for x, n in a.items()) / total if total else 1.0

    seen = 0
    for (i, t), (_, u) in zip(short, short[1:] + short[:1]):
        if t is None or u is None:
            continue
        k = len(t) // 2
        e = t[: len(t) - k] + u[:k]
        text = lambda s: ",".join(f"{d:010x}{n:x}" for d, n in sorted(s.items()))
        want = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(sets(t)), text(sets(e)), inside(sets(t), sets(e)), inside(sets(t), sets(u)))
        assert got[want] > 0, (i, want[5:], [x[5:] for x in got if x[:2] == want[:2]])
        seen += 1
    assert seen >= 5


# -- 9: toxicity


def test_noisy_or_by_hand():
    model = toxicity.Model({"bad": 3.0, "good": -2.0, "badl*": 1.5}, -4.0)
    rng = random.Random(1)
    words = ["bad", "good", "badly", "BAD", "other", "x1", "", "!"]
    for _ in range(200):
        text = "".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) + rng.choice([". ", "! ", "\n", "。", "; "]) for _ in range(rng.randint(0, 6)))
        clean = 1.0
        for s in re.split(r"[.!?\n。！？]", text):
            found = re.findall(r"[^\W\d_]+", s.lower())
            if found:
                z = -4.0 + 3.0 * ("bad" in found) - 2.0 * ("good" in found) + 1.5 * ("badly" in found)
                clean *= 1 - 1 / (1 + math.exp(-z))
        score, spans = model.score(text)
        assert abs(score - (1 - clean)) < 1e-9
        assert all(0.5 <= p <= 1 and "bad" in text[a:b].lower() for a, b, p in spans)
    assert model.score(None) == model.score("") == (0.0, [])


def test_noisy_or_is_fitted_to_its_maximum():
    rng = np.random.default_rng(2)
    doc = np.repeat(np.arange(60), 3)
    sents = [np.unique(rng.integers(0, 6, rng.integers(1, 4))) for _ in doc]
    y = np.array([float(any(0 in sents[s] for s in np.flatnonzero(doc == d)) ^ (rng.random() < 0.1)) for d in range(60)])
    plain, weight = rng.integers(0, 3, 60), rng.random(60) + 0.5

    def likelihood(theta):
        clean = np.ones(60) * (1 - 1 / (1 + np.exp(-theta[-1]))) ** plain
        for s, d in zip(sents, doc):
            clean[d] *= 1 - 1 / (1 + np.exp(-(theta[-1] + theta[:-1][s].sum())))
        return float((weight * np.where(y == 1, np.log(np.maximum(1 - clean, 1e-300)), np.log(clean))).sum() / weight.sum() - 0.5 * 1e-4 * (theta[:-1] ** 2).sum())

    w, b = toxicity.fit_noisy_or(doc, sents, plain, y, weight, 6, rounds=3000)
    best = likelihood(np.append(w, b))
    assert w.argmax() == 0
    for i in range(7):
        for step in (-0.05, 0.05):
            moved = np.append(w, b)
            moved[i] += step
            assert likelihood(moved) < best + 1e-4


def test_a_score_of_exactly_one_half_is_toxic():
    model = toxicity.Model({"w": 0.0}, 0.0)
    assert model.score("w")[0] == 0.5 and len(model.score("w")[1]) == 1
    assert len(ODD) > 5
