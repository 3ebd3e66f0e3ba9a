"""Each operator against brute force or held-out labels, on the smallest tables and on odd rows."""

import functools
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyboard.llm import chunks, graph, langid, lm, mixing, neighbours, packing, pii, queries, simhash, tokens, toxicity
from tallyboard.llm.common import Scratch

from .brute import BASE, DATA, ODD, base_spans, crc_ids, docs, odd_docs, roots, shingles, simhash as plain_simhash, words


@pytest.fixture(params=["table", "odd", "empty"])
def some_docs(request, spark):
    return docs(spark) if request.param == "table" else odd_docs(spark, ODD if request.param == "odd" else [])


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_components_of_a_hub_and_a_chain(spark, scratch):
    links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (5, 0)]
    got = graph.connected_components(spark.createDataFrame(links, "u long, v long"), scratch).collect()
    want = roots({x for e in links for x in e}, links)
    assert {r["node"]: r["component"] for r in got} == {k: v for k, v in want.items() if k not in (7,) or v == 0}


def test_languages_of_held_out_texts(spark):
    got = {r["doc_id"]: r for r in queries.op1_langid(spark, DATA.replace("0.001", "0.01")).collect()}
    truth = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(truth)
    judged = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in truth if got[r["doc_id"]]["held_out"] and r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert len(judged) > 100 and np.mean([a == b for a, b in judged]) >= 0.9


def test_languages_of_odd_rows(spark, scratch):
    filters = langid.fit(docs(spark), scratch)
    got = langid.detect(odd_docs(spark), filters).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert sorted((r["doc_id"] for r in got if r["lang_pred"] == "und"), key=str) == [2, 3, 4, 5]
    assert langid.detect(odd_docs(spark), langid.fit(odd_docs(spark, []), scratch)).count() == len(ODD)
    assert langid.detect(odd_docs(spark, []), filters).count() == 0


def test_bloom_filter_returns_every_language_of_a_trigram(spark, scratch):
    d = spark.createDataFrame([(i, "zzz qqq " * 5, lang) for i, lang in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    found, total = langid.fit(d, scratch).counts(["zzz", "wxw"])
    assert (found[0] == total[0]).all() and (found[1] == 0).all()


def test_simhash_groups(some_docs, scratch):
    rows = rows_of(some_docs)
    got = simhash.near_duplicates(some_docs, scratch).collect()
    fps = [plain_simhash(t) for _, t in rows]
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter(zip([i for i, _ in rows], fps))
    group = roots(set(fps), [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 3])
    low = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        low[group[f]] += [i] if i is not None else []
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, min(low[group[f]], default=None)) for (i, _), f in zip(rows, fps)}


def test_simhash_links_across_tiles_of_a_large_group(spark, scratch, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 16)) << 48  # one shared block: all in a single band
    fps = list({base | int(x) for x in rng.integers(0, 1 << 11, 400)})
    d = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, f.to_bytes(8, "big"), f.bit_count(), 1) for f in fps], "node long, fp binary, ones int, band long")
    got = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(d, scratch, 3).collect()]
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    assert roots(fps, got) == want


def test_similar_groups_by_five_word_shingles(some_docs, scratch):
    rows = [(i, r["text"]) for i, r in enumerate(some_docs.select("text").collect())]
    numbered = some_docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(numbered, scratch).collect()}
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    alike = lambda a, b: a == b or (len(a & b) >= 0.8 * len(a | b))
    assert got == roots(list(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])


@functools.cache
def _library(name):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(tokens.vocabulary_path(name))
    out.encode_special_tokens = True  # their strings in a text are ordinary text
    return out


def _ids(name, text):
    return _library(name).encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(some_docs, scratch):
    got = tokens.read_files(tokens.write_files(some_docs, scratch, tokens.vocabulary_path("word_bpe_49k.json"), end_id=1)).orderBy("start").collect()
    rows = sorted(rows_of(some_docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))  # null ids first
    ids = [_ids("word_bpe_49k.json", t) + [1] for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    assert [tuple(r) for r in got] == [(i, s, len(x), crc_ids(x)) for (i, _), s, x in zip(rows, starts, ids)]


def test_token_files_by_ranges(spark, scratch, monkeypatch):
    d = odd_docs(spark, [*ODD, (None, "a", None, None, 1), (None, None, None, None, 0)])
    files = tokens.write_files(d, scratch, tokens.vocabulary_path("word_bpe_49k.json"), end_id=1)
    want = [tuple(r) for r in tokens.read_files(files).orderBy("start").collect()]
    for r in files.collect():
        near = tokens.TokenFile(r["folder"], r["file"], r["width"], r["n_docs"], r["n_null"])
        far = tokens.TokenFile(r["folder"], r["file"], r["width"], r["n_docs"], r["n_null"])
        far.local = False  # as in a store that cannot be mapped
        assert [near[i].tolist() for i in range(len(near))] == [far[i].tolist() for i in range(len(far))]
        assert near.doc_ids(0, len(near)).to_pylist() == far.doc_ids(0, len(far)).to_pylist()
    assert len(want) == d.count() and want[0][0] is None


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_library(vocabulary):
    enc = tokens.encoder(tokens.vocabulary_path(vocabulary))
    texts = ["", " ", "a  b", "a\n b \n", "Größe, LEÇON! ", "don't stop 123 4.5", "文字 　x y", "<|endoftext|> [CLS]", "a <|endoftext|>b", "a  <|endoftext|>  \n b<|endoftext|>", "x<|startoftext|> y <|ENDOFTEXT|>", "é́ \U0001f600", "\x00 \x1f x", "tab\tand\r\nline  ", "'re 're", "ﬁ Ⅷ İ"]
    rnd = random.Random(1)
    odd = [*"ab .,'\n\t\r 0é #<|>&", "\u0301", "\u3000", "  ", "\n\n", " \n", "'s", "<|endoftext|>", "İ", "\x1c", "\x85", "𝒳", "文", "Àb", "ª", "Word", " word...", "ﬁ"]
    texts += ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 40))) for _ in range(20_000)]
    got = [b for _, _, blobs in enc.batches(pa.array([*texts, None])) for b in blobs]
    assert got[-1] == b"" and len(got) == len(texts) + 1
    for t, b in zip(texts, got):
        assert np.frombuffer(b, enc.dtype).tolist() == _ids(vocabulary, t), t


def test_packing_holds_each_token_once(some_docs, scratch):
    packed = packing.pack(some_docs, scratch, tokens.vocabulary_path("byte_bpe_50k.json"), keep_ids=True)
    got = packed.pieces.collect()
    bare = packing.pack(some_docs, scratch, tokens.vocabulary_path("byte_bpe_50k.json")).pieces
    same = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert Counter(tuple(r[c] for c in same) for r in bare.collect()) == Counter(tuple(r[c] for c in same) for r in got)
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r["row"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert crc_ids(np.frombuffer(r["ids"], "<u2")) == r["ids_crc32"] and len(r["ids"]) == 2 * r["length"] > 0
    made = Counter()
    for parts in by_row.values():
        parts.sort(key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in parts), "<u2").tolist()
        assert [r["start"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts[:-1]]]).tolist() and len(ids) == parts[0]["doc_tokens"]
        made[parts[0]["doc_id"], tuple(ids)] += 1
    assert made == Counter((i, tuple(_ids("byte_bpe_50k.json", t) + [0])) for i, t in rows_of(some_docs))
    padded = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts[:-1]]]).tolist() and n <= 1024
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded <= 0.02 * sum(r["length"] for r in got) and set(by_seq) == set(range(len(by_seq)))


def test_patterns_reach_the_bound():
    cols, x = packing.patterns(np.array([3, 5, 7]), np.array([100.0, 100, 100]), 10)
    assert (packing.times(cols, x) >= 99.9).all() and x.sum() <= 152 and (cols.T @ np.array([3, 5, 7]) <= 10).all()


def test_personal_data_spans(some_docs, scratch):
    got = pii.digest(pii.sanitise_spans(some_docs, scratch)).collect()
    want = [(i, *[sum(s.startswith(k) for s in b) for k in pii.KINDS], hashlib.sha256(",".join(b).encode()).hexdigest()) for i, t in rows_of(some_docs) for b in [base_spans(t)]]
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)


def test_patterns_on_hard_texts(spark, scratch):
    texts = ["a@b a@b.c@d.e", "..@x.y", "1.2.3.4.5.6.7.8", "999.1.1.1 255.255.255.0255", "4111 1111 1111 1111 22", "4111-1111-1111-1111", "+1 (234) 567-8901 +1", "+123456789012345678", "a.b+c%d@e-f.g-h.", "x@y.z.1.2.3.4", "\U0001f600 a@b.cc \U0001f600 10.0.0.1", "@" * 50 + "a" * 3000, "1 " * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.sanitise_spans(d, scratch)).collect()}
    assert got == {i: ",".join(base_spans(t)) for i, t in enumerate(texts)}


def test_terms_that_reveal_a_value(spark, scratch):
    rows = [(i, f"note {i} zorblax the writer at zed@mail.org said so {i} zorblax") for i in range(6)] + [(100 + i, f"the writer of page {i} said so at noon") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.sanitise_spans(d, scratch)
    got = {r["doc_id"]: [rows[r["doc_id"]][1][t["start"] : t["end"]] for t in r["terms"]] for r in found.collect() if r["doc_id"] < 100}
    assert all(x == ["note", "zorblax", "zorblax"] for x in got.values())
    masked = d.join(found.withColumnRenamed("doc_id", "f"), F.col("doc_id") == F.col("f")).select("doc_id", pii.mask(F.col("text"), pii.bare(F.col("spans")), F.col("terms")).alias("t"))
    assert {r["t"] for r in masked.filter("doc_id = 3").collect()} == {" 3  the writer at [EMAIL] said so 3 "}


def test_ratings_of_terms(spark, scratch):
    rnd = random.Random(3)
    values = ["a{}@mail1.example.com", "b{}@mail2.example.com", "10.0.{}.7", "+1 (407) 555-{:04d}", 'token = "9f86d081884c7d659a2feaa0c55ad{:03x}"']
    rows = []
    for i in range(300):
        ws = [rnd.choice(["and", "of", "soup", "rain", "noon", f"rare{rnd.randint(0, 20)}"]) for _ in range(rnd.randint(0, 12))]
        for k in range(len(values)):
            if rnd.random() < 0.08:
                ws.insert(rnd.randint(0, len(ws)), ["write", "write", "host", "ring", "secret"][k] + " " + values[k].format(i % 250))
        rows.append((i, " ".join(ws)))
    rows += rows[:40]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = scratch.write(pii.find_base(d).withColumn("row", F.monotonically_increasing_id()), "found")
    got = {(r["e"], r["term"]): r["ratio"] for r in pii.ratings(d, found, scratch).collect()}
    texts = {t for _, t in rows}
    ents, terms = {}, {}
    for t in texts:
        e = set()
        for k, (p, ok) in BASE.items():
            for m in re.finditer(p, t):
                if ok(m.group()):
                    v = m.group()
                    e |= {k, f"{k}={v}", f"{k}/" + {"email": v.split("@")[-1], "ip": "A", "card": v[0], "phone": "+1"}[k]}
        ents[t] = e | ({"identifier"} if "token" in t else set())
        terms[t] = {w.lower() for w in re.findall(r"[^\W_]+", t) if len(w) >= 3}
    n_e, n_t = Counter(e for s in ents.values() for e in s), Counter(w for s in terms.values() for w in s)
    n_et = Counter((e, w) for t in texts for e in ents[t] for w in terms[t])
    n = len(texts)
    want = {(e, w): math.log(k * n / (n_t[w] * n_e[e])) / math.log(n / n_e[e]) for (e, w), k in n_et.items() if k >= 5 and 5 <= n_e[e] <= n / 2}
    want = {k: r for k, r in want.items() if r >= 0.8}
    assert got == pytest.approx(want) and {("identifier", "token"), ("identifier", "secret"), ("ip", "host"), ("email/mail1.example.com", "mail1")} <= set(want)
    spans = {r["doc_id"]: r for r in pii.digest(pii.sanitise_spans(d, scratch, identifier_bits=10.0)).collect()}
    for i, t in rows:
        assert (spans[i]["n_spans"] > 0) == bool(ents[t]), t


def test_many_numbers_in_one_text(spark, scratch):
    rows = [(1, ", ".join(str(10 + i % 90_000) for i in range(200_000))), (2, "x " + "a1@b.cc " * 3_000)]
    start = time.time()
    got = {r["doc_id"]: r for r in pii.digest(pii.sanitise_spans(spark.createDataFrame(rows, "doc_id long, text string"), scratch)).collect()}
    assert got[1]["n_spans"] == 0 and got[2]["n_email"] == 3_000 and time.time() - start < 60
    assert got[2]["spans"] == ",".join(f"email:{2 + 8 * i}:{9 + 8 * i}" for i in range(3_000))


def brute_scores(texts):
    """(words, backed off, log score) of each text, its own words and bigrams left out of every count."""
    of = [words(t) for t in texts]
    uni = Counter(w for t in of for w in t) + Counter({"<s>": sum(1 for t in of if t)})
    bi = Counter(g for t in of for g in zip(["<s>", *t], t))
    total = sum(map(len, of))
    for t in of:
        mine, own = Counter(zip(["<s>", *t], t)), Counter(["<s>", *t])
        s, backs = 0.0, 0
        for v, w in zip(["<s>", *t], t):
            c = bi[v, w] - mine[v, w]
            backs += c <= 0
            s += math.log(c / (uni[v] - own[v])) if c > 0 else math.log(0.4 * max(uni[w] - own[w], 1) / max(total - len(t), 1))
        yield len(t), backs, s


@pytest.mark.parametrize("block_chars", [lm.BLOCK_CHARS, 5_000])
def test_backoff_scores(some_docs, scratch, block_chars):
    rows = rows_of(some_docs)
    want = Counter((i, n, backs, round(round(s, 6), 4)) for (i, _), (n, backs, s) in zip(rows, brute_scores([t for _, t in rows])))
    got = lm.score(some_docs, scratch, block_chars=block_chars).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_backoff"], round(r["log_score"], 4)) for r in got) == want
    assert all(r["score"] == (r["log_score"] / r["n_tokens"] if r["n_tokens"] else 0.0) for r in got)


def test_backoff_scores_against_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = duck.sql(queries.ORACLE_SQL["op6_lm_scores"]).select("doc_id, n_tokens, n_backoff, log_score, score").fetchall()
    got = [tuple(r) for r in queries.op6_lm_scores(spark, DATA).select("doc_id", "n_tokens", "n_backoff", "log_score", "score").collect()]
    assert sorted(got) == sorted(want)


def test_backoff_counts_every_word(spark, scratch):
    # 300,000 words that occur once each: no bigram is seen elsewhere, so all tokens back off
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(10_000))) for i in range(30)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert len(got) == 30 and all((r["n_tokens"], r["n_backoff"]) == (10_000, 10_000) for r in got)
    assert all(r["score"] == pytest.approx(math.log(0.4 / 290_000), abs=1e-6) for r in got)


def test_backoff_counts_beyond_15_bits(spark, scratch):
    texts = ["x " * 70_000, "x " * 70_000 + "y", "x"]
    got = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch, block_chars=1).collect()
    want = dict(enumerate(brute_scores(texts)))
    assert all((r["n_tokens"], r["n_backoff"], r["log_score"]) == (*want[r["doc_id"]][:2], pytest.approx(want[r["doc_id"]][2], abs=1e-4)) for r in got)


def test_a_hot_bigram_has_one_entry_a_block(spark, scratch):
    rows = [(i, f"the the a{i} b{i}") for i in range(3_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = lm.deal_blocks(d, scratch, block_chars=9_000)
    n = blocks.count()
    entries = lm.ngram_entries(blocks, 8)
    assert lm.counts_elsewhere(entries).select(F.explode(F.zip_with("c", "c_high", lambda a, b: b * 32768 + a)).alias("c")).agg(F.max("c")).first()[0] < 6_000
    keys = entries.select("bucket", "block", F.explode(F.arrays_zip("hi", "lo", "n")).alias("g")).groupBy("bucket", "g.hi", "g.lo").agg(F.count("*").alias("n"), F.sum("g.n").alias("c"))
    top = keys.agg(F.max("n"), F.max("c"), F.count("*")).first()
    assert 3 < n < 10 and tuple(top) == (n, 6_000, 2 + 2 * 3_000 + 2 + 2 * 3_000)
    got = lm.score(d, scratch, block_chars=9_000).collect()
    # <s> the, the the: 2,999 others; a and b back off, as words that occur nowhere else
    s = math.log(2_999 / 2_999) + math.log(2_999 / 5_998) + 2 * math.log(0.4 / 11_996)
    assert len(got) == 3_000 and all((r["n_tokens"], r["n_backoff"], r["log_score"]) == (4, 2, pytest.approx(s, abs=1e-5)) for r in got)


def test_fingerprints_of_edited_texts(some_docs):
    got = chunks.compare_with_edits(some_docs).collect()
    rows = sorted(rows_of(some_docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:3] for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_chunks_survive_a_shift_and_follow_the_gear_hash():
    text = " ".join(f"word{i * i % 997}" for i in range(3000))
    a, b = chunks.chunk_set(text), chunks.chunk_set("a prefix " + text)
    assert chunks.containment(a, b) > 0.95 and chunks.containment(a, a) == 1 and chunks.likeness(a, b) > 0.9
    data = np.frombuffer(text.encode(), np.uint8)[:500]
    h, plain = 0, []
    for x in data:
        h = (h * 2 + int(chunks.GEAR[x])) % (1 << 32)
        plain.append(h)
    assert chunks.gear(data).tolist()[40:] == plain[40:]
    back = chunks.from_text(chunks.as_text(a))
    assert (back[0] == a[0]).all() and (back[1] == a[1]).all()
    assert chunks.containment(chunks.chunk_set(""), a) == 1 and chunks.as_text(chunks.chunk_set(None)) == ""


def test_mix_agrees_with_sorting(some_docs, scratch):
    got = mixing.mix(some_docs, scratch).select("doc_id", "size", "source_size", "target", "taken").collect()
    duck = duckdb.connect()
    table = some_docs.select("doc_id", "text", "source").toArrow()
    duck.register("documents", table)
    want = duck.sql(queries.ORACLE_SQL["op8_mixing"]).select("doc_id, size, source_size, target, taken").fetchall()
    near = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert near(map(tuple, got)) == near(want)


def test_mix_comes_near_its_targets_and_takes_rows(spark, scratch):
    d = docs(spark)
    plan = mixing.mix(d, scratch).join(d.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("most")).collect()
    assert all(abs(r["t"] - r["target"]) <= r["most"] for r in plan)
    odd = odd_docs(spark)
    taken = Counter(r["doc_id"] for r in mixing.take(odd, scratch).collect())
    want = Counter()
    for r in mixing.mix(odd, scratch).collect():
        want[r["doc_id"]] += r["epochs"]
    assert taken == +want and mixing.take(odd, scratch).columns == odd.columns


def test_toxicity_of_held_out_documents(spark):
    sf = DATA.replace("0.001", "0.1")
    got = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").select("predicted", "toxic").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() >= 0.95


def test_toxicity_locates_the_sentence(spark, scratch):
    rows = [(i, f"A calm day number {i}. " + ("You are a grumblefoul person. " if i % 2 else "We had soup. ") + "Then it rained.") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, scratch)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(i % 2) for i in range(80))
    assert all("grumblefoul" in rows[i][1][s["start"] : s["end"]] for i in range(1, 80, 2) for s in got[i]["offending"])
    odd = toxicity.score(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) and all(r["score"] < 0.5 for r in odd)
    assert toxicity.keep_clean(odd_docs(spark), model).columns == odd_docs(spark).columns
    assert toxicity.score(odd_docs(spark), toxicity.fit(d, labels.filter("toxic = 1"), scratch)).filter("score > 1e-4").count() == 0


def vectors(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    n, top = len(rows[0][1]), max(r[0] for r in rows)
    v = rows[0][1]
    odd = [None, [0.0] * n, [float("nan")] * n, [None] + [1.0] * (n - 1), [float("inf")] + [0.0] * (n - 1), v, v, [x * 2 for x in v]]
    rows += [(top + 1 + i, x, rows[0][2]) for i, x in enumerate(odd)] + [(top + 20, v, None), (top + 21, v, 99)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_near_vectors(spark, scratch):
    df, rows = vectors(spark)
    fine = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    m, lab = np.stack([v for _, v, _ in fine]), np.array([x for *_, x in fine])
    u = m / np.sqrt((m * m).sum(axis=1))[:, None]
    a, b = np.nonzero(np.triu((u @ u.T >= 0.93) & (lab[:, None] == lab[None, :]), 1))
    links = [(fine[i][0], fine[j][0]) for i, j in zip(a, b)]
    n, comp = Counter(x for e in links for x in e), roots([r[0] for r in rows], links)
    got = neighbours.near_vectors(df.withColumn("node", F.lit("clash")), scratch).collect()
    assert {tuple(r) for r in got} == {(i, n[i], comp[i], i == comp[i]) for i, *_ in rows}
    assert neighbours.near_vectors(df.limit(0), scratch).count() == 0


def test_descent_walks_neighbours_below_the_threshold(spark, scratch):
    # pairs at cosine 0.97 among strangers; a pair may part in both of two trees
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 1_000, 6))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.97 * a + math.sqrt(1 - 0.97**2) * b / np.linalg.norm(b, axis=1)[:, None]
    m = np.concatenate([a, b]).astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(m)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_vectors(d, scratch, threshold=0.969, trees=2, sample=1, most_forests=1).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    want = ((u @ u.T) >= 0.969).sum(axis=1) - 1
    assert sum(got[i] == n for i, n in enumerate(want)) >= 0.97 * len(m)


def test_audit_counts_isolated_pairs_and_the_rest_is_exact(spark, scratch):
    # a hot cluster, whose links outnumber those of pairs by far, and pairs that one tree parts
    rng = np.random.default_rng(5)
    hot = np.r_[1.0, np.zeros(7)] + 0.01 * rng.standard_normal((400, 8))
    a = rng.standard_normal((300, 8))
    m = np.concatenate([hot, a, a + 0.1 * rng.standard_normal(a.shape)]).astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(m)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_vectors(d, scratch, k=1, threshold=0.98, trees=1, most_forests=1).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    assert got == dict(enumerate((((u @ u.T) >= 0.98).sum(axis=1) - 1).tolist()))


@pytest.mark.parametrize("pairs, cluster", [(0, 0), (5, 0), (60, 0), (0, 3000)])
def test_audit_is_one_bounded_pass(spark, scratch, monkeypatch, pairs, cluster):
    # strangers beyond the sample, with no link, few links, or a cluster of thousands
    rng = np.random.default_rng(7)
    m = rng.standard_normal((2_000, 24))
    twins = m[:pairs] + 0.05 * rng.standard_normal((pairs, 24))
    hot = np.r_[5.0, np.zeros(23)] + 0.1 * rng.standard_normal((cluster, 24))
    m = np.concatenate([m, twins, hot]).astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(m)], "vec_id long, embedding array<float>, label int")
    passes, real, report = [], neighbours._audit, {}
    monkeypatch.setattr(neighbours, "_audit", lambda *a: passes.append(a[1:4]) or real(*a))
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_vectors(d, scratch, sample=200, report=report).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    assert got == dict(enumerate((((u @ u.T) >= 0.93).sum(axis=1) - 1).tolist()))
    assert len(passes) == 1 and report["audited"] == 200 and 2 <= report["forests"] <= 4 and report["found"] == report["linked"]


def test_thousands_of_different_addresses_in_one_text(spark, scratch):
    parts = [f"name{i} user{i}@host{i % 50}.org" for i in range(20_000)]
    rows = [(i, f"mail user{i}@example.org about alpha{i % 7}") for i in range(68)] + [(100, " ".join(parts))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in pii.digest(pii.sanitise_spans(d, scratch)).collect()}
    assert time.time() - start < 60  # each term and each entity once: about 10 s, most of it start-up
    at, want = 0, []
    for x in parts:
        a = at + x.index(" ") + 1
        want.append(f"email:{a}:{at + len(x)}")
        at += len(x) + 1
    assert got[100]["spans"] == ",".join(want)


def test_terms_and_identifiers_beside_spans(spark, scratch):
    spans, stretch = "array<struct<kind string, start bigint, end bigint>>", "array<struct<start bigint, end bigint, removed boolean>>"
    rng = random.Random(9)
    rows = []
    for i in range(60):
        cut = lambda n: [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(n))]
        rows.append((i, [("email", a, b) for a, b in cut(rng.randint(0, 4))], [(a, b, 9) for a, b in cut(rng.randint(0, 3))], [(a, b, rng.random() < 0.5) for a, b in cut(rng.randint(0, 6))]))
    d = spark.createDataFrame(rows, f"row long, spans {spans}, long array<struct<start bigint, end bigint, mixes int>>, terms {stretch}")
    hit = lambda x, ys: any(x[0] < b and a < x[1] for a, b in ys)
    want = {}
    for i, ss, ls, ts in rows:
        base, own = [x[1:] for x in ss], [x[:2] for x in ls]
        kept = sorted([(*x, False) for x in own if not hit(x, base)] + [t for t in ts if not hit(t, base) and not hit(t, own)])
        if kept:
            want[i] = kept
    assert {r["row"]: [tuple(t) for t in r["terms"]] for r in pii._clear(d).collect()} == want


def pairs_at(similarity_of_union, n, seed):
    """Pairs of texts that share four of five of all their shingles, for unions of several sizes."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        union = rng.choice(similarity_of_union)
        shared, a = 4 * union // 5, rng.randint(0, union // 5)
        base = [f"w{rng.randrange(10**9)}" for _ in range(shared + 4)]
        for extra in (a, union // 5 - a):
            rows.append((len(rows), " ".join(base + [f"x{rng.randrange(10**9)}" for _ in range(extra)])))
    return rows


def test_pairs_at_exactly_the_threshold(spark, scratch):
    rows = pairs_at([5, 5, 10, 15, 20, 25, 50, 100], 1_500, 4)
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert all(got[i] == got[i + 1] == i for i in range(0, len(rows), 2))


def test_exact_links_of_groups_beyond_a_tile(spark, scratch, monkeypatch):
    # chains, whose ends are far apart, and clusters, in candidate groups of many tiles
    monkeypatch.setattr(simhash, "SET_TILE", 6)
    rng = random.Random(2)
    sets = {}
    for c in range(12):
        at = rng.getrandbits(40)
        sets[len(sets)] = set(range(at, at + 40))
        for step in range(rng.randint(1, 9)):
            at += rng.choice([2, 4, 4, 5, 9])
            sets[len(sets)] = set(range(at, at + 40))
    members = spark.createDataFrame([(i % 2, i, len(x)) for i, x in sets.items()], "comp long, node long, size long")
    blobs = spark.createDataFrame([(i, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in sets.items()], "node long, shingles binary")
    links = [(a, b) for a in sets for b in sets if a < b and (a - b) % 2 == 0 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    edges = [(r["u"], r["v"]) for r in simhash.exact_links(members, blobs, 0.8, scratch).collect()]
    assert roots(sets, edges) == want and all(want[a] == want[b] for a, b in edges) and len(set(want.values())) > 12
