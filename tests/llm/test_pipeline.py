"""Stages of the pipeline on odd rows and against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .brute import DATA, ODD, base_spans, odd_docs, roots, shingles


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns over the smallest documents, as the run does it."""
    base, out = str(tmp_path_factory.mktemp("stages")), []
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, d, DATA).write.parquet(f"{base}/{i}")
        out.append((d, d := spark.read.parquet(f"{base}/{i}")))
    return out


def test_columns(kept):
    assert all(tuple(after.columns) == P.COLUMNS for _, after in kept[:-1])


def test_toxic_documents_go(spark):
    sf = DATA.replace("0.001", "0.1")  # smaller tables have too few labels to learn from
    before, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    after = P.drop_toxic(spark, before, sf).select("doc_id").withColumn("kept", F.lit(1))
    n = {(r["toxic"], r["kept"]): r["count"] for r in labels.join(after, "doc_id", "left").groupBy("toxic", "kept").count().collect()}
    assert n.get((0, None), 0) <= 0.005 * n[0, 1] and n[1, None] >= 0.9 * (n[1, None] + n.get((1, 1), 0))


def test_one_of_each_group_stays(kept):
    before, after = (x.select("doc_id", "text").collect() for x in kept[1])
    sets = {r["doc_id"]: frozenset(shingles(r["text"], 5)) for r in before}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = roots(list(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    assert Counter(group[r["doc_id"]] for r in after) == Counter(set(group.values()))


def test_personal_data_goes_and_the_rest_stays(kept):
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in kept[2])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not base_spans(before[i]["text"]):
            assert r["text"] == before[i]["text"]
    assert sum(len(re.findall(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"])) for r in after.values()) > 0


def test_sources_near_targets(kept):
    size = F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"))
    before, after = ({r["source"]: r["n"] for r in x.groupBy("source").agg(F.sum(size).alias("n")).collect()} for x in kept[3])
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) < 0.1 * sum(before.values())
    assert max(Counter(r["doc_id"] for r in kept[3][1].collect()).values()) <= 2


def test_all_tokens_are_packed(kept):
    before, after = kept[4]
    pieces = after.toPandas()
    assert (pieces["ids"].map(len) == 2 * pieces["length"]).all()
    ends = sum((np.frombuffer(x, "<u2") == 0).sum() for x in pieces["ids"])
    assert ends == before.count() and pieces.groupby("sequence_id")["length"].sum().max() <= 1024


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_odd_rows(spark, k, rows):
    got = P.STAGES[k][1](spark, odd_docs(spark, rows), DATA).collect()
    if k in (0, 2):
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    if k == 1 and rows:
        # a repeated row, three texts without words and one differing in case only are copies
        assert len(got) == len(rows) - 4
    if k == 2 and rows:
        assert {r["text"] for r in got if r["doc_id"] is None} == {"no id here mail [EMAIL]"}
    if k == 3:
        assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
