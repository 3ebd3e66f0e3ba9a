"""Landed issue pages, label lines, and the log source, on handwritten fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from tallyboard.functions import texts as T
from tallyboard.sources import issue_pages as I
from tallyboard.streaming import log_tail

ROW = "<tr><td class='id'><a href='/issues/{0}'>#{0}</a></td><td class='tracker'>Bug</td><td class=subject><a href='/issues/{0}'> {1} </a></td><td class='fixed_version'></td><td class='version'>v1</td></tr>"


def page(*rows, more=""):
    return "<table class='list issues'><thead><tr><td class=id>9</td><td class=subject>head</td></tr></thead><tbody>" + "".join(ROW.format(*r) for r in rows) + f"</tbody></table>{more}"


def scan(spark, pages):
    return I.issue_rows(I.read_pages(spark.createDataFrame(pages, "page_no long, url string, html string")))


def test_rows_of_pages(spark):
    pages = [
        (1, "http://t/issues", page((7, "one"), (8, "two"), more="<ul class=pagination><li class='next page'><a href='?page=2'>next</a></li></ul>")),
        (2, "http://t/issues?page=2", page((8, "again"), (0, "no id"), (10, ""))),
        (4, "http://t/x?back=/login", "<table class=issues><tr><td class=id>12<td class=subject>un&amp;closed<tr><td class=id>13<td class=subject>last"),
        (5, None, None),
        (6, "http://t/issues", page((11, "a page seen before"))),
        (7, "http://t/y", page((14, "behind it"))),
    ]
    got = {r["id"]: r for r in scan(spark, pages).collect()}
    assert {i: r["subject"] for i, r in got.items()} == {7: "one", 8: "two", 12: "un&closed", 13: "last", 10: "#10"}
    assert got[7]["url"] == "http://t/issues/7" and got[7]["version"] == "v1" and got[7]["tracker"] == "Bug" and got[12]["url"] == ""
    parsed = I.read_pages(spark.createDataFrame(pages, "page_no long, url string, html string")).collect()
    assert [r["next_url"] for r in parsed] == ["http://t/issues?page=2", None, None, None, None, None]


@pytest.mark.parametrize("bad", [(2, "http://t/a", "<form action='/login'>"), (2, "http://t/a", "<div id=login-form>"), (2, "http://t/login", "")])
def test_a_sign_in_page_voids_the_scan(spark, bad):
    assert scan(spark, [(1, "http://t", page((7, "one"))), bad]).count() == 0


def test_no_pages(spark):
    assert scan(spark, []).count() == 0


@pytest.mark.parametrize(
    "text, once, landed",
    [
        ("引用\n描述\n a ", "a", "a"), (" 描述 \n\n a", "a", "a"), ("引用\r\n a", "a", "a"), ("描述: a", "描述: a", "描述: a"), ("　引用\n　描述\n描述\na", "描述\na", "a"),
        ("描述\n引用\na", "引用\na", "引用\na"), ("", "", ""), (None, None, None), ("描述", "描述", "描述"), ("a\n描述\nb", "a\n描述\nb", "a\n描述\nb"),
    ],
)
def test_label_lines(spark, text, once, landed):
    d = spark.createDataFrame([(text,)], "t string")
    got = d.select(T.strip_labels(F.col("t")), T.strip_landed_labels(F.col("t")), T.description(F.col("t"))).first()
    assert got[:2] == (once, landed) and (got[2] == T.NO_DESCRIPTION) == (not text)


def test_log_goes_on_from_its_offset(spark, tmp_path):
    log_tail.register(spark)
    log = tmp_path / "out.log"
    log.write_bytes(b"first\r\n\nsecond\npart")

    def drain():
        q = spark.readStream.format("log_tail").option("path", str(log)).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["byte_offset"], r["line"]) for r in spark.read.schema("line string, byte_offset long").parquet(str(tmp_path / "out")).collect())

    assert drain() == [(7, "first"), (15, "second")]
    with open(log, "ab") as f:
        f.write(b"ial\nb\xffd\n")
    assert drain() == [(7, "first"), (15, "second"), (23, "partial"), (27, "b�d")]


def test_log_reader(tmp_path):
    path = str(tmp_path / "x.log")
    assert list(log_tail._Reader({"path": path}).read({"at": 5})[0]) == []
    with open(path, "wb") as f:
        f.write(b"a\nb")
    assert list(log_tail._Reader({"path": path}).read({"at": 99})[0]) == [("a", 2)]  # shorter than the offset
    rows, end = log_tail._Reader({"path": path, "final": "true"}).read({"at": 2})
    assert (list(rows), end) == ([("b", 3)], {"at": os.path.getsize(path)})
