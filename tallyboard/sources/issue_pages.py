"""Landed pages of a tracker's issue list as raw ticket rows.

``read_pages`` parses each page on its own (one row in, one row out), so pages spread over
tasks; ``issue_rows`` then applies the rules of a whole scan with DataFrame operations:
a sign-in page voids the scan, the walk ends at an address that it has seen or after
``most_pages``, and of rows with one id the first wins.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A field and the cell classes that hold it, in order of preference.
CELLS = {
    "project": ("project",), "tracker": ("tracker",), "priority": ("priority",), "status": ("status",), "subject": ("subject",),
    "version": ("fixed_version", "version"), "assignee": ("assigned_to",), "author": ("author",), "updated": ("updated_on",),
}
MOST_PAGES = 200
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

_ROW = pa.struct([("id", pa.int64()), *((k, pa.string()) for k in CELLS), ("url", pa.string())])
_PAGE = pa.schema([("page_no", pa.int64()), ("url", pa.string()), ("login", pa.bool_()), ("next_url", pa.string()), ("rows", pa.list_(_ROW))])
PAGE_SCHEMA = "page_no long, url string, login boolean, next_url string, rows array<struct<id long, " + ", ".join(f"{k} string" for k in CELLS) + ", url string>>"


class _Page(HTMLParser):
    """Collects the issue rows, the next link and the signs of a sign-in form of one page."""

    def __init__(self, url: str, with_rows: bool = True):
        super().__init__()
        self.with_rows, self.url, self.login, self.next, self.rows = with_rows, url, False, None, []
        self.open: list[tuple[str, set[str]]] = []
        self.row: dict | None = None
        self.in_link = False

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def _inside(self, cls: str, tag: str | None = None) -> bool:
        return any(cls in c and tag in (None, t) for t, c in self.open)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = set(a["class"].split()) if "class" in a else set()
        self.login |= a.get("id") == "login-form" or (tag == "form" and "/login" in a.get("action", ""))
        if tag in ("tr", "td", "th"):  # an unclosed row or cell ends here
            self._close(tag if tag == "tr" else ("td", "th"), within="table" if tag == "tr" else "tr")
        if tag == "tr" and self.with_rows and self._inside("issues", "table") and not any(t in ("thead", "tfoot") for t, _ in self.open):
            self.row = {"cells": {}, "href": None, "link": ""}
        if tag == "a":
            self._link(a, classes)
        if tag not in _VOID:
            self.open.append((tag, classes))
        if tag == "td" and self.row is not None:
            for c in classes:
                self.row["cells"].setdefault(c, "")
            self.cell = classes

    def _link(self, a: dict, classes: set[str]) -> None:
        row = self.row
        if row is not None and row["href"] is None and ("issue" in classes or self._inside("subject", "td") or self._inside("id", "td")):
            row["href"], self.in_link = a.get("href", ""), True
        paged = self._inside("pagination") and ("next" in classes or self._inside("next"))
        if self.next is None and (a.get("rel") == "next" or paged or any(t == "li" and {"next", "page"} <= c for t, c in self.open)):
            self.next = a.get("href", "")

    def _close(self, tags, within: str | None = None) -> None:
        tags = (tags,) if isinstance(tags, str) else tags
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                closed = [t for t, _ in self.open[i:]]
                del self.open[i:]
                if "a" in closed:
                    self.in_link = False
                if self.row is not None and "tr" in closed:
                    self.rows.append(self.row)
                    self.row = None
                return
            if self.open[i][0] == within:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.row is None:
            return
        if any(t == "td" for t, _ in self.open):
            for c in self.cell:
                self.row["cells"][c] += data
        if self.in_link:
            self.row["link"] += data

    def found(self) -> list[dict]:
        if self.row is not None:
            self.rows.append(self.row)
            self.row = None
        out = []
        for r in self.rows:
            text = {c: t.strip() for c, t in r["cells"].items()}
            got = {k: next((text[c] for c in cs if text.get(c)), "") for k, cs in CELLS.items()}
            digits = re.sub(r"[^0-9]", "", text.get("id") or r["link"])
            got |= {"id": int(digits) if 0 < len(digits) <= 18 else 0, "url": _join(self.url, r["href"]) if r["href"] else ""}
            got["subject"] = got["subject"] or r["link"].strip()
            out.append(got)
        return out


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _path(url: str) -> str:
    try:
        return urlsplit(url).path
    except ValueError:
        return ""


def read_pages(pages: DataFrame, keep: tuple[str, ...] = (), with_rows: bool = True) -> DataFrame:
    """(page_no, url, login, next_url, rows) of each page, then its columns ``keep``; ``pages`` has page_no, url and html.

    A null page is an empty one; a null address is ''. Rows of an id that is no number, or one
    of over 18 digits, have id 0. Without ``with_rows`` there is no column rows: a walk needs the links alone.
    """
    schema = _PAGE if with_rows else pa.schema([f for f in _PAGE if f.name != "rows"])

    def run(stream):
        for batch in stream:
            out = []
            for no, url, html in zip(*(c.to_pylist() for c in batch.columns[:3])):
                page = _Page(url or "", with_rows)
                page.feed(html or "")
                page.close()
                login = page.login or "/login" in _path(url or "")
                out.append({"page_no": no, "url": url or "", "login": login, "next_url": _join(url or "", page.next) if page.next else None, **({"rows": page.found()} if with_rows else {})})
            got = pa.RecordBatch.from_pylist(out, schema)
            yield pa.RecordBatch.from_arrays([*got.columns, *batch.columns[3:]], [*schema.names, *keep])

    d = pages.select(F.col("page_no").cast("long"), "url", "html", *keep)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in d.schema[3:])
    return d.mapInArrow(run, (PAGE_SCHEMA if with_rows else PAGE_SCHEMA.partition(", rows")[0]) + more)


def issue_rows(parsed: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """Raw ticket rows of one scan from ``read_pages``; none at all if one of its pages asks to sign in.

    Pages are taken in order of page_no, ``most_pages`` at most, which is the scan's own guard;
    the walk ends where an address comes for the second time. Rows without id or subject are
    left out.
    """
    voided = parsed.agg(F.coalesce(F.bool_or("login"), F.lit(False)).alias("voided")).filter(~F.col("voided"))
    seen = parsed.withColumn("visit", F.row_number().over(Window.partitionBy("url").orderBy("page_no")))
    end = seen.agg(F.min(F.when(F.col("visit") > 1, F.col("page_no"))).alias("end"))
    walked = parsed.crossJoin(F.broadcast(end)).filter("end IS NULL OR page_no < end")  # one row
    first = walked.select("page_no", "rows").orderBy("page_no").limit(most_pages)
    rows = first.select("page_no", F.posexplode("rows").alias("pos", "r")).select("page_no", "pos", "r.*").filter("id <> 0 AND subject <> ''")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("page_no", "pos"))
    rows = rows.withColumn("nth", nth).filter("nth = 1").drop("nth", "pos")
    return rows.crossJoin(F.broadcast(voided)).drop("voided", "page_no")  # one row or none
