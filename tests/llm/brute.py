"""Plain single-process versions of what the operators compute, and odd rows to hold both against."""

from __future__ import annotations

import re
import zlib

import xxhash

DATA = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 60_000
ODD = [
    (1, "one two three four five six seven", "en", "a", 1),
    (1, "one two three four five six seven", "en", "a", 1),  # a repeated row
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "  \t\n ", "fr", None, 5),
    (None, "no id here mail me@example.com", "en", "a", 3),
    (5, "12345 !!! 67890", None, "b", 15),
    (6, LONG, "en", "b", len(LONG)),
    (7, "One Two THREE four five six seven", "en", "c", 3),
    (8, "émigré naïve 文字 \U0001f600 mixed", "fr", "c", 3),
    (9, "x", "en", "c", 1),
    (1, "another text under an id that repeats", "en", "b", 9),
]
CLASHES = ("row", "h", "e", "l", "n", "k", "fp", "node", "bucket", "size", "term", "band", "chunk", "label")


def odd_docs(spark, rows=ODD):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def roots(nodes, links) -> dict:
    """The smallest node reachable from each."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def shingles(text, width):
    w = words(text)
    return [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def simhash(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


# The four plain patterns with their conditions.
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub(r"\D", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
}


def base_spans(text):
    found = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
