r"""Personal data: base patterns, and terms that reveal them, with DataFrame functions only.

Base spans come from four patterns (email, ip, card, phone). Each pattern below finds the
same leftmost matches as the plain one of its comment in time linear in the text: a match
starts at the start of a run of its first class or where the last match ended (``\G``),
and runs are possessive where the next character cannot belong to them.

Information-theoretic sanitisation then looks at the corpus. Protected entities of a text are
its values, the classes of its values (the kind; the domain of an email, the network class of
an address, the first digit of a card, the country of a phone number), so that a value which
occurs once is protected by what it is, and identifiers: runs of letters and digits whose
alternations carry ``identifier_bits`` or more, an alternation being worth -log2 of how often
the corpus has one. For an entity e and a term t of the same text the pointwise mutual
information log(P(e,t) / P(e)P(t)) is compared with the information of the entity itself,
-log P(e). The ratio is 1 where the term occurs only with that entity and so reveals it wholly.
Terms at ``generalise`` or more are replaced by their kind of token, at ``remove`` or more they
are removed, wherever they stand in the texts that hold the entity; identifiers are
generalised. All counts are of distinct texts, so copies are no evidence; entities and pairs
need ``support`` of them, and an entity of over half of all texts tells nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, rows_if_small

KINDS = ("email", "ip", "card", "phone")
#: Patterns: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ;
#: [0-9]([\x20-]?[0-9])+ (of 12 digits or more: shorter ones are dropped anyway) ; \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind has: texts without it are not searched.
MARK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = "term"
WORD = r"[\p{L}\p{N}]++"
#: What may be an identifier, and where letters and digits alternate.
LONG = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
MIX = r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"
IDENTIFIER = "identifier"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn: every second from the right doubled, its digits summed."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    each = F.transform(F.sequence(F.lit(1), F.length(digits)), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15)


def _places(pattern: str | Column, text: Column) -> Column:
    """array<struct<start, value>> of all matches of a pattern, which may be a column.

    Splitting at the matches gives the gaps between them; lengths of gaps and matches add up
    to the starts. They are added up in blocks of about the root of their number, so that no
    array is copied once a match.
    """
    one, none = "struct<start: int, value: string>", "CAST(array() AS array<{}>)"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["value"].alias("value")))).alias("out"))

    def join(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), m["value"].alias("value")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(pairs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        first = F.struct(F.lit(0).alias("at"), F.expr(none.format(one)).alias("out"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / width).cast("int")), lambda i: F.aggregate(F.slice(pairs, i * width + 1, width), first, step))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr(none.format(f"array<{one}>")).alias("out")), join, lambda a: F.flatten(a["out"]))

    def paired(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(found, gaps, lambda v, g: F.struct(F.length(g).alias("gap"), v.alias("value")))
        return F.when(F.size(found) > 0, _once(pairs, placed)).otherwise(F.expr(none.format(one)))

    return _once(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)), paired)


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(kind: str, text: Column) -> Column:
    """All matches of the kind's pattern, valid or not; texts without a character that each has are not searched."""
    here = text.contains(MARK[kind]) if MARK[kind] else text.rlike("[0-9]")
    return F.when(here, _places(PATTERNS[kind], text)).otherwise(F.expr("CAST(array() AS array<struct<start: int, value: string>>)"))


def _valid_only(kind: str, matches: Column) -> Column:
    return F.filter(matches, lambda m: _valid(kind, m["value"]))


def _spans(kind: str, matches: Column) -> Column:
    def span(m: Column) -> Column:
        start, end = m["start"].cast("long"), (m["start"] + F.length(m["value"])).cast("long")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), m["value"].alias("value"))

    return F.transform(matches, span)


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans, long, mixes, chars, text) of every row; a null text counts as empty.

    spans is array<struct<kind, start, end, value>>, ``long`` array<struct<start, end, mixes>> of
    what may be an identifier. Offsets are code points, the end exclusive. ``mixes`` is how often
    letters and digits alternate. The text is kept where there are spans or long runs.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    for k in KINDS:
        d = d.withColumn(f"m_{k}", _valid_only(k, _matches(k, text)))
    digits = text.rlike("[0-9]")
    d = d.withColumn("mixes", F.when(digits, F.regexp_count(text, F.lit(MIX))).otherwise(0))
    none = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, mixes: int>>)")
    long = F.transform(_places(LONG, text), lambda m: F.struct(m["start"].cast("long").alias("start"), (m["start"] + F.length(m["value"])).cast("long").alias("end"), F.regexp_count(m["value"], F.lit(MIX)).alias("mixes")))
    d = d.withColumn("long", F.when(F.col("mixes") > 1, F.filter(long, lambda m: m["mixes"] > 1)).otherwise(none))
    d = d.withColumn("spans", F.concat(*[_spans(k, F.col(f"m_{k}")) for k in KINDS]))
    kept = F.when((F.size("spans") > 0) | (F.size("long") > 0), text)
    return d.select("doc_id", F.xxhash64("text").alias("text_hash"), "spans", "long", "mixes", F.length("text").alias("chars"), kept.alias("text"))


def _entities(spans: Column, long: Column) -> Column:
    """The distinct entities of a text as strings: kinds, classes and values, and whether it has an identifier."""

    def of(s: Column) -> Column:
        k, v = s["kind"], s["value"]
        first = F.substring_index(v, ".", 1)
        network = F.when(F.length(first) < 3, "A").when(first < "128", "A").when(first < "192", "B").otherwise("C")
        group = F.when(k == "email", F.substring_index(v, "@", -1)).when(k == "ip", network).when(k == "card", F.substring(v, 1, 1)).otherwise(F.regexp_extract(v, r"^\+[0-9]+", 0))
        return F.array(k, F.concat(k, F.lit("/"), group), F.concat(k, F.lit("="), v))

    own = F.when(F.size(long) > 0, F.array(F.lit(IDENTIFIER))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return F.array_distinct(F.concat(F.flatten(F.transform(spans, of)), own))


def _terms(text: Column) -> Column:
    """The distinct words of three characters or more, in lower case."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def document_frequency(docs: DataFrame, found: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """(term, n_t): in how many distinct texts each word occurs."""
    # a text that m rows hold counts 1/m in each, so words add up within tasks before the shuffle
    copies = scratch.write(found.groupBy("text_hash").agg(F.count("*").alias("m")).filter("m > 1"), "copies")
    side = F.broadcast(copies) if rows_if_small(copies, 200_000) else copies
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text")).join(side, F.xxhash64("text") == F.col("text_hash"), "left")
    words = texts.select(F.explode(_terms(F.col("text"))).alias("term"), (F.lit(1.0) / F.coalesce("m", F.lit(1))).alias("share"))
    return words.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_t"))


def ratings(docs: DataFrame, found: DataFrame, scratch: Scratch, text_col: str = "text", support: int = 5, generalise: float = 0.8) -> DataFrame:
    """(e, term, ratio): the terms that reveal an entity by ``generalise`` or more."""
    total = found.select("text_hash").distinct().count()
    holders = found.filter("text IS NOT NULL").dropDuplicates(["text_hash"]).select("row", "text", _entities(F.col("spans"), F.col("long")).alias("es"))
    holders = scratch.write(holders, "holders")
    each = holders.select("row", F.explode("es").alias("e"))
    held = scratch.write(each.groupBy("e").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= support) & (F.col("n_e") * 2 <= total)), "entities")
    side = F.broadcast(held) if rows_if_small(held, 200_000) else held
    # a text is carried once, with those of its entities that count; terms are extracted once
    known = each.join(side, "e").groupBy(F.col("row").alias("k_row")).agg(F.collect_list(F.struct("e", "n_e")).alias("known"))
    near = holders.join(known, F.col("row") == F.col("k_row")).select("known", F.explode(_terms(F.col("text"))).alias("term")).select("term", F.inline("known"))
    pairs = near.groupBy("e", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).filter(F.col("n_et") >= support)
    n = F.lit(float(max(total, 2)))
    ratio = F.log(F.col("n_et") * n / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.col("n_e"))
    return pairs.join(document_frequency(docs, found, scratch, text_col), "term").select("e", "term", ratio.alias("ratio")).filter(F.col("ratio") >= generalise)


def revealing(docs: DataFrame, found: DataFrame, scratch: Scratch, text_col: str = "text", support: int = 5, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(row, terms): array<struct<start, end, removed>> of all places of the terms that reveal an entity of the row's text.

    ``found`` is the written table of ``find_base`` with ``row``.
    """
    out = scratch.write(ratings(docs, found, scratch, text_col, support, generalise), "rated")
    out = F.broadcast(out) if rows_if_small(out, 200_000) else out
    texts = found.filter("text IS NOT NULL")
    # a text's terms meet the ratings, what is left its entities: no pairs of the two are made
    hits = texts.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(out, "term")
    own = texts.select("row", F.explode(_entities(F.col("spans"), F.col("long"))).alias("e"))
    hits = hits.join(own, ["row", "e"], "left_semi").groupBy("row", "term").agg(F.max(F.col("ratio") >= remove).alias("removed"))
    removed = F.collect_list(F.when(F.col("removed"), F.col("term")))  # nulls are left out
    lists = hits.groupBy(F.col("row").alias("h_row")).agg(F.array_join(F.collect_list("term"), "|").alias("marked"), removed.alias("removed"))
    # terms are letters and digits, so they stand for themselves in a pattern
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.col("marked"), F.lit(r")(?![\p{L}\p{N}])"))
    terms = F.transform(_places(pattern, F.col("text")), lambda m: F.struct(m["start"].cast("long").alias("start"), (m["start"] + F.length(m["value"])).cast("long").alias("end"), F.array_contains("removed", F.lower(m["value"])).alias("removed")))
    return texts.join(lists, F.col("row") == F.col("h_row")).select("row", terms.alias("terms"))


def sanitise_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", identifier_bits: float = 64.0, **limits) -> DataFrame:
    """(doc_id, spans, terms) of every row; spans as from ``find_base``, terms array<struct<start, end, removed>>.

    Terms are the places of revealing words and the identifiers. Those that overlap a base span
    are left to it. Null texts are empty; repeated rows each get their row, null ids are kept;
    an empty table gives an empty result; other columns are ignored.
    """
    base = scratch.write(find_base(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "base")
    mixes, chars = base.agg(F.coalesce(F.sum("mixes"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    bits = math.log2((chars + 1) / (mixes + 1))  # what one alternation is worth
    found = base.withColumn("long", F.filter("long", lambda m: m["mixes"] * bits >= identifier_bits))
    found = found.withColumn("text", F.when((F.size("spans") > 0) | (F.size("long") > 0), F.col("text")))
    marked = revealing(docs, found, scratch, text_col, **limits).select(F.col("row").alias("t_row"), "terms")
    some = found.select("row", "spans", "long").join(marked, F.col("row") == F.col("t_row"), "left").filter("t_row IS NOT NULL OR size(long) > 0")
    clear = _clear(some).withColumnRenamed("row", "c_row")
    out = found.drop("text").join(clear, F.col("row") == F.col("c_row"), "left")
    none = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, removed: boolean>>)")
    return out.select("doc_id", "spans", F.coalesce("terms", none).alias("terms"))


def _clear(d: DataFrame) -> DataFrame:
    """(row, terms): identifiers that overlap no base span, and terms that overlap neither.

    ``d`` has row, spans, long, terms. The stretches of a row are sorted, so no two are compared: one
    overlaps an earlier one that reaches beyond its start, or a later one that starts before its end.
    """

    def stretches(xs: Column, tag: int, removed) -> Column:
        return F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(tag).alias("tag"), removed(x).alias("removed")))

    none, no = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, removed: boolean>>)"), lambda x: F.lit(False)
    every = F.concat(stretches(F.col("spans"), 0, no), stretches(F.col("long"), 1, no), stretches(F.coalesce("terms", none), 2, lambda x: x["removed"]))
    rows = d.select("row", F.inline(every))
    order = Window.partitionBy("row").orderBy("start", "end", "tag")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("tag")).rowsBetween(Window.unboundedPreceding, -1)
    for tag in (0, 1):
        mine = F.col("tag") == tag
        rows = rows.withColumn(f"reach{tag}", F.max(F.when(mine, F.col("end"))).over(before)).withColumn(f"next{tag}", F.min(F.when(mine, F.col("start"))).over(back))
    hit = lambda tag: F.coalesce(F.col(f"reach{tag}") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"next{tag}") < F.col("end"), F.lit(False))
    kept = rows.filter(((F.col("tag") == 1) & ~hit(0)) | ((F.col("tag") == 2) & ~hit(0) & ~hit(1)))
    return kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))


def bare(spans: Column) -> Column:
    """Kind, start and end only."""
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def digest(found: DataFrame) -> DataFrame:
    """Counts of each kind, the hash of the base spans and all spans as text, from ``sanitise_spans``."""
    rank = {k: i for i, k in enumerate(KINDS)}

    def listed(spans: Column) -> Column:
        order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.coalesce(*[F.when(s["kind"] == k, i) for k, i in rank.items()], F.lit(len(rank))).alias("r"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.array_join(F.transform(F.sort_array(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(k: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    base = bare(F.col("spans"))
    terms = F.transform("terms", lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    n_terms = F.size("terms").cast("long").alias("n_terms")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.concat(base, terms)).alias("spans"), n_terms, (F.size("spans") + F.size("terms")).cast("long").alias("n_spans"))


def mask(text: Column, spans: Column, terms: Column) -> Column:
    """The text with base spans as ``[KIND]``, generalised terms as ``[TERM]``, removed terms gone.

    Spans that begin within an earlier one are part of it.
    """
    base = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    more = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["removed"], "").otherwise("[TERM]").alias("by")))
    every = F.sort_array(F.concat(base, more))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["by"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), grown.alias("out")))

    done = F.aggregate(every, first, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(every) > 0, done).otherwise(text)
