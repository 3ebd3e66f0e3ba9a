"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chunks, langid, lm, mixing, neighbours, packing, pii, quality, simhash, tokens, toxicity, variants
from .common import Scratch, crc_mod, documents


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    filters = langid.fit(docs.filter(~held), Scratch(spark, "op1"))
    return langid.detect(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir), Scratch(spark, "op2"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write_files(documents(spark, sf_dir), Scratch(spark, "op3"), tokens.vocabulary_path("word_bpe_49k.json"), end_id=1)
    return tokens.read_files(files)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), Scratch(spark, "op4"), tokens.vocabulary_path("byte_bpe_50k.json"), end_id=0)
    return packed.pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise_spans(documents(spark, sf_dir), Scratch(spark, "op5")))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), Scratch(spark, "op6"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.compare_with_edits(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), Scratch(spark, "op8")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held), Scratch(spark, "op9"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op10"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = quality.fit(docs, labels.filter(~held), Scratch(spark, "op11"))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def drop_one_in_97(doc_id: Column, run: Column) -> Column:
    """The run, or in one of 97 places (by a checksum of id and run) the run without one character; a null id counts as ''."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    words = scratch.write(variants.count_words(documents(spark, sf_dir), drop_one_in_97), "words")
    return variants.group_variants(words, scratch)


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "op13"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_simhash, op3_token_files, op4_packing, op5_pii, op6_lm_scores, op7_fingerprints, op8_mixing, op9_toxicity, op10_near_vectors, op11_quality, op12_variants, op13_interactions)}

#: The SQL of operator 8 finds the same thresholds by sorting each source by hash, that of
#: operator 6 counts words and bigrams themselves, not their hashes. That of operator 12 computes
#: the checksum byte by byte and finds near words by their patterns, that of operator 13 applies the
#: filters of each order to the documents themselves.
ORACLE_SQL = {
    "op6_lm_scores": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), tokens AS (
  SELECT r, unnest(list_prepend('', ws)[1:len(ws)]) AS v, unnest(ws) AS w FROM d WHERE len(ws) > 0
), own1 AS (
  SELECT r, w, count(*) AS n FROM tokens GROUP BY r, w UNION ALL SELECT r, '', 1 FROM d WHERE len(ws) > 0
), all1 AS (
  SELECT w, sum(n) AS n FROM own1 GROUP BY w
), own2 AS (
  SELECT r, v, w, count(*) AS n FROM tokens GROUP BY r, v, w
), all2 AS (
  SELECT v, w, sum(n) AS n FROM own2 GROUP BY v, w
), scored AS (
  SELECT o.r, o.n, a.n - o.n AS c, av.n - ov.n AS cv, greatest(aw.n - ow.n, 1) AS cw
  FROM own2 o JOIN all2 a ON o.v = a.v AND o.w = a.w
  JOIN all1 av ON o.v = av.w JOIN own1 ov ON o.r = ov.r AND o.v = ov.w
  JOIN all1 aw ON o.w = aw.w JOIN own1 ow ON o.r = ow.r AND o.w = ow.w
), sums AS (
  SELECT d.r, any_value(d.doc_id) AS doc_id, any_value(len(d.ws)) AS n_tokens,
         coalesce(sum(CASE WHEN s.c <= 0 THEN s.n END), 0) AS n_backoff,
         round(coalesce(sum(s.n * ln(CASE WHEN s.c > 0 THEN s.c / s.cv ELSE 0.4e0 * s.cw / greatest((SELECT sum(len(ws)) FROM d) - len(d.ws), 1) END)), 0e0), 6) AS log_score
  FROM d LEFT JOIN scored s ON d.r = s.r GROUP BY d.r
)
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_backoff AS BIGINT) AS n_backoff, log_score,
       CASE WHEN n_tokens > 0 THEN log_score / n_tokens ELSE 0e0 END AS score
FROM sums
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, least(1.5e0 * sum(source_size) OVER (), 2e0 * sum(source_size) OVER ()) AS budget,
         coalesce(sum(2e0 * source_size) OVER (ORDER BY 2e0 * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS filled,
         sum(w) OVER (ORDER BY 2e0 * source_size / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s
), t AS (
  SELECT source, source_size, least(2e0 * source_size, max((budget - filled) / w_left) OVER () * w) AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, d.h, t.source, t.source_size, t.target,
         CASE WHEN t.target >= t.source_size THEN 1 ELSE 0 END AS whole,
         t.target - CASE WHEN t.target >= t.source_size THEN t.source_size ELSE 0 END AS b,
         sum(d.size) OVER (PARTITION BY t.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY t.source, d.h) AS same
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, whole + CASE WHEN upto <= b OR (upto - same <= b AND upto - b < b - (upto - same)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
""",
    "op12_variants": r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT d, run, count(*) AS n FROM runs GROUP BY d, run
), summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(d || ':' || run)), 2), lambda i: CAST('0x' || substr(hex(d || ':' || run), i, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM counted, bits
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), holes AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), patterns AS (
  SELECT word, n, left(word, i - 1) || '?' || substr(word, i + 1) AS same, left(word, i - 1) || substr(word, i + 1) AS less FROM holes
), shorter AS (
  SELECT DISTINCT p.word AS a, p.n AS a_n, w.word AS b, w.n AS b_n FROM patterns p JOIN words w ON p.less = w.word
), near AS (
  SELECT p.word, p.n, q.word AS other, q.n AS other_n FROM patterns p JOIN patterns q ON p.same = q.same AND p.word <> q.word
  UNION ALL SELECT a, a_n, b, b_n FROM shorter UNION ALL SELECT b, b_n, a, a_n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, min((-other_n, encode(other), other)) AS top FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 2 * n THEN top[3] END AS form, CASE WHEN -top[1] >= 2 * n THEN -top[1] END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain(word, root) AS (
  SELECT word, word FROM words UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.root = e.word AND e.form IS NULL
""",
    "op13_interactions": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id AS l_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON doc_id = l_id
), parts AS (
  SELECT DISTINCT part FROM d
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o AS filter_order, k AS step, left(o, k - 1) AS before, o[k] AS letter FROM orders, range(1, 6) r(k) WHERE length(o) = 5
), hits AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails = letter AS only_this, contains(fails, letter) AS hit,
         length(translate(fails, before, '')) < length(fails) AS gone
  FROM hits, steps
), per AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM per
""",
}
