"""The registered queries of this subpackage, each over its whole table, and their DuckDB texts."""

from __future__ import annotations

import os

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ann, decontaminate, jaccard, langid, licences, lm, negatives, packing, runs, substring, toxicity, urlfilter, warc

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; 0 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(4) != 2).select("text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "language.lang_pred", "language.score", "language.bits")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "toxic"))
    out = toxicity.score(docs, model, "score")
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(5) != 1)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(v.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@F.pandas_udf(T.StringType())
def repeated(text: pd.Series, g: pd.Series) -> pd.Series:
    """The words from the a-th on replaced by repeats of the first p of them; a and p follow from g and the number of words."""
    def one(t, g):
        ws = t.encode().split() if t else []
        if not ws:
            return t
        n = len(ws)
        a = int(g) % n
        p = 1 + (n - a) // (3 + int(g) % 8)
        return b" ".join(ws[:a] + (ws[a:a + p] * (-(-(n - a) // p)))[:n - a]).decode()
    return pd.Series([one(t, v) for t, v in zip(text, g, strict=True)], dtype=object)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = h % 10 == 0
    text = F.when(planted, repeated(F.when(planted, F.col("text")), F.coalesce(F.floor(h / 10), F.lit(0)))).otherwise(F.col("text"))
    out = runs.periodic_runs(docs.select("doc_id", text.alias("text")), "periodic")
    r = F.col("periodic.runs")
    best = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    listed = F.array_join(F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    listed = F.when(F.size(r) > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size(r).cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
                     F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                      F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_substring_dedup, op3_toxicity, op4_ngram_jaccard_join, op5_packing, op6_url_filters,
    op7_license_scans, op8_decontamination, op9_lm_scoring, op10_ann, op11_hard_negatives,
    op12_warc, op13_periodic_runs, pipeline)}

ORACLES = {
    "op2_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words)),
least AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g),
hit AS (SELECT w.doc_id, w.i FROM windows w JOIN least l ON w.g = l.g WHERE l.first_id < w.doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM words),
mark AS (
  SELECT p.doc_id, p.p, p.word,
         max(CASE WHEN h.i IS NULL THEN 0 ELSE 1 END)
           OVER (PARTITION BY p.doc_id ORDER BY p.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM pos p LEFT JOIN hit h ON p.doc_id = h.doc_id AND p.p = h.i),
kept AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed,
         string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY p) AS t
  FROM mark GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label,
         CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10""",
    "op12_warc": """
WITH h AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
b AS (SELECT *, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits FROM h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * (1 << CAST(4 - j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b""",
    "op13_periodic_runs": r"""
WITH said AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
             lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM documents),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) ELSE len(ws) END AS a, 3 + (h // 10) % 8 AS k FROM said),
words AS (
  SELECT doc_id, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (len(ws) - a) // k) ELSE i END] AS word
  FROM (SELECT *, unnest(range(len(ws))) AS i FROM cut)),
three AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT * FROM three WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 3),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM often x JOIN often y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
found AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM equal GROUP BY doc_id, q, island HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM found GROUP BY doc_id, start, length),
step AS (
  SELECT doc_id, i, sum(d) AS d FROM (
    SELECT doc_id, start + period AS i, 1 AS d FROM runs UNION ALL SELECT doc_id, start + length, -1 FROM runs) GROUP BY doc_id, i),
mark AS (
  SELECT w.doc_id, w.i, w.word, coalesce(sum(s.d) OVER (PARTITION BY w.doc_id ORDER BY w.i), 0) AS inside
  FROM words w LEFT JOIN step s ON w.doc_id = s.doc_id AND w.i = s.i),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM mark WHERE inside = 0 GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1)
SELECT s.doc_id, coalesce(l.n, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM said s LEFT JOIN listed l ON s.doc_id = l.doc_id LEFT JOIN best b ON s.doc_id = b.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id""",
}
