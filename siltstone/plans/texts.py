"""Queries over documents: tokens, passages, BM25, budgets, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import tokenize
from siltstone.operators import passages as P
from siltstone.storage import spread

QUERY = "of the restoration and that"
WORD = r"[\p{L}\p{N}_#+-]+(?:\.[\p{L}\p{N}_#+-]+)*"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def split_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_plain(documents(spark, sf_dir)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "text")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.score_passages(P.split_plain(documents(spark, sf_dir)), QUERY)


def bm25_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = P.rank_passages(_scored(spark, sf_dir).withColumn("score", F.round("score", 6)), 1)
    return best.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "score")


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.budget_passages(_scored(spark, sf_dir).withColumn("score", F.round("score", 6)), 2500)


def budget_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "text", "score")


def passage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("score", F.round("score", 6)).withColumn("total", F.count("*").over(W.partitionBy("doc_id")))
    return P.passage_view(P.budget_passages(scored, 2500))


def excerpt_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_excerpts(_picked(spark, sf_dir))


def head_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", P.head_view(F.col("text"), 1000, 100).alias("view"))


def stem_sql(t: str) -> str:
    return f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3) WHEN length({t}) > 3 AND {t} LIKE '%ed' THEN left({t}, length({t}) - 2) WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"


def tokens_sql(source: str, keys: str, text: str) -> str:
    """keys and token for every token of text in source."""
    words = f"(SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{WORD}')) AS w FROM {source})"
    return rf"SELECT {keys}, {stem_sql('w')} AS token FROM {words} UNION ALL SELECT {keys}, {stem_sql('tail')} AS token FROM (SELECT {keys}, regexp_extract(w, '^.+\.([^.]+)$', 1) AS tail FROM {words}) WHERE regexp_matches(tail, '\p{{L}}')"


_PASSAGES = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS t FROM documents),
n AS (SELECT doc_id, t, regexp_extract_all(t, '[^.!?\n]+[.!?]?\s*') AS s FROM t WHERE length(t) > 1200),
r(doc_id, s, i, cur, done) AS (
    SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [t] END, 0, '', NULL::VARCHAR FROM n
    UNION ALL
    SELECT doc_id, s, i + 1, CASE WHEN length(cur) + length(s[i + 1]) > 900 AND length(cur) >= 24 THEN s[i + 1] ELSE cur || s[i + 1] END,
        CASE WHEN length(cur) + length(s[i + 1]) > 900 AND length(cur) >= 24 THEN cur END FROM r WHERE i < len(s)),
o AS (SELECT doc_id, i, regexp_replace(done, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS text FROM r WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, i + 1, regexp_replace(cur, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') FROM r WHERE i = len(s)),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, text FROM o WHERE length(text) >= 24
    UNION ALL SELECT doc_id, 0, t FROM t WHERE length(t) BETWEEN 24 AND 1200)"""

_Q = "('of'), ('the'), ('restoration'), ('and'), ('that')"
_SCORED = (
    _PASSAGES
    + f""", q(token) AS (VALUES {_Q}), k AS ({tokens_sql("p", "doc_id, pos", "text")}),
tf AS (SELECT doc_id, pos, token, count(*) AS n FROM k JOIN q USING (token) GROUP BY ALL),
df AS (SELECT doc_id, token, count(*) AS d FROM tf GROUP BY ALL),
st AS (SELECT doc_id, count(*) AS total, avg(length(text)) AS avg_len FROM p GROUP BY doc_id),
sc AS (SELECT p.doc_id, p.pos, p.text, coalesce(sum(ln(1 + (total - d + 0.5) / (d + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * (length(p.text) / avg_len)))), 0) AS base
    FROM p JOIN st USING (doc_id) LEFT JOIN tf USING (doc_id, pos) LEFT JOIN df ON df.doc_id = p.doc_id AND df.token = tf.token GROUP BY ALL),
b AS (SELECT doc_id, pos, text, base * CASE WHEN regexp_replace(lower(text), '\\s+', ' ', 'g') LIKE '%of the restoration and that%' THEN 1.5 ELSE 1 END
    * CASE WHEN j > 1 THEN 0.3 WHEN j > 0.4 THEN 0.6 ELSE 1 END AS score FROM (SELECT *, len(regexp_extract_all(text, '\\{{\\{{|\\}}\\}}|\\[\\[|\\]\\]|https?://')) / greatest(length(text) / 100, 1) AS j FROM sc))"""
)
_PICKED = (
    _SCORED
    + """, rs AS (SELECT doc_id, pos, text, round(score, 6) AS score, 2500 - coalesce(sum(length(text) + 20) OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM b),
pk AS (SELECT doc_id, pos::BIGINT AS pos, CASE WHEN pos = 0 THEN left(text, 600) WHEN length(text) > rest THEN left(text, rest::BIGINT) || '…' ELSE text END AS text, CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE score END AS score
    FROM rs WHERE pos = 0 OR (score > 0 AND rest > 0 AND NOT (length(text) > rest AND rest < 80)))"""
)

QUERIES = {f.__name__: f for f in (tokenize_documents, doc_frequency, split_passages, bm25_passages, bm25_topk, budget_passages, passage_view, excerpt_best_passage, head_view)}
ORACLES = {
    "tokenize_documents": f"SELECT doc_id, token, count(*) AS tf FROM ({tokens_sql('documents', 'doc_id', 'text')}) GROUP BY ALL",
    "doc_frequency": f"SELECT token, count(DISTINCT doc_id) AS df FROM ({tokens_sql('documents', 'doc_id', 'text')}) GROUP BY token",
    "split_passages": _PASSAGES + " SELECT doc_id, pos::BIGINT AS pos, text FROM p",
    "bm25_passages": _SCORED + " SELECT doc_id, pos::BIGINT AS pos, round(score, 6) AS score FROM b",
    "bm25_topk": _SCORED + " SELECT doc_id, pos::BIGINT AS pos, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, pos) = 1 ORDER BY score DESC, doc_id LIMIT 20",
    "budget_passages": _PICKED + " SELECT doc_id, pos, text, score FROM pk",
    "passage_view": _PICKED + " SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || '[' || count(*) || ' of ' || any_value(total) || ' passages shown — most relevant to the query. Omit query for the page head; offset pages it.]' AS view FROM pk JOIN st USING (doc_id) GROUP BY doc_id",
    "excerpt_best_passage": _PICKED + r", bp AS (SELECT doc_id, text FROM pk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1), fl AS (SELECT doc_id, regexp_replace(text, '\n+', ' ', 'g') AS e FROM bp WHERE length(text) > 80) SELECT doc_id, CASE WHEN length(e) > 500 THEN left(e, 499) || '…' ELSE e END AS excerpt FROM fl",
    "head_view": "SELECT doc_id, CASE WHEN n <= 100 THEN '[offset 100 is past the end (' || n || ' chars)]' WHEN n <= 980 THEN substr(text, 101, 880) ELSE substr(text, 101, (880 - k)::BIGINT) || chr(10) || chr(10) || '[truncated at ' || (980 - k) || ' of ' || n || ' chars — pass offset:' || (980 - k) || ' for the next part, or a query]' END AS view FROM (SELECT *, length(chr(10) || chr(10) || '[truncated at 980 of ' || n || ' chars — pass offset:980 for the next part, or a query]') AS k FROM (SELECT doc_id, text, length(text) AS n FROM documents))",
}
