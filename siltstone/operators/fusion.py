"""Relevance gate and weighted reciprocal-rank fusion of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import gate_tokens, gate_tokens_of, let, tokenize
from siltstone.functions.urls import normalize_url, parts

#: Weight of each engine's ranks; others weigh 1. Fixed values.
WEIGHTS = {"ddg": 1.0, "ddg-lite": 1.0, "ddg-jina": 0.9, "brave": 1.0, "bing": 0.5}
#: Constant of reciprocal-rank fusion.
K = 60


def token_hit(q: Column, tokens: Column) -> Column:
    """Equal, or, for five letters and more, one starts with the other."""
    prefix = F.exists(tokens, lambda d: F.startswith(d, q) | ((F.length(d) >= 5) & F.startswith(q, d)))
    return F.array_contains(tokens, q) | ((F.length(q) >= 5) & prefix)


def row_tokens(title: Column, snippet: Column, url: Column) -> Column:
    path = parts(url)["path"]
    words = F.regexp_replace(F.coalesce(F.try_url_decode(path), url), "[-_/.]+", " ")
    return F.array_distinct(tokenize(F.concat_ws(" ", title, snippet, words)))


def relevance_gate(rows: DataFrame, query: str | Column) -> DataFrame:
    """rows(title, snippet, url, …) with kept: whether they share two of the query's words, or its only one. A query without words keeps all.

    query: one for all rows, or a column. Rows' words are worked out once each.
    """
    if isinstance(query, str):
        words = gate_tokens_of(query)
        tokens = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    else:
        tokens = gate_tokens(query)
    pair = F.struct(tokens.alias("q"), row_tokens(F.col("title"), F.col("snippet"), F.col("url")).alias("doc"))
    enough = lambda x: (F.size(x["q"]) == 0) | (F.size(F.filter(x["q"], lambda t: token_hit(t, x["doc"]))) >= F.least(F.lit(2), F.size(x["q"])))
    return rows.withColumn("kept", let(pair, enough))


def gate_stats(gated: DataFrame) -> DataFrame:
    return gated.groupBy("bucket").agg(F.count("*").alias("got"), F.count_if("kept").alias("kept"))


def fuse(rows: DataFrame, k: int) -> DataFrame:
    """rows(query_id, bucket, bucket_ord, rank, title, url, snippet, date, date_kind) to the k best pages of each query.

    Pages meet by their canonical key. Of each the first row gives url and, with
    its date kind, the date; the longest snippet, the shortest title of eight
    letters or more and the earliest published date win. One aggregate by
    (query, key), then one window by query.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p]), F.col("bucket")), F.lit(1.0))
    order = F.struct("bucket_ord", "rank")
    keyed = rows.select("*", normalize_url(F.col("url")).alias("key"), order.alias("ord"), (weight / (K + F.col("rank"))).alias("part"), F.length("title").alias("tl"), F.length("snippet").alias("sl"))
    published = (F.col("date").isNotNull()) & ~F.coalesce(F.col("date_kind") == "indexed", F.lit(False))
    merged = keyed.groupBy("query_id", "key").agg(
        F.sum("part").alias("score"),
        F.min("ord").alias("ord"),
        F.min_by("url", "ord").alias("url"),
        F.min_by(F.struct("title", "tl"), "ord").alias("first_title"),
        F.min_by(F.when(F.col("tl") >= 8, F.struct("title", "tl")), F.when(F.col("tl") >= 8, F.struct("tl", "ord"))).alias("short_title"),
        F.min_by("snippet", F.struct((-F.col("sl")).alias("l"), "ord")).alias("snippet"),
        F.min(F.when(published, F.col("date"))).alias("date_published"),
        F.min_by(F.struct("date", "date_kind"), "ord").alias("first_date"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "bucket"))), lambda s: s["bucket"])).alias("engines"),
    )
    shorter = F.col("short_title.tl") < F.col("first_title.tl")
    top = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "ord"))
    out = merged.withColumn("position", top).where(F.col("position") <= k)
    return out.select(
        "query_id", "position", "key", F.round("score", 9).alias("score"), "url", F.coalesce(F.when(shorter, F.col("short_title.title")), F.col("first_title.title")).alias("title"), "snippet",
        F.coalesce("date_published", "first_date.date").alias("date"), F.when(F.col("date_published").isNotNull(), "published").otherwise(F.col("first_date.date_kind")).alias("date_kind"), F.array_join("engines", "+").alias("engines"),
    )


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def host_diverse(rows: DataFrame, skip: str, k: int) -> DataFrame:
    """Per query the first k rows of different hosts, without hosts that match skip. rows(query_id, position, url, …)."""
    host = F.regexp_replace(parts(F.col("url"))["host"], r"^www\.", "")
    own = rows.withColumn("host", host).where(~F.col("host").rlike(skip))
    own = own.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "host").orderBy("position"))).where("_n = 1").drop("_n")
    return own.withColumn("pick", F.row_number().over(W.partitionBy("query_id").orderBy("position"))).where(F.col("pick") <= k)
