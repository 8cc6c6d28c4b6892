"""Queries over events and conversations: keyed state, errors, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import backoff_ms, describe_error, error_class, seconds
from siltstone.operators import state as S
from siltstone.streaming import state as stream

TTL = 6 * 3600 * 1_000_000
GAP = 1_200_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.micros().alias("t"), "user_id", "event_type")


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "t")
    return S.ttl_cache(own, TTL).select(F.col("id").alias("event_id"), "hit")


def throttle_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "t")
    return S.throttle(own, GAP * 100).select(F.col("id").alias("event_id"), F.col("start").alias("start_us"))


def host_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for limits that ask for event_id modulo 400 seconds."""
    own = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "t", (F.col("event_type") == "error").alias("limited"), ((F.col("event_id") % 400) * 1_000_000).alias("retry_us"))
    return S.cooldown(own, most_us=40 * 3600 * 1_000_000).select(F.col("id").alias("event_id"), "cooling")


def offline_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failures of user_id as host, purchases successes; logs are kept apart by day."""
    own = events(spark, sf_dir).where("event_type IN ('error', 'purchase')").select(F.col("event_id").alias("id"), "t", F.col("user_id").alias("host"), (F.col("event_type") == "error").alias("failed"), F.floor(F.col("t") / 86_400_000_000).alias("day"))
    return S.offline(own, ["day"], 600_000_000, 3_000_000_000).select(F.col("id").alias("event_id"), "offline")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", S.micros().alias("t"), "user_id", "event_type")


def ttl_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "t")
    return stream.drain(stream.ttl_cache(own, TTL)).select(F.col("id").alias("event_id"), "hit")


def throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _event_stream(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "t")
    return stream.drain(stream.throttle(own, GAP * 100)).select(F.col("id").alias("event_id"), F.col("start").alias("start_us"))


def cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "t", (F.col("event_type") == "error").alias("limited"), ((F.col("event_id") % 400) * 1_000_000).alias("retry_us"))
    return stream.drain(stream.cooldown(own, most_us=40 * 3600 * 1_000_000)).select(F.col("id").alias("event_id"), "cooling")


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 410, 429, 500))), (F.col("event_id") % 7 + 1).cast("int"))
    message = F.when(F.col("event_id") % 2 == 0, "Blocked host (SSRF protection): x").otherwise("socket hang up")
    own = events(spark, sf_dir).where("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 11 != 0, status).alias("status"), message.alias("message"))
    code = F.when(F.col("event_id") % 3 == 0, "ECONNRESET").when(F.col("event_id") % 3 == 1, "host")
    told, took = describe_error(F.col("message"), code), seconds(F.col("event_id") % 1000 * 100)
    return own.select("event_id", error_class(F.col("status"), F.col("message")).alias("error_class"), backoff_ms(F.col("event_id") % 3).alias("wait_ms"), told.alias("told"), took.alias("took"))


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache per event type with room for 64 users."""
    own = events(spark, sf_dir).select("event_type", F.col("event_id").alias("id"), "t", F.col("user_id").alias("key"))
    return S.evicting_cache(own, "event_type", 64, TTL * 4).select(F.col("id").alias("event_id"), "hit", "size")


def thread_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn answers the turn half its number: a tree in every conversation."""
    nodes = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"), F.col("turn").alias("ord"), "text")
    flat = S.flatten_threads(nodes)
    return flat.select(F.col("thread").alias("conv_id"), F.col("id").alias("turn"), F.col("depth").cast("bigint").alias("depth"), F.array_join(F.transform("path", lambda p: F.lpad(p["ord"].cast("string"), 6, "0")), "/").alias("path"))


def thread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text, its turns in order; of each turn the first 500 characters, as of comments in a thread."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.substring("text", 1, 500).alias("text")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n\n").alias("text"))


QUERIES = {f.__name__: f for f in (ttl_cache, throttle_schedule, host_cooldown, offline_flag, error_classes, cache_eviction, thread_flatten, thread_text, ttl_cache_stream, throttle_stream, cooldown_stream)}
_E = "e AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type FROM events)"
ORACLES = {
    "ttl_cache": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
r AS (SELECT user_id, i, event_id, t AS at, false AS hit FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN n.t - r.at <= {TTL} THEN r.at ELSE n.t END, n.t - r.at <= {TTL} FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) SELECT event_id, hit FROM r""",
    "throttle_schedule": f"WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS i FROM e) SELECT event_id, (i * {GAP * 100} + max(t - i * {GAP * 100}) OVER (PARTITION BY event_type ORDER BY i))::BIGINT AS start_us FROM n",
    "host_cooldown": f"WITH {_E} SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN t + (event_id % 400) * 1000000 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > t, false) AS cooling FROM e",
    "offline_flag": f"""WITH {_E}, f AS (SELECT *, t // 86400000000 AS day FROM e WHERE event_type IN ('error', 'purchase')),
h AS (SELECT a.event_id, count(DISTINCT b.user_id) AS hosts FROM f a JOIN f b ON a.day = b.day AND b.event_type = 'error' AND b.t BETWEEN a.t - 600000000 AND a.t GROUP BY 1)
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' AND hosts >= 2 THEN t + 3000000000 WHEN event_type = 'purchase' THEN 0 END IGNORE NULLS) OVER (PARTITION BY day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > t, false) AS offline FROM f LEFT JOIN h USING (event_id)""",
    "error_classes": "SELECT event_id, CASE WHEN st IN (401, 403) THEN 'auth' WHEN st = 429 THEN 'ratelimit' WHEN st IN (404, 410) THEN 'notfound' WHEN st IS NULL AND event_id % 2 = 0 THEN 'permanent' ELSE 'transient' END AS error_class, (300 * pow(3, event_id % 3))::BIGINT AS wait_ms, CASE WHEN event_id % 2 = 0 THEN 'Blocked host (SSRF protection): x' || CASE WHEN event_id % 3 = 0 THEN ' (ECONNRESET)' ELSE '' END ELSE 'socket hang up' || CASE event_id % 3 WHEN 0 THEN ' (ECONNRESET)' WHEN 1 THEN ' (host)' ELSE '' END END AS told, event_id % 1000 // 10 || '.' || event_id % 10 || 's' AS took FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN [200, 401, 403, 404, 410, 429, 500][event_id % 7 + 1] END AS st FROM events WHERE event_type = 'error')",
    # the cache as a list of writes in order, one step for each event of a type
    "cache_eviction": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS i FROM e),
r(event_type, i, event_id, hit, c) AS (SELECT event_type, i, event_id, false, [{{'k': user_id, 'w': t}}] FROM n WHERE i = 1
    UNION ALL SELECT n.event_type, n.i, n.event_id, len(list_filter(r.c, lambda x: x.k = n.user_id AND n.t - x.w <= {TTL * 4})) > 0,
        CASE WHEN len(list_filter(r.c, lambda x: x.k = n.user_id AND n.t - x.w <= {TTL * 4})) > 0 THEN r.c ELSE list_append(list_filter(CASE WHEN len(r.c) >= 64 THEN r.c[2:] ELSE r.c END, lambda x: x.k <> n.user_id), {{'k': n.user_id, 'w': n.t}}) END FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1)
SELECT event_id, hit, len(c)::BIGINT AS size FROM r""",
    "thread_flatten": "WITH RECURSIVE r AS (SELECT conv_id, turn, 0::BIGINT AS depth, lpad(turn::VARCHAR, 6, '0') AS path FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1, path || '/' || lpad(c.turn::VARCHAR, 6, '0') FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn > 0 AND (c.turn - 1) // 2 = r.turn) SELECT * FROM r",
    "thread_text": "SELECT conv_id, string_agg(role || ': ' || left(text, 500), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
}
ORACLES |= {f"{name}_stream": ORACLES[batch] for name, batch in (("ttl_cache", "ttl_cache"), ("throttle", "throttle_schedule"), ("cooldown", "host_cooldown"))}
