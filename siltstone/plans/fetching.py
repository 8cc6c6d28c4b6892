"""Queries over requests: outcomes, fallbacks, races, redirects, caps, snapshots, DNS, retries, caches.

The request logs are made from events and orders; each row of them is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import state as S
from siltstone.operators import web as O
from siltstone.plans import logs, web

NOW_MS = 1_704_067_200_000  # 2024-01-01
STATUS = (200, 202, 301, 401, 403, 404, 410, 429, 500, 503)
KINDS = ("text/html; charset=utf-8", "application/pdf", "image/png", "application/json", "text/plain", "application/octet-stream")


def _of(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events(spark, sf_dir)


def response_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind, host = F.when(n % 3 == 0, "application/json").otherwise("text/html"), F.concat(F.lit("h"), F.col("user_id").cast("string"))
    retry = _of(("120", "Mon, 01 Jan 2024 00:10:00 GMT", "soon"), n)
    out = O.response_outcome(_of(STATUS, n), kind, host, retry, F.lit(NOW_MS))
    return _events(spark, sf_dir).select("event_id", *[c.alias(k) for k, c in out.items()])


def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events in a row are the four legs of a search."""
    n = F.col("event_id")
    status = _of((200, 200, 200, 500, 403), n * 7919)
    legs = _events(spark, sf_dir).select(F.floor(n / 4).alias("query_id"), _of(("html", "lite", "post", "relay"), n).alias("leg"), status.alias("status"), F.when(status == 200, n * 104729 % 3).otherwise(0).alias("n_rows"))
    return O.search_fallback(legs)


def search_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    legs = _events(spark, sf_dir).select(F.floor(n / 4).alias("query_id"), _of(("ddg", "bing", "brave", "ddg-jina"), n).alias("leg"), (n * 7919 % 1000).alias("latency_ms"), F.when(F.floor(n / 4) % 3 == 0, F.when(n % 4 < 2, 0).otherwise(n * 31 % 3)).otherwise(n * 31 % 8).alias("kept"), (F.floor(n / 4) % 11 == 0).alias("challenged"), (F.floor(n / 4) % 5 == 0).alias("cooling"))
    return O.search_race(legs)


def _address(n: Column) -> Column:
    """Ids' addresses on a hundred hosts; every 97th is private."""
    return F.when(n % 97 == 0, F.concat(F.lit("http://10.0.0.1/"), n.cast("string"))).otherwise(F.concat(F.lit("https://h"), (n % 100).cast("string"), F.lit(".example/"), n.cast("string")))


def redirect_chase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four addresses lead on to another, 100 or 37 further."""
    n = F.col("event_id")
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    to = F.when(n % 4 == 1, n + 100).when(n % 4 == 2, n + 37).when(n % 4 == 3, n + 200)
    return O.follow_redirects(ids.select(n.alias("id"), _address(n).alias("url")), ids.where(to.isNotNull()).select(_address(n).alias("url"), _address(to).alias("location"))).select("id", "final_url", F.col("hops").cast("bigint").alias("hops"), "error", "headers_kept")


def capped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of 4,000 bytes, as pages are small; every third answer tells its length."""
    n = F.col("page_id")
    size = F.octet_length("html")
    out = O.capped_body(_of(KINDS, n), size, F.when(n % 3 == 0, size), 4000)
    return web.pages(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in out.items()])


def content_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.functions.html import content_route as route

    n = F.col("page_id")
    url = F.when(n % 11 == 0, F.lit("https://e.com/a.pdf?x=1")).otherwise(F.col("url"))
    kind = _of((*KINDS, "application/ld+json", "text/css", None), n)
    return web.pages(spark, sf_dir).select("page_id", route(kind, url).alias("route"), route(kind, url, raw=True).alias("raw_route"))


_SOFT, _HARD = "Just a moment...", "You've been blocked"


def relay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.col("text")
    made = F.when(n % 6 == 1, F.concat(F.lit("Title\nWarning: Target URL returned error 404: Not Found\n"), text)).when(n % 6 == 2, F.concat(F.lit(f"{_HARD} "), text)).when(n % 6 == 3, F.concat(F.lit(f"{_SOFT}\nMarkdown Content:\n"), text)).when(n % 6 == 4, F.concat(F.lit(f"{_SOFT}\n"), text)).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", O.relay_outcome(F.coalesce(made, F.lit(""))).alias("outcome"))


def fetch_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bodies, of which each source has its own; every seventh body is thin."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    has = lambda k, name: F.when(n % k == 0, F.concat(F.lit(f"{name} of "), n.cast("string"), F.lit(" "), text))
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        n.alias("id"), has(11, "site").alias("adapter_text"), (n % 13 == 0).alias("cooling"), _of(STATUS, n).alias("status"), F.when(n % 4 == 3, "application/json").otherwise("text/html").alias("content_type"),
        F.when(n % 7 == 0, F.lit("thin")).otherwise(text).alias("text"), has(3, "archive").alias("archive_text"), F.when(n % 10 == 5, F.lit(f"{_HARD} from this page, as it seems to be")).otherwise(has(2, "relay of the page")).alias("relay_text"), (n % 17 == 0).alias("raw"),
    )
    return O.fetch_ladder(made)


def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order nearest to a day of their own."""
    days = F.date_add(F.lit("1995-06-17").cast("date"), (F.col("c_custkey") % 1000).cast("int"))
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), days.cast("timestamp").alias("at"))
    taken = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("taken"), F.col("o_orderkey").alias("id"))
    return O.closest_snapshot(wanted, taken).select("key", "id", F.date_format("taken", "yyyy-MM-dd").alias("taken"))


def dns_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hosts, their orders as addresses; every 50th order's is private, and some hosts have none."""
    n, k = F.col("c_custkey"), F.col("o_orderkey")
    urls = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(n % 10 == 0, F.concat(F.lit("https://8.8.8."), (n % 250).cast("string"), F.lit("/"), n.cast("string"))).otherwise(F.concat(F.lit("https://C"), n.cast("string"), F.lit(".example/"))).alias("url"))
    address = F.when(k % 50 == 0, F.concat(F.lit("192.168."), (k % 200).cast("string"), F.lit(".1"))).otherwise(F.concat(F.lit("93.184."), (k % 200).cast("string"), F.lit(".1")))
    dns = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".example")).alias("host"), address.alias("address"))
    return O.resolve_safe(urls, dns)


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    own = _events(spark, sf_dir).where("event_type = 'error'").select(n.alias("id"), (n % 40 * 100 + 500).alias("deadline_ms"), (n % 7 * 50).alias("took_ms"))
    return O.retry_schedule(own).select(F.col("id").alias("event_id"), F.col("attempt").cast("bigint").alias("attempt"), "start_ms")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    out = O.search_request(F.concat(F.lit("q"), (n % 50).cast("string")), _of((None, 0, 3, 8, 50), n), _of(("d", "x", None), n), _of((" en-US ", "e", "pt", None), n), _of((None, "multi", "bing"), F.floor(n / 50)), _of((None, "true", "3", "0", "99", "maybe"), n))
    return _events(spark, sf_dir).select("event_id", "t", *[c.alias(k) for k, c in out.items()])


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).drop("t")


def search_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each search is answered from what an equal one left within six hours."""
    return S.ttl_cache(_requests(spark, sf_dir).select("key", F.col("event_id").alias("id"), "t"), logs.TTL).select(F.col("id").alias("event_id"), "hit")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("at")).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "at", F.lit("v").alias("value"))
    line = F.when(F.pmod(F.col("at"), F.lit(13)) == 0, F.lit('{"key":')).otherwise(F.to_json(F.struct("key", "at", "value")))
    return O.load_cache(own.select(line.alias("line")), 1_706_745_600_000_000, 20 * 86_400_000_000)


def cache_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry a user, some broken; those of the last twenty days."""
    return _entries(spark, sf_dir).select("key", "at")


def cache_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half of the entries, as they are too large together."""
    return S.newest_half(_entries(spark, sf_dir).withColumn("size", F.length("key")), "at", "size", 100).select("key", "at")


def cache_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of one entry a type, whose least recently used entry leaves."""
    own = _events(spark, sf_dir).select("event_type", F.col("event_id").alias("id"), "t", F.col("user_id").alias("key"))
    return S.evicting_cache(own, "event_type", 1, logs.TTL * 4, recent=True).select(F.col("id").alias("event_id"), "hit", "size")


QUERIES = {f.__name__: f for f in (response_outcomes, search_fallback, search_race, redirect_chase, capped_bodies, content_route, relay_outcomes, fetch_ladder, snapshot_asof, dns_safety, retry_schedule, search_requests, search_cache, cache_load, cache_flush, cache_recent)}


def _pick(values: tuple, index: str) -> str:
    shown = ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'{}'".format(v) for v in values)
    return f"[{shown}][(({index}) % {len(values)}) + 1]"


_E = logs._E
_KIND_TOLD = (*KINDS, "application/ld+json", "text/css", None)
_HOP = "CASE WHEN {0} % 4 = 1 THEN {0} + 100 WHEN {0} % 4 = 2 THEN {0} + 37 WHEN {0} % 4 = 3 THEN {0} + 200 END"
_ADDR = "CASE WHEN {0} % 97 = 0 THEN 'http://10.0.0.1/' || {0} ELSE 'https://h' || {0} % 100 || '.example/' || {0} END"
_HOSTOF = "CASE WHEN {0} % 97 = 0 THEN '10.0.0.1' ELSE 'h' || {0} % 100 END"
_LEGS = """SELECT event_id // 4 AS query_id, event_id % 4 AS leg, event_id * 7919 % 1000 AS ms, CASE WHEN (event_id // 4) % 3 = 0 THEN CASE WHEN event_id % 4 < 2 THEN 0 ELSE event_id * 31 % 3 END ELSE event_id * 31 % 8 END AS kept FROM events"""
_SEARCH = f"""SELECT event_id, t, least(greatest(coalesce({_pick((None, 0, 3, 8, 50), 'event_id')}, 8), 1), 20)::BIGINT AS n, CASE WHEN event_id % 3 = 0 THEN 'd' END AS recency, {_pick(('en-US', None, 'pt', None), 'event_id')} AS lang, {_pick((0, 4, 3, 1, 8, 0), 'event_id')}::BIGINT AS deep, coalesce({_pick((None, 'multi', 'bing'), 'event_id // 50')}, 'auto') AS engine FROM e"""
_KEYED = f"SELECT event_id, t, n, recency, lang, deep, 's:' || engine || ':' || coalesce(recency, '') || ':' || coalesce(lang, '') || ':' || n || ':q' || event_id % 50 || ':deep' || deep AS key FROM ({_SEARCH})"
_LOADED = f"{_E}, c AS (SELECT 'u' || user_id AS key, max(t) AS \"at\" FROM e GROUP BY user_id), l AS (SELECT * FROM c WHERE \"at\" % 13 <> 0 AND 1706745600000000 - \"at\" <= 1728000000000)"
ORACLES = {
    "response_outcomes": f"""SELECT event_id, ok, CASE WHEN ok THEN NULL WHEN s IN (401, 403) THEN 'HTTP ' || s || ' — h' || user_id || ' refuses unauthenticated requests' WHEN s = 429 THEN 'HTTP 429 — h' || user_id || ' rate-limits us' ELSE 'HTTP ' || s END AS message,
CASE WHEN ok THEN NULL WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'ratelimit' WHEN s IN (404, 410) THEN 'notfound' ELSE 'transient' END AS retry_class, CASE WHEN s = 429 THEN [120000, 300000, 60000][event_id % 3 + 1]::BIGINT END AS wait_ms
FROM (SELECT event_id, user_id, s, s BETWEEN 200 AND 299 AND NOT (s = 202 AND event_id % 3 = 0) AS ok FROM (SELECT *, {_pick(STATUS, 'event_id')} AS s FROM events))""",
    "search_fallback": f"""WITH a AS (SELECT event_id // 4 AS query_id, event_id % 4 AS leg, s, CASE WHEN s = 200 THEN event_id * 104729 % 3 ELSE 0 END AS r FROM (SELECT event_id, {_pick((200, 200, 200, 500, 403), 'event_id * 7919')} AS s FROM events)),
f AS (SELECT query_id, s AS s0, r AS r0 FROM a WHERE leg = 0), ok AS (SELECT a.query_id, leg, r FROM a LEFT JOIN f USING (query_id) WHERE r > 0 AND (leg = 0 OR leg = 3 OR (leg = 1 AND coalesce(s0, 0) NOT IN (202, 403) AND s0 IS NOT NULL) OR (leg = 2 AND s0 = 200 AND r0 = 0)) QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY leg) = 1)
SELECT query_id, ['html', 'lite', 'post', 'relay'][ok.leg + 1] AS leg, r AS n_rows, CASE WHEN ok.leg IS NULL THEN CASE WHEN s0 IN (202, 403) THEN 'challenge' ELSE 'no results' END END AS error FROM (SELECT DISTINCT query_id FROM a) LEFT JOIN f USING (query_id) LEFT JOIN ok USING (query_id)""",
    "search_race": f"""WITH l AS ({_LEGS}), f AS (SELECT query_id, min(ms) AS first, arg_min(kept, {{'a': ms, 'b': CASE leg WHEN 0 THEN 'ddg' ELSE 'bing' END}}) AS fk FROM l WHERE leg < 2 GROUP BY 1), p AS (SELECT l.query_id, string_agg(CASE leg WHEN 0 THEN 'ddg' ELSE 'bing' END, '+' ORDER BY ms, leg DESC) AS e FROM l JOIN f USING (query_id) WHERE leg < 2 AND kept > 0 AND (fk < 5 OR ms <= first + 300) GROUP BY 1),
o AS (SELECT query_id, max(kept) FILTER (leg = 2) AS brave, max(kept) FILTER (leg = 3) AS relay FROM l GROUP BY 1)
SELECT query_id, coalesce(e, CASE WHEN brave > 0 AND query_id % 11 <> 0 AND query_id % 5 <> 0 THEN 'brave' WHEN relay > 0 THEN 'ddg-jina' ELSE '' END) AS engines FROM o LEFT JOIN p USING (query_id)""",
    "redirect_chase": f"""WITH RECURSIVE n AS (SELECT max(event_id) AS hi, min(event_id) AS lo FROM events), r(id, pos_, hops, error, kept, stop) AS (SELECT event_id, event_id, 0, CASE WHEN event_id % 97 = 0 THEN 'blocked host' END, true, event_id % 97 = 0 FROM events
    UNION ALL SELECT id, CASE WHEN hops < 5 AND nx % 97 <> 0 THEN nx ELSE pos_ END, CASE WHEN hops < 5 AND nx % 97 <> 0 THEN hops + 1 ELSE hops END, CASE WHEN hops >= 5 THEN 'too many redirects' WHEN nx % 97 = 0 THEN 'blocked host' END, kept AND (hops >= 5 OR nx % 97 = 0 OR {_HOSTOF.format('nx')} = {_HOSTOF.format('pos_')}), hops >= 5 OR nx % 97 = 0
    FROM (SELECT r.*, {_HOP.format('pos_')} AS nx FROM r JOIN n ON pos_ BETWEEN lo AND hi WHERE NOT stop) WHERE nx IS NOT NULL)
SELECT id, {_ADDR.format('pos_')} AS final_url, hops::BIGINT AS hops, error, kept AS headers_kept FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC, stop DESC) = 1""",
    "capped_bodies": f"""SELECT page_id, CASE WHEN b OR big THEN 0 ELSE least(n, 4000) END::BIGINT AS n_read, NOT b AND NOT big AND n > 4000 AS capped, CASE WHEN NOT b AND big THEN 'Response too large: 0.0MB' END AS error
FROM (SELECT page_id, n, page_id % {len(KINDS)} IN (2, 5) AS b, page_id % 3 = 0 AND n > 4000 AS big FROM (SELECT page_id, strlen(html) AS n FROM pages))""",
    "content_route": f"""SELECT page_id, CASE WHEN page_id % 11 = 0 OR k = 'application/pdf' THEN 'pdf' WHEN k IN ('image/png', 'application/octet-stream') THEN 'binary' WHEN k LIKE '%json' THEN 'json' WHEN k IN ('text/plain', 'text/css') THEN 'text' ELSE 'html' END AS route,
    CASE WHEN page_id % 11 = 0 OR k = 'application/pdf' THEN 'pdf' WHEN k IN ('image/png', 'application/octet-stream') THEN 'binary' ELSE 'raw' END AS raw_route FROM (SELECT page_id, {_pick(_KIND_TOLD, 'page_id')} AS k FROM pages)""",
    "relay_outcomes": r"""SELECT doc_id, CASE WHEN k = 1 THEN 'origin 404' WHEN k NOT IN (2, 3, 4) AND length(trim(t)) < 40 THEN 'empty' WHEN k = 2 AND length(trim(t)) + 20 < 40 THEN 'empty' WHEN k = 4 AND length(trim(t, ' ')) + 17 < 40 AND length(trim('Just a moment...' || chr(10) || t)) < 40 THEN 'empty' WHEN k = 2 OR k = 4 THEN 'blocked'
    WHEN k = 3 AND length(trim(regexp_replace('Markdown Content:' || chr(10) || t, '[\s\x{00A0}]+', ' ', 'g'))) < 600 THEN CASE WHEN length(trim('Just a moment...' || chr(10) || 'Markdown Content:' || chr(10) || t)) < 40 THEN 'empty' ELSE 'blocked' END ELSE 'ok' END AS outcome FROM (SELECT doc_id, doc_id % 6 AS k, coalesce(text, '') AS t FROM documents)""",
    "fetch_ladder": rf"""WITH b AS (SELECT doc_id AS n, coalesce(text, '') AS t, {_pick(STATUS, 'doc_id')} AS s FROM documents),
l AS (SELECT n, s, CASE WHEN n % 7 = 0 THEN 'thin' ELSE t END AS body, CASE WHEN n % 11 = 0 AND n % 17 <> 0 THEN 'site of ' || n || ' ' || t END AS site, CASE WHEN n % 3 = 0 THEN 'archive of ' || n || ' ' || t END AS arch, CASE WHEN n % 10 <> 5 AND n % 2 = 0 THEN 'relay of the page of ' || n || ' ' || t END AS rel0 FROM b),
c AS (SELECT *, CASE WHEN length(trim(rel0)) >= 40 THEN rel0 END AS rel, length(regexp_replace(regexp_replace(body, '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')) AS bs FROM l),
e AS (SELECT *, length(regexp_replace(regexp_replace(rel, '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')) AS es FROM c),
d AS (SELECT *, CASE WHEN site IS NOT NULL THEN 'adapter' WHEN n % 13 = 0 THEN CASE WHEN arch IS NOT NULL THEN 'wayback' WHEN rel IS NOT NULL THEN 'relay' END
    WHEN s BETWEEN 200 AND 299 THEN CASE WHEN n % 4 <> 3 AND bs < 400 AND n % 17 <> 0 AND es > bs THEN 'relay' ELSE 'direct' END WHEN s IN (401, 403, 429, 503) AND arch IS NOT NULL THEN 'wayback' WHEN s IN (401, 403, 301, 500, 503) AND rel IS NOT NULL THEN 'relay' END AS source FROM e)
SELECT n AS id, source, CASE source WHEN 'adapter' THEN site WHEN 'wayback' THEN arch WHEN 'relay' THEN rel WHEN 'direct' THEN body END AS text, CASE WHEN source IS NULL THEN CASE WHEN n % 13 = 0 THEN 'HTTP 429' ELSE 'HTTP ' || s END END AS error FROM d""",
    "snapshot_asof": "SELECT c_custkey AS key, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS taken FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(epoch_us(o_orderdate) - epoch_us((DATE '1995-06-17' + (c_custkey % 1000)::INT)::TIMESTAMP)), o_orderdate, o_orderkey) = 1",
    "dns_safety": "WITH d AS (SELECT o_custkey, min(CASE WHEN o_orderkey % 50 = 0 THEN '192.168.' || o_orderkey % 200 || '.1' END) AS bad FROM orders GROUP BY 1) SELECT CASE WHEN c_custkey % 10 = 0 THEN 'https://8.8.8.' || c_custkey % 250 || '/' || c_custkey ELSE 'https://C' || c_custkey || '.example/' END AS url, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN o_custkey IS NULL THEN 'dns lookup failed' WHEN bad IS NOT NULL THEN 'resolves to ' || bad END AS reason FROM customer LEFT JOIN d ON o_custkey = c_custkey",
    "retry_schedule": "WITH f AS (SELECT event_id, event_id % 40 * 100 + 500 AS d, event_id % 7 * 50 AS k FROM events WHERE event_type = 'error') SELECT event_id, 0::BIGINT AS attempt, 0::BIGINT AS start_ms FROM f UNION ALL SELECT event_id, 1, k + 300 FROM f WHERE d - k >= 800 UNION ALL SELECT event_id, 2, 2 * k + 1200 FROM f WHERE d - k >= 800 AND d - (2 * k + 300) >= 1400",
    "search_requests": f"WITH {_E} SELECT event_id, n, recency, lang, deep, key FROM ({_KEYED})",
    "search_cache": f"""WITH RECURSIVE {_E}, k AS ({_KEYED}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS i FROM k),
r AS (SELECT key, i, event_id, t AS at, false AS hit FROM n WHERE i = 1 UNION ALL SELECT n.key, n.i, n.event_id, CASE WHEN n.t - r.at <= {logs.TTL} THEN r.at ELSE n.t END, n.t - r.at <= {logs.TTL} FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1) SELECT event_id, hit FROM r""",
    "cache_load": f"WITH {_LOADED} SELECT key, \"at\" FROM l",
    "cache_flush": f"WITH {_LOADED} SELECT key, \"at\" FROM l QUALIFY (SELECT sum(length(key)) FROM l) <= 100 OR row_number() OVER (ORDER BY \"at\" DESC, key) <= ceil((SELECT count(*) FROM l) / 2)",
    "cache_recent": f"WITH {_E}, p AS (SELECT *, lag(user_id) OVER w AS before, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)), g AS (SELECT *, sum(CASE WHEN before = user_id THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY i) AS run FROM p) SELECT event_id, t - first_value(t) OVER (PARTITION BY event_type, run ORDER BY i) <= {logs.TTL * 4} AND before = user_id AS hit_, 1::BIGINT AS size FROM g",
}
ORACLES["cache_recent"] = ORACLES["cache_recent"].replace("AS hit_", "AND coalesce(before = user_id, false) AS hit").replace("AND before = user_id AND", "AND")
