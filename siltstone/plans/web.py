"""Queries over pages: keys, safety, routing, relevance, fusion, text, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import fusion as R
from siltstone.storage import spread

#: URLs with what the table lacks: ports, amp paths, hashbangs, unsafe hosts, known sites.
URLS = (
    "https://Example.com:8080/a/", "http://www.example.com/amp/story/amp", "https://en.m.example.org/x/index.HTML", "https://example.com/#!/deep/link",
    "https://stackoverflow.com/questions/12/some-slug?utm_medium=x&b=2&a=1", "https://m.example.com/?q=a%20b&fbclid=1&ref_src=z", "Not a URL ", "ftp://example.com/f", "http://user:pw@example.com/",
    "http://localhost/x", "http://printer.local/", "http://127.0.0.1/", "http://10.1.2.3/a", "http://172.20.0.1/", "http://8.8.8.8/", "http://100.64.9.9/", "http://[::1]/", "http://[2001:db8::1]/", "http://169.254.169.254/meta",
    "https://github.com/acme/tool", "https://github.com/acme/tool/blob/main/src/a.py", "https://github.com/acme/tool/tree/main/src", "https://github.com/acme/tool/issues/7", "https://github.com/acme/tool/pull/8", "https://github.com/features/actions", "https://github.com/acme/tool/blob/main/../x",
    "https://unix.stackexchange.com/questions/5/why", "https://superuser.com/a/77", "https://old.reddit.com/r/x/comments/abc/t/", "https://news.ycombinator.com/item?id=42", "https://en.wikipedia.org/wiki/Apache_Spark", "https://en.wikipedia.org/wiki/Talk:Spark", "https://arxiv.org/abs/1706.03762", "https://arxiv.org/pdf/1706.03762",
    "https://api.example.com/data.json", "https://example.com/p?api_key=123", "https://example.com/feed.rss?x=1",
)
LANGS = ("en-US", "pt-BR", "sv-SE", "fr", "zh-TW", "en-GB")
QUERY = "that this que une der die"
AGGREGATORS = r"(^|\.)(reddit|ycombinator|github|wikipedia)\.(com|org)$"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs of the pages and the fixed ones."""
    fixed = spark.createDataFrame([(u,) for u in URLS], "url string")
    return pages(spark, sf_dir).select("url").unionByName(fixed).distinct()


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", U.normalize_url(F.col("url")).alias("key"))


def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(U.normalize_url(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", U.safety_reason(F.col("url")).alias("reason"))


def adapter_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", U.adapter_route(F.col("url")).alias("adapter"))


def relay_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", U.relay_block_reason(F.col("url"), F.lit(None).cast("string")).alias("reason"))


def locale_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = T.locale_codes(F.col("lang"))
    return spark.createDataFrame([(x,) for x in LANGS], "lang string").select("lang", *[v.alias(k) for k, v in codes.items()])


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as result rows: the h1 as title, the first words of the body as snippet."""
    title = T.strip_tags(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    snippet = F.substring(T.strip_tags(F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1)), 1, 300)
    return pages(spark, sf_dir).select("page_id", "url", title.alias("title"), snippet.alias("snippet"))


def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relevance_gate(_rows(spark, sf_dir), QUERY).select("page_id", "kept")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines' lists of the pages that pass the gate, in different orders, by language as the query."""
    kept = R.relevance_gate(_rows(spark, sf_dir), QUERY).where("kept")
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    named = kept.select(lang.alias("query_id"), "page_id", "url", "title", "snippet")
    ranked = named.withColumn("_one", F.row_number().over(W.partitionBy("query_id").orderBy("page_id"))).withColumn("_two", F.row_number().over(W.partitionBy("query_id").orderBy(F.length("title"), "page_id")))
    in_bucket = lambda rank, bucket, ord_, month, kind: F.struct(F.col(rank).alias("rank"), F.lit(bucket).alias("bucket"), F.lit(ord_).alias("bucket_ord"), F.format_string(f"{month}-%02d", F.col("page_id") % 28 + 1).alias("date"), F.lit(kind).alias("date_kind"))
    both = F.array(in_bucket("_one", "ddg", 0, "2024-01", "published"), in_bucket("_two", "bing", 1, "2023-12", "indexed"))
    return ranked.where("_one <= 15 OR _two <= 15").select("query_id", "page_id", "url", "title", "snippet", F.inline(both)).where("rank <= 15")


def gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    return R.gate_stats(R.relevance_gate(_rows(spark, sf_dir), QUERY).withColumn("bucket", lang))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_buckets(spark, sf_dir), 8)


def host_diverse_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.host_diverse(R.fuse(_buckets(spark, sf_dir), 8), AGGREGATORS, 3).select("query_id", "pick", "host", "url")


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", H.html_title(F.col("html")).alias("title"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", H.html_text(F.col("html"), 200_000).alias("text"))


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = H.page_flags(F.col("html"), F.col("text"), F.lit("text/html"), F.lit(200))
    return pages(spark, sf_dir).select("page_id", "html", H.html_text(F.col("html"), 200_000).alias("text")).select("page_id", *[v.alias(k) for k, v in flags.items()])


#: (html, url): one case for each sign of a date.
DATED = (
    ('<meta property="article:published_time" content="2025-05-12T23:30:00-05:00">', "https://e.com/"),
    ('<meta name="og:updated_time" content="2025/5/2">', "https://e.com/"),
    ('<script type="application/ld+json">{"@graph":[{"dateModified":"2024-02-03"}]}</script>', "https://e.com/"),
    ('<time datetime="2023-07-08">x</time>', "https://e.com/"),
    ('<meta name="pubdate" content="March 3, 2022">', "https://e.com/"),
    ("<p>x</p>", "https://e.com/2021/04/05/post"),
    ('<meta name="citation_date" content="2020/1/9">', "https://e.com/"),
    ("[Submitted on 12 Jun 2017]", "https://e.com/"),
    ("Published March 3, 2025", "https://e.com/"),
    ("<dt>Last updated</dt> <dd>Apr 4, 2024</dd>", "https://e.com/"),
    ("posted Apr 24, 2024 by", "https://e.com/"),
    ("no date at all", "https://e.com/"),
)


def extract_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(-1 - i, u, h) for i, (h, u) in enumerate(DATED)], "page_id long, url string, html string")
    return pages(spark, sf_dir).select("page_id", "url", "html").unionByName(fixed).select("page_id", H.extract_date(F.col("html"), F.col("url")).alias("date"))


#: Fixed addresses' upstream ones.
UPSTREAM = (
    ("https://github.com/acme/tool", "https://api.github.com/repos/acme/tool https://raw.githubusercontent.com/acme/tool/HEAD/README.md"),
    ("https://github.com/acme/tool/blob/main/src/a.py", "https://raw.githubusercontent.com/acme/tool/main/src/a.py"),
    ("https://github.com/acme/tool/tree/main/src", "https://api.github.com/repos/acme/tool/contents/src?ref=main"),
    ("https://github.com/acme/tool/issues/7", "https://api.github.com/repos/acme/tool/issues/7 https://api.github.com/repos/acme/tool/issues/7/comments?per_page=30"),
    ("https://github.com/acme/tool/pull/8", "https://api.github.com/repos/acme/tool/pulls/8 https://api.github.com/repos/acme/tool/issues/8/comments?per_page=30"),
    ("https://stackoverflow.com/questions/12/some-slug?utm_medium=x&b=2&a=1", "https://api.stackexchange.com/2.3/questions/12/answers?order=desc&sort=votes&site=stackoverflow&filter=withbody&pagesize=5 https://api.stackexchange.com/2.3/questions/12?site=stackoverflow&filter=!9Z(-wwYGT"),
    ("https://unix.stackexchange.com/questions/5/why", "https://api.stackexchange.com/2.3/questions/5/answers?order=desc&sort=votes&site=unix&filter=withbody&pagesize=5 https://api.stackexchange.com/2.3/questions/5?site=unix&filter=!9Z(-wwYGT"),
    ("https://superuser.com/a/77", "https://api.stackexchange.com/2.3/answers/77?order=desc&sort=votes&site=superuser&filter=withbody"),
    ("https://old.reddit.com/r/x/comments/abc/t/", "https://old.reddit.com/r/x/comments/abc/t.json?limit=30"),
    ("https://news.ycombinator.com/item?id=42", "https://hn.algolia.com/api/v1/items/42"),
    ("https://en.wikipedia.org/wiki/Apache_Spark", "https://en.wikipedia.org/api/rest_v1/page/summary/Apache_Spark https://en.wikipedia.org/api/rest_v1/page/html/Apache_Spark"),
    ("https://arxiv.org/abs/1706.03762", "https://export.arxiv.org/api/query?id_list=1706.03762&max_results=1"),
)


def adapter_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", F.array_join(U.adapter_upstream(F.col("url")), " ").alias("upstream"))


QUERIES = {
    f.__name__: f
    for f in (url_normalize, url_dedupe, url_safety, adapter_route, relay_policy, locale_codes, relevance_gate, gate_stats, rrf_fuse, host_diverse_pick, html_title, html_text, page_flags, extract_date, adapter_upstream)
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ALL = f"urls AS (SELECT url FROM pages UNION SELECT unnest([{', '.join(map(_quoted, URLS))}]))"
_RE = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\s*$"


def _parts_sql(source: str, keep: str) -> str:
    get = lambda i: f"regexp_extract(url, '{_RE}', {i})"
    return rf"""SELECT {keep}, regexp_matches(url, '{_RE}') AND {get(2)} <> '' AS ok, lower({get(1)}) AS scheme, regexp_extract({get(2)}, '^(.*)@', 1) AS usr,
    lower(regexp_replace(regexp_replace({get(2)}, '^.*@', ''), ':[0-9]*$', '')) AS host, {get(3)} AS path, regexp_replace({get(4)}, '^\?', '') AS query, {get(5)} AS hash FROM {source}"""


_KEY = r"""(CASE WHEN NOT ok THEN lower(trim(url, ' ')) ELSE h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(kv) > 0 THEN '?' || list_aggregate(list_transform(list_sort(list_transform(kv, lambda x, i: {'k': x.k, 'i': i, 'v': x.v})), lambda x: x.k || '=' || x.v), 'string_agg', '&') ELSE '' END END)"""


def _keys_sql(source: str, keep: str) -> str:
    """keep and key of every url of source."""
    return rf"""SELECT {keep}, {_KEY} AS key FROM (SELECT *, CASE WHEN regexp_matches(h, '(^|\.)(stackoverflow|superuser|serverfault)\.com$|\.stackexchange\.com$') THEN regexp_replace(p1, '^(/questions/\d+)/.*', '\1') ELSE p1 END AS p,
    list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))}}), lambda x: NOT regexp_matches(x.k, '(?i)^(utm_\w+|fbclid|gclid|ref|ref_src|si)$')) AS kv
    FROM (SELECT *, regexp_replace(regexp_replace(host, '^(www|m|amp|mobile)\.', ''), '^([a-z]{{2,3}})\.m\.', '\1.') AS h,
        regexp_replace(CASE WHEN hash LIKE '#!/%' THEN substr(hash, 3) ELSE regexp_replace(regexp_replace(regexp_replace(path, '/+$', ''), '^/amp(/)', '\1'), '/amp$', '') END, '(?i)/index\.(html?|php)$', '') AS p1 FROM ({_parts_sql(source, keep)})))"""


_V4 = r"^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
_SAFETY = rf"""SELECT url, CASE WHEN url IS NULL OR NOT (ok OR regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')) THEN 'invalid url'
    WHEN lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'blocked protocol' WHEN NOT ok THEN 'invalid url' WHEN usr <> '' THEN 'credentials'
    WHEN regexp_matches(hs, '(?i)^(localhost|localhost\.localdomain)$|\.(local|internal|localhost|home\.arpa)$') THEN 'blocked host'
    WHEN regexp_matches(hs, '{_V4}') AND (hs LIKE '127.%' OR hs LIKE '10.%' OR hs LIKE '192.168.%' OR hs LIKE '169.254.%' OR hs LIKE '0.%' OR regexp_matches(hs, '^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.')) THEN 'blocked host'
    WHEN hs IN ('[::1]', '[::]') OR regexp_matches(hs, '^\[(f[cd][0-9a-f]{{2}}:|fe[89ab][0-9a-f]:|64:ff9b::)') THEN 'blocked host' END AS reason
FROM (SELECT *, regexp_replace(host, '\.$', '') AS hs FROM ({_parts_sql("urls", "url")}))"""
_ROUTE = rf"""SELECT url, CASE WHEN scheme NOT IN ('http', 'https') THEN NULL
    WHEN gh AND regexp_matches(path, '^/[^/]+/[^/]+/(blob|raw)/[^/]+/.') AND path NOT LIKE '%..%' THEN 'github-raw' WHEN gh AND regexp_matches(path, '^/[^/]+/[^/]+/tree/[^/]+/.') AND path NOT LIKE '%..%' THEN 'github-tree-api'
    WHEN gh AND regexp_matches(path, '^/[^/]+/[^/]+/pull/[1-9]') THEN 'github-pr-api' WHEN gh AND regexp_matches(path, '^/[^/]+/[^/]+/issues/[1-9]') THEN 'github-issue-api' WHEN gh AND regexp_matches(path, '^/[^/]+/[^/]+/?$') THEN 'github-api'
    WHEN regexp_matches(host, '^(stackoverflow|superuser|serverfault)\.com$|^[a-z0-9-]+\.stackexchange\.com$') AND regexp_matches(path, '/(questions|q|a)/\d+') THEN 'stackexchange-api'
    WHEN regexp_matches(host, '^(www\.|old\.|new\.|np\.)?reddit\.com$') AND contains(path, '/comments/') THEN 'reddit-json' WHEN host = 'news.ycombinator.com' AND regexp_matches(query, '(^|&)id=\d+(&|$)') THEN 'hn-algolia'
    WHEN regexp_matches(host, '^[a-z-]+\.(m\.)?wikipedia\.org$') AND host NOT LIKE 'www.%' AND regexp_matches(path, '^/wiki/[^/:#]+$') THEN 'wikipedia-rest' WHEN regexp_matches(host, '^(www\.)?arxiv\.org$') AND regexp_matches(path, '^/abs/[^?#]+$') THEN 'arxiv-api' END AS adapter
FROM (SELECT *, regexp_matches(host, '^(www\.)?github\.com$') AND split_part(path, '/', 2) NOT IN ('', {', '.join(map(_quoted, U.RESERVED_OWNERS))}) AS gh FROM ({_parts_sql("urls", "url")}))"""
_RELAY = rf"""SELECT url, CASE WHEN len(sec) > 0 THEN 'secret-looking param ''' || sec[1] || '''' WHEN regexp_matches(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '(?i)\.(json|xml|txt|csv|pdf|md|yaml|yml|rss|atom)(\?|$)') THEN 'non-HTML path' END AS reason
FROM (SELECT *, list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda k: regexp_matches(k, '(?i)^(token|key|api[_-]?key|auth|authorization|sig|signature|secret|password|access[_-]?token|code|session|jwt)$')) AS sec FROM ({_parts_sql("urls", "url")}))"""
_LOCALE = f"""SELECT lang, coalesce(MAP {{{', '.join(f"{_quoted(k)}: {_quoted(v)}" for k, v in T.KL_CODES.items())}}}[lang], CASE WHEN r <> '' THEN lower(r) || '-' || lower(l) ELSE l || '-' || l END) AS kl,
    upper(CASE WHEN r <> '' THEN r ELSE lang END) AS country, CASE WHEN r <> '' THEN lower(l) || '-' || upper(r) ELSE lang END AS market, lang || ',' || l || ';q=0.9,en;q=0.5' AS accept
FROM (SELECT lang, split_part(lang, '-', 1) AS l, split_part(lang, '-', 2) AS r FROM (SELECT unnest([{', '.join(map(_quoted, LANGS))}]) AS lang))"""


def _decoded_sql(x: str) -> str:
    for name, to in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("apos", "'"), ("nbsp", " "), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {_quoted(to)})"
    return x


def _stripped_sql(x: str) -> str:
    inner = _decoded_sql(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    return rf"regexp_replace(regexp_replace({inner}, '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')"


_ROWS = rf"""rows_ AS (SELECT page_id, url, {_stripped_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, left({_stripped_sql("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")}, 300) AS snippet FROM pages)"""


def _tokens_sql(source: str, keys: str, text: str) -> str:
    from siltstone.plans.texts import tokens_sql

    return tokens_sql(source, keys, text)


_GATE = rf"""{_ROWS}, docs_ AS (SELECT page_id, title || ' ' || snippet || ' ' || regexp_replace(url_decode(path), '[-_/.]+', ' ', 'g') AS t FROM (SELECT * FROM ({_parts_sql("rows_", "page_id, title, snippet, url")}))),
tk AS (SELECT DISTINCT page_id, token FROM ({_tokens_sql("docs_", "page_id", "t")})), q(q) AS (VALUES ('that'), ('thi'), ('que'), ('une'), ('der'), ('die')),
hits AS (SELECT page_id, count(DISTINCT q) AS n FROM tk, q WHERE token = q OR (length(q) >= 5 AND (starts_with(token, q) OR (length(token) >= 5 AND starts_with(q, token)))) GROUP BY page_id),
gate AS (SELECT r.*, coalesce(n, 0) >= 2 AS kept FROM rows_ r LEFT JOIN hits USING (page_id))"""
_LANG = r"regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1)"
_FUSED = rf"""{_GATE}, nm AS (SELECT {_LANG} AS query_id, * FROM gate WHERE kept),
bk AS (SELECT query_id, page_id, url, title, snippet, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank, 'ddg' AS bucket, 0 AS bo, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS date, 'published' AS kind, 1.0::DOUBLE AS w FROM nm
    UNION ALL SELECT query_id, page_id, url, title, snippet, row_number() OVER (PARTITION BY query_id ORDER BY length(title), page_id), 'bing', 1, '2023-12-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0'), 'indexed', 0.5 FROM nm),
ky AS ({_keys_sql("(SELECT * FROM bk WHERE rank <= 15)", "query_id, url, title, snippet, rank, bucket, bo, date, kind, w")}),
fz AS (SELECT query_id, key, sum(w / (60 + rank)) AS s, min({{'a': bo, 'b': rank}}) AS o, arg_min(url, {{'a': bo, 'b': rank}}) AS url, arg_min(title, {{'a': bo, 'b': rank}}) AS t1, arg_min(title, {{'a': length(title), 'b': bo, 'c': rank}}) FILTER (length(title) >= 8) AS t2,
    arg_min(snippet, {{'a': -length(snippet), 'b': bo, 'c': rank}}) AS snippet, min(date) FILTER (kind <> 'indexed') AS d1, arg_min(date, {{'a': bo, 'b': rank}}) AS d2, arg_min(kind, {{'a': bo, 'b': rank}}) AS k2,
    list_distinct(list(bucket)) AS e FROM ky GROUP BY ALL),
fu AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, o) AS position, key, round(s, 9) AS score, url, CASE WHEN length(t2) < length(t1) THEN t2 ELSE t1 END AS title, snippet, coalesce(d1, d2) AS date, CASE WHEN d1 IS NOT NULL THEN 'published' ELSE k2 END AS date_kind,
    CASE WHEN len(e) = 2 THEN 'ddg+bing' ELSE e[1] END AS engines FROM fz)"""


def _scope_sql() -> str:
    art = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
    return f"CASE WHEN length({art}) > length(html) * 0.1 THEN {art} ELSE html END"


def _text_sql() -> str:
    x = "sc"
    for tag in H.DROPPED:
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    for p, to in (("(?s)<!--.*?-->", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|li|tr|h[1-6]|section|article|blockquote|pre|td)>", "\n"), ("(?i)<li[^>]*>", "• "), ("<[^>]+>", " ")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    x = _decoded_sql(x)
    for p, to in ((r"[ \t]+", " "), (r"(?m)^[^\S\n]+|[^\S\n]+$", ""), (r"\n{3,}", "\n\n"), (r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


_TITLE = rf"regexp_replace({_decoded_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
_TEXT = f"SELECT page_id, html, left(CASE WHEN ti <> '' THEN ti || chr(10) || repeat('=', least(length(ti), 60)) || chr(10) || bo ELSE bo END, 200000) AS text FROM (SELECT page_id, html, {_TITLE} AS ti, {_text_sql()} AS bo FROM (SELECT *, {_scope_sql()} AS sc FROM pages))"
_DATES = ("2025-05-13", "2025-05-02", "2024-02-03", "2023-07-08", "2022-03-03", "2021-04-05", "2020-01-09", "2017-06-12", "2025-03-03", "2024-04-04", "2024-04-24", None)
ORACLES = {
    "url_normalize": f"WITH {_ALL} {_keys_sql('urls', 'url')}",
    "url_dedupe": f"SELECT key, min(page_id) AS page_id, count(*) AS n FROM ({_keys_sql('pages', 'page_id, url')}) GROUP BY key",
    "url_safety": f"WITH {_ALL} {_SAFETY}",
    "adapter_route": f"WITH {_ALL} {_ROUTE}",
    "adapter_upstream": f"WITH {_ALL}, up(url, upstream) AS (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in UPSTREAM)}) SELECT url, upstream FROM urls LEFT JOIN up USING (url)",
    "relay_policy": f"WITH {_ALL} {_RELAY}",
    "locale_codes": _LOCALE,
    "relevance_gate": f"WITH {_GATE} SELECT page_id, kept FROM gate",
    "gate_stats": f"WITH {_GATE} SELECT {_LANG} AS bucket, count(*) AS got, count(*) FILTER (kept) AS kept FROM gate GROUP BY 1",
    "rrf_fuse": f"WITH {_FUSED} SELECT * FROM fu WHERE position <= 8",
    "host_diverse_pick": rf"WITH {_FUSED}, hs AS (SELECT query_id, position, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host FROM fu WHERE position <= 8), on_ AS (SELECT * FROM hs WHERE NOT regexp_matches(host, '{AGGREGATORS}') QUALIFY row_number() OVER (PARTITION BY query_id, host ORDER BY position) = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS pick, host, url FROM on_ QUALIFY pick <= 3",
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_text": f"SELECT page_id, text FROM ({_TEXT})",
    "page_flags": rf"SELECT page_id, sz < 400 AS thin, sz < 1200 AND regexp_matches(text, '(?i)subscribe|paywall|sign in to read') AS paywall, false AS hard_block, false AS soft_block, length(text) < 200 AND (length(html) > 20000 OR (length(html) > 5000 AND regexp_matches(html, '(?i)<app-root|<div id=\x22root\x22|<div id=\x22app\x22|ng-app|data-reactroot|__NEXT_DATA__|shreddit|<web-app'))) AS script_rendered FROM (SELECT *, length(regexp_replace(regexp_replace(text, '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')) AS sz FROM ({_TEXT}))",
    "extract_date": rf"SELECT page_id, CASE WHEN regexp_matches(url, '/20\d{{2}}/\d{{2}}/\d{{2}}(/|$)') THEN replace(regexp_extract(url, '/(20\d{{2}}/\d{{2}}/\d{{2}})(/|$)', 1), '/', '-') END AS date FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f'({-1 - i}, {_quoted(d) if d else chr(78) + chr(85) + chr(76) + chr(76)})' for i, d in enumerate(_DATES))})",
}
