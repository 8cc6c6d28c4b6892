"""Queries over pages as they are read: markdown, blocks, views, deep search, briefings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import markdown as M
from siltstone.functions import urls as U
from siltstone.operators import fusion as R
from siltstone.operators import passages as P
from siltstone.operators import web as O
from siltstone.plans import sites, web
from siltstone.sources import parsers as S
from siltstone.sources.pdf import pdf_text_udf

QUERY = "the restoration of ther"

#: Lines of page chrome among lines to keep.
LINES = (
    "Skip to main content", "skip to content here", "Jump to navigation", "Jump to content", "Advertisement", "Cookie settings", "Cookies are baked", "Views", "Viewsonic", "Tools", "- Deutsch", "- German", "- Hiri motu",
    "- Germanic tribes", "- 12 German", "12 languages", "12 languages spoken", "# Computer Science > Databases", "arXiv:2101.00001 (cs)", "arXiv:2101.00001 says", "Plain text", "", "  Edit links  ", "Print/export",
)


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.html_markdown(web.pages(spark, sf_dir)).select("page_id", "text", "truncated")


def html_best_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.html_markdown(web.pages(spark, sf_dir)).select("page_id", "block", F.round("score", 4).alias("score"), "letters", "cjk")


def html_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, html) to (page_id, pre, post, parent, depth, tag, size): nodes in document order; a node's subtree is pre to post - 1, size the length of its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = M.read(html or "")
                size = [len(M._SPACE.sub(" ", t).strip()) if t else 0 for t in n.text]
                k = len(n.tag)
                yield pa.RecordBatch.from_arrays([pa.array([page] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array(n.end, pa.int64()), pa.array(n.parent, pa.int64()), pa.array(n.depth, pa.int64()), pa.array(n.tag), pa.array(size, pa.int64())], names=["page_id", "pre", "post", "parent", "depth", "tag", "size"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, pre long, post long, parent long, depth long, tag string, size long")


def subtree_sums(nodes: DataFrame, of: list[str]) -> DataFrame:
    """(page_id, pre, tag, text, p, li, pre_blocks) for the nodes with one of the tags: sums over the nodes below each.

    Containment is a range of places in one page: a running sum over the page's
    nodes, looked up at a subtree's first and last place, so that no node meets
    each of those below it.
    """
    order = W.partitionBy("page_id").orderBy("pre").rowsBetween(W.unboundedPreceding, 0)
    is_ = lambda tag: (F.col("tag") == tag).cast("long")
    running = nodes.select("*", *[F.sum(c).over(order).alias(k) for k, c in (("text", F.col("size")), ("p", is_("p")), ("li", is_("li")), ("pre_blocks", is_("pre")))])
    heads = running.where(F.col("tag").isin(*of))
    last = running.select(F.col("page_id").alias("_page"), (F.col("pre") + 1).alias("_post"), *[F.col(c).alias(f"_{c}") for c in ("text", "p", "li", "pre_blocks")])
    met = heads.join(last, (F.col("page_id") == F.col("_page")) & (F.col("post") == F.col("_post")))
    return met.select("page_id", "pre", "tag", *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in ("text", "p", "li", "pre_blocks")])


def subtree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtree_sums(html_nodes(web.pages(spark, sf_dir)), ["article"]).select("page_id", "text", "p", "li")


def chrome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_no long, line string")
    t = F.trim("line")
    language = t.rlike(r"^- [^\d][\w '’-]{1,25}$") & F.lower(F.trim(F.substring(t, 3, 100))).isin(*M.LANGUAGES)
    return lines.select("line_no", (t.rlike(M.CHROME) | t.rlike(M.ARXIV_CHROME) | language).alias("chrome"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are kept after extraction; every ninth came from the cache, every seventh was redirected."""
    n = F.col("page_id")
    made = web.pages(spark, sf_dir)
    read = M.html_markdown(made).select(n.alias("_id"), "text")
    notes = F.when(n % 7 == 0, F.array(F.lit("redirected 1×"))).otherwise(F.array().cast("array<string>"))
    return made.join(read, n == F.col("_id")).select(n, "url", "text", F.col("html").alias("raw"), F.lit(200).alias("status"), F.when(n % 5 == 0, "wayback").otherwise("direct").alias("source"), F.when(n % 2 == 0, "2024-01-02").alias("date"), notes.alias("notes"), (n % 9 == 0).alias("cached"))


def fetch_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.read_pages(_extracted(spark, sf_dir), max_chars=1500, offset=50)


def fetch_page_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.read_pages(_extracted(spark, sf_dir), max_chars=700, raw=True)


def fetch_page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.read_pages(_extracted(spark, sf_dir), query=QUERY, max_chars=1500)


def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the pages' markdown, which has headings and blank lines, with a fence after every second page."""
    n = F.col("page_id")
    md = M.html_markdown(web.pages(spark, sf_dir)).select(n.alias("doc_id"), F.concat("text", F.when(n % 2 == 0, F.lit("\n```py\nx = 1\n\ny = 2\n~~~\n## Last part\nWith a line that is long enough.\n")).otherwise("")).alias("text"))
    return P.split_markdown(md).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "heading", "text", "kind")


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages' scores for a query with code signs, so that headings, phrases and code count."""
    return P.score_passages(_with_code(spark, sf_dir), "part; long").select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


def _with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_passages(spark, sf_dir)


def search_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused results of each query; the first four with what their page says."""
    fused = R.fuse(web._buckets(spark, sf_dir), 8)
    pages = _page_texts(spark, sf_dir)
    return O.deep_excerpts(fused, pages, QUERY, 4).select("query_id", "position", "url", "excerpt", "date", "date_kind")


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    keyed = web.pages(spark, sf_dir).select(n, "url", "html", U.normalize_url(F.col("url")).alias("key"))
    first = R.first_per_key(keyed.select(n, "key"), "key", "page_id").select(n.alias("_id"), F.col("key").alias("_key"))
    read = M.html_markdown(web.pages(spark, sf_dir)).select("page_id", "text")
    return read.join(first, n == F.col("_id")).select("page_id", F.col("_key").alias("key"), "text", F.when(n % 3 == 0, "2022-02-02").alias("date"))


def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text a query: engines, what the gate took out, numbered results."""
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    gated = R.relevance_gate(web._rows(spark, sf_dir), web.QUERY).withColumn("query_id", lang)
    stats = gated.groupBy("query_id").agg(F.count("*").alias("got"), F.count_if("kept").alias("kept"))
    both = stats.withColumn("bucket", F.explode(F.array(F.lit("bing"), F.lit("ddg"))))
    fused = R.fuse(web._buckets(spark, sf_dir), 8).withColumn("excerpt", F.lit(None).cast("string"))
    return O.search_text(fused, both)


def cached_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cached_engines(R.fuse(web._buckets(spark, sf_dir), 8))


def research_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A briefing for each query: six web results, four stories and four repositories, three articles, then three pages of different hosts."""
    fused = R.fuse(web._buckets(spark, sf_dir), 6)
    common = ("query_id", "kind", "kind_ord", "position", "title", "url", "snippet", "excerpt", "date", "date_kind", "engines", "meta")
    none = lambda *names: [F.lit(None).cast("string").alias(x) for x in names]
    sources = fused.select(F.col("query_id"), F.lit("web").alias("kind"), F.lit(0).alias("kind_ord"), "position", "title", "url", "snippet", *none("excerpt"), "date", "date_kind", "engines", *none("meta")).select(*common)
    rows = sites._results(spark, sf_dir)
    answers = sites._api_answers(rows.withColumn("query_id", F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)))
    for order, (kind, most) in enumerate((("hn", 4), ("github", 4), ("wikipedia", 3)), 1):
        one = S.parse_api(kind, answers[kind]).withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("i"))).where(F.col("position") <= most)
        sources = sources.unionByName(one.select("query_id", F.lit(kind).alias("kind"), F.lit(order).alias("kind_ord"), "position", "title", "url", "snippet", *none("excerpt", "date", "date_kind"), F.lit("").alias("engines"), "meta").select(*common))
    picks = R.host_diverse(fused, AGGREGATORS, 3).select("query_id", "pick", "title", "url", "key")
    texts = _page_texts(spark, sf_dir).select("key", F.substring("text", 1, 3000).alias("text"))
    return O.research(sources, picks.join(texts, "key", "left"), F.col("query_id"))


#: Hosts that a briefing passes over.
AGGREGATORS = r"duckduckgo|brave\.com|reddit\.com|medium\.com"


def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first lines as PDF streams, every second one packed, and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            made = []
            for doc, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = f"BT /F1 12 Tf ({line}) Tj 0 -14 Td (end) Tj ET".encode("latin-1")
                packed = zlib.compress(body) if doc % 2 else body
                kind = b"/Filter /FlateDecode" if doc % 2 else b""
                made.append(b"%PDF-1.4\n1 0 obj <<" + kind + b">>\nstream\n" + packed + b"\nendstream endobj")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "pdf"])

    line = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 200), "[^A-Za-z0-9 ]", ""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("A "), F.regexp_replace(line, " +", " ")).alias("line")).mapInArrow(run, "doc_id long, pdf binary").select("doc_id", pdf_text_udf("pdf").alias("text"))


def page_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of texts that show each sign: blocks, soft blocks with little and with much behind, walls, scripts."""
    n = F.col("page_id")
    text = H.html_text(F.col("html"), 200_000)
    shown = F.when(n % 5 == 1, F.concat(F.lit("Log in to your Reddit account. "), F.col("t"))).when(n % 5 == 2, F.concat(F.lit("Checking your browser\n"), F.col("t"))).when(n % 5 == 3, F.concat(F.lit("Just a moment...\nMarkdown Content: "), F.substring("t", 1, 700))).when(n % 5 == 4, F.lit("Please subscribe")).otherwise(F.col("t"))
    page = F.when(n % 5 == 4, F.concat(F.lit('<div id="root">'), F.repeat(F.lit("x"), 6000))).otherwise(F.col("html"))
    own = web.pages(spark, sf_dir).select(n, "html", text.alias("t")).select(n, page.alias("html"), shown.alias("shown"))
    return own.select(n, *[c.alias(k) for k, c in H.page_flags(F.col("html"), F.col("shown"), F.lit("text/html"), F.lit(200)).items()])


QUERIES = {
    f.__name__: f
    for f in (html_markdown, html_best_block, subtree_stats, chrome_lines, fetch_page, fetch_page_raw, fetch_page_query, page_passages, page_scores, search_deep, web_search, cached_engines, research_material, pdf_texts, page_signs)
}

# ---- SQL: the pages of the tables hold one article each, with a heading and paragraphs
_BODY = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_DEC = web._decoded_sql
_MARKED = rf"regexp_replace(trim(regexp_replace({_DEC(rf"regexp_replace(regexp_replace(regexp_replace({_BODY}, '<h1>(.*?)</h1>', chr(10) || '# \1' || chr(10), 'g'), '<p><b>([^<]*)<br>', chr(10) || '**\1**' || chr(10), 'g'), '</?p>', chr(10), 'g')")}, '\s+\n', chr(10) || chr(10), 'g'), chr(10) || ' '), '\n{{3,}}', chr(10) || chr(10), 'g')"
_SIZES = lambda html: f"list_sum(list_transform(regexp_extract_all({html}, '>([^<]*)', 1), lambda x: length(trim(regexp_replace({_DEC('x')}, '\\s+', ' ', 'g')))))"
_AD = rf"regexp_replace({_DEC(r"regexp_extract(html, '(?s)<div class=\x22ad\x22>(.*?)</div>', 1)")}, '\s+', ' ', 'g')"
#: The article if it has over 200 characters, else the body or the page where they have.
_MD = rf"""md AS (SELECT page_id, url, html, title, own, ps, whole, block, CASE WHEN length(b) < 120 THEN '' ELSE b END AS text, b FROM (SELECT *, CASE WHEN block = 'article' THEN a ELSE trim(CASE WHEN block = '#page' THEN title ELSE '' END || CASE WHEN ad <> '' THEN chr(10) || ad ELSE '' END || chr(10) || chr(10) || a, chr(10)) END AS b
    FROM (SELECT *, own + ad_n + length(title) AS whole, CASE WHEN own > 200 THEN 'article' WHEN own + ad_n > 200 AND own + ad_n + 25 * ps >= 0.8 * (own + ad_n + length(title) + 25 * ps) AND own + ad_n >= 0.9 * (own + ad_n + length(title)) THEN 'body' ELSE '#page' END AS block
    FROM (SELECT page_id, url, html, {web._TITLE} AS title, {_AD} AS ad, length(trim({_AD})) AS ad_n, {_MARKED} AS a, {_SIZES("'>' || " + _BODY)} AS own, len(regexp_extract_all({_BODY}, '<p>')) AS ps FROM pages))))"""
_LETTERS = r"len(regexp_extract_all(b, '\p{L}'))"


def _view_sql(text: str, most: int, offset: int) -> str:
    budget = most - 120
    footer = lambda at: f"chr(10) || chr(10) || '[truncated at ' || {at} || ' of ' || length({text}) || ' chars — pass offset:' || {at} || ' for the next part, or a query]'"
    room = f"({budget} - length({footer(offset + budget)}))"
    return f"CASE WHEN length({text}) <= {offset} THEN '[offset {offset} is past the end (' || length({text}) || ' chars)]' WHEN length({text}) <= {offset + budget} THEN substr({text}, {offset + 1}, {budget}) ELSE substr({text}, {offset + 1}, {room}::BIGINT) || {footer(f'({offset} + {room})')} END"


def _page_sql(view: str, total: str, offset: int) -> str:
    return f"""'[' || url || ']' || chr(10) || '[HTTP 200' || CASE WHEN page_id % 5 = 0 THEN ' · via wayback' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN ' · 2024-01-02' ELSE '' END || ' · {offset}–' || ({offset} + length({view})) || ' of ' || {total} || CASE WHEN page_id % 7 = 0 THEN ' · redirected 1×' ELSE '' END || CASE WHEN page_id % 9 = 0 THEN ' · cached' ELSE '' END || ']' || chr(10) || chr(10) || {view}"""


#: Passages of markdown made of headings, blank lines and paragraphs without line breaks, then of a fence and a last part.
_BLOCKS = r"""bl AS (SELECT page_id AS doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM md),
hd AS (SELECT *, last_value(CASE WHEN regexp_matches(t, '^# .{3,120}$') THEN trim(substr(t, 3)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM bl),
pr AS (SELECT doc_id, i, coalesce(h, '') AS h, trim(regexp_replace(t, '^# .{3,120}$', '')) AS t FROM hd),
lg AS (SELECT doc_id, i, h, t, regexp_extract_all(t, '[^.!?\n]+[.!?]?\s*') AS s FROM pr WHERE length(t) > 1200),
rc(doc_id, i, h, s, k, cur, done) AS (SELECT doc_id, i, h, CASE WHEN len(s) > 0 THEN s ELSE [t] END, 0, '', NULL::VARCHAR FROM lg
    UNION ALL SELECT doc_id, i, h, s, k + 1, CASE WHEN length(cur) + length(s[k + 1]) > 900 AND length(cur) >= 24 THEN s[k + 1] ELSE cur || s[k + 1] END, CASE WHEN length(cur) + length(s[k + 1]) > 900 AND length(cur) >= 24 THEN cur END FROM rc WHERE k < len(s)),
al AS (SELECT doc_id, i, k, h, trim(done) AS t, 'prose' AS kind FROM rc WHERE done IS NOT NULL UNION ALL SELECT doc_id, i, k + 1, h, trim(cur), 'prose' FROM rc WHERE k = len(s) AND length(trim(cur)) >= 24 UNION ALL SELECT doc_id, i, 0, h, t, 'prose' FROM pr WHERE length(t) BETWEEN 24 AND 1200"""
_FENCED = """ UNION ALL SELECT doc_id, 1000000, 0, arg_max(h, i), '```py' || chr(10) || 'x = 1' || chr(10) || chr(10) || 'y = 2' || chr(10) || '~~~', 'code' FROM pr WHERE doc_id % 2 = 0 GROUP BY doc_id UNION ALL SELECT page_id, 1000001, 0, 'Last part', 'With a line that is long enough.', 'prose' FROM md WHERE page_id % 2 = 0"""
_PASSAGES = f"{_BLOCKS}{_FENCED}), ps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS pos, h AS heading, t AS text, kind FROM al)"
_PLAIN = f"{_BLOCKS}), ps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS pos, h AS heading, t AS text, kind FROM al)"


def _scored_sql(words: tuple[str, ...], phrase: str, code: bool) -> str:
    from siltstone.plans.texts import tokens_sql

    listed = ", ".join(f"('{w}')" for w in words)
    heading = " OR ".join(f"contains(lower(heading), '{w}')" for w in words)
    return f"""q(token) AS (VALUES {listed}), tk AS ({tokens_sql('ps', 'doc_id, pos', 'text')}), tf AS (SELECT doc_id, pos, token, count(*) AS n FROM tk JOIN q USING (token) GROUP BY ALL), df AS (SELECT doc_id, token, count(*) AS d FROM tf GROUP BY ALL),
st AS (SELECT doc_id, count(*) AS total, avg(length(text)) AS avg_len FROM ps GROUP BY doc_id),
sb AS (SELECT ps.doc_id, ps.pos, ps.heading, ps.text, total, coalesce(sum(ln(1 + (total - d + 0.5) / (d + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * (length(ps.text) / avg_len)))), 0) AS base FROM ps JOIN st USING (doc_id) LEFT JOIN tf USING (doc_id, pos) LEFT JOIN df ON df.doc_id = ps.doc_id AND df.token = tf.token GROUP BY ALL),
sc AS (SELECT doc_id, pos, heading, text, total, base * CASE WHEN heading <> '' AND ({heading}) THEN 1.5 ELSE 1 END * CASE WHEN contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), '{phrase}') THEN 1.5 ELSE 1 END * {"CASE WHEN regexp_matches(text, '```|\\t|=>|function |const |def |class ') THEN 1.2 ELSE 1 END" if code else "1"}
    * CASE WHEN j > 1 THEN 0.3 WHEN j > 0.4 THEN 0.6 ELSE 1 END AS score FROM (SELECT *, len(regexp_extract_all(text, '\\{{\\{{|\\}}\\}}|\\[\\[|\\]\\]|https?://')) / greatest(length(text) / 100, 1) AS j FROM sb))"""


def _picked_sql(most: int) -> str:
    return f"""rs AS (SELECT *, {most} - coalesce(sum(length(text) + length(heading) + 20) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM sc),
pk AS (SELECT doc_id, pos, heading, total, CASE WHEN pos = 0 THEN left(text, 600) WHEN length(text) > rest THEN left(text, rest::BIGINT) || '…' ELSE text END AS text, CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE score END AS score FROM rs WHERE pos = 0 OR (score > 0 AND rest > 0 AND NOT (length(text) > rest AND rest < 80)))"""


_WORDS = ("the", "restoration", "of", "ther")
_ASKED = f"{_MD}, {_PLAIN}, {_scored_sql(_WORDS, 'the restoration of ther', False)}"
_VIEWED = f"""{_ASKED}, {_picked_sql(1500)}, vw AS (SELECT doc_id, string_agg(CASE WHEN heading <> '' AND heading IS DISTINCT FROM before THEN '## ' || heading || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || '[' || count(*) || ' of ' || any_value(total) || ' passages shown — most relevant to the query. Omit query for the page head; offset pages it.]' AS v
    FROM (SELECT *, lag(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM pk) GROUP BY doc_id)"""
_KEYS = f"ks AS ({web._keys_sql('pages', 'page_id, url')}), fk AS (SELECT key, min(page_id) AS page_id FROM ks GROUP BY key)"
_LINE = lambda pos, title, url, date, kind, engines, meta, snippet: f"{pos} || '. ' || {title} || chr(10) || '   ' || {url} || coalesce(CASE WHEN {kind} = 'indexed' THEN '  (indexed ' ELSE '  (' END || {date} || ')', '') || CASE WHEN {engines} <> '' THEN '  · ' || {engines} ELSE '' END || CASE WHEN {meta} <> '' THEN chr(10) || '   ' || {meta} ELSE '' END || CASE WHEN {snippet} <> '' THEN chr(10) || '   ' || CASE WHEN length({snippet}) > 250 THEN left({snippet}, 249) || '…' ELSE {snippet} END ELSE '' END"
_LANG = web._LANG
ORACLES = {
    "html_markdown": f"WITH {_MD} SELECT page_id, text, false AS truncated FROM md",
    "wikipedia": f"WITH {_MD} SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 2 = 0 THEN CASE WHEN text = '' THEN title || chr(10) || chr(10) ELSE text END ELSE 'A summary that the article lacks.' || chr(10) || chr(10) || text END AS text, 'wikipedia-rest' AS source FROM md",
    "html_best_block": f"WITH {_MD} SELECT page_id, block, CASE WHEN block = 'article' THEN (own + 25 * ps) * 1.5 WHEN block = 'body' THEN whole - length(title) + 25 * ps WHEN whole > 200 THEN whole + 25 * ps ELSE 0 END::DOUBLE AS score, {_LETTERS}::BIGINT AS letters, 0::BIGINT AS cjk FROM md",
    "subtree_stats": f"WITH {_MD} SELECT page_id, own::BIGINT AS text, ps::BIGINT AS p, 0::BIGINT AS li FROM md",
    "chrome_lines": "SELECT line_no, line_no IN (0, 1, 3, 4, 5, 7, 9, 11, 12, 15, 17, 18, 22, 23) AS chrome FROM (SELECT unnest(range(24)) AS line_no)",
    "fetch_page": f"WITH {_MD}, v AS (SELECT page_id, url, text, {_view_sql('text', 1500, 50)} AS v FROM md) SELECT page_id, {_page_sql('v', 'length(text)', 50)} AS page FROM v",
    "fetch_page_raw": f"SELECT page_id, {_page_sql('left(html, 700)', 'length(html)', 0)} AS page FROM pages",
    "fetch_page_query": f"WITH RECURSIVE {_VIEWED}, v AS (SELECT page_id, url, text, coalesce(v, {_view_sql('text', 1500, 0)}) AS v FROM md LEFT JOIN vw ON doc_id = page_id) SELECT page_id, {_page_sql('v', 'length(text)', 0)} AS page FROM v",
    "page_passages": f"WITH RECURSIVE {_MD}, {_PASSAGES} SELECT doc_id, pos::BIGINT AS pos, heading, text, kind FROM ps",
    "page_scores": f"WITH RECURSIVE {_MD}, {_PASSAGES}, {_scored_sql(('part', 'long'), 'part; long', True)} SELECT doc_id, pos::BIGINT AS pos, round(score, 6) AS score FROM sc",
    "cached_engines": f"WITH {web._FUSED} SELECT query_id, array_to_string(list_sort(list_distinct(flatten(list(string_split(engines, '+'))))), ' + ') AS engines FROM fu WHERE position <= 8 GROUP BY query_id",
    "web_search": f"""WITH {web._FUSED}, sx AS (SELECT {_LANG} AS query_id, count(*) AS got, count(*) FILTER (kept) AS kept FROM gate GROUP BY 1), bx AS (SELECT query_id, string_agg({_LINE('position', 'title', 'url', 'date', 'date_kind', 'engines', "''", 'snippet')}, chr(10) || chr(10) ORDER BY position) AS b FROM fu WHERE position <= 8 GROUP BY 1)
SELECT query_id, '[via ' || CASE WHEN kept > 0 THEN 'bing + ddg' ELSE '' END || CASE WHEN kept < got THEN ' · bing ' || got || '→' || kept || ' kept, ddg ' || got || '→' || kept || ' kept' ELSE '' END || ']' || chr(10) || chr(10) || b AS text FROM bx JOIN sx USING (query_id)""",
    "search_deep": f"""WITH RECURSIVE {web._FUSED}, {_MD}, {_KEYS}, {_PLAIN.replace("bl AS (", "bl AS (")}, {_scored_sql(_WORDS, 'the restoration of ther', False).replace("q(token)", "qt(token)").replace("JOIN q USING", "JOIN qt USING").replace("tk AS (", "tkd AS (").replace("FROM tk ", "FROM tkd ")}, {_picked_sql(12000)},
bp AS (SELECT doc_id, heading, text FROM pk WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1), ex AS (SELECT doc_id, CASE WHEN heading <> '' THEN heading || ': ' ELSE '' END || regexp_replace(text, '\\n+', ' ', 'g') AS e FROM bp WHERE length(text) > 80)
SELECT query_id, position::INT AS position, fu.url, CASE WHEN position <= 4 THEN CASE WHEN length(e) > 500 THEN left(e, 499) || '…' ELSE e END END AS excerpt, CASE WHEN position <= 4 AND fk.page_id % 3 = 0 THEN '2022-02-02' ELSE date END AS date, CASE WHEN position <= 4 AND fk.page_id % 3 = 0 THEN 'published' ELSE date_kind END AS date_kind
FROM fu LEFT JOIN fk USING (key) LEFT JOIN ex ON ex.doc_id = fk.page_id WHERE position <= 8""",
    "research_material": f"""WITH {web._FUSED}, {_MD}, {_KEYS}, rz AS (SELECT * REPLACE (trim(snippet) AS snippet), {_LANG} AS query_id, strftime(DATE '2024-01-01' + (page_id % 40)::INT, '%Y-%m-%d') AS day FROM rows_),
hn AS (SELECT query_id, 1 AS o, 'hn' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS pos, {sites._API['hn']}, '' AS date FROM rz WHERE page_id % 5 <> 0 AND title <> ''), gh AS (SELECT query_id, 2, 'github', row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS pos, {sites._API['github']}, '' FROM rz), wk AS (SELECT query_id, 3, 'wikipedia', row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS pos, {sites._API['wikipedia']}, '' FROM rz),
ap AS (SELECT * FROM hn WHERE pos <= 4 UNION ALL SELECT * FROM gh WHERE pos <= 4 UNION ALL SELECT * FROM wk WHERE pos <= 3),
ln AS (SELECT query_id, 0 AS o, 'web' AS kind, position AS pos, {_LINE('position', 'title', 'url', 'date', 'date_kind', 'engines', "''", 'snippet')} AS l FROM fu WHERE position <= 6 UNION ALL SELECT query_id, o, kind, pos, {_LINE('pos', 'title', 'url', 'NULL', "''", "''", "coalesce(meta, '')", 'snippet')} FROM ap),
bk2 AS (SELECT query_id, o, '## ' || kind || ' results' || chr(10) || string_agg(l, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) AS t FROM ln GROUP BY query_id, o, kind), so AS (SELECT query_id, string_agg(t, '' ORDER BY o) AS s FROM bk2 GROUP BY 1),
hs AS (SELECT query_id, position, url, title, key, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM fu WHERE position <= 6), on_ AS (SELECT * FROM hs WHERE NOT regexp_matches(host, '{AGGREGATORS}') QUALIFY row_number() OVER (PARTITION BY query_id, host ORDER BY position) = 1), pi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS pick FROM on_ QUALIFY pick <= 3),
pg AS (SELECT query_id, '## Page contents' || chr(10) || string_agg('### ' || pi.title || chr(10) || pi.url || chr(10) || chr(10) || coalesce(left(md.text, 3000), '') || chr(10) || chr(10), '' ORDER BY pick) AS p FROM pi LEFT JOIN fk USING (key) LEFT JOIN md USING (page_id) GROUP BY 1)
SELECT query_id, '# Research: ' || query_id || chr(10) || chr(10) || s || coalesce(p, '') AS material FROM so LEFT JOIN pg USING (query_id)""",
    "pdf_texts": "SELECT doc_id, 'A ' || regexp_replace(trim(regexp_replace(left(coalesce(text, ''), 200), '[^A-Za-z0-9 ]', '', 'g')), ' +', ' ', 'g') || chr(10) || 'end' AS text FROM documents",
    "page_signs": rf"""WITH t AS (SELECT page_id, html, text FROM ({web._TEXT})), s AS (SELECT page_id, page_id % 5 AS k, CASE page_id % 5 WHEN 1 THEN 'Log in to your Reddit account. ' || text WHEN 2 THEN 'Checking your browser' || chr(10) || text WHEN 3 THEN 'Just a moment...' || chr(10) || 'Markdown Content: ' || left(text, 700) WHEN 4 THEN 'Please subscribe' ELSE text END AS t, CASE WHEN page_id % 5 = 4 THEN 6015 ELSE length(html) END AS n, left(text, 700) AS c FROM t),
z AS (SELECT *, length(regexp_replace(regexp_replace(t, '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')) AS sz, length(regexp_replace(regexp_replace('Markdown Content: ' || c, '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')) AS behind FROM s)
SELECT page_id, sz < 400 AS thin, sz < 1200 AND regexp_matches(t, '(?i)subscribe|paywall|sign in to read') AS paywall, k = 1 AS hard_block, k = 2 OR (k = 3 AND behind < 600) AS soft_block, length(t) < 200 AND (k = 4 OR n > 20000) AS script_rendered FROM z""",
}
