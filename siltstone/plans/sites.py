"""Queries over answers of search engines and known sites.

The answers are made from the tables, in each site's own form; the SQL works
out what must come back from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import web
from siltstone.sources import adapters as A
from siltstone.sources import parsers as S

#: Results on one page.
PAGE = 10


def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with the result page that they stand on, query_id."""
    return web._rows(spark, sf_dir).select("page_id", "url", "title", F.trim("snippet").alias("snippet"), F.concat(F.lit("q"), F.floor(F.col("page_id") / PAGE).cast("string")).alias("query_id"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 40).cast("int")), "yyyy-MM-dd").alias("day"))


def _pages(rows: DataFrame, one: Column, before: str = "", after: str = "", sep: str = "\n") -> DataFrame:
    """(query_id, page): the rows of each result page, at most PAGE, as text."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", one.alias("t")))), lambda s: s["t"]), sep)
    return rows.groupBy("query_id").agg(F.concat(F.lit(before), listed, F.lit(after)).alias("page"), F.min("page_id").alias("least"))


def serp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth link is one inside the engine, every third row has no stamp, every seventh page is a challenge."""
    link = F.when(F.col("page_id") % 5 == 0, F.lit("/settings")).otherwise(F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1")))
    stamp = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<a class="result__timestamp" href="#">'), F.col("day"), F.lit("</a>"))).otherwise("")
    one = F.concat(F.lit('<div><a rel="nofollow" class="result__a" href="'), link, F.lit('">'), _esc(F.col("title")), F.lit('</a><a class="result__snippet" href="#"><b>'), _esc(F.col("snippet")), F.lit("</b></a>"), stamp, F.lit("</div>"))
    made = _pages(_results(spark, sf_dir), one)
    challenged = made.withColumn("page", F.when(F.floor(F.col("least") / PAGE) % 7 == 3, F.lit('<div class="anomaly-modal">')).otherwise(F.col("page")))
    return S.parse_ddg_html(challenged).select("query_id", "title", "url", "snippet", "date", "error")


def lite_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit('<tr><td><a rel="nofollow" class="result-link" href="'), F.when(F.col("page_id") % 5 == 0, F.lit("/feedback")).otherwise(F.col("url")), F.lit('">'), _esc(F.col("title")), F.lit('</a></td></tr><tr><td class="result-snippet">'), _esc(F.col("snippet")), F.lit("</td></tr>"))
    return S.parse_ddg_lite(_pages(_results(spark, sf_dir), one)).select("query_id", "title", "url", "snippet")


def _flat(c: Column, n: int) -> Column:
    """Letters, digits and spaces alone: what a link's label may hold."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N} ]", ""), " +", " "), 1, n)


def relay_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result three times: title, its address as text, snippet; even ones with a date behind."""
    url = F.concat(F.lit("https://r.example/"), F.col("page_id").cast("string"))
    label = lambda t: F.concat(F.lit("["), t, F.lit("]("), url, F.lit(")"))
    one = F.concat(label(F.concat(F.lit("T "), _flat(F.col("title"), 60))), F.lit("\n"), label(F.concat(F.lit("r.example/"), F.col("page_id").cast("string"))), F.lit("\n"), label(F.concat(F.lit("S "), _flat(F.col("snippet"), 350))), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), F.col("day"))).otherwise(""))
    return S.parse_relayed(_pages(_results(spark, sf_dir), one)).select("query_id", F.trim("title").alias("title"), "url", F.trim("snippet").alias("snippet"), "date")


def brave_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows come twice; links of the engine's own are left out."""
    own = F.when(F.col("page_id") % 5 == 0, F.lit("https://search.brave.com/help")).otherwise(F.concat(F.lit("https://b.example/"), F.col("page_id").cast("string")))
    one = F.concat(F.lit('<a href="'), own, F.lit('"><div class="site">b.example</div><div class="title x">T'), _flat(F.col("title"), 60), F.lit('</div></a>'))
    twice = F.when(F.col("page_id") % 2 == 1, F.concat(one, one)).otherwise(one)
    return S.parse_brave(_pages(_results(spark, sf_dir), twice)).select("query_id", F.trim("title").alias("title"), "url", "engine")


def rss_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth item has no title; days count to 9 February, told on 6 February."""
    day = F.date_format(F.col("day").cast("date"), "EEE, dd MMM yyyy")
    one = F.concat(F.lit("<item><title>"), F.when(F.col("page_id") % 5 == 0, "").otherwise(_esc(F.col("title"))), F.lit("</title><link>"), _esc(F.col("url")), F.lit("</link><description>"), _esc(F.col("snippet")), F.lit("</description><pubDate>"), day, F.lit(" 10:00:00 GMT</pubDate></item>"))
    made = _pages(_results(spark, sf_dir), one, "<rss><channel>", "</channel></rss>")
    return S.parse_rss(made, "bing", F.lit("2024-02-06 00:00:00").cast("timestamp")).select("query_id", "title", "url", "snippet", "date", "date_kind")


def _json_pages(rows: DataFrame, item: Column, around: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("t")))), lambda s: s["t"])
    return rows.groupBy("query_id").agg(F.concat(F.lit(around.split("*")[0]), F.to_json(listed), F.lit(around.split("*")[1])).alias("json"))


def _api_answers(rows: DataFrame) -> dict[str, DataFrame]:
    n, title, url, snippet = F.col("page_id"), F.col("title"), F.col("url"), F.col("snippet")
    some = lambda c: F.when(n % 3 != 0, c)
    struct = lambda **cols: F.struct(*[c.alias(k) for k, c in cols.items()])
    stamp = F.concat(F.col("day"), F.lit("T10:00:00Z"))
    items = {
        "stackoverflow": (struct(title=_esc(title), link=url, score=n, answer_count=n % 4, accepted_answer_id=some(n), tags=F.array(*[F.concat(F.lit(f"t{k}-"), (n % 9).cast("string")) for k in range(6)])), '{"items":*}'),
        "wikipedia": (struct(title=F.concat(F.lit("Page of "), n.cast("string")), snippet=F.concat(F.lit("an <span class=\"x\">entry</span> "), n.cast("string"))), '{"query":{"search":*}}'),
        "npm": (struct(package=struct(name=F.concat(F.lit("p"), n.cast("string")), version=F.lit("1.2.3"), description=some(title)), score=struct(detail=struct(quality=n % 100 / 100, popularity=F.lit(0.5)))), '{"objects":*}'),
        "github": (struct(full_name=F.concat(F.lit("o/r"), n.cast("string")), html_url=url, description=some(title), stargazers_count=n, language=some(F.lit("C")), pushed_at=stamp), '{"items":*}'),
        "hn": (struct(title=F.when(n % 5 != 0, title), url=some(url), objectID=n.cast("string"), points=n, num_comments=n % 7, story_text=F.concat(F.lit("<p>"), _esc(snippet), F.lit("</p>")), created_at=stamp), '{"hits":*}'),
        "brave_api": (struct(title=_esc(title), url=url, description=_esc(snippet), page_age=stamp), '{"web":{"results":*}}'),
        "tavily": (struct(title=title, url=url, content=snippet, published_date=some(F.col("day"))), '{"results":*}'),
        "jina_api": (struct(title=title, url=url, description=some(snippet), content=title, date=F.date_format(F.col("day").cast("date"), "MMM d, yyyy")), '{"data":*}'),
    }
    return {kind: _json_pages(rows, item, around) for kind, (item, around) in items.items()}


def api_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, made in _api_answers(_results(spark, sf_dir)).items():
        one = S.parse_api(kind, made).select(F.lit(kind).alias("api"), "query_id", F.col("i").cast("bigint").alias("i"), "title", "url", "snippet", "meta")
        out = one if out is None else out.unionByName(one)
    return out


# ---- answers of known sites


def _id_first(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), "text", "source")


def _repositories(rows: DataFrame) -> DataFrame:
    n = F.col("page_id")
    meta = F.to_json(F.struct(F.concat(F.lit("o/r"), n.cast("string")).alias("full_name"), F.when(n % 3 != 0, F.col("title")).alias("description"), n.alias("stargazers_count"), F.when(n % 4 != 0, F.lit("C++")).alias("language"), F.concat("day", F.lit("T00:00:00Z")).alias("updated_at"), F.when(n % 5 != 0, F.struct(F.lit("MIT").alias("spdx_id"))).alias("license"), F.when(n % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("t"), k.cast("string")))).alias("topics")))
    return rows.select(n.alias("id"), meta.alias("meta"), F.when(n % 7 != 0, F.col("snippet")).alias("readme"))


def github_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id_first(A.github_repo(_repositories(_results(spark, sf_dir))))


def github_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id_first(A.github_raw(web.pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("html").alias("body"))))


def github_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as folders of nations."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    key = F.col("n_nationkey")
    entry = F.struct(F.col("n_name").alias("name"), F.when(key % 3 == 0, "dir").otherwise("file").alias("type"), F.when(key % 4 != 0, key).alias("size"))
    listed = nation.groupBy("n_regionkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda s: s["e"])).alias("listing"))
    made = region.join(listed, region["r_regionkey"] == listed["n_regionkey"]).select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") > 0, F.col("r_name")).otherwise("").alias("path"), "listing")
    return _id_first(A.github_tree(made))


def github_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues, their lines as comments."""
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    said = F.struct(F.when(F.col("l_linenumber") % 5 != 0, F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("login"))).alias("user"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("body"))
    own = lines.where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", said.alias("c")))), lambda s: s["c"])).alias("comments"))
    key = F.col("o_orderkey")
    item = F.to_json(F.struct(F.when(key % 3 != 0, F.concat(F.lit("Order "), key.cast("string"))).alias("title"), F.when(key % 4 != 0, F.col("o_orderpriority")).alias("body")))
    made = orders.join(own, key == F.col("l_orderkey"), "left").select(key.alias("id"), F.concat(F.lit("o/r#"), key.cast("string")).alias("name"), item.alias("item"), "comments", (key % 2 == 0).alias("is_pull"))
    return _id_first(A.github_issue(made))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def _questions(turns: DataFrame) -> DataFrame:
    """Conversations as questions: turn 0 asks, the others answer; every second answer holds code."""
    body = F.concat(F.lit("<p>"), _esc(F.col("text")), F.lit("</p>"), F.when(F.col("turn") % 2 == 1, F.lit("<pre><code>a &lt; b\n</code></pre>")).otherwise("<p>use <code>x&amp;y</code></p>"))
    answer = F.struct((F.col("turn") == 1).alias("is_accepted"), body.alias("body"), F.col("conv_id").alias("question_id"))
    per = turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, body)).alias("asked"),
        F.to_json(F.struct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", answer.alias("a")))), lambda s: s["turn"] > 0), lambda s: s["a"]).alias("items"))).alias("answers"),
    )
    question = F.when(F.col("asked").isNotNull(), F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Question "), F.col("conv_id").cast("string")).alias("title"), F.col("asked").alias("body"))).alias("items"))))
    return per.select(F.col("conv_id").alias("id"), question.alias("question"), "answers")


def stackexchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id_first(A.stackexchange(_questions(_conversations(spark, sf_dir))))


def stackexchange_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first answer by its own address; every third on another site."""
    made = _questions(_conversations(spark, sf_dir)).select("id", F.when(F.col("id") % 3 == 0, "unix").otherwise("stackoverflow").alias("site"), F.col("answers").alias("answer"))
    return _id_first(A.stackexchange_answer(made))


def _trees(turns: DataFrame, node) -> DataFrame:
    """(id, answer): each conversation as nested JSON, a turn below the turn half its number; node(turn, role, text, children) makes a node."""
    import json

    import pyarrow as pa

    def run(groups: pa.Table) -> pa.Table:
        rows = sorted(zip(*(groups.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True), reverse=True)
        below: dict[int, list] = {}
        top = None
        for turn, role, text in rows:
            made = node(turn, role, text, below.pop(turn, [])[::-1])
            if turn:
                below.setdefault((turn - 1) // 2, []).append(made)
            else:
                top = made
        return pa.table({"id": groups.column("conv_id")[:1], "answer": pa.array([json.dumps(top) if top else None], pa.string())})

    return turns.groupBy("conv_id").applyInArrow(run, "id long, answer string")


def hn_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda turn, role, text, below: {"id": turn, "title": None if turn else "Thread", "points": 7, "author": role, "text": f"<p>{text}</p>" if turn else None, "children": below}
    return _id_first(A.hn_thread(_trees(_conversations(spark, sf_dir), node)))


def reddit_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree ends with a stub for more comments."""

    def node(turn, role, text, below):
        more = [{"kind": "more", "data": {"count": 3}}]
        if turn:
            return {"kind": "t1", "data": {"author": role, "ups": turn, "body": text, "replies": {"data": {"children": below + more}} if below else ""}}
        return [{"data": {"children": [{"data": {"title": "Post", "subreddit": "s", "ups": 5, "author": role, "selftext": text}}]}}, {"data": {"children": below + more}}]

    return _id_first(A.reddit_thread(_trees(_conversations(spark, sf_dir), node)))


def wikipedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages have their own beginning as summary, others one that the text doesn't have; every seventh has none."""
    n = F.col("page_id")
    extract = F.when(n % 2 == 0, F.regexp_extract("html", r"(?s)<article><h1>(.*?)</h1>", 1)).otherwise("A summary that the article lacks.")
    made = web.pages(spark, sf_dir).select(n.alias("id"), F.when(n % 7 != 0, F.to_json(F.struct(F.regexp_replace(extract, "&amp;", "&").alias("extract")))).alias("summary"), "html", "url")
    return _id_first(A.wikipedia(made))


def arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    later = F.when(n % 2 == 0, F.col("day")).otherwise(F.lit("2024-03-01"))
    atom = F.concat(F.lit("<feed><entry>\n<id>http://arxiv.org/abs/"), n.cast("string"), F.lit("</id><published>"), F.col("day"), F.lit("T00:00:00Z</published><updated>"), later, F.lit("T00:00:00Z</updated><title> "), _esc(F.col("title")), F.lit("\n</title><summary> "), F.when(n % 9 != 0, _esc(F.col("snippet"))).otherwise(""), F.lit("</summary><author>\n<name>A B</name></author><author><name>C &amp; D</name></author></entry></feed>"))
    return A.arxiv(_results(spark, sf_dir).select(n.alias("id"), atom.alias("atom"))).select(F.col("id").cast("bigint").alias("id"), "text", "source", "date")


def adapter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two routes through their readers; texts of 80 characters or less leave the page to the generic reader."""
    rows = _results(spark, sf_dir)
    raw = web.pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.substring("html", 1, 80)).otherwise(F.substring("html", 1, 81)).alias("body"))
    return A.read_routed({"github-api": _repositories(rows), "github-raw": raw}).select(F.col("id").cast("bigint").alias("id"), "text", "source")


def json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as JSON, every fifth broken off."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    body = F.to_json(F.struct(F.col("n_name").alias("name"), F.array("n_nationkey", "n_regionkey").alias("keys")))
    body = F.when(F.col("n_nationkey") % 5 == 0, F.substring(body, 1, 10)).otherwise(body)
    return nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.coalesce(A.pretty_json(body), body).alias("text"))


QUERIES = {f.__name__: f for f in (serp_parse, lite_parse, relay_parse, brave_parse, rss_parse, api_parse, github_repo, github_raw, github_tree, github_issue, stackexchange, stackexchange_answer, hn_thread, reddit_thread, wikipedia, arxiv, adapter_text, json_pretty)}

_R = f"""{web._ROWS}, rs AS (SELECT * REPLACE (trim(snippet) AS snippet), 'q' || (page_id // {PAGE}) AS query_id, strftime(DATE '2024-01-01' + (page_id % 40)::INT, '%Y-%m-%d') AS day FROM rows_)"""
_W = rf"WITH {_R}"
_FL = lambda c, n: rf"left(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}} ]', '', 'g'), ' +', ' ', 'g'), {n})"
_I = "row_number() OVER (PARTITION BY query_id ORDER BY page_id) - 1"
_WIKI = "Page of "
_API = {
    "stackoverflow": "title, url, '' AS snippet, '▲' || page_id || ' · ' || page_id % 4 || ' answers' || CASE WHEN page_id % 3 <> 0 THEN ' · ✓accepted' ELSE '' END || ' · ' || 't0-' || page_id % 9 || ', t1-' || page_id % 9 || ', t2-' || page_id % 9 || ', t3-' || page_id % 9 AS meta",
    "wikipedia": "'Page of ' || page_id AS title, 'https://en.wikipedia.org/wiki/Page_of_' || page_id AS url, 'an entry ' || page_id AS snippet, NULL AS meta",
    "npm": "'p' || page_id || ' v1.2.3' AS title, 'https://www.npmjs.com/package/p' || page_id AS url, CASE WHEN page_id % 3 <> 0 THEN title ELSE '' END AS snippet, 'quality ' || page_id % 100 || '% · popularity 50%' AS meta",
    "github": "'o/r' || page_id AS title, url, CASE WHEN page_id % 3 <> 0 THEN title ELSE '' END AS snippet, '★' || page_id || CASE WHEN page_id % 3 <> 0 THEN ' · C' ELSE '' END || ' · updated ' || day AS meta",
    "hn": "title, CASE WHEN page_id % 3 <> 0 THEN url ELSE 'https://news.ycombinator.com/item?id=' || page_id END AS url, left(snippet, 200) AS snippet, '▲' || page_id || ' · ' || page_id % 7 || ' comments · ' || day AS meta",
    "brave_api": "title, url, snippet, day AS meta",
    "tavily": "title, url, snippet, CASE WHEN page_id % 3 <> 0 THEN day END AS meta",
    "jina_api": "title, url, CASE WHEN page_id % 3 <> 0 THEN snippet ELSE title END AS snippet, day AS meta",
}
_REPO_TEXT = """'# o/r' || page_id || chr(10) || chr(10) || CASE WHEN page_id % 3 <> 0 THEN title ELSE '' END || chr(10) || chr(10) || '★ ' || page_id || ' · ' || CASE WHEN page_id % 4 <> 0 THEN 'C++' ELSE '?' END || ' · updated ' || day || chr(10)
    || CASE WHEN page_id % 5 <> 0 THEN 'License: MIT' || chr(10) ELSE '' END || CASE WHEN page_id % 2 = 0 THEN 'Tags: t1, t2, t3, t4, t5, t6, t7, t8' || chr(10) ELSE '' END || CASE WHEN page_id % 7 <> 0 THEN chr(10) || '---' || chr(10) || chr(10) || snippet ELSE '' END"""
#: A turn's body as text, by its number.
_BODY = r"regexp_replace(regexp_replace(text || CASE WHEN turn % 2 = 1 THEN chr(10) || '```' || chr(10) || 'a < b' || chr(10) || chr(10) || '```' ELSE chr(10) || 'use `x&y`' END, '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')"
_TREE = """t AS (SELECT conv_id, turn, role, text, 0 AS depth, lpad(turn::VARCHAR, 6, '0') AS path FROM conversations WHERE turn = 0
    UNION ALL SELECT c.conv_id, c.turn, c.role, c.text, depth + 1, path || '/' || lpad(c.turn::VARCHAR, 6, '0') FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn > 0 AND (c.turn - 1) // 2 = t.turn)"""
ORACLES = {
    "serp_parse": f"{_W} SELECT query_id, title, url, snippet, CASE WHEN page_id % 3 <> 0 THEN day END AS date, NULL AS error FROM rs WHERE page_id % 5 <> 0 AND (page_id // {PAGE}) % 7 <> 3 UNION ALL SELECT DISTINCT query_id, NULL, NULL, NULL, NULL, 'challenge' FROM rs WHERE (page_id // {PAGE}) % 7 = 3",
    "lite_parse": f"{_W} SELECT query_id, title, url, snippet FROM rs WHERE page_id % 5 <> 0",
    "relay_parse": f"{_W} SELECT query_id, trim('T ' || {_FL('title', 60)}) AS title, 'https://r.example/' || page_id AS url, trim(left('S ' || {_FL('snippet', 350)}, 300)) AS snippet, CASE WHEN page_id % 2 = 0 THEN day END AS date FROM rs",
    "brave_parse": f"{_W} SELECT query_id, trim('T' || {_FL('title', 60)}) AS title, 'https://b.example/' || page_id AS url, 'brave' AS engine FROM rs WHERE page_id % 5 <> 0",
    "rss_parse": f"{_W} SELECT query_id, title, url, snippet, day AS date, CASE WHEN day >= '2024-02-03' THEN 'indexed' ELSE 'published' END AS date_kind FROM rs WHERE page_id % 5 <> 0 AND title <> ''",
    "api_parse": f"{_W} " + " UNION ALL ".join(f"SELECT '{k}' AS api, query_id, {_I} AS i, {cols} FROM rs" if k != "hn" else f"SELECT 'hn' AS api, * EXCLUDE (page_id) FROM (SELECT query_id, {_I} AS i, page_id, {cols} FROM rs) WHERE page_id % 5 <> 0 AND title <> ''" for k, cols in _API.items()),
    "github_repo": f"{_W} SELECT page_id AS id, {_REPO_TEXT} AS text, 'github-api' AS source FROM rs",
    "github_raw": "SELECT page_id AS id, left(html, 200000) AS text, 'github-raw' AS source FROM pages",
    "github_tree": "SELECT r_regionkey::BIGINT AS id, '# ' || CASE WHEN r_regionkey > 0 THEN r_name ELSE 'repository root' END || chr(10) || chr(10) || string_agg(CASE WHEN n_nationkey % 3 = 0 THEN '- d ' || n_name ELSE '- f ' || n_name || CASE WHEN n_nationkey % 4 <> 0 THEN ' (' || n_nationkey || 'B)' ELSE '' END END, chr(10) ORDER BY n_nationkey) || chr(10) AS text, 'github-tree-api' AS source FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name",
    "github_issue": """SELECT o_orderkey AS id, '# ' || CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey ELSE 'o/r#' || o_orderkey END || chr(10) || chr(10) || CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '(no body)' END || chr(10) || coalesce(chr(10) || '---' || chr(10) || chr(10) || '## Comments' || chr(10) || chr(10) || said, '') AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'github-pr-api' ELSE 'github-issue-api' END AS source
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('**' || CASE WHEN l_linenumber % 5 <> 0 THEN 's' || l_suppkey ELSE '?' END || '** (' || strftime(l_shipdate, '%Y-%m-%d') || '):' || chr(10) || chr(10) || 'part ' || l_partkey, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS said FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey""",
    "stackexchange": f"""SELECT conv_id AS id, left(coalesce('# Question ' || conv_id || chr(10) || chr(10) || max(b) FILTER (turn = 0) || chr(10), '') || coalesce(chr(10) || '---' || chr(10) || chr(10) || '## Answers' || chr(10) || chr(10) || string_agg(CASE WHEN turn = 1 THEN '**Accepted answer**' || chr(10) || chr(10) ELSE '' END || b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (turn > 0 AND r <= 5), chr(10) || '(no answers yet)' || chr(10)), 100000) AS text, 'stackexchange-api' AS source
FROM (SELECT conv_id, turn, {_BODY} AS b, row_number() OVER (PARTITION BY conv_id, turn > 0 ORDER BY turn) AS r FROM conversations) GROUP BY conv_id""",
    "stackexchange_answer": f"""SELECT c.conv_id AS id, CASE WHEN b IS NOT NULL THEN CASE WHEN turn = 1 THEN '**Accepted answer**' || chr(10) || chr(10) ELSE '' END || b || chr(10) || chr(10) || '[question ' || c.conv_id || '](https://' || CASE WHEN c.conv_id % 3 = 0 THEN 'unix.stackexchange.com' ELSE 'stackoverflow.com' END || '/questions/' || c.conv_id || ')' END AS text, 'stackexchange-api' AS source
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, turn, {_BODY} AS b FROM conversations WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) a ON a.conv_id = c.conv_id""",
    "hn_thread": rf"WITH RECURSIVE {_TREE} SELECT conv_id AS id, left('# Thread' || chr(10) || chr(10) || '7 points · u/' || max(role) FILTER (turn = 0) || chr(10) || chr(10) || coalesce(string_agg(repeat('  ', depth) || '- ' || regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') || chr(10), '' ORDER BY path) FILTER (turn > 0), ''), 100000) AS text, 'hn-algolia' AS source FROM t GROUP BY conv_id",
    "reddit_thread": r"WITH RECURSIVE " + _TREE + r" SELECT conv_id AS id, left('# Post' || chr(10) || chr(10) || 'r/s · ↑5 · u/' || max(role) FILTER (turn = 0) || chr(10) || chr(10) || max(text) FILTER (turn = 0) || chr(10) || chr(10) || '## Top comments' || chr(10) || chr(10) || coalesce(string_agg(repeat('  ', depth - 1) || '- **u/' || role || '** (↑' || turn || '): ' || left(regexp_replace(text, '\n+', ' ', 'g'), 500) || chr(10), '' ORDER BY path) FILTER (turn > 0), ''), 80000) AS text, 'reddit-json' AS source FROM t GROUP BY conv_id",
    "arxiv": f"{_W} SELECT page_id AS id, CASE WHEN page_id % 9 <> 0 AND title <> '' AND snippet <> '' THEN left('# ' || title || chr(10) || chr(10) || 'A B, C & D' || chr(10) || chr(10) || 'Published ' || day || CASE WHEN page_id % 2 = 1 AND day <> '2024-03-01' THEN ' · updated 2024-03-01' ELSE '' END || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || snippet || chr(10) || chr(10) || '[PDF](https://arxiv.org/pdf/' || page_id || ')' || chr(10), 60000) END AS text, 'arxiv-api' AS source, day AS date FROM rs",
    "adapter_text": f"{_W}, b AS (SELECT page_id AS id, {_REPO_TEXT} AS text, 'github-api' AS source FROM rs UNION ALL SELECT page_id, left(html, CASE WHEN page_id % 2 = 0 THEN 80 ELSE 81 END), 'github-raw' FROM pages) SELECT id, CASE WHEN length(text) > 80 THEN text END AS text, source FROM b",
    "json_pretty": """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 5 = 0 THEN left('{"name":"' || n_name || '"', 10) ELSE '{' || chr(10) || '  "name": "' || n_name || '",' || chr(10) || '  "keys": [' || chr(10) || '    ' || n_nationkey || ',' || chr(10) || '    ' || n_regionkey || chr(10) || '  ]' || chr(10) || '}' END AS text FROM nation""",
}
