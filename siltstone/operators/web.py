"""Searching and reading as tables: outcomes of requests, fallbacks, redirects, snapshots, views, deep search.

Nothing here goes to the network. Requests, answers, addresses and snapshots
are tables, and what a live client would do next is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import error_class, http_message, retry_after_ms
from siltstone.functions.urls import is_private_address, parts, safety_reason
from siltstone.operators import passages as P

#: Bytes of a body that are read, and redirects that are followed. Fixed values.
MOST_BYTES, MOST_REDIRECTS = 3 * 1024 * 1024, 5
SKIPPED_TYPES = r"^(image|video|audio|font)/|^application/(zip|gzip|x-tar|octet-stream|wasm|sqlite|x-7z-compressed|x-rar)"
#: A race of search legs ends this long after the first one with so many rows.
ENOUGH_ROWS, GRACE_MS = 5, 300
#: Least time left that a retry needs after its wait, in ms.
RETRY_RESERVE = 500


def response_outcome(status: Column, content_type: Column, host: Column, retry_after: Column, now_ms: Column) -> dict[str, Column]:
    """ok: a page to read, challenge pages (202 with HTML) among them; else the message, retry class and wait of the answer."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    ok = status.between(200, 299) & ((status != 202) | kind.contains("html"))
    failed = lambda c: F.when(~ok, c)
    limited = F.least(F.coalesce(retry_after_ms(retry_after, now_ms), F.lit(60_000)), F.lit(300_000))
    return {"ok": ok, "message": failed(http_message(host, status)), "retry_class": failed(error_class(status, F.lit(None).cast("string"))), "wait_ms": F.when(status == 429, limited.cast("bigint"))}


def search_fallback(attempts: DataFrame) -> DataFrame:
    """attempts(query_id, leg, status, n_rows), legs html, lite, post and relay, to (query_id, leg, n_rows, error): the first leg in order that gives rows.

    A challenge (202, 403) of the first leg leaves the relay alone; post is tried
    only where html answered without rows.
    """
    of = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    wide = attempts.groupBy("query_id").agg(*[of(leg, c).alias(f"{leg}_{c}") for leg in ("html", "lite", "post", "relay") for c in ("status", "n_rows")])
    has = lambda leg: (F.col(f"{leg}_status") == 200) & (F.col(f"{leg}_n_rows") > 0)
    challenged = F.col("html_status").isin(202, 403)
    empty = (F.col("html_status") == 200) & (F.col("html_n_rows") == 0)
    leg = F.when(has("html"), "html").when(~challenged & has("lite"), "lite").when(empty & has("post"), "post").when(has("relay"), "relay")
    rows = F.coalesce(*[F.when(F.col("leg") == x, F.col(f"{x}_n_rows")) for x in ("html", "lite", "post", "relay")])
    return wide.withColumn("leg", leg).select("query_id", "leg", rows.alias("n_rows"), F.when(F.col("leg").isNull(), F.when(F.coalesce(challenged, F.lit(False)), "challenge").otherwise("no results")).alias("error"))


def search_race(legs: DataFrame) -> DataFrame:
    """legs(query_id, leg, latency_ms, kept, challenged, cooling) to (query_id, engines) in order of arrival.

    The first two legs run together: once the first to answer keeps ENOUGH_ROWS
    the other has GRACE_MS; else both are waited for. Only if none keeps a row,
    the third is asked unless it cools down or the first was challenged, and
    only if that keeps none either, the relay.
    """
    of = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    first = F.min(F.when(F.col("leg").isin("ddg", "bing"), F.struct("latency_ms", "leg", "kept")))
    wide = legs.groupBy("query_id").agg(
        first.alias("first"), F.coalesce(F.max(F.when(F.col("leg") == "ddg", F.col("challenged"))), F.lit(False)).alias("challenged"), F.coalesce(F.max(F.when(F.col("leg") == "brave", F.col("cooling"))), F.lit(False)).alias("cooling"),
        *[F.coalesce(of(x, "kept"), F.lit(0)).alias(x) for x in ("ddg", "bing", "brave", "ddg-jina")], *[of(x, "latency_ms").alias(f"{x}_ms") for x in ("ddg", "bing")],
    )
    cut = F.when(F.col("first.kept") >= ENOUGH_ROWS, F.col("first.latency_ms") + GRACE_MS).otherwise(F.lit(1 << 40))
    arrived = F.array_sort(F.array_compact(F.array(*[F.when((F.col(x) > 0) & (F.col(f"{x}_ms") <= cut), F.struct(F.col(f"{x}_ms").alias("at"), F.lit(x).alias("leg"))) for x in ("ddg", "bing")])))
    asked = (F.size("a") == 0) & ~F.col("challenged") & ~F.col("cooling")
    later = F.when(asked & (F.col("brave") > 0), "brave").when((F.size("a") == 0) & (F.col("ddg-jina") > 0), "ddg-jina").otherwise("")
    return wide.withColumn("a", arrived).select("query_id", F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda x: x["leg"]), "+")).otherwise(later).alias("engines"))


def follow_redirects(requests: DataFrame, redirects: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """requests(id, url) and redirects(url, location) to (id, final_url, hops, error, headers_kept).

    Each hop is checked like a first request; own headers go no further than the
    first host. At most MOST_REDIRECTS hops, each a join.
    """
    checked = lambda u: safety_reason(u)
    host = lambda u: parts(u)["host"]
    now = requests.select("id", F.col("url").alias("at"), F.lit(0).alias("hops"), checked(F.col("url")).alias("error"), F.lit(True).alias("headers_kept"), F.lit(False).alias("done"))
    to = redirects.select(F.col("url").alias("_from"), F.col("location").alias("_to"))
    for hop in range(MOST_REDIRECTS + 1):
        met = now.join(to, (F.col("at") == F.col("_from")) & F.col("error").isNull() & ~F.col("done"), "left")
        moves = F.col("_to").isNotNull()
        if hop == MOST_REDIRECTS:
            now = met.withColumn("error", F.when(moves, "too many redirects").otherwise(F.col("error")))
            break
        why = checked(F.col("_to"))
        now = met.select(
            "id", F.when(moves & why.isNull(), F.col("_to")).otherwise(F.col("at")).alias("at"), (F.col("hops") + F.when(moves & why.isNull(), 1).otherwise(0)).alias("hops"), F.when(moves, why).otherwise(F.col("error")).alias("error"),
            (F.col("headers_kept") & (~(moves & why.isNull()) | (host(F.col("_to")) == host(F.col("at"))))).alias("headers_kept"), (~moves).alias("done"),
        )
    return now.select("id", F.col("at").alias("final_url"), "hops", "error", "headers_kept")


def capped_body(content_type: Column, length: Column, said_length: Column, most: int = MOST_BYTES) -> dict[str, Column]:
    """What is read of a body: nothing of binary types, an error where the answer says it is too large, else up to `most` bytes."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    binary, large = kind.rlike(SKIPPED_TYPES), F.coalesce(said_length > most, F.lit(False))
    error = F.when(~binary & large, F.concat(F.lit("Response too large: "), F.format_string("%.1f", F.round(said_length / 1e6, 1)), F.lit("MB")))
    return {"n_read": F.when(binary | large, F.lit(0)).otherwise(F.least(length, F.lit(most))).cast("bigint"), "capped": ~binary & ~large & (length > most), "error": error}


def relay_outcome(text: Column) -> Column:
    """What a relayed text is: ok, origin and its status, empty, or blocked. A soft sign of a block counts where little follows it."""
    from siltstone.functions.html import page_flags

    flags = page_flags(F.lit(""), text, F.lit("text/html"), F.lit(200))
    origin = F.regexp_extract(text, r"(?m)^Warning: Target URL returned error (\d{3})", 1)
    return F.when(origin != "", F.concat(F.lit("origin "), origin)).when(F.length(F.trim(text)) < 40, "empty").when(flags["hard_block"] | flags["soft_block"], "blocked").otherwise("ok")


def closest_snapshot(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """wanted(key, at) and snapshots(key, taken, id) to the snapshot of the key nearest in time, as (key, at, taken, id); of two equally near the earlier, then the smaller id. Keys without any are left out."""
    near = F.struct(F.abs(F.unix_micros("taken") - F.unix_micros("at")).alias("gap"), "taken", "id")
    return wanted.join(snapshots, "key").groupBy("key", "at").agg(F.min(near).alias("s")).select("key", "at", "s.taken", "s.id")


def resolve_safe(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """urls(url) and dns(host, address) to (url, reason): null where every address of the host is public."""
    u = parts(F.col("url"))
    host = F.regexp_replace(u["host"], r"\.$", "")
    literal = host.rlike(r"^\[|^[0-9.]+$")
    bad = dns.groupBy(F.lower("host").alias("_host")).agg(F.min(F.when(is_private_address(F.col("address")), F.col("address"))).alias("_bad"))
    met = urls.withColumn("_own", safety_reason(F.col("url"))).withColumn("_h", host).join(bad, F.col("_h") == F.col("_host"), "left")
    reason = F.when(F.col("_own").isNotNull(), F.col("_own")).when(literal, None).when(F.col("_host").isNull(), "dns lookup failed").when(F.col("_bad").isNotNull(), F.concat(F.lit("resolves to "), F.col("_bad")))
    return met.select("url", reason.alias("reason"))


def retry_schedule(failures: DataFrame, attempts: int = 3) -> DataFrame:
    """failures(id, deadline_ms, took_ms) to (id, attempt, start_ms): each attempt takes took_ms; waits of 300, 900, … ms lie between, as long as the deadline leaves RETRY_RESERVE after them."""
    wait = lambda k: F.lit(300) * (F.pow(F.lit(3), k) - 1) / 2  # noqa: E731  sum of the first k waits
    each = failures.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    start = F.col("attempt") * F.col("took_ms") + wait(F.col("attempt"))
    # before its wait an attempt needs the wait and the reserve
    last_wait = F.lit(300) * F.pow(F.lit(3), F.col("attempt") - 1)
    enough = (F.col("attempt") == 0) | (F.col("deadline_ms") - (start - last_wait) >= last_wait + RETRY_RESERVE)
    return each.where(enough).select("id", "attempt", start.cast("bigint").alias("start_ms"))


def fetch_ladder(legs: DataFrame) -> DataFrame:
    """legs(id, adapter_text, cooling, status, content_type, text, archive_text, relay_text, raw) to (id, source, text, error): the first source that gives a page.

    A site's own answer comes first. A host that cools down leaves the archive
    and the relay. An answer stands, unless it is a thin page of which the relay
    has more. Refused, limited and unavailable answers (401, 403, 429, 503) go
    to the archive; refused ones, and those that fail for now, to the relay. The
    relay's text counts only where it is a page (relay_outcome).
    """
    size = lambda c: F.length(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{00A0}]+", " "), "^ | $", ""))
    status, html = F.col("status"), F.coalesce(F.col("content_type"), F.lit("")).contains("html")
    relay = F.when(relay_outcome(F.coalesce("relay_text", F.lit(""))) == "ok", F.col("relay_text"))
    kind = error_class(status, F.lit(None).cast("string"))
    ok = status.between(200, 299)
    thin = ok & html & (size(F.col("text")) < 400) & ~F.col("raw")
    archived = kind.isin("auth", "ratelimit") | (status == 503)
    with_relay = legs.withColumn("_relay", relay)
    source = (
        F.when(F.col("adapter_text").isNotNull() & ~F.col("raw"), "adapter").when(F.col("cooling") & F.col("archive_text").isNotNull(), "wayback").when(F.col("cooling") & F.col("_relay").isNotNull(), "relay").when(F.col("cooling"), None)
        .when(thin & (size(F.col("_relay")) > size(F.col("text"))), "relay").when(ok, "direct").when(archived & F.col("archive_text").isNotNull(), "wayback").when(kind.isin("auth", "transient") & F.col("_relay").isNotNull(), "relay")
    )
    out = with_relay.withColumn("source", source)
    text = F.when(F.col("source") == "adapter", F.col("adapter_text")).when(F.col("source") == "wayback", F.col("archive_text")).when(F.col("source") == "relay", F.col("_relay")).when(F.col("source") == "direct", F.col("text"))
    return out.select("id", "source", text.alias("text"), F.when(F.col("source").isNull(), F.when(F.col("cooling"), "HTTP 429").otherwise(F.concat(F.lit("HTTP "), status.cast("string")))).alias("error"))


def search_request(query: Column, max_results: Column, recency: Column, lang: Column, engine: Column, deep: Column) -> dict[str, Column]:
    """A search's parameters within their bounds, and the key under which its result is kept.

    max_results: 1 to 20, 8 if unsaid; deep: "true" is 4, a number 1 to 8, else 0.
    """
    number = deep.try_cast("double")
    n_deep = F.when(deep == "true", 4).when(number.isNotNull(), F.least(F.greatest(F.round(number), F.lit(1)), F.lit(8))).otherwise(0).cast("bigint")
    tongue = F.when(F.trim(lang).rlike("^[a-z]{2}(-[A-Za-z]{2,4})?$"), F.trim(lang))
    since = F.when(recency.isin("d", "w", "m", "y"), recency)
    n = F.least(F.greatest(F.floor(F.coalesce(max_results, F.lit(8))), F.lit(1)), F.lit(20)).cast("bigint")
    by = F.coalesce(engine, F.lit("auto"))
    key = F.concat(F.lit("s:"), by, F.lit(":"), F.coalesce(since, F.lit("")), F.lit(":"), F.coalesce(tongue, F.lit("")), F.lit(":"), n.cast("string"), F.lit(":"), query, F.lit(":deep"), n_deep.cast("string"))
    return {"n": n, "recency": since, "lang": tongue, "deep": n_deep, "key": key}


def load_cache(lines: DataFrame, now: int, ttl: int) -> DataFrame:
    """(line) JSON entries to (key, at, value) of those that can be read and aren't older than ttl."""
    entry = F.from_json("line", "struct<key:string,at:bigint,value:string>")
    return lines.select(entry.alias("e")).select("e.*").where(F.col("key").isNotNull() & F.col("at").isNotNull() & (F.lit(now) - F.col("at") <= ttl))


def flush_cache(entries: DataFrame, folder: str) -> None:
    """Write (key, at, value) as JSON lines in place of what folder holds."""
    entries.select(F.to_json(F.struct("key", "at", "value"))).write.mode("overwrite").text(folder)


def page_header(url: Column, status: Column, source: Column, date: Column, offset: Column, shown: Column, total: Column, notes: Column, cached: Column) -> Column:
    """Two lines over a page's view."""
    tags = F.concat_ws(
        " · ", F.concat(F.lit("HTTP "), status.cast("string")), F.when(source != "direct", F.concat(F.lit("via "), source)), date,
        F.concat(offset.cast("string"), F.lit("–"), (offset + shown).cast("string"), F.lit(" of "), total.cast("string")), F.nullif(F.array_join(notes, " · "), F.lit("")), F.when(cached, "cached"),
    )
    return F.concat(F.lit("["), url, F.lit("]\n["), tags, F.lit("]\n\n"))


def read_pages(extracted: DataFrame, query: str | None = None, max_chars: int = 8000, offset: int = 0, raw: bool = False) -> DataFrame:
    """extracted(page_id, url, text, raw, status, source, date, notes, cached) to (page_id, page): one view of each page under its header.

    All views come from one extraction: the raw body, the passages that answer a
    query, or the text from an offset on.
    """
    most = min(max(int(max_chars), 1), 50_000)
    if raw:
        own = F.coalesce(F.col("raw"), F.lit(""))
        beyond = F.concat(F.lit(f"[offset {offset} is past the end ("), F.length(own).cast("string"), F.lit(" chars)]"))
        viewed = extracted.withColumn("_view", F.when(F.length(own) <= offset, beyond).otherwise(F.substring(own, offset + 1, most))).withColumn("_total", F.length(own))
    else:
        head = P.head_view(F.col("text"), most, offset)
        viewed = extracted.withColumn("_view", head).withColumn("_total", F.length(F.coalesce("text", F.lit(""))))
    if query and query.strip() and not raw:
        split = P.split_markdown(extracted.select(F.col("page_id").alias("doc_id"), "text"))
        scored = P.score_passages(split, query).withColumn("total", F.count("*").over(W.partitionBy("doc_id")))
        views = P.passage_view(P.budget_passages(scored, most)).select(F.col("doc_id").alias("_id"), F.col("view").alias("_asked"))
        viewed = viewed.join(views, F.col("page_id") == F.col("_id"), "left").withColumn("_view", F.coalesce("_asked", "_view"))
    header = page_header(F.col("url"), F.col("status"), F.col("source"), F.col("date"), F.lit(offset), F.length("_view"), F.col("_total"), F.col("notes"), F.col("cached"))
    return viewed.select("page_id", F.concat(header, F.col("_view")).alias("page"))


def deep_excerpts(results: DataFrame, pages: DataFrame, query: str, n: int, max_chars: int = 12_000) -> DataFrame:
    """results(query_id, position, key, …, date, date_kind) with excerpt: of the first n of each query, the page's passage that answers best.

    pages: (key, page_id, text, date), the pages' text; a result without a page stays without
    excerpt. A page's own date replaces the result's, and its kind with it.
    """
    read = results.where(F.col("position") <= n).select("key").distinct().join(pages, "key")
    scored = P.score_passages(P.split_markdown(read.select(F.col("page_id").alias("doc_id"), "text")), query)
    picked = P.budget_passages(scored, max_chars).where("score > 0")
    best = P.best_excerpts(picked).join(read.select(F.col("page_id").alias("doc_id"), F.col("key").alias("_key")), "doc_id").select("_key", "excerpt")
    own = pages.select(F.col("key").alias("_page"), F.col("date").alias("_date"))
    met = results.join(best, results["key"] == best["_key"], "left").join(own, results["key"] == own["_page"], "left")
    near = F.col("position") <= n
    dated = near & F.col("_date").isNotNull()
    return met.withColumn("excerpt", F.when(near, F.col("excerpt"))).withColumn("date_kind", F.when(dated, "published").otherwise(F.col("date_kind"))).withColumn("date", F.when(dated, F.col("_date")).otherwise(F.col("date"))).drop("_key", "_page", "_date")


def search_text(fused: DataFrame, stats: DataFrame) -> DataFrame:
    """fused(query_id, position, …, engines) and stats(query_id, bucket, got, kept) to (query_id, text): the engines, what the gate took out, and the results."""
    from siltstone.sources.parsers import format_results

    gated = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept") < F.col("got"), F.struct("bucket", "got", "kept")))), lambda s: F.concat(s["bucket"], F.lit(" "), s["got"].cast("string"), F.lit("→"), s["kept"].cast("string"), F.lit(" kept"))), ", ")
    engines = F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept") > 0, F.col("bucket")))), " + ")
    head = stats.groupBy("query_id").agg(engines.alias("_e"), gated.alias("_g"))
    block = format_results(fused)
    return block.join(head, "query_id").select("query_id", F.concat(F.lit("[via "), F.col("_e"), F.when(F.col("_g") != "", F.concat(F.lit(" · "), F.col("_g"))).otherwise(""), F.lit("]\n\n"), F.col("block")).alias("text"))


def cached_engines(rows: DataFrame) -> DataFrame:
    """(query_id, engines) of kept results: all their engines, each once."""
    return rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("engines", r"\+"))))), " + ").alias("engines"))


def research(sources: DataFrame, pages: DataFrame, topic: Column) -> DataFrame:
    """sources(query_id, kind, kind_ord, position, …) and pages(query_id, pick, title, url, text) to (query_id, material): results by kind, then the pages, for a reader to sum up."""
    from siltstone.sources.parsers import format_results

    blocks = format_results(sources.withColumn("_by", F.struct("query_id", "kind_ord", "kind")), by="_by").select("_by.*", "block")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind_ord", F.concat(F.lit("## "), "kind", F.lit(" results\n"), "block", F.lit("\n\n")).alias("t")))), lambda s: s["t"]), "")
    first = blocks.groupBy("query_id").agg(shown.alias("_sources"))
    page = F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.lit("\n"), "url", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    read = pages.groupBy("query_id").agg(F.concat(F.lit("## Page contents\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", page.alias("t")))), lambda s: s["t"]), "")).alias("_pages"))
    return first.join(read, "query_id", "left").select("query_id", F.concat(F.lit("# Research: "), topic, F.lit("\n\n"), F.col("_sources"), F.coalesce("_pages", F.lit(""))).alias("material"))


