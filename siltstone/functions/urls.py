"""URL functions on columns: canonical keys, safety reasons, routing, relay policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import let

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\s*$"

#: First path parts of a code host that are no accounts. Fixed values.
RESERVED_OWNERS = (
    "features", "topics", "marketplace", "orgs", "sponsors", "login", "settings",
    "explore", "trending", "collections", "events", "about", "pricing", "apps",
    "enterprise", "customer-stories", "security", "readme", "site", "team",
)

#: Private IPv4 networks. Fixed values.
PRIVATE_V4 = (("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("100.64.0.0", 10), ("0.0.0.0", 8))

# Names, parameters and paths that are blocked or left out. Fixed values.
BLOCKED_NAME = r"(?i)^(localhost|localhost\.localdomain)$|\.(local|internal|localhost|home\.arpa)$"
TRACKING = r"(?i)^(utm_\w+|fbclid|gclid|ref|ref_src|si)$"
SECRET_PARAM = r"(?i)^(token|key|api[_-]?key|auth|authorization|sig|signature|secret|password|access[_-]?token|code|session|jwt)$"
NON_HTML_PATH = r"(?i)\.(json|xml|txt|csv|pdf|md|yaml|yml|rss|atom)(\?|$)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def parts(url: Column) -> dict[str, Column]:
    get = lambda i: F.regexp_extract(url, _URL, i)
    authority = get(2)
    return {
        "ok": url.rlike(_URL) & (authority != ""),
        "scheme": F.lower(get(1)),
        "user": F.regexp_extract(authority, "^(.*)@", 1),
        "host": F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", "")),
        "path": get(3),
        "query": F.regexp_replace(get(4), r"^\?", ""),
        "hash": get(5),
    }


def with_parts(url: Column, then) -> Column:
    """then(parts), with the URL taken apart once."""
    return let(F.struct(*[c.alias(k) for k, c in parts(url).items()]), then)


def _decoded(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), s)


def params(query: Column) -> Column:
    """array<struct<k, v>> of a query string, decoded, in order."""
    pair = lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)


def normalize_url(url: Column) -> Column:
    """The key under which equal pages of different engines meet."""
    return with_parts(url, lambda u: _key(url, u))


def _key(url: Column, u: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(u["host"], r"^(www|m|amp|mobile)\.", ""), r"^([a-z]{2,3})\.m\.", "$1.")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(u["path"], "/+$", ""), "^/amp(?=/)", ""), "/amp$", "")
    path = F.when(u["hash"].startswith("#!/"), F.substring(u["hash"], 3, 1 << 30)).otherwise(path)
    path = F.regexp_replace(path, r"(?i)/index\.(html?|php)$", "")
    asked = lambda host: host.rlike(r"(^|\.)(stackoverflow|superuser|serverfault)\.com$|\.stackexchange\.com$")
    place = lambda host: lambda path: F.when(asked(host), F.regexp_replace(path, r"^(/questions/\d+)/.*", "$1")).otherwise(path)
    kept = F.filter(params(u["query"]), lambda p: ~p["k"].rlike(TRACKING))
    indexed = lambda kept: F.transform(kept, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    shown = lambda kept: F.array_join(F.transform(F.array_sort(indexed(kept)), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    query = let(kept, lambda kept: F.when(F.size(kept) > 0, F.concat(F.lit("?"), shown(kept))).otherwise(""))
    where = let(host, lambda host: F.concat(host, let(let(path, place(host)), lambda path: F.when(path == "", "/").otherwise(path))))
    return F.when(u["ok"], F.concat(where, query)).otherwise(F.lower(F.trim(url)))


def ipv4_number(address: Column) -> Column:
    o = F.split(address, r"\.")
    return F.when(address.rlike(V4), o[0].cast("bigint") * 16777216 + o[1].cast("bigint") * 65536 + o[2].cast("bigint") * 256 + o[3].cast("bigint"))


def _v4(net: str) -> int:
    a, b, c, d = map(int, net.split("."))
    return a << 24 | b << 16 | c << 8 | d


def is_private_address(address: Column) -> Column:
    """Private IPv4 and IPv6 addresses, and everything that is no address. IPv4 in IPv6 goes by the IPv4 rules."""
    return let(F.lower(address), lambda low: let(ipv4_number(F.coalesce(F.nullif(F.regexp_extract(low, r"^::ffff:([0-9.]+)$", 1), F.lit("")), low)), lambda n: _is_private(low, n)))


def _is_private(low: Column, n: Column) -> Column:
    inside = F.lit(False)
    for net, bits in PRIVATE_V4:
        inside = inside | n.between(_v4(net), _v4(net) | (1 << (32 - bits)) - 1)
    v6 = low.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$")
    v6_private = low.isin("::", "::1") | low.rlike(r"^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:|^64:ff9b::")
    return F.when(n.isNotNull(), inside).when(v6, v6_private).otherwise(F.lit(True))


def safety_reason(url: Column) -> Column:
    """Why a URL must not be fetched; null if it may."""
    return with_parts(url, lambda u: _reason(url, u))


def _reason(url: Column, u: Column) -> Column:
    host = F.regexp_replace(u["host"], r"\.$", "")
    literal = F.regexp_replace(host, r"^\[|\]$", "")
    is_ip = literal.rlike(V4) | host.startswith("[")
    return (
        F.when(url.isNull() | ~(u["ok"] | url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")), "invalid url")
        .when(~F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), "blocked protocol")
        .when(~u["ok"], "invalid url").when(u["user"] != "", "credentials").when(host.rlike(BLOCKED_NAME), "blocked host")
        .when(is_ip & is_private_address(literal), "blocked host")
    )


def adapter_route(url: Column) -> Column:
    """Name of the site adapter for a URL; null for the generic path."""
    return with_parts(url, lambda u: _route(u)["name"])


def adapter_upstream(url: Column) -> Column:
    """The addresses that the site adapter for a URL reads; null for the generic path."""
    return with_parts(url, lambda u: _route(u)["upstream"])


def _encoded(s: Column) -> Column:
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def _route(u: Column) -> Column:
    """struct<name, upstream>."""
    seg = F.filter(F.split(u["path"], "/"), lambda s: s != "")
    at = lambda i: F.try_element_at(seg, F.lit(i))
    n = F.size(seg)
    up = F.exists(F.slice(seg, F.lit(4), F.greatest(F.size(seg), F.lit(1))), lambda s: (F.try_url_decode(s).isNull()) | (F.try_url_decode(s) == ".."))
    code = u["host"].rlike(r"^(www\.)?github\.com$") & (n >= 2) & ~at(1).isin(*RESERVED_OWNERS)
    number = F.coalesce(at(4).try_cast("double"), F.lit(0.0)) != 0
    asked = u["host"].rlike(r"^(stackoverflow|superuser|serverfault)\.com$|^[a-z0-9-]+\.stackexchange\.com$") & u["path"].rlike(r"/(questions|q|a)/\d+")
    item = F.exists(params(u["query"]), lambda p: (p["k"] == "id") & p["v"].rlike(r"^\d+$"))
    wiki = u["host"].rlike(r"^[a-z-]+\.(m\.)?wikipedia\.org$") & ~u["host"].rlike(r"^www\.") & u["path"].rlike("^/wiki/[^/:#]+$")
    rest = lambda k: F.array_join(F.slice(seg, F.lit(k), F.greatest(n, F.lit(1))), "/")
    repo = F.concat(at(1), F.lit("/"), at(2))
    api, raw = F.concat(F.lit("https://api.github.com/repos/"), repo), F.concat(F.lit("https://raw.githubusercontent.com/"), repo)
    item_no = at(4).try_cast("double").cast("bigint").cast("string")
    talk = F.concat(api, F.lit("/issues/"), item_no, F.lit("/comments?per_page=30"))
    site = F.when(u["host"].endswith(".stackexchange.com"), F.regexp_extract(u["host"], r"^([a-z0-9-]+)\.stackexchange", 1)).otherwise(F.regexp_extract(u["host"], r"^([a-z]+)\.com$", 1))
    question, answer = F.regexp_extract(u["path"], r"/(?:questions|q)/(\d+)", 1), F.regexp_extract(u["path"], r"/a/(\d+)", 1)
    se = F.lit("https://api.stackexchange.com/2.3/")
    of_question = F.array(F.concat(se, F.lit("questions/"), question, F.lit("/answers?order=desc&sort=votes&site="), site, F.lit("&filter=withbody&pagesize=5")), F.concat(se, F.lit("questions/"), question, F.lit("?site="), site, F.lit("&filter=!9Z(-wwYGT")))
    of_answer = F.array(F.concat(se, F.lit("answers/"), answer, F.lit("?order=desc&sort=votes&site="), site, F.lit("&filter=withbody")))
    id_ = F.get(F.filter(params(u["query"]), lambda p: p["k"] == "id"), F.lit(0))["v"]
    lang, title = F.regexp_extract(u["host"], r"^([a-z-]+)\.", 1), _encoded(_decoded(F.regexp_extract(u["path"], "^/wiki/([^/:#]+)$", 1)))
    rest_api = F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/api/rest_v1/page/"))
    to = lambda name, *upstream: F.struct(F.lit(name).alias("name"), F.array(*upstream).alias("upstream"))
    return F.when(
        u["scheme"].isin("http", "https"),
        F.when(code & at(3).isin("blob", "raw") & (n >= 5) & ~up, to("github-raw", F.concat(raw, F.lit("/"), rest(4))))
        .when(code & (at(3) == "tree") & (n >= 5) & ~up, to("github-tree-api", F.concat(api, F.lit("/contents/"), rest(5), F.lit("?ref="), _encoded(at(4)))))
        .when(code & (at(3) == "pull") & number, to("github-pr-api", F.concat(api, F.lit("/pulls/"), item_no), talk))
        .when(code & (at(3) == "issues") & number, to("github-issue-api", F.concat(api, F.lit("/issues/"), item_no), talk))
        .when(code & (n == 2), to("github-api", api, F.concat(raw, F.lit("/HEAD/README.md"))))
        .when(asked, F.struct(F.lit("stackexchange-api").alias("name"), F.when(question != "", of_question).otherwise(of_answer).alias("upstream")))
        .when(u["host"].rlike(r"^(www\.|old\.|new\.|np\.)?reddit\.com$") & u["path"].contains("/comments/"), to("reddit-json", F.concat(u["scheme"], F.lit("://"), u["host"], F.regexp_replace(u["path"], "/$", ""), F.lit(".json?limit=30"))))
        .when((u["host"] == "news.ycombinator.com") & item, to("hn-algolia", F.concat(F.lit("https://hn.algolia.com/api/v1/items/"), id_)))
        .when(wiki, to("wikipedia-rest", F.concat(rest_api, F.lit("summary/"), title), F.concat(rest_api, F.lit("html/"), title)))
        .when(u["host"].rlike(r"^(www\.)?arxiv\.org$") & u["path"].rlike("^/abs/[^?#]+$"), to("arxiv-api", F.concat(F.lit("https://export.arxiv.org/api/query?id_list="), F.substring(u["path"], 6, 1 << 20), F.lit("&max_results=1")))),
    )


def relay_block_reason(url: Column, content_type: Column, enabled: bool = True, raw: bool = False, headers: bool = False) -> Column:
    """Why a page must not go through the text relay; null if it may."""
    u = parts(url)
    secret = F.filter(params(u["query"]), lambda p: p["k"].rlike(SECRET_PARAM))
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    if not enabled or raw or headers:
        return F.lit("disabled" if not enabled else "raw" if raw else "custom headers")
    return (
        F.when(F.size(secret) > 0, F.concat(F.lit("secret-looking param '"), F.try_element_at(secret, F.lit(1))["k"], F.lit("'")))
        .when(content_type.isNotNull() & (kind != "") & ~kind.contains("html"), F.concat(F.lit("content-type "), kind))
        .when(content_type.isNull() & F.concat(u["path"], F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise("")).rlike(NON_HTML_PATH), "non-HTML path")
    )


def unwrap_redirect(href: Column) -> Column:
    """The target of a result link; null for links inside the engine."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return F.when(target != "", F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.rlike("^https?://"), href)
