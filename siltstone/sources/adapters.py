"""Readers of known sites' answers: JSON, HTML bodies and Atom to markdown.

Each takes a table of raw answers and gives (id, text, source). A text of 80
characters or less, or an answer that can't be read, is null: the page is then
read like any other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.markdown import page_markdown
from siltstone.functions.text import decode_entities

#: Characters kept of each source's text. Fixed values.
MOST = {"github-api": 120_000, "github-raw": 200_000, "github-issue-api": 100_000, "github-pr-api": 100_000, "stackexchange-api": 100_000, "hn-algolia": 100_000, "reddit-json": 80_000, "wikipedia-rest": 200_000, "arxiv-api": 60_000}
#: Characters of a comment in a thread of the link site, and answers and comments that are shown.
COMMENT, ANSWERS, COMMENTS = 500, 5, 30


def _cut(text: Column, source: str) -> Column:
    return F.substring(text, 1, MOST[source]) if source in MOST else text


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _told(condition: Column, *parts: Column) -> Column:
    return F.when(condition, F.concat(*parts)).otherwise("")


_REPO = "struct<full_name:string,description:string,stargazers_count:bigint,language:string,updated_at:string,license:struct<spdx_id:string>,topics:array<string>>"


def github_repo(answers: DataFrame) -> DataFrame:
    """(id, meta, readme): readme null where the repository has none."""
    m = F.col("m")
    md = F.concat(
        F.lit("# "), _text(m["full_name"]), F.lit("\n\n"), _text(m["description"]), F.lit("\n\n★ "), m["stargazers_count"].cast("string"), F.lit(" · "), F.coalesce(m["language"], F.lit("?")), F.lit(" · updated "), F.substring(_text(m["updated_at"]), 1, 10), F.lit("\n"),
        _told(m["license"]["spdx_id"].isNotNull() & (m["license"]["spdx_id"] != ""), F.lit("License: "), m["license"]["spdx_id"], F.lit("\n")),
        _told(F.coalesce(F.size(m["topics"]), F.lit(0)) > 0, F.lit("Tags: "), F.array_join(F.slice(m["topics"], 1, 8), ", "), F.lit("\n")),
        _told(F.col("readme").isNotNull(), F.lit("\n---\n\n"), F.col("readme")),
    )
    return answers.select("id", F.from_json("meta", _REPO).alias("m"), "readme").select("id", _cut(md, "github-api").alias("text"), F.lit("github-api").alias("source"))


def github_raw(answers: DataFrame) -> DataFrame:
    """(id, body)."""
    return answers.select("id", _cut(F.col("body"), "github-raw").alias("text"), F.lit("github-raw").alias("source"))


def github_tree(answers: DataFrame) -> DataFrame:
    """(id, path, listing): a folder's entries in the answer's order."""
    items = F.from_json("listing", "array<struct<name:string,type:string,size:bigint>>")
    line = lambda f: F.concat(F.when(f["type"] == "dir", "- d ").otherwise("- f "), f["name"], _told((f["type"] == "file") & f["size"].isNotNull(), F.lit(" ("), f["size"].cast("string"), F.lit("B)")))
    name = F.when(F.col("path") != "", F.col("path")).otherwise("repository root")
    return answers.select("id", F.when(items.isNotNull(), F.concat(F.lit("# "), name, F.lit("\n\n"), F.array_join(F.transform(items, line), "\n"), F.lit("\n"))).alias("text"), F.lit("github-tree-api").alias("source"))


def github_issue(answers: DataFrame) -> DataFrame:
    """(id, name, item, comments, is_pull): comments null or [] where there are none."""
    said = F.slice(F.coalesce(F.from_json("comments", "array<struct<user:struct<login:string>,created_at:string,body:string>>"), F.array()), 1, COMMENTS)
    one = lambda c: F.concat(F.lit("**"), F.coalesce(c["user"]["login"], F.lit("?")), F.lit("** ("), F.substring(_text(c["created_at"]), 1, 10), F.lit("):\n\n"), _text(c["body"]))
    item = F.from_json("item", "struct<title:string,body:string>")
    md = F.concat(F.lit("# "), F.coalesce(item["title"], F.col("name")), F.lit("\n\n"), F.coalesce(item["body"], F.lit("(no body)")), F.lit("\n"), _told(F.size(said) > 0, F.lit("\n---\n\n## Comments\n\n"), F.array_join(F.transform(said, one), "\n\n---\n\n")))
    return answers.select("id", _cut(md, "github-issue-api").alias("text"), F.when(F.col("is_pull"), "github-pr-api").otherwise("github-issue-api").alias("source"))


def strip_html(body: Column) -> Column:
    """Text of a question's or answer's HTML; code stays as it is between fences or ticks."""
    out = F.regexp_replace(body, r"(?s)<pre><code>(.*?)</code></pre>", "\n```\n$1\n```\n")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<code>(.*?)</code>", "`$1`"), r"(?i)<(p|br|div|li|h[1-6])[^>]*>", "\n")
    out = F.regexp_replace(decode_entities(F.regexp_replace(out, "<[^>]+>", "")), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


_ANSWERS = "struct<items:array<struct<is_accepted:boolean,body:string,question_id:bigint>>>"


def _answer(a: Column) -> Column:
    return F.concat(_told(F.coalesce(a["is_accepted"], F.lit(False)), F.lit("**Accepted answer**\n\n")), strip_html(_text(a["body"])))


def stackexchange(answers: DataFrame) -> DataFrame:
    """(id, question, answers): a question with its answers in the answer's order."""
    question = F.get(F.from_json("question", "struct<items:array<struct<title:string,body:string>>>")["items"], F.lit(0))
    given = F.slice(F.coalesce(F.from_json("answers", _ANSWERS)["items"], F.array()), 1, ANSWERS)
    md = F.concat(
        _told(question.isNotNull(), F.lit("# "), _text(question["title"]), F.lit("\n\n"), strip_html(_text(question["body"])), F.lit("\n")),
        F.when(F.size(given) > 0, F.concat(F.lit("\n---\n\n## Answers\n\n"), F.array_join(F.transform(given, _answer), "\n\n---\n\n"))).otherwise("\n(no answers yet)\n"),
    )
    return answers.select("id", _cut(md, "stackexchange-api").alias("text"), F.lit("stackexchange-api").alias("source"))


def stackexchange_answer(answers: DataFrame) -> DataFrame:
    """(id, site, answer): one answer, with a link to its question."""
    a = F.get(F.from_json("answer", _ANSWERS)["items"], F.lit(0))
    host = F.when(F.col("site") == "stackoverflow", "stackoverflow.com").otherwise(F.concat("site", F.lit(".stackexchange.com")))
    number = a["question_id"].cast("string")
    md = F.concat(_answer(a), F.lit("\n\n[question "), number, F.lit("](https://"), host, F.lit("/questions/"), number, F.lit(")"))
    return answers.select("id", F.when(a.isNotNull(), _cut(md, "stackexchange-api")).alias("text"), F.lit("stackexchange-api").alias("source"))


def arxiv(answers: DataFrame) -> DataFrame:
    """(id, atom) to text, source and date."""
    entry = F.regexp_extract("atom", r"(?s)<entry>(.*?)</entry>", 1)
    pick = lambda tag: F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"^\s+|\s+$", "")
    flat = lambda s: F.regexp_replace(F.regexp_replace(decode_entities(s), r"[\s\x{00A0}]+", " "), "^ | $", "")
    title, summary = flat(pick("title")), flat(pick("summary"))
    authors = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<author>\s*<name>(.*?)</name>"), F.lit(1)), decode_entities)
    published, updated = F.substring(pick("published"), 1, 10), F.substring(pick("updated"), 1, 10)
    md = F.concat(
        F.lit("# "), title, F.lit("\n\n"), F.array_join(authors, ", "), F.lit("\n\nPublished "), F.when(published != "", published).otherwise("?"), _told((updated != "") & (updated != published), F.lit(" · updated "), updated),
        F.lit("\n\n## Abstract\n\n"), summary, F.lit("\n\n[PDF](https://arxiv.org/pdf/"), F.replace(pick("id"), F.lit("http://arxiv.org/abs/"), F.lit("")), F.lit(")\n"),
    )
    return answers.select("id", entry.alias("e")).select("id", F.when((title != "") & (summary != ""), _cut(md, "arxiv-api")).alias("text"), F.lit("arxiv-api").alias("source"), F.nullif(published, F.lit("")).alias("date"))


def _by_row(answers: DataFrame, columns: list[str], fn: Callable[..., str | None], source: str) -> DataFrame:
    """fn of each row's columns, for answers that nest without a bound; what fn can't read is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, batch.num_columns)), strict=True):
                try:
                    texts.append(fn(*row))
                except (ValueError, TypeError, AttributeError, KeyError, IndexError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([source] * len(texts))], names=["id", "text", "source"])

    return answers.select(F.col("id").cast("long"), *columns).mapInArrow(run, "id long, text string, source string")


def _listed(roots: list, children: Callable, line: Callable) -> str:
    """One line for each node of a tree, children below their parents; a stack, so that any depth can be read."""
    out, todo = [], [(n, 0) for n in reversed(roots)]
    while todo:
        node, depth = todo.pop()
        shown = line(node)
        if shown is not None:
            out.append("  " * depth + shown + "\n")
        todo += [(c, depth + 1) for c in reversed(children(node))]
    return "".join(out)


def hn_text(answer: str) -> str:
    item = json.loads(answer)
    line = lambda n: "- " + re.sub(r"\s+", " ", re.sub("<[^>]+>", "", str(n["text"]))).strip() if n.get("text") else None
    head = f"# {item['title'] if item.get('title') is not None else 'HN thread ' + str(item.get('id', ''))}\n\n"
    if item.get("points"):
        head += f"{item['points']} points · u/{item.get('author') or '?'}\n\n"
    return (head + _listed([item], lambda n: n.get("children") or [], line))[: MOST["hn-algolia"]]


def hn_thread(answers: DataFrame) -> DataFrame:
    """(id, answer): a story with its comments, indented by depth."""
    return _by_row(answers, ["answer"], hn_text, "hn-algolia")


def reddit_text(answer: str) -> str | None:
    data = json.loads(answer)
    post = data[0]["data"]["children"][0]["data"]
    comments = (data[1]["data"]["children"] if len(data) > 1 else None) or []
    real = lambda listed: [c for c in listed or [] if c.get("data") and c.get("kind") != "more"]
    replies = lambda c: real((((c["data"].get("replies") or {}) or {}).get("data") or {}).get("children"))
    flat = lambda s: re.sub(r"\n+", " ", str(s or ""))[:COMMENT]
    line = lambda c: f"- **u/{c['data'].get('author')}** (↑{c['data'].get('ups')}): {flat(c['data'].get('body'))}"
    head = f"# {post.get('title')}\n\nr/{post.get('subreddit')} · ↑{post.get('ups')} · u/{post.get('author')}\n\n{post.get('selftext') or ''}\n"
    return (head + "\n## Top comments\n\n" + _listed(real(comments), replies, line))[: MOST["reddit-json"]]


def reddit_thread(answers: DataFrame) -> DataFrame:
    """(id, answer): a post with its comments, indented by depth, each cut. Stubs for more comments are passed over."""
    return _by_row(answers, ["answer"], reddit_text, "reddit-json")


def wikipedia_text(summary: str | None, html: str | None, url: str) -> str | None:
    """An article as markdown; its summary comes first where the text doesn't begin with it."""
    if not summary or not html:
        return None
    extract = json.loads(summary).get("extract")
    md = page_markdown(html, url, MOST["wikipedia-rest"])["text"]
    plain = lambda s: re.sub(r"\s+", " ", re.sub(r"[*_`]", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s))).strip()
    lede = plain(re.split(r"\n#{1,6}\s", md)[0])[:300].lower()
    if extract and plain(extract)[:60].lower() not in lede:
        md = f"{extract}\n\n{md}"
    return md[: MOST["wikipedia-rest"]]


def wikipedia(answers: DataFrame) -> DataFrame:
    """(id, summary, html, url)."""
    return _by_row(answers, ["summary", "html", "url"], wikipedia_text, "wikipedia-rest")


#: What reads each route's answers.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "github-api": github_repo, "github-raw": github_raw, "github-tree-api": github_tree, "github-issue-api": github_issue, "github-pr-api": github_issue,
    "stackexchange-api": stackexchange, "reddit-json": reddit_thread, "hn-algolia": hn_thread, "wikipedia-rest": wikipedia, "arxiv-api": arxiv,
}


def read_routed(answers: dict[str, DataFrame]) -> DataFrame:
    """Each route's answers through its reader, as (id, text, source); texts of 80 characters or less are null."""
    out = None
    for name, table in answers.items():
        one = READERS[name](table).select("id", "text", "source")
        out = one if out is None else out.unionByName(one)
    return out.select("id", F.when(F.length("text") > 80, F.col("text")).alias("text"), "source")


def pretty_json(body: Column) -> Column:
    """JSON with two spaces a level; null where it can't be read."""

    def pretty(texts: pa.Array) -> pa.Array:
        def one(t):
            try:
                return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
            except (ValueError, TypeError):
                return None

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(pretty, "string")(body)
