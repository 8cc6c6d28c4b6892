"""Passages of documents: splitting, BM25 inside a document, budgets and views."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import clip, let, tokenize, tokens_of

SHORTEST, LONGEST, PACKED = 24, 1200, 900
K1, B = 1.5, 0.75
SENTENCE = r"[^.!?\n]+[.!?]?\s*"
_TRIM = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, _TRIM, "")


def pack_sentences(text: Column) -> Column:
    """Passages of one block: itself if short, else sentences packed to about 900 characters. array<string>."""
    t = trimmed(text)
    found = F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0))
    sentences = F.when(F.size(found) > 0, found).otherwise(F.array(t))
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(s) > PACKED) & (F.length(acc["cur"]) >= SHORTEST)
        return F.struct(F.when(full, s).otherwise(F.concat(acc["cur"], s)).alias("cur"), F.when(full, F.concat(acc["out"], F.array(trimmed(acc["cur"])))).otherwise(acc["out"]).alias("out"))

    packed = F.aggregate(sentences, start, step, lambda acc: F.when(F.length(trimmed(acc["cur"])) >= SHORTEST, F.concat(acc["out"], F.array(trimmed(acc["cur"])))).otherwise(acc["out"]))
    return F.when(F.length(t) < SHORTEST, F.array().cast("array<string>")).when(F.length(t) <= LONGEST, F.array(t)).otherwise(packed)


def split_plain(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, heading, text, kind) of texts without headings, blank lines and fences; the rest is for split_markdown."""
    return docs.select("doc_id", F.posexplode(pack_sentences(F.coalesce("text", F.lit("")))).alias("pos", "text")).select("doc_id", "pos", F.lit("").alias("heading"), "text", F.lit("prose").alias("kind"))


_SENTENCE = re.compile(SENTENCE)
_FENCE = r"[^\S\n]*(?:```|~~~)[^\n]*"
#: Fenced code up to the next fence of any mark, a heading, a blank line, or a line of prose.
_LINES = re.compile(rf"^(?:(?P<fence>{_FENCE})(?P<code>(?:\n(?!{_FENCE})[^\n]*)*)(?:\n(?P<end>{_FENCE}))?|#{{1,6}}[^\S\n]+(?P<heading>[^\n]{{3,120}}?)[^\S\n]*|(?P<blank>[^\S\n]*)|(?P<prose>[^\n]+))$", re.M)


def _packed(parts: list[str], extra: int, least: int) -> Iterator[list[str]]:
    """Neighbouring parts up to about PACKED characters; a group of less than `least` goes on. extra: characters between two parts."""
    group, size = [], 0
    for part in parts:
        if size + len(part) > PACKED and size >= least:
            yield group
            group, size = [], 0
        group.append(part)
        size += len(part) + extra
    if group:
        yield group


def _prose(block: str) -> list[str]:
    t = block.strip()
    if len(t) <= LONGEST:
        return [t] if len(t) >= SHORTEST else []
    groups = ["".join(g) for g in _packed(_SENTENCE.findall(t) or [t], 0, SHORTEST)]
    return [g.strip() for k, g in enumerate(groups) if k < len(groups) - 1 or len(g.strip()) >= SHORTEST]


def _code(opening: str, body: str, closing: str) -> list[str]:
    lines = body.split("\n")
    groups = [] if not body.strip() else [lines] if len(body) <= LONGEST else _packed(lines, 1, 1)
    return ["\n".join([opening, *g, closing]) for g in groups]


def markdown_passages(text: str) -> list[tuple[str, str, str]]:
    """(heading, text, kind) in order. Blank lines end passages; fenced code stays whole or is cut by lines."""
    out: list[tuple[str, str, str]] = []
    heading, run = "", []
    for m in _LINES.finditer(text):
        if m["prose"] is not None:
            run.append(m["prose"])
            continue
        out += [(heading, t, "prose") for t in _prose("\n".join(run))]
        run = []
        if m["fence"] is not None:
            mark = re.search("```|~~~", m["fence"])[0]
            out += [(heading, t, "code") for t in _code(m["fence"], m["code"][1:], m["end"] if m["end"] is not None else mark)]
        elif m["heading"] is not None:
            heading = m["heading"].strip()
    return out + [(heading, t, "prose") for t in _prose("\n".join(run))]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, pos, *p) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for pos, p in enumerate(markdown_passages(text or ""))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "pos", "heading", "text", "kind"])


def split_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, heading, text, kind) of any text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_split, "doc_id long, pos int, heading string, text string, kind string")


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(tokens_of(query)))


#: A query that looks like code.
CODEISH = r"[(){}\[\];=.\\/>]|undefined|null|function|const|error|npm|import"


def query_codeish(query: Column) -> Column:
    return query.rlike(f"(?i){CODEISH}")


def score_passages(passages: DataFrame, query: str) -> DataFrame:
    """passages with score: BM25 with statistics of the passage's own document, lengths in characters.

    One shuffle, by document: the query's few tokens are counted in place, so
    no token table is built. Each text is tokenised once, however many tokens
    the query has.
    """
    words, per_doc = query_tokens(query), W.partitionBy("doc_id")
    n_q = len(words)
    if not n_q:
        return passages.withColumn("score", F.lit(0.0))
    found = let(F.filter(tokenize(F.col("text")), lambda x: x.isin(*words)), lambda toks: F.array(*[F.size(toks) - F.size(F.array_remove(toks, t)) for t in words]))
    toks = passages.withColumn("_tf", found)
    stats = toks.withColumn("_n", F.count("*").over(per_doc)).withColumn("_avg", F.avg(F.length("text")).over(per_doc))
    df = F.array(*[F.count_if(F.col("_tf")[i] > 0).over(per_doc) for i in range(n_q)])
    stats = stats.withColumn("_df", df)
    norm = K1 * (1 - B + B * (F.length("text") / F.col("_avg")))
    total = F.lit(0.0)
    for i in range(n_q):
        n, d = F.col("_tf")[i], F.col("_df")[i]
        total = total + F.when(n > 0, F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5)) * n * (K1 + 1) / (n + norm)).otherwise(0.0)
    low = F.lower("heading")
    total = total * F.when((F.col("heading") != "") & reduce(operator.or_, [low.contains(t) for t in words]), 1.5).otherwise(1.0)
    phrase = " ".join(query.lower().split())
    if n_q >= 2 and len(phrase) >= 6:
        total = total * F.when(F.regexp_replace(F.lower("text"), r"\s+", " ").contains(phrase), 1.5).otherwise(1.0)
    if re.search(CODEISH, query, re.I):
        total = total * F.when(F.col("text").rlike(r"```|\t|=>|function |const |def |class "), 1.2).otherwise(1.0)
    junk = F.regexp_count("text", F.lit(r"\{\{|\}\}|\[\[|\]\]|https?://")) / F.greatest(F.length("text") / 100, F.lit(1.0))
    total = total * F.when(junk > 1, 0.3).when(junk > 0.4, 0.6).otherwise(1.0)
    return stats.withColumn("score", total).drop("_tf", "_n", "_avg", "_df")


def rank_passages(scored: DataFrame, k: int) -> DataFrame:
    """The k best passages of each document."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def budget_passages(scored: DataFrame, budget: int = 6000, intro: int = 600) -> DataFrame:
    """What of each document fits a budget of characters: its first passage, then the best ones in document order.

    Greedy by score: a passage costs its length, its heading and 20; the last
    one is cut, unless less than 80 characters of it would be left.
    """
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    cost = F.length("text") + F.length("heading") + 20
    rest = F.lit(budget) - F.coalesce(F.sum(cost).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.length("text")
    kept = scored.withColumn("_rest", rest).where((F.col("pos") == 0) | ((F.col("score") > 0) & (F.col("_rest") > 0) & ~((n > F.col("_rest")) & (F.col("_rest") < 80))))
    first = F.col("pos") == 0
    text = F.when(first, F.substring("text", 1, intro)).when(n > F.col("_rest"), F.concat(F.substring(F.col("text"), F.lit(1), F.col("_rest").cast("int")), F.lit("…"))).otherwise(F.col("text"))
    more = [c for c in scored.columns if c not in ("doc_id", "pos", "heading", "text", "score")]
    return kept.select("doc_id", "pos", "heading", text.alias("text"), F.when(first, 0.0).otherwise(F.col("score")).alias("score"), *more)


def passage_view(picked: DataFrame) -> DataFrame:
    """picked(doc_id, pos, heading, text, total) to (doc_id, view): passages in order, headings where they change, and how many of all are shown."""
    previous = F.lag("heading").over(W.partitionBy("doc_id").orderBy("pos"))
    show = (F.col("heading") != "") & ~F.col("heading").eqNullSafe(previous)
    lines = picked.withColumn("_line", F.concat(F.when(show, F.concat(F.lit("## "), F.col("heading"), F.lit("\n"))).otherwise(""), F.col("text")))
    one = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_line"))), lambda s: s["_line"]), "\n\n").alias("body"), F.count("*").alias("n"), F.max("total").alias("total"))
    return one.select("doc_id", F.concat("body", F.lit("\n\n["), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" passages shown — most relevant to the query. Omit query for the page head; offset pages it.]")).alias("view"))


def best_excerpts(picked: DataFrame) -> DataFrame:
    """(doc_id, excerpt) from each document's best picked passage of more than 80 characters."""
    best = picked.groupBy("doc_id").agg(F.max_by(F.struct("heading", "text"), F.struct("score", -F.col("pos"))).alias("b"))
    flat = F.concat(F.when(F.col("b.heading") != "", F.concat(F.col("b.heading"), F.lit(": "))).otherwise(""), F.regexp_replace("b.text", r"\n+", " "))
    return best.where(F.length("b.text") > 80).select("doc_id", clip(flat, 500).alias("excerpt"))


def head_view(text: Column, most: int, offset: int = 0) -> Column:
    """A page of a text. From budgets of 600 on a footer tells where to go on; page and footer together keep to the budget less 120."""
    text = F.coalesce(text, F.lit(""))
    total, past = F.length(text), F.lit(offset)
    beyond = F.concat(F.lit(f"[offset {offset} is past the end ("), total.cast("string"), F.lit(" chars)]"))
    if most < 600:
        return F.when(past >= total, beyond).otherwise(F.substring(text, offset + 1, most))
    budget = most - 120
    footer = lambda at: F.concat(F.lit("\n\n[truncated at "), at.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" chars — pass offset:"), at.cast("string"), F.lit(" for the next part, or a query]"))
    end = F.lit(offset + budget)
    size = F.greatest(F.lit(1), F.lit(budget) - F.length(footer(end)))
    page = F.concat(F.substring(text, F.lit(offset + 1), size), footer(past + size))
    return F.when(past >= total, beyond).when(end >= total, F.substring(text, offset + 1, budget)).otherwise(page)
