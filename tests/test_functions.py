import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import markdown as M
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import passages as P
from siltstone.operators import state as S
from siltstone.sources import adapters as A
from siltstone.sources.pdf import pdf_text
from siltstone.streaming import state as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokenize(F.lit("react.useEffect walking 日本語x c++ passed class"))) == ["react.useeffect", "useeffect", "walk", "日本", "本語", "x", "c++", "pass", "class"]
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []


def test_entities(spark):
    assert one(spark, T.decode_entities(F.lit("&amp;lt; &#65;&#x1F600; &#99999999; &nope; &eacute;"))) == "&lt; A😀 &#99999999; &nope; é"


def test_equal_urls(spark):
    pairs = [("https://www.e.com/a/", "http://m.e.com/a"), ("https://e.com/a?b=1&a=2&utm_x=3", "https://e.com/a?a=2&b=1"), ("https://e.com:81/x#y", "https://e.com/x"), ("https://stackoverflow.com/questions/1/s", "https://stackoverflow.com/questions/1")]
    for a, b in pairs:
        assert one(spark, U.normalize_url(F.lit(a))) == one(spark, U.normalize_url(F.lit(b)))
    assert one(spark, U.normalize_url(F.lit("https://e.com/A"))) != one(spark, U.normalize_url(F.lit("https://e.com/a")))


def test_unsafe_names(spark):
    for url in ("http://localhost/", "http://x.internal/", "http://[::ffff:127.0.0.1]/", "http://a:b@e.com/", "file:///etc/passwd", "nonsense"):
        assert one(spark, U.safety_reason(F.lit(url))), url
    for url in ("https://e.com/", "http://8.8.8.8/", "http://[::ffff:8.8.8.8]/"):
        assert one(spark, U.safety_reason(F.lit(url))) is None, url


def test_markdown_passages():
    text = "Intro text that is long enough to stay.\n\n# Guide\nSome words under the guide heading.\n\n```py\nprint(1)\n\nprint(2)\n```\n\nshort\n"
    assert P.markdown_passages(text) == [("", "Intro text that is long enough to stay.", "prose"), ("Guide", "Some words under the guide heading.", "prose"), ("Guide", "```py\nprint(1)\n\nprint(2)\n```", "code")]
    assert P.markdown_passages("") == []


def test_markdown_passages_of_odd_lines():
    # an indented # is no heading, any fence ends a fence and keeps its own marks, an open fence is closed with the mark it began with
    assert P.markdown_passages("  # not a heading but a long line") == [("", "# not a heading but a long line", "prose")]
    assert P.markdown_passages("```\na\n~~~\nA line of prose that is long enough.") == [("", "```\na\n~~~", "code"), ("", "A line of prose that is long enough.", "prose")]
    assert P.markdown_passages("~~~ x\na\n\nb") == [("", "~~~ x\na\n\nb\n~~~", "code")]
    assert P.markdown_passages("```\n\n```") == []
    long = "\n".join(f"line {k} of the code" for k in range(200))
    chunks = P.markdown_passages(f"```py\n{long}\n```")
    assert len(chunks) > 3 and all(len(t) <= 1100 and t.startswith("```py\n") and t.endswith("\n```") for _, t, _ in chunks)
    assert "\n".join(t[6:-4] for _, t, _ in chunks) == long


def test_packing_is_the_same_in_both_forms(spark):
    text = "A sentence of some length here. " * 120 + "No end"
    assert one(spark, P.pack_sentences(F.lit(text))) == [t for _, t, _ in P.markdown_passages(text)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 20))
def test_throttle(spark, times, gap):
    rows = [(1, i, t) for i, t in enumerate(sorted(times))]
    got = {r["id"]: r["start"] for r in S.throttle(spark.createDataFrame(rows, "key long, id long, t long"), gap).collect()}
    last = None
    for _, i, t in rows:
        last = t if last is None else max(t, last + gap)
        assert got[i] == last


def test_pdf():
    import zlib

    body = zlib.compress(b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj 0 -14 Td (World) Tj ET")
    data = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + body + b"\nendstream endobj"
    assert pdf_text(data) == "Hello (PDF)\nWorld"
    assert pdf_text(b"no") is None and pdf_text(None) is None


def test_linked_dates(spark):
    """JSON-LD dates of any node: of an array, of @graph, of the only one; from the first script that has one."""
    plain, graph = '{"name":"x"}', '{"@context":"c","@graph":[%s]}'
    cases = [
        (['[%s, null, "x", 7, {"dateModified":"2024-02-03"}, {"datePublished":"2020-01-01"}]' % plain], "2024-02-03"),
        ([graph % ",".join([plain] * 2 + ['{"datePublished":"2024-02-03"}'])], "2024-02-03"),
        ([graph % ",".join([plain] * 40 + ['{"datePublished":"soon","dateModified":"2024-02-03T10:00:00Z"}'])], "2024-02-03"),
        (['\n {"datePublished":"2024-02-03","dateModified":"2025-01-01"}'], "2024-02-03"),
        (['{"datePublished":"2024-02-03","@graph":null}'], "2024-02-03"),
        ([graph % plain, "[]", "[broken", "", '\n[%s,{"datePublished":"2024-02-03"}]' % plain], "2024-02-03"),
        (['{"datePublished":"2020-01-01","@graph":[%s]}' % plain], "2023-07-08"),  # @graph stands in for the rest
        (["[%s]" % plain], "2023-07-08"),
    ]
    rows = [("".join(f'<script type="application/ld+json">{j}</script>' for j in scripts) + '<time datetime="2023-07-08">x</time>', want) for scripts, want in cases]
    for r in spark.createDataFrame(rows, "html string, want string").select("html", "want", H.extract_date(F.col("html"), F.lit("https://e.com/")).alias("date")).collect():
        assert r.date == r.want, r.html


WORDS = st.text(st.sampled_from("abingsed.#+-_ 12éß日本語ひ한"), max_size=30)


@settings(max_examples=25, deadline=None)
@given(WORDS)
def test_tokens_on_the_driver(spark, text):
    assert one(spark, T.tokenize(F.lit(text))) == T.tokens_of(text)


def test_very_long_words(spark):
    """Words of many dotted parts must not end the JVM."""
    for text in ("a" + ".b" * 20_000, "x" * 100_000, "a.b-" * 10_000):
        assert one(spark, F.size(T.tokenize(F.lit(text)))) >= 1


def test_scores_do_not_depend_on_how_often_words_are_asked(spark):
    docs = spark.createDataFrame([(1, 0, "", "one two three four five six seven", "prose"), (1, 1, "", "one one other words here", "prose")], "doc_id long, pos int, heading string, text string, kind string")
    once = P.score_passages(docs, "one two").orderBy("pos").collect()
    again = P.score_passages(docs, "one two one TWO").orderBy("pos").collect()
    assert [round(r.score, 9) for r in once][1] == [round(r.score, 9) for r in again][1] > 0
    assert P.score_passages(docs, "").first().score == 0


def test_threads_of_any_depth(spark):
    n = 500
    rows = [(1, k, k - 1 if k else None, k, f"t{k}") for k in range(n)] + [(2, 7, 99, 0, "its parent isn't there")]
    flat = {(r.thread, r.id): r for r in S.flatten_threads(spark.createDataFrame(rows, "thread long, id long, parent long, ord long, text string")).collect()}
    assert len(flat) == n + 1 and all(flat[1, k].depth == k and len(flat[1, k].path) == k + 1 for k in range(n)) and flat[2, 7].depth == 0
    ring = spark.createDataFrame([(1, 1, 2, 0, "a"), (1, 2, 1, 0, "b")], "thread long, id long, parent long, ord long, text string")
    with pytest.raises(ValueError, match="circle"):
        S.flatten_threads(ring)


EVENTS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), min_size=1, max_size=40)


@settings(max_examples=10, deadline=None)
@given(EVENTS, st.integers(0, 15))
def test_ttl_cache(spark, events, ttl):
    rows = [(k, i, t) for i, (k, t) in enumerate(events)]
    got = {r.id: r.hit for r in S.ttl_cache(spark.createDataFrame(rows, "key long, id long, t long"), ttl).collect()}
    last = {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = k in last and t - last[k] <= ttl
        assert got[i] == hit
        if not hit:
            last[k] = t


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 3), st.booleans()), min_size=1, max_size=25))
def test_offline(spark, events):
    """Against the definition: two hosts failing within the span, ties in time included."""
    rows = [(i, t, h, f, 0) for i, (t, h, f) in enumerate(sorted(events))]
    got = {r.id: r.offline for r in S.offline(spark.createDataFrame(rows, "id long, t long, host long, failed boolean, day long"), ["day"], 3, 5).collect()}
    until = None
    for i, t, h, f, _ in rows:
        assert got[i] == (until is not None and until > t)
        if not f:
            until = 0
        elif len({x[2] for x in rows if x[3] and t - 3 <= x[1] <= t}) >= 2:
            until = t + 5


def test_streams_keep_state_between_batches(spark, tmp_path):
    rows = [(k % 3, k, 7 * k * k % 50 + 10 * k) for k in range(60)]
    rows.sort(key=lambda r: r[2])
    import time

    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], "key long, id long, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = lambda: spark.readStream.schema("key long, id long, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    all_ = spark.createDataFrame(rows, "key long, id long, t long")
    as_set = lambda df, c: {(r.id, r[c]) for r in df.collect()}
    assert as_set(ST.drain(ST.ttl_cache(source(), 25)), "hit") == as_set(S.ttl_cache(all_, 25), "hit")
    assert as_set(ST.drain(ST.throttle(source(), 40)), "start") == as_set(S.throttle(all_, 40), "start")


PAGE = """<html><head><title>My Page - Site</title></head><body><div class="content"><p>Intro text that is long enough to be counted as the content of this page, with <a href="/x">a link</a> and <b>bold</b> words in it.</p>
<table><tr><th>A</th><th>B|C</th></tr><tr><td>1<td>2</table><pre class="language-py"><code>x = 1
  y = 2</code></pre><ul><li>one<li>two <i>it</i></ul><ol><li><p>first</p><p>more</p></ol><blockquote><p>quoted</p></blockquote><p hidden>secret</p>
<div style="display:none">unseen</div><div>block one</div><div>block two</div><footer>foot</footer><p>And a last paragraph which has enough words to make the page long.<sup class="reference">[1]</sup></p></div><div class="comments">%s</div></body></html>""" % ("bad comment " * 40)
MARKDOWN = """# My Page

Intro text that is long enough to be counted as the content of this page, with [a link](https://e.com/x) and **bold** words in it.

| A | B\\|C |
| --- | --- |
| 1 | 2 |

```py
x = 1
  y = 2
```

- one
- two it

1. first

  more

> quoted

block one

block two

And a last paragraph which has enough words to make the page long.[1]"""


def test_page_markdown():
    found = M.page_markdown(PAGE, "https://e.com/a/b", 10_000)
    assert (found["text"], found["block"], found["truncated"]) == (MARKDOWN, "div", False)
    assert M.page_markdown(PAGE, "nonsense", 50) | {"score": 0, "letters": 0} == {"text": MARKDOWN[:50], "truncated": True, "block": "div", "score": 0, "letters": 0, "cjk": 0}
    for odd in (None, "", "<", "<p", "</p>", "<p><", "<!-- open", "<a href=", "<script>never closed", "&#x110000;"):
        assert M.page_markdown(odd, None, 100)["text"] == ""


def test_deeply_nested_pages():
    deep = "<div>" * 5000 + "<p>" + "words in the middle of it all " * 20 + "</p>"
    assert "words in the middle" in M.page_markdown(f"<body>{deep}</body>", None, 1000)["text"]


def test_hinted_sites():
    body = "<p>" + "The words of the documentation page. " * 8 + "</p>"
    page = f'<html><head><meta name="generator" content="Docusaurus v2"></head><body><div class="main">{"<p>" + "other text of the shell " * 60 + "</p>"}<div class="theme-doc-markdown x">{body}</div></div></body></html>'
    assert M.page_markdown(page, "https://e.com/", 9999)["text"] == ("The words of the documentation page. " * 8).strip()


def test_code_of_lines():
    """Each div of a code block is a line, and each break."""
    page = "<article><p>" + "Some words to fill the page with. " * 10 + "</p><pre><code><div>a</div><div>b<br></div><div>c</div></code></pre></article>"
    assert M.page_markdown(page, None, 9999)["text"].endswith("```\na\nb\nc\n```")


def test_flattened_threads_of_sites():
    nested = {"id": 1, "title": "T", "points": 0, "text": None, "children": []}
    at = nested
    for k in range(3000):
        at["children"] = [{"id": k, "text": f"c{k}", "children": []}]
        at = at["children"][0]
    assert A._listed([nested], lambda n: n["children"], lambda n: n["text"]).count("\n") == 3000


def test_site_answers_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(1, "{broken"), (2, None), (3, "[]"), (4, '{"id":9}')], "id long, answer string")
    assert {r.id: r.text for r in A.hn_thread(rows).collect()} == {1: None, 2: None, 3: None, 4: "# HN thread 9\n\n"}
    assert {r.id: r.text for r in A.reddit_thread(rows).collect()} == {1: None, 2: None, 3: None, 4: None}


def test_pdf_strings_that_hold_operators():
    assert pdf_text(b"%PDF-1.4\n1 0 obj <<>>\nstream\nBT (GO ET GO) Tj 0 -14 Td (BT) Tj ET\nendstream") == "GO ET GO\nBT"
