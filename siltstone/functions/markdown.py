"""Pages as markdown: a tolerant HTML reader, the densest block of text, and its rendering.

A page becomes flat columns in document order, one entry a node: its tag, its
parent, its depth and the place after its last descendant. A subtree is a range
of places, so all counts of a subtree are differences of running sums, and the
renderer goes through the places from last to first, with every child done
before its parent. Nothing recurses, so nesting of any depth is safe.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import ENTITIES

# Tags by what they do. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe form select button nav aside link meta base area track param annotation semantics".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
INLINE = frozenset("a b i em strong span code small sub sup u s mark abbr time cite q kbd label img br wbr".split())
BLOCK = frozenset("p div section article main ul ol li table pre blockquote h1 h2 h3 h4 h5 h6 hr header footer figure figcaption details summary dl dt dd address fieldset".split())
APART = frozenset("div section article main li dd dt figure figcaption details summary dl address fieldset".split())
#: A tag to the open ones that it ends and those that keep it from looking further.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    **{t: ({"tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
}
# Classes that speak for and against a block, and lines that are chrome. Fixed values.
GOOD_CLASS = "content|article|post|entry|body|main|markdown|docs"
BAD_CLASS = r"comment|sidebar|footer|nav|related|share|promo|advert|ads?-|cookie|banner|social|newsletter|widget|mw-portlet|vector-menu|(^|[-_])menu(s)?($|[-_](item|container|list|bar|wrapper|toggle))"
CHROME = r"(?i)^(skip to (main )?content|toggle (the )?table of contents|jump to (content|nav)|advertisement|cookie (notice|settings)?|edit links|views|actions|print/export|in other projects|appearance|move to sidebar|tools)\b|^\d+ languages$"
ARXIV_CHROME = r"^# Computer Science >|^arXiv:\d{4}\.\d{4,5}( \(cs\))?$"
#: Names of languages, as lists of translations show them. Fixed values.
LANGUAGES = frozenset(
    """afrikaans,albanian,amharic,arabic,armenian,asturian,assamese,avaric,aymara,azerbaijani,bashkir,basque,belarusian,bengali,bosnian,breton,bulgarian,burmese,
catalan,cebuano,chamorro,cherokee,chichewa,chinese,corsican,cree,croatian,czech,danish,dutch,dzongkha,english,esperanto,estonian,ewe,faroese,fijian,filipino,finnish,
french,fula,galician,georgian,german,greek,guarani,gujarati,haitian,hausa,hebrew,herero,hindi,hiri motu,hungarian,icelandic,ido,igbo,indonesian,interlingua,inuktitut,
irish,italian,japanese,javanese,kannada,kanuri,kazakh,khmer,kikuyu,kinyarwanda,kirundi,korean,kurdish,kyrgyz,lao,latin,latvian,limburgish,lingala,lithuanian,
luxembourgish,macedonian,malagasy,malay,malayalam,maltese,manx,maori,marathi,mongolian,nauru,navajo,ndonga,nepali,norwegian,occitan,ojibwe,oromo,ossetian,pashto,
persian,polish,portuguese,punjabi,quechua,romanian,russian,samoan,sango,sanskrit,sardinian,scots,serbian,sesotho,shona,sindhi,sinhala,slovak,slovenian,somali,spanish,
sundanese,swahili,swedish,tagalog,tahitian,tajik,tamil,tatar,telugu,thai,tigrinya,tok pisin,tongan,tsonga,tswana,turkish,turkmen,twi,ukrainian,urdu,uyghur,uzbek,
vietnamese,walloon,welsh,wolof,xhosa,yiddish,yoruba,zulu""".replace("\n", "").split(",")
)
#: What hints at the content of documentation sites: (host, generator, how to find it).
HINTS = (
    (r"(^|\.)postgresql\.org$", None, ("id", "docContent")),
    (None, "docusaurus", ("class", "theme-doc-markdown")),
    (None, "docusaurus", ("tag", "article")),
    (None, "nextra", ("child", "main", "article")),
    (r"(^|\.)developer\.mozilla\.org$", None, ("class", "main-page-content")),
    (r"(^|\.)react\.dev$", None, ("tag", "article")),
)

_GOOD, _BAD = re.compile(GOOD_CLASS, re.I), re.compile(BAD_CLASS, re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</(?P<close>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<open>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>[^>]*)>|<[^>]*>", re.S)
_ATTR = re.compile(r"""([A-Za-z_:][^\s=/>"']*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z]\w*));")
_SPACE = re.compile(r"\s+")


def decoded(s: str) -> str:
    """Character references: numbers and the known names; others stay."""

    def char(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]

    return _ENTITY.sub(char, s) if "&" in s else s


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): decoded(m[2].strip("\"'") if m[2][:1] in "\"'" else m[2]) if m[2] is not None else "" for m in _ATTR.finditer(source)}


class Nodes:
    """A page's nodes in document order; place 0 is the page itself. Text has the tag #text."""

    def __init__(self) -> None:
        self.tag, self.parent, self.depth, self.end = ["#page"], [-1], [0], [0]
        self.attrs: list[dict[str, str]] = [{}]
        self.text = [""]

    def add(self, tag: str, parent: int, attrs: dict[str, str] | None = None, text: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.end.append(len(self.tag))
        self.attrs.append(attrs or {})
        self.text.append(text)
        return len(self.tag) - 1

    def first(self, wanted) -> int | None:
        return next((i for i in range(len(self.tag)) if wanted(i)), None)

    def raw(self, i: int) -> str:
        return "".join(self.text[i : self.end[i]])


def read(html: str) -> Nodes:
    """Nodes of any text. What is dropped or hidden ends at its first closing tag and leaves no nodes."""
    nodes, open_, at = Nodes(), [0], 0

    def close(keep: int) -> None:
        """Close all but the first `keep` open nodes."""
        for i in open_[keep:]:
            nodes.end[i] = len(nodes.tag)
        del open_[keep:]

    def past(tag: str, start: int, form: str) -> int:
        found = re.compile(form.format(tag), re.I).search(html, start)
        return found.end() if found else len(html)

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            nodes.add("#text", open_[-1], text=decoded(html[at : m.start()]))
        at, tag, rest = m.end(), (m["open"] or "").lower(), m["rest"] or ""
        if m["close"] is not None:
            name = m["close"].strip().lower()
            last = next((k for k in range(len(open_) - 1, 0, -1) if nodes.tag[open_[k]] == name), None)
            if last is not None:
                close(last)
        if not tag:
            continue
        alone = tag in VOID or bool(re.search(r"/\s*$", rest))
        if tag in DROPPED:
            at = at if alone else past(tag, at, r"</{}\b[^>]*>")
            continue
        attrs = attributes(rest)
        if "hidden" in attrs or re.search(r"display:\s*none", attrs.get("style", "")):
            at = at if alone else past(tag, at, r"</{}\b[^>]*>")
            continue
        if re.search("mw:Transclusion|mw:Param|mw:Extension", attrs.get("typeof", "")):
            at = past(tag, at, r"</{}\s*>")
            continue
        for ends, within in ([ENDS[tag]] if tag in ENDS else []) + ([({"p"}, None)] if tag in CLOSES_P else []):
            for k in range(len(open_) - 1, 0, -1):
                name = nodes.tag[open_[k]]
                if name in ends:
                    close(k)
                    break
                if (name in within) if within else (name not in INLINE):
                    break
        i = nodes.add(tag, open_[-1], attrs)
        if not (tag in VOID or re.search(r"""(^|["'\s])/$""", rest)):
            open_.append(i)
    tail = html[at:]
    if tail and ("pre" in (nodes.tag[i] for i in open_) or tail.strip()):
        nodes.add("#text", open_[-1], text=decoded(tail))
    close(0)
    return nodes


def _sums(values: list[int]) -> list[int]:
    return [0, *accumulate(values)]


def densest(nodes: Nodes) -> tuple[int, float]:
    """(place, score) of the block that holds the text: much of it, little of it links, none of it comments or menus."""
    n = len(nodes.tag)
    names = [f"{a.get('id', '')} {a.get('class', '')}" for a in nodes.attrs]
    bad = [False] * n
    for i in range(1, n):
        bad[i] = bad[nodes.parent[i]] or (nodes.tag[i] != "#text" and (nodes.tag[i] == "footer" or bool(_BAD.search(names[i]))))
    size = [len(_SPACE.sub(" ", t).strip()) if t else 0 for t in nodes.text]
    text, raw = _sums(size), _sums([len(t) for t in nodes.text])
    junk = _sums([s if b else 0 for s, b in zip(size, bad, strict=True)])
    inside = lambda sums, i: sums[nodes.end[i]] - sums[i + 1]
    links = _sums([inside(text, i) if nodes.tag[i] == "a" else 0 for i in range(n)])
    parts = _sums([int(nodes.tag[i] in ("p", "li", "pre") and not bad[nodes.parent[i]]) for i in range(n)])
    found = []
    for i in range(n):
        own = inside(text, i) - inside(junk, i)
        if nodes.tag[i] == "#text" or nodes.depth[i] > 25 or own <= 200:
            continue
        share = inside(links, i) / max(inside(text, i), 1)
        score = own * (1 - share) + 25 * inside(parts, i)
        for times, holds in ((1.5, nodes.tag[i] in ("article", "main")), (1.25, _GOOD.search(names[i])), (0.4, _BAD.search(names[i])), (0.3, share > 0.6), (4, "mw-parser-output" in nodes.attrs[i].get("class", ""))):
            score *= times if holds else 1
        found.append((i, score, own, inside(raw, i)))
    if not found:
        return 0, 0.0
    best = max(found, key=lambda f: (f[1], -f[0]))
    near = [f for f in found if f[1] >= 0.8 * best[1] and f[2] >= 0.9 * best[2]] or [best]
    chosen = min(near, key=lambda f: (f[3], f[0]))
    return chosen[0], chosen[1]


def hinted(nodes: Nodes, html: str, host: str) -> int | None:
    """The content of a known documentation site, if it has 200 characters or more. The generator is read from the page, as its tag leaves no node."""
    generator = next((a.get("content", "") for a in (attributes(m) for m in re.findall(r"(?i)<meta\b([^>]*)>", html)) if a.get("name") == "generator"), "")
    for on, made, (what, *names) in HINTS:
        if (on and not re.search(on, host)) or (made and not re.search(made, generator, re.I)):
            continue
        if what == "child":
            outer = nodes.first(lambda i: nodes.tag[i] == names[0])
            found = None if outer is None else nodes.first(lambda i: nodes.tag[i] == names[1] and nodes.parent[i] == outer)
        else:
            is_it = {"id": lambda i: nodes.attrs[i].get("id") == names[0], "class": lambda i: names[0] in nodes.attrs[i].get("class", "").split(), "tag": lambda i: nodes.tag[i] == names[0]}[what]
            found = nodes.first(is_it)
        if found is not None and len(_SPACE.sub(" ", nodes.raw(found)).strip()) >= 200:
            return found
    return None


def absolute(href: str | None, base: str | None) -> str | None:
    """An address that can be followed, or None."""
    t = (href or "").strip()
    if not t or t.startswith("#") or re.match("(?i)(javascript|mailto|tel|data):", t):
        return None
    try:
        out = urljoin(base or "", t)
        parts = urlsplit(out)
    except ValueError:
        return None
    if not parts.scheme:
        return None
    return out + "/" if parts.netloc and not parts.path and not parts.query and not parts.fragment else out


def _table(rows: list[list[str]]) -> str:
    """At most 8 columns, a head and 29 rows."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = min(max(map(len, rows)), 8)
    line = lambda cells: f"| {' | '.join((cells + [''] * width)[:width])} |"
    return "\n" + "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:30])]) + "\n"


class _Renderer:
    """Each node's markdown as running text and as a block, from the last node of a subtree to its first."""

    def __init__(self, nodes: Nodes, top: int, base: str | None) -> None:
        self.nodes, self.top, self.base = nodes, top, base
        self.children: dict[int, list[int]] = defaultdict(list)
        for i in range(top + 1, nodes.end[top]):
            self.children[nodes.parent[i]].append(i)
        self.inline: dict[int, str] = {}
        self.block: dict[int, str] = {}

    def __call__(self) -> str:
        for i in range(self.nodes.end[self.top] - 1, self.top, -1):
            self.inline[i] = self._inline(i)
            self.block[i] = self._block(i)
        return self._inner(self.top)

    def _inline(self, i: int) -> str:
        n = self.nodes
        tag, attrs = n.tag[i], n.attrs[i]
        if tag == "#text":
            return _SPACE.sub(" ", n.text[i])
        kids = "".join(self.inline[c] for c in self.children[i])
        mark = {"b": "**", "strong": "**", "em": "_", "i": "_", "code": "`"}.get(tag)
        if mark:
            return f"{mark}{kids.strip()}{mark}"
        if tag == "a":
            to, label = absolute(attrs.get("href"), self.base), kids.strip()
            return f"[{label}]({to})" if to and label else label
        if tag == "img":
            alt, src = attrs.get("alt", "").strip(), absolute(attrs.get("src"), self.base)
            return f"![{alt}]({src})" if alt and src else ""
        return "\n" if tag == "br" else kids

    def _inner(self, i: int) -> str:
        """The children of a block. White space between blocks, or at an end, is layout; elsewhere it parts words."""
        n, kids = self.nodes, self.children[i]
        if n.depth[i] - n.depth[self.top] > 40:
            return n.raw(i)
        out = []
        for k, c in enumerate(kids):
            if n.tag[c] == "#text" and not n.text[c].strip():
                if 0 < k < len(kids) - 1 and n.tag[kids[k - 1]] not in BLOCK and n.tag[kids[k + 1]] not in BLOCK:
                    out.append(" ")
            else:
                out.append(self.block[c])
        return "".join(out)

    def _block(self, i: int) -> str:
        n = self.nodes
        tag, named = n.tag[i], n.attrs[i].get("class", "")
        if tag == "#text":
            return self.inline[i]
        if tag == "footer" or (tag == "sup" and re.search("(?i)reference|noprint|cite", named)) or (tag == "table" and re.search("(?i)infobox|vertical-navbox|metadata|sidebar|toc|ambox", named)):
            return ""
        if re.fullmatch("h[1-6]", tag):
            text = re.sub(r"\s*\[(\d+)\]\s*", "", self.inline[i]).strip()
            return f"\n{'#' * int(tag[1])} {text}\n" if text else ""
        if tag == "p":
            text = self.inline[i].strip()
            return f"\n{text}\n" if text else ""
        if tag == "pre":
            return self._code(i)
        if tag == "blockquote":
            inner = self._inner(i).strip()
            return "\n" + "\n".join(f"> {x}" for x in inner.split("\n")) + "\n" if inner else ""
        if tag in ("ul", "ol"):
            items = [t for c in self.children[i] if n.tag[c] == "li" and (t := self._inner(c).strip())]
            shown = [(f"{k}. " if tag == "ol" else "- ") + t.replace("\n", "\n  ") for k, t in enumerate(items, 1)]
            return "\n" + "\n".join(shown) + "\n" if shown else ""
        if tag == "table":
            rows = [r for r in range(i + 1, n.end[i]) if n.tag[r] == "tr"]
            cell = lambda c: re.sub(r"\n+", " ", self.inline[c].replace("|", "\\|")).strip()[:120]
            return _table([[cell(c) for c in self.children[r] if n.tag[c] in ("td", "th")] for r in rows])
        if tag == "hr":
            return "\n---\n"
        inner = self._inner(i)
        return f"\n{inner}\n" if tag in APART and inner.strip() else "" if tag in APART else inner

    def _code(self, i: int) -> str:
        n = self.nodes
        holder = next((c for c in self.children[i] if n.tag[c] == "code"), i)
        language = re.search(r"language-([\w+-]+)", f"{n.attrs[i].get('class', '')} {n.attrs[holder].get('class', '')}")
        kids = self.children[holder]
        if any(n.tag[c] in ("div", "br") for c in kids):  # a line for each div or break
            out = ""
            for k in range(holder + 1, n.end[holder]):
                out += "\n" if n.tag[k] == "br" else n.text[k]
                # divs that end here end their line, but for the last of all
                up = k
                while up != holder and n.end[up] == k + 1:
                    if n.tag[up] == "div" and not out.endswith("\n") and n.end[up] != n.end[holder]:
                        out += "\n"
                    up = n.parent[up]
        else:
            out = n.raw(holder)
        return f"\n```{language[1] if language else ''}\n{out.removeprefix(chr(10)).rstrip(chr(10))}\n```\n"


def is_language(word: str) -> bool:
    return word.strip().lower() in LANGUAGES


def _chrome(line: str) -> bool:
    t = line.strip()
    return bool(re.search(CHROME, t) or re.search(ARXIV_CHROME, t) or (re.match(r"- [^\d][\w '’-]{1,25}$", t) and is_language(t[2:])))


def letters(text: str) -> tuple[int, int]:
    """(letters, CJK letters)."""
    return len(regex.findall(r"\p{L}", text)), len(regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]", text))


def page_markdown(html: str | None, url: str | None, most: int) -> dict:
    """text ("" for pages without readable text), truncated, and of the block chosen: tag, score, letters and CJK letters."""
    html = html or ""
    nodes = read(html)
    try:
        base = url if url and urlsplit(url).scheme and urlsplit(url).netloc else None
        host = (urlsplit(base).hostname or "") if base else ""
    except ValueError:
        base, host = None, ""
    (top, score), hint = densest(nodes), hinted(nodes, html, host)
    top = hint if hint is not None else top
    tidy = lambda s: re.sub(r"\n{3,}", "\n\n", s)
    body = re.sub(r"[ \t]+\n", "\n", tidy(_Renderer(nodes, top, base)())).strip()
    body = tidy("\n".join(x for x in body.split("\n") if not _chrome(x))).strip()
    n, cjk = letters(body)
    out = {"text": "", "truncated": False, "block": nodes.tag[top], "score": round(score, 6), "letters": n, "cjk": cjk}
    if len(body) < 120 or n / len(body) < (0.25 if cjk / max(n, 1) > 0.3 else 0.35):
        return out
    titled = nodes.first(lambda i: nodes.tag[i] == "title")
    title = nodes.raw(titled).strip() if titled is not None else ""
    plain = lambda s: regex.sub(r"[^\p{L}\p{N}]+", " ", s.lower()).strip()
    bare = re.sub(r"\s+[-–—|·»:]\s+[^-–—|·»:]{2,60}$", "", title).strip()
    start = body[:300]
    heading = re.search(r"^#{1,6}\s+(.+)$", start, re.M)
    said = bool(re.search(r"^# |\n# ", start)) or (heading is not None and plain(heading[1]) in (plain(bare), plain(title)))
    full = f"# {bare}\n\n{body}" if title and not said else body
    return out | {"text": full[:most], "truncated": len(full) > most}


def html_markdown(pages: DataFrame, most: int = 200_000) -> DataFrame:
    """(page_id, url, html) to (page_id, text, truncated, block, score, letters, cjk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [page_markdown(html, url, most) for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                kinds = {"text": pa.string(), "truncated": pa.bool_(), "block": pa.string(), "score": pa.float64(), "letters": pa.int64(), "cjk": pa.int64()}
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[c] for r in rows], t) for c, t in kinds.items()]], names=["page_id", *kinds])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, text string, truncated boolean, block string, score double, letters long, cjk long")
