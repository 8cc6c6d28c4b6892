"""Text functions on columns: tokens, stems, entities, clipping, locale codes."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The repeated group is possessive: Java's matcher then loops over it, where it would recurse and end the JVM on very long words.
WORD = r"[\p{L}\p{N}_#+-]+(?:\.[\p{L}\p{N}_#+-]+)*+"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+"

#: Words that never count for relevance. Fixed values.
STOPWORDS = ("how", "to", "in", "vs", "the", "a", "an", "of", "for", "and", "or", "is", "what", "with", "on", "does", "do")

#: Named character references. Fixed values.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™",
    "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "times": "×", "middot": "·", "bull": "•", "deg": "°", "plusmn": "±", "eacute": "é",
    "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "euro": "€",
    "dagger": "†", "permil": "‰", "prime": "′", "Prime": "″", "larr": "←", "rarr": "→", "uarr": "↑", "darr": "↓", "harr": "↔",
}

#: Region codes of one engine that follow no rule. Fixed values.
KL_CODES = {
    "es-ES": "es-es", "de-DE": "de-de", "fr-FR": "fr-fr", "it-IT": "it-it", "pt-PT": "pt-pt",
    "pt-BR": "br-pt", "ja-JP": "jp-jp", "ko-KR": "kr-kr", "ru-RU": "ru-ru", "nl-NL": "nl-nl",
    "en-US": "us-en", "en-GB": "uk-en", "en-AU": "au-en", "en-CA": "ca-en",
}


def stem(t: Column) -> Column:
    """Cut one of -ing, -ed, -s, the first that fits."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return F.when((n > 4) & t.endswith("ing"), cut(3)).when((n > 3) & t.endswith("ed"), cut(2)).when((n > 3) & t.endswith("s") & ~t.endswith("ss"), cut(1)).otherwise(t)


def let(value: Column, then) -> Column:
    """then(value), with value worked out once: Spark would repeat its expression wherever then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _word_tokens(w: Column) -> Column:
    tail = F.substring_index(w, ".", -1)
    return F.when(w.contains(".") & tail.rlike(r"\p{L}"), F.array(stem(w), stem(tail))).otherwise(F.array(stem(w)))


def _cjk_tokens(w: Column) -> Column:
    pairs = F.flatten(F.transform(F.regexp_extract_all(w, F.lit(CJK), F.lit(0)), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    rest = F.filter(F.split(F.regexp_replace(w, CJK, " "), r"\s+"), lambda r: r != "")
    return F.concat(pairs, F.transform(rest, stem))


def tokenize(s: Column) -> Column:
    """Stemmed words; dotted words also give their last part; runs of CJK letters give pairs. Null: no tokens."""
    low = F.lower(F.coalesce(s, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    plain = F.transform(words, stem)  # neither CJK letters nor dots inside words
    full = F.flatten(F.transform(words, lambda w: F.when(w.rlike(CJK), _cjk_tokens(w)).otherwise(_word_tokens(w))))
    return F.when(low.rlike(rf"[\p{{L}}\p{{N}}_#+-]\.[\p{{L}}\p{{N}}_#+-]|{CJK}"), full).otherwise(plain)


def _stemmed(t: str) -> str:
    for least, end in ((4, "ing"), (3, "ed"), (3, "s")):
        if len(t) > least and t.endswith(end) and not (end == "s" and t.endswith("ss")):
            return t[: -len(end)]
    return t


def tokens_of(text: str) -> list[str]:
    """tokenize() of one short text, such as a query, on the driver."""
    cjk, out = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+"), []
    for w in regex.findall(WORD, text.lower()):
        runs = cjk.findall(w)
        if runs:
            for r in runs:
                out += [r] if len(r) == 1 else [r[k : k + 2] for k in range(len(r) - 1)]
            out += [_stemmed(x) for x in cjk.sub(" ", w).split()]
            continue
        out.append(_stemmed(w))
        tail = w.rpartition(".")[2]
        if "." in w and regex.search(r"\p{L}", tail):
            out.append(_stemmed(tail))
    return out


def gate_tokens_of(query: str) -> list[str]:
    """gate_tokens() of one query, on the driver."""
    return [t for t in dict.fromkeys(tokens_of(query)) if len(t) > 2 and t not in STOPWORDS]


def gate_tokens(query: Column) -> Column:
    """Distinct query tokens of more than two letters that aren't stopwords."""
    return F.filter(F.array_distinct(tokenize(query)), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def decode_entities(s: Column) -> Column:
    """Numeric references, then named ones; unknown and invalid ones stay. &amp; comes last, so nothing is decoded twice."""
    number = lambda m: F.when(m.rlike("^&#[xX]"), F.conv(F.regexp_extract(m, "^&#[xX]([0-9a-fA-F]{1,6});", 1), 16, 10)).otherwise(F.regexp_extract(m, "^&#([0-9]{1,7});", 1))
    code = lambda m: F.coalesce(number(m).try_cast("int"), F.lit(-1))
    valid = lambda m: (code(m) > 0) & (code(m) <= 0x10FFFF) & ~code(m).between(0xD800, 0xDFFF)
    # UTF-32 spells a code point as four bytes
    char = lambda m: F.decode(F.unhex(F.lpad(F.hex(code(m)), 8, "0")), "UTF-32")
    pattern = "&#(?:[xX][0-9a-fA-F]+|[0-9]+);"
    gaps, hits = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    done = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("m")), lambda p: F.concat(p["g"], F.when(p["m"].isNull(), "").when(valid(p["m"]), char(p["m"])).otherwise(p["m"]))), "")
    out = F.when(s.contains("&#"), done).otherwise(s)
    named = out
    for name, to in ENTITIES.items():
        if name != "amp":
            named = F.replace(named, F.lit(f"&{name};"), F.lit(to))
    named = F.replace(named, F.lit("&amp;"), F.lit("&"))
    return F.when(out.contains("&"), named).otherwise(out)


def collapse(s: Column) -> Column:
    """White space to single spaces, trimmed; a no-break space counts as white."""
    return F.regexp_replace(F.regexp_replace(s, r"[\s\x{00A0}]+", " "), "^ | $", "")


def strip_tags(s: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(s, "<[^>]+>", "")))


def clip(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def clamp(n: Column, most: int) -> Column:
    return F.least(F.greatest(n, F.lit(1)), F.lit(most))


def locale_codes(lang: Column) -> dict[str, Column]:
    """The code each engine uses for a language tag."""
    parts = F.split(lang, "-")
    language, region = parts[0], F.try_element_at(parts, F.lit(2))
    kl = F.create_map(*[F.lit(x) for p in KL_CODES.items() for x in p])
    return {
        "kl": F.coalesce(F.try_element_at(kl, lang), F.when(region.isNotNull() & (region != ""), F.concat(F.lower(region), F.lit("-"), F.lower(language))).otherwise(F.concat(language, F.lit("-"), language))),
        "country": F.upper(F.coalesce(region, lang)),
        "market": F.when(region.isNotNull() & (region != ""), F.concat(F.lower(language), F.lit("-"), F.upper(region))).otherwise(lang),
        "accept": F.concat(lang, F.lit(","), language, F.lit(";q=0.9,en;q=0.5")),
    }


def error_class(status: Column, message: Column) -> Column:
    """Retry class of a status, or of a message where there is no status."""
    permanent = message.rlike("Blocked (protocol|host)|Invalid URL|too large|Too many redirects|DNS lookup failed|AbortError")
    return (
        F.when(status.isin(401, 403), "auth").when(status == 429, "ratelimit").when(status.isin(404, 410), "notfound")
        .when(status.isNull() & F.coalesce(permanent, F.lit(False)), "permanent").otherwise("transient")
    )


def backoff_ms(attempt: Column) -> Column:
    """Wait after the attempt, counted from 0."""
    return (F.lit(300) * F.pow(F.lit(3), attempt)).cast("bigint")


def describe_error(message: Column, code: Column) -> Column:
    """A message with the cause's code after it, unless it is in there."""
    return F.when(code.isNull() | (code == "") | message.contains(code), message).otherwise(F.concat(message, F.lit(" ("), code, F.lit(")")))


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal."""
    return F.concat(F.format_string("%.1f", F.round(ms / 1000, 1)), F.lit("s"))


def http_message(host: Column, status: Column) -> Column:
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    return F.when(status.isin(401, 403), F.concat(code, F.lit(" — "), host, F.lit(" refuses unauthenticated requests"))).when(status == 429, F.concat(code, F.lit(" — "), host, F.lit(" rate-limits us"))).otherwise(code)


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Seconds or an HTTP date to milliseconds from now."""
    seconds = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(seconds >= 0, (seconds * 1000).cast("bigint")).when(date.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.unix_millis(date) - now_ms))
