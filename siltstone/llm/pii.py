"""Surrogates for personal data, in DataFrame operations alone.

E-mail addresses, IBANs, card and social-security numbers, IPv4 and IPv6
addresses, phone numbers and titled names are found in whole texts. Each gets a
surrogate drawn from a keyed hash of its canonical form, so that all mentions
of an entity, however they are written, get the same one. Surrogates keep type
and format: letters stay letters of their script and case, digits stay digits,
separators stay; cards and IBANs that pass their check digits still do; phone
numbers keep their country code; private addresses stay private and public ones
public.

Names are replaced word by word, so that a surname alone still matches; their
ending follows the gender of the title. In a text with a titled name the same
full name, and its last word alone, are replaced without title too; of a
surname with titles of both genders the first one counts. Names that never
have a title in their text are not found.

Distinct entities must get distinct surrogates, and none that is an entity of
the corpus itself. That is checked over all distinct entities; those that
collide are drawn again with the next attempt number until nothing collides.
A short form may have fewer surrogates than there are entities: from attempt 10
on surrogates grow by a letter, digit or syllable with each attempt, private
addresses come from 10.0.0.0/8, and from attempt 20 on all addresses from
2001:db8::/32, so there is always room.

Cases: null text stays null; empty text stays empty; very long texts are
searched whole, in time linear in their length, and words of any length are
safe, as no pattern repeats a group by recursion; repeated rows are replaced
alike; of entities with equal surrogates the smallest keeps it; an empty table
gives an empty result. Rows and all columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents, fresh, materialize

#: Key of the registered query where the session names none; for checks, not for real data.
CHECK_KEY = "only for checks"
KEY_SETTING = "spark.siltstone.pii.key"
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "name")
#: Attempts after which surrogates grow, and after which addresses leave IPv4.
GROWS, LEAVES = 10, 20

#: Titles by the gender that they tell.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Госпожа")
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин")

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}.-]*?\.\p{L}{2})[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_V6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})"
IP = rf"(?<![0-9.]){_V4}(?![0-9]|\.[0-9])|(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9]){_V6}(?![\p{{L}}\p{{N}}:])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
NAME = rf"(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE)})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: (?!(?:{'|'.join(FEMALE + MALE)})\b)\p{{Lu}}\p{{Ll}}{{1,30}}){{0,2}}(?!\p{{L}})"
ENTITY = "|".join((EMAIL, IBAN, CARD, SSN, IP, PHONE, NAME))
#: Each title holds one of these.
_STEMS = ("Mr", "Ms", "Miss", "Madam", "Sir", "Herr", "Frau", "Monsieur", "Señor", "Госпо")

#: Country codes of one and two digits; all others have three. Fixed values.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _run(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


#: (script, small letters, capitals) that surrogates are spelt with; scripts without case have one list.
SCRIPTS = (
    ("IsCyrillic", _run("а", "я"), _run("А", "Я")),
    ("IsGreek", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("IsArmenian", _run("ա", "ֆ"), _run("Ա", "Ֆ")),
    ("IsHan", "天地山川田中石木林森", None),
    ("IsHiragana", "あいうえおかきくけこさしすせそ", None),
    ("IsKatakana", "アイウエオカキクケコサシスセソ", None),
    ("IsHangul", "가나다라마바사아자차카타파하", None),
    ("IsArabic", _run("ا", "غ") + _run("ف", "و"), None),
    ("IsHebrew", _run("א", "ת"), None),
    ("IsDevanagari", _run("क", "ह"), None),
    ("IsBengali", _run("ক", "ন"), None),
    ("IsThai", _run("ก", "ฮ"), None),
    ("IsGeorgian", _run("ა", "ჰ"), None),
)


def kind_of(v: Column) -> Column:
    return (
        F.when(v.contains("@"), "email").when(v.rlike(rf"^{_V4}$|:.*:"), "ip").when(v.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban").when(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(v.rlike(r"^[0-9 -]{15,}$"), "card").when(v.rlike(r"^[+(0-9]"), "phone").otherwise("name")
    )


def _plain_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def canonical(kind: Column, v: Column) -> Column:
    """What all spellings of an entity have in common. A phone number of ten digits without a country code is one of +1."""
    digits = _plain_digits(v)
    phone = F.when(~v.startswith("+") & (F.length(digits) == 10), F.concat(F.lit("1"), digits)).otherwise(digits)
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(v, F.lit(" "))).when(kind == "name", v).otherwise(F.lower(v))


def _byte(h: Column, i: Column) -> Column:
    """Byte i of a hex digest, again from its start after 32."""
    return F.conv(F.substring(h, (i % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once: Spark would repeat its expression wherever then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _pick(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), (b % len(letters) + 1).cast("int"), F.lit(1))


def _letter(c: Column, b: Column) -> Column:
    """A digit for a digit, a letter of the same script and case for a letter; anything else as it is."""
    out = F.when(c.rlike("[0-9]"), _pick("0123456789", b)).when(c.rlike("[a-z]"), _pick(_run("a", "z"), b)).when(c.rlike("[A-Z]"), _pick(_run("A", "Z"), b)).when(~c.rlike(r"\p{L}"), c)
    for script, small, capital in SCRIPTS:
        there = c.rlike(rf"\p{{{script}}}")
        out = out.when(there & (c != F.lower(c)), _pick(capital, b)).when(there, _pick(small, b)) if capital else out.when(there, _pick(small, b))
    return out.when(c != F.lower(c), _pick(_run("A", "Z"), b)).otherwise(_pick(_run("a", "z"), b))


def _shaped(v: Column, h: Column, at=lambda i: i) -> Column:
    """Each character by its place, or by what `at` makes of it."""
    return F.array_join(F.transform(F.split(v, ""), lambda c, i: _let(_byte(h, at(i)), lambda b: _letter(c, b))), "")


def _grown(attempt: Column) -> Column:
    return F.greatest(attempt - (GROWS - 1), F.lit(0)).cast("int")


def _digits(v: Column, h: Column, keep: Column, attempt: Column) -> Column:
    """v with its digits replaced, the first `keep` of them as they are. Digits count from the end, so that formats and country codes don't matter."""
    after = lambda i: F.length(_plain_digits(F.substring(v, i + 2, F.length(v))))
    digit = lambda c, i, changed: F.when(c.rlike("[0-9]"), _let(after(i), lambda n: F.when(n < changed, (_byte(h, n) % 10).cast("string")).otherwise(c))).otherwise(c)
    out = _let(F.length(_plain_digits(v)) - keep, lambda changed: F.array_join(F.transform(F.split(v, ""), lambda c, i: digit(c, i, changed)), ""))
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(_grown(attempt), F.lit(1))), lambda i: (_byte(h, i + 20) % 10).cast("string")), "")
    return F.when(_grown(attempt) > 0, F.concat(out, more)).otherwise(out)


def _luhn(v: Column) -> Column:
    """The check sum of a card number, modulo 10, in any format."""
    d = F.reverse(F.split(_plain_digits(v), ""))
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _card(v: Column, h: Column, attempt: Column) -> Column:
    last = lambda raw: F.regexp_extract(raw, "([0-9])$", 1).cast("int")
    fixed = lambda raw: F.concat(F.substring(raw, F.lit(1), F.length(raw) - 1), ((last(raw) + 10 - _luhn(raw)) % 10).cast("string"))
    return _let(_digits(v, h, F.lit(0), attempt), lambda raw: F.when(_luhn(v) == 0, fixed(raw)).otherwise(raw))


def _mod97(v: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(v, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def _iban(v: Column, h: Column, attempt: Column) -> Column:
    """Country and spaces stay; the check digits are right."""
    rest = F.concat(F.substring(v, F.lit(5), F.length(v)), F.repeat(F.lit("0"), _grown(attempt)))
    country = F.substring(v, 1, 2)
    check = lambda body: 98 - _mod97(F.concat(F.replace(body, F.lit(" ")), country, F.lit("00")))
    shaped = lambda r: _shaped(r, h, lambda i: F.length(F.replace(F.substring(r, F.lit(1), i), F.lit(" "))))
    return _let(_let(rest, shaped), lambda body: F.concat(country, F.lpad(check(body).cast("string"), 2, "0"), body))


def _ip(v: Column, h: Column, attempt: Column) -> Column:
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(h, i * 3) % 254 + 1).cast("string"))
    private = F.regexp_extract(v, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)", 1)
    prefix = F.when(private == "", F.concat((_byte(h, F.lit(0)) % 32 + 128).cast("string"), F.lit("."))).when(attempt < GROWS, private).otherwise("10.")
    four = _let(prefix, lambda p: F.concat(p, F.array_join(F.slice(octets, F.size(F.split(p, r"\.")), F.lit(4)), ".")))
    hexes = lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", _byte(h, i))).when(c.rlike("[A-F]"), _pick("0123456789ABCDEF", _byte(h, i))).otherwise(c)
    kept = F.regexp_extract(v, "^(?i:fe80|f[cd][0-9a-f]{2}|2001:db8)", 0)
    six = _let(kept, lambda k: F.concat(k, F.array_join(F.transform(F.split(F.substring(v, F.length(k) + 1, F.length(v)), ""), hexes), "")))
    wide = F.concat(F.lit("2001:db8"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit(":"), F.substring(h, (i * 4 + 1).cast("int"), F.lit(4)))), ""))
    return F.when(attempt >= LEAVES, wide).when(v.contains(":"), six).otherwise(four)


_LATIN = ("ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "ze", "ka", "lo", "mi", "pe")
_SLAVIC = ("ба", "де", "ви", "го", "лу", "ма", "не", "ри", "со", "ту", "ва", "зе", "ка", "ло", "ми", "пе")
_ENDING = "(?:na|n|на|н)$"


def name_stem(word: Column, attempt: Column, key: str) -> Column:
    """A word of a name as syllables, before its ending."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("name"), word, attempt.cast("string")).cast("binary"), 256)
    syllables = F.when(word.rlike(r"\p{IsCyrillic}"), F.array(*map(F.lit, _SLAVIC))).otherwise(F.array(*map(F.lit, _LATIN)))
    return _let(F.struct(h.alias("h"), syllables.alias("s")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + _grown(attempt)), lambda i: F.element_at(x["s"], (_byte(x["h"], i) % 16 + 1).cast("int"))), ""))


def _name_words(v: Column) -> Column:
    return F.slice(F.split(v, " "), F.lit(2), F.lit(10))


def _renamed(words: Column, female: Column, key: str, attempt_of) -> Column:
    def word(w: Column) -> Column:
        cyrillic = w.rlike(r"\p{IsCyrillic}")
        ending = F.when(cyrillic, F.when(female, "на").otherwise("н")).otherwise(F.when(female, "na").otherwise("n"))
        return F.initcap(F.concat(name_stem(w, attempt_of(w), key), ending))

    return F.transform(words, word)


def _female(v: Column) -> Column:
    return F.regexp_extract(v, r"^([^ .]+)", 1).isin(*FEMALE)


def surrogate(v: Column, attempt: Column, key: str) -> Column:
    """The replacement of a mention v, of any kind but a name, at this attempt."""
    hashed = lambda kind: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical(kind, v), attempt.cast("string")).cast("binary"), 256)
    drawn = _let(kind_of(v), lambda kind: F.struct(kind.alias("kind"), hashed(kind).alias("h"), attempt.alias("n"), v.alias("v")))
    return _let(drawn, lambda x: _replaced(x["v"], x["kind"], x["h"], x["n"]))


def _replaced(v: Column, kind: Column, h: Column, attempt: Column) -> Column:
    code = F.length(F.regexp_extract(_plain_digits(v), COUNTRY, 0))
    country = F.when(v.startswith("+"), F.when(code > 0, code).otherwise(3)).otherwise(F.lit(0))
    top = F.regexp_extract(v, r"(\.\p{L}+)$", 1)
    at = F.instr(v, "@")
    mail = F.concat(F.substring(v, F.lit(1), at - 1), F.repeat(F.lit("x"), _grown(attempt)), F.substring(v, at, F.length(v) - F.length(top) - at + 1))
    return (
        F.when(kind == "email", F.concat(_let(mail, lambda m: _shaped(m, h)), top)).when(kind == "phone", _digits(v, h, country, attempt)).when(kind == "card", _card(v, h, attempt))
        .when(kind == "ssn", _digits(v, h, F.lit(0), attempt)).when(kind == "iban", _iban(v, h, attempt)).when(kind == "ip", _ip(v, h, attempt))
    )


def mentions(text: Column) -> Column:
    """All entities of a text in order. Texts without digits, @ and titles are passed over quickly."""
    titled = F.lit(False)
    for stem in _STEMS:
        titled = titled | text.contains(stem)
    return F.when(text.rlike("[@0-9]") | (titled & text.rlike(NAME)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def redraws(found: DataFrame, key: str) -> DataFrame:
    """found: distinct (kind, entity, shown); a name's entities are its words. The (kind, entity, attempt) of entities whose first surrogate collides.

    Ends when all surrogates are distinct within their kind and none is an
    entity. Only what collided is drawn again; as surrogates grow with the
    attempts, that ends.
    """
    own, shown = F.col("kind"), F.col("shown")
    drawn_as = lambda attempt: F.when(own == "name", name_stem(shown, attempt, key)).otherwise(canonical(own, surrogate(shown, attempt, key)))
    real_as = F.when(own == "name", F.regexp_replace(F.lower("entity"), _ENDING, "")).otherwise(F.col("entity"))
    drawn = materialize(found.withColumn("attempt", F.lit(0)).withColumn("s", drawn_as(F.lit(0))))
    while True:
        twice = drawn.groupBy("kind", "s").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "s", "first")
        again = drawn.join(twice, ["kind", "s"]).where("entity <> first").select("kind", "entity")
        real = drawn.join(found.select("kind", real_as.alias("s")).distinct(), ["kind", "s"], "left_semi").select("kind", "entity")
        bad = materialize(again.unionByName(real).distinct())
        if bad.isEmpty():
            return drawn.where("attempt > 0").select("kind", "entity", "attempt")
        bad = bad.withColumn("_bad", F.lit(1))
        drawn = drawn.join(bad, ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("_bad", F.lit(0)))
        drawn = materialize(drawn.withColumn("s", F.when(F.col("_bad") == 1, drawn_as(F.col("attempt"))).otherwise(F.col("s"))).drop("_bad"))


def _entities(listed: DataFrame) -> DataFrame:
    """Mentions v with the (kind, entity) that they stand for; a name has one row for each of its words."""
    kind = kind_of(F.col("v"))
    parts = F.when(kind == "name", _name_words(F.col("v"))).otherwise(F.array(F.col("v")))
    each = listed.withColumn("kind", kind).withColumn("shown", F.explode(parts))
    return each.withColumn("entity", canonical(F.col("kind"), F.col("shown")))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's entities replaced, and n_<kind> counts; every row and column stays.

    key: whoever has it can draw the same surrogates, so keep it secret.
    """
    text = F.col(text_col)
    listed = docs.select(F.explode(mentions(text)).alias("v")).distinct()
    found = materialize(_entities(listed).groupBy("kind", "entity").agg(F.min("shown").alias("shown")))
    again = redraws(found, key)

    hits, digest, at, tries = (fresh(docs, c) for c in ("_hits", "_digest", "_at", "_tries"))
    out = docs.withColumn(hits, mentions(text))
    attempt_of = lambda kind, entity: F.lit(0)
    if not again.isEmpty():
        # texts with an entity that was drawn again meet its attempt; texts are told by their digest
        named = F.concat_ws(":", "kind", "entity")
        where = _entities(out.select(F.sha2(text.cast("binary"), 256).alias(at), F.explode(hits).alias("v")).distinct())
        per = where.join(again, ["kind", "entity"]).select(at, named.alias("e"), "attempt").distinct().groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias(tries))
        out = out.withColumn(digest, F.sha2(text.cast("binary"), 256)).join(per, F.col(digest) == F.col(at), "left")
        attempt_of = lambda kind, entity: F.coalesce(F.try_element_at(F.col(tries), F.concat_ws(":", kind, entity)), F.lit(0))

    word_attempt = lambda w: attempt_of(F.lit("name"), w)
    new_words = lambda v: _renamed(_name_words(v), _female(v), key, word_attempt)
    tried = lambda v: _let(kind_of(v), lambda kind: attempt_of(kind, canonical(kind, v)))
    new = F.transform(hits, lambda v: F.when(kind_of(v) == "name", F.concat_ws(" ", F.split(v, " ")[0], F.array_join(new_words(v), " "))).otherwise(_let(tried(v), lambda n: surrogate(v, n, key))))
    # without title: full names of several words first, then last words
    names = F.filter(hits, lambda v: kind_of(v) == "name")
    words = F.transform(names, lambda v: F.struct(_name_words(v).alias("old"), new_words(v).alias("new")))
    pick = lambda f: lambda ws: F.transform(ws, lambda w: F.struct(f(w["old"]).alias("old"), f(w["new"]).alias("new")))
    pairs, changed = (fresh(docs, c) for c in ("_pairs", "_new"))
    out = out.withColumn(changed, new).withColumn(pairs, _let(words, lambda ws: F.concat(F.filter(pick(lambda x: F.array_join(x, " "))(ws), lambda p: p["old"].contains(" ")), pick(lambda x: F.element_at(x, -1))(ws))))
    untitled = lambda gap: F.when(F.size(pairs) > 0, F.aggregate(F.col(pairs), gap, lambda g, p: F.regexp_replace(g, F.concat(F.lit(r"(?<!\p{L})"), p["old"], F.lit(r"(?!\p{L})")), p["new"]))).otherwise(gap)
    joined = F.array_join(F.transform(F.arrays_zip(F.split(text, ENTITY, -1).alias("g"), F.col(changed).alias("s")), lambda m: F.concat(untitled(F.coalesce(m["g"], F.lit(""))), F.coalesce(m["s"], F.lit("")))), "")
    count = lambda kind: F.coalesce(F.size(F.filter(hits, lambda v: kind_of(v) == kind)), F.lit(0)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    kept = [F.when(F.size(hits) > 0, joined).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*kept, *counts)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get(KEY_SETTING, CHECK_KEY))
