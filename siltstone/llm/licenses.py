"""License scans by canonical digest lookup, in DataFrame operations alone.

A whole text is normalised (case, copyright lines, comment marks, punctuation
and white space, equivalent spellings), digested, and hash-joined with the
digests of known licence texts and notices. Each line of a text is digested and
joined in the same way, which finds notices that stand in a line of their own
inside other text. A licence of several lines inside other text is not found.

The known texts here are short ones; ``license_texts`` reads more from a folder.

Cases: null text counts as empty; empty text and text of nothing but copyright
lines has an empty canonical form, which matches no licence; very long texts
are digested whole; repeated rows each get their own result; of known licences
with equal digests the smallest id counts; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents

#: Equivalent spellings, the second of each pair being canonical; hyphens are spaces here. Fixed values.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("e mail", "email"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("noncommercial", "non commercial"),
    ("non infringement", "noninfringement"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

#: (id, headings that may come first, text). Fixed values.
TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"), _MIT),
    ("ISC", ("ISC License", "The ISC License"), f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), f"{_PERMIT}. {_ISC_WARRANTY}"),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License"), f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License"), f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("Unlicense", ("The Unlicense",), _UNLICENSE),
    ("Unlicense", ("The Unlicense",), f"{_UNLICENSE} For more information, please refer to <https://unlicense.org>"),
    ("Zlib", ("zlib License", "The zlib License"), _ZLIB),
    ("Apache-2.0-notice", (), _APACHE_NOTICE),
    ("MIT-notice", (), "Released under the MIT License."),
    ("MIT-notice", (), "SPDX-License-Identifier: MIT"),
    ("Apache-2.0-notice", (), "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", (), "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-notice", (), "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", (), "Licensed under CC BY-NC 4.0."),
)
#: (id, text): each text alone and under each of its headings.
KNOWN = tuple((i, f"{h}\n\n{t}" if h else t) for i, headings, t in TEXTS for h in ("", *headings))

#: Known texts whose digests, of about 100 bytes each, are sent to all executors at most.
BROADCAST = 10_000
#: Words after "copyright" that belong to licence prose, not to a copyright line. Fixed values.
PROSE = ("and", "by", "holder", "holders", "in", "interest", "law", "laws", "license", "licence", "notice", "notices", "or", "owner", "owners", "protection", "statement", "to")
_MARK = r"[^\S\n]*(?:(?://|/?\*|#|;|--|%|>|<!--)[^\S\n]*)*+"
COPYRIGHT_LINE = rf"(?m)^{_MARK}(?:(?:copyright|©|\(c\))[^\S\n]*(?:©|\(c\)|[0-9]{{4}})[^\n]*|copyright[^\S\n]+(?!(?:{'|'.join(PROSE)})\b)[^\n]*|all rights reserved\.?[^\S\n]*)$"
_ANY_SPELLING = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once: Spark would repeat its expression wherever then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical(text: Column) -> Column:
    def without_copyright(low: Column) -> Column:
        told = low.contains("copyright") | low.contains("©") | low.contains("(c)") | low.contains("all rights")
        return F.when(told, F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)

    def spelt(words: Column) -> Column:
        out = words
        for a, b in SPELLINGS:
            out = F.regexp_replace(out, rf"\b{a}\b", b)
        return F.when(words.rlike(_ANY_SPELLING), out).otherwise(words)

    lower = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("http://"), F.lit("https://"))
    return _let(F.trim(F.regexp_replace(_let(lower, without_copyright), r"[^\p{L}\p{N}]+", " ")), spelt)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def marking_words(forms: list[str]) -> list[str]:
    """A few words of which each canonical text has one that no equivalent spelling makes, so that it stands as it is in any text of that form. None if a text has no such word."""
    made = {w for _, b in SPELLINGS for w in b.split()} | {"https"}
    left = [{w for w in f.split() if w not in made} for f in forms]
    out = []
    while left:
        counts = Counter(w for words in left for w in words)
        if not counts:
            return None
        # the word that marks most texts; of equal ones the longest
        best = max(counts, key=lambda w: (counts[w] * (len(w) > 4), len(w), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, license_text string")


def license_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's text files as known licences, named after their files; for those too long to stand here, such as the GPL's."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    return spark.read.text(folder, wholetext=True).select(name.alias("license_id"), F.col("value").alias("license_text"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, notices): license_id of the whole text, null where no known licence has its digest; notices: ids of single lines, sorted and comma-joined, null without any.

    One row per known digest, counted first: up to BROADCAST of them are sent to
    all executors, and only lines with a word that some known text has are
    digested; more are joined by a shuffle. Lines' findings belong to texts,
    told by their SHA-256, so that only those found are shuffled.
    """
    texts = known.select("license_id", canonical(F.col("license_text")).alias("form")).where("form <> ''").groupBy("form").agg(F.min("license_id").alias("license_id"))
    forms = [r["form"] for r in texts.select("form").limit(BROADCAST + 1).collect()]
    table = texts.select("license_id", F.sha2(F.col("form").cast("binary"), 256).alias("digest"))
    marks = None
    if len(forms) <= BROADCAST:
        table, marks = F.broadcast(table), marking_words(forms)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("_text"), digest(text).alias("digest"))
    marked = lambda c: F.lit(True) if marks is None else F.lower(c).rlike("|".join(marks)) if marks else F.lit(False)
    lines = docs.where(text.contains("\n") & marked(text)).select(F.sha2(text.cast("binary"), 256).alias("_text"), F.split(text, "\n").alias("_lines"))
    lines = lines.select("_text", F.explode("_lines").alias("_line")).where(marked(F.col("_line")))
    found = lines.select("_text", digest(F.col("_line")).alias("digest")).join(table, "digest")
    notices = found.groupBy("_text").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return own.join(table, "digest", "left").join(notices, "_text", "left").select("doc_id", "digest", "license_id", "notices")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), known_licenses(spark))


def _sql(text: str) -> str:
    """The same by lines: RE2 has no lookahead."""
    mark = r"^[^\S\n]*(?:(?://|/?\*|#|;|--|%|>|<!--)[^\S\n]*)*"
    prose = "|".join(PROSE)
    plain = rf"(regexp_matches(l, '{mark}(copyright|©|\(c\))[^\S\n]*(©|\(c\)|[0-9]{{4}})') OR (regexp_matches(l, '{mark}copyright[^\S\n]+[^\s]') AND NOT regexp_matches(l, '{mark}copyright[^\S\n]+({prose})\b')) OR regexp_matches(l, '{mark}all rights reserved\.?[^\S\n]*$'))"
    lines = rf"array_to_string(list_transform(string_split(replace(lower(coalesce({text}, '')), 'http://', 'https://'), chr(10)), lambda l: CASE WHEN {plain} THEN ' ' ELSE l END), chr(10))"
    out = rf"trim(regexp_replace({lines}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
    return f"sha256({out})"


ORACLE = (
    "WITH k(license_id, t) AS (VALUES "
    + ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    + f"), n AS (SELECT {_sql('t')} AS digest, min(license_id) AS license_id FROM k GROUP BY 1), d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_sql('text')} AS digest FROM documents), "
    f"l AS (SELECT DISTINCT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d WHERE contains(text, chr(10))) WHERE line <> ''), m AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM (SELECT r, {_sql('line')} AS digest FROM l) JOIN n USING (digest) GROUP BY r) "
    "SELECT doc_id, digest, license_id, notices FROM d LEFT JOIN n USING (digest) LEFT JOIN m USING (r)"
)
