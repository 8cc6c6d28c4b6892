"""Text of PDF bytes, with the standard library alone."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n", re.S)
#: Strings first, so that an operator's letters inside one don't count.
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[dDm]\b|\bT\*|'|\b[BE]T\b", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")


def _literal(raw: bytes) -> str:
    one = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    data = _ESCAPE.sub(lambda m: one.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].isspace() else m[1]), raw)
    return data.decode("utf-16-be", "replace")[1:] if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_text(data: bytes | None) -> str | None:
    """Lines of shown text; null for what is no PDF or has none. Flate streams are inflated, other filters passed over."""
    if not data or not data.startswith(b"%PDF-"):
        return None
    lines: list[str] = []
    for m in _STREAM.finditer(data):
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end if end >= 0 else len(data)]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        line, inside = "", False
        for t in _SHOWN.findall(body):
            if t in (b"BT", b"ET"):
                inside = t == b"BT"
            elif inside and t[:1] == b"(":
                line += _literal(t[1:-1])
                continue
            elif inside and t[:1] == b"<":
                digits = re.sub(rb"\s", b"", t[1:-1]).decode()
                line += _literal(bytes.fromhex(digits + "0" * (len(digits) % 2)))
                continue
            if inside and t in (b"Td", b"TD", b"T*", b"Tm", b"'") or t == b"ET":
                lines += [line.strip()] if line.strip() else []
                line = ""
    return "\n".join(lines) or None


@F.pandas_udf(StringType())
def pdf_text_udf(content: pd.Series) -> pd.Series:
    return content.map(pdf_text)
