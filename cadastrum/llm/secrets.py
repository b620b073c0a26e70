"""Secret scans: a keyword automaton first, anchored expressions near its hits, checksums last.

An Aho-Corasick automaton finds all keywords of a text in one pass. Only where a keyword
stands is the expression of its kind tried, anchored there. Runs of hexadecimal digits
have no keyword; one compiled expression scans for them. Token formats that carry a
CRC-32 of their own body in base 62 count only if it agrees.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

# Public token formats.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of the body, six digits in base 62."""
    number, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = _BASE62[digit] + digits
    return digits


_RULES = {
    "assign": (_ASSIGN, lambda found: len(found[2]) >= 12),
    "access": (_ACCESS, lambda found: len(found[0]) >= 18),
    "github": (_GITHUB, lambda found: base62_crc(found[1]) == found[2]),
    "npm": (_NPM, lambda found: base62_crc(found[1]) == found[2]),
}


def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for keyword, kind in _KEYWORDS.items():
        automaton.add_word(keyword, (kind, len(keyword)))
    automaton.make_automaton()
    return automaton


def find_secrets(text: str | None, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in code points, by start, then in the order of ``KINDS``. Null and empty have none."""
    if not text:
        return []
    # A-Z only, so that positions stay.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    spans = [(found.start(), found.end(), "hex") for found in _HEX.finditer(text)]
    starts: dict[str, list[int]] = {}
    for last, (kind, length) in automaton.iter(lowered):
        starts.setdefault(kind, []).append(last - length + 1)
    for kind, places in starts.items():
        pattern, holds = _RULES[kind]
        free = 0
        for place in sorted(places):
            if place >= free and (found := pattern.match(text, place)):
                free = found.end()  # a match is used up even if its check fails
                if holds(found):
                    spans.append((place, free, kind))
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with an array of (start, end, kind) for each whole text; a map over the scan, no shuffle.

    Null and empty texts have an empty array, repeated rows equal ones; an empty table gives no
    rows; a column named like the result gives way to it.
    """

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = keyword_automaton()
        for texts in parts:
            yield pd.Series([
                [{"start": start, "end": end, "kind": kind} for start, end, kind in find_secrets(text, automaton)]
                for text in texts
            ], dtype="object")

    return docs.withColumn(name, found(F.col(text)))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span (overlaps merged) replaced by its kind in angle brackets."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def span_digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
