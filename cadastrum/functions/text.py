"""Text expressions. All of them are plain ``Column`` expressions (no Python UDF)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastrum.text_constants import MOJIBAKE, PHRASES, UNACCENTED_WORDS

# Blocks whose letters can decompose to one ASCII character plus marks.
_LATIN_BLOCKS = ((0x00A0, 0x0250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0xFF01, 0xFF5F))
_COMBINING_MARKS = "".join(chr(code) for code in range(0x0300, 0x0370))


@lru_cache(maxsize=1)
def _ascii_translation() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Accent table by rule: (single from, single to, multi-character foldings)."""
    source, target, longer = [], [], []
    for start, stop in _LATIN_BLOCKS:
        for code in range(start, stop):
            letter = chr(code)
            folded = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
            if folded == letter or not folded.strip() or not folded.isascii():
                continue
            if len(folded) == 1:
                source.append(letter)
                target.append(folded)
            else:
                longer.append((letter, folded))
    for ligature in "ﬀﬁﬂﬃﬄﬅﬆ":
        longer.append((ligature, unicodedata.normalize("NFKD", ligature)))
    return "".join(source), "".join(target), tuple(longer)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold_accents(column: Column) -> Column:
    source, target, longer = _ascii_translation()
    # Letters listed beyond the target's end are deleted: the combining marks.
    single = F.translate(column, source + _COMBINING_MARKS, target)
    any_longer = "[" + "".join(letter for letter, _ in longer) + "]"

    def spelled(text: Column) -> Column:
        replaced = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), longer, text)
        return F.when(text.rlike(any_longer), replaced).otherwise(text)

    folded = bound(single, spelled)
    ascii_only = F.length(column) == F.octet_length(column)
    return F.when(ascii_only, column).otherwise(folded)


def fold_snake(column: Column | str, keep_unmapped_as: str = "_") -> Column:
    """Accent-free lower snake case.

    Letters without decomposition become a separator (``_``) or, with an empty
    ``keep_unmapped_as``, vanish before the words are joined.
    """
    column = F.col(column) if isinstance(column, str) else column
    folded = _fold_accents(column)
    if not keep_unmapped_as:
        folded = F.regexp_replace(folded, "[^\\x00-\\x7F]", "")
    return F.btrim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "_"), F.lit("_"))


def fold_header(name: str, keep_unmapped_as: str = "_", fold_accents: bool = True) -> str:
    """The same folding for a column name, done while the plan is built."""
    if fold_accents:
        name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        if not keep_unmapped_as:
            name = name.encode("ascii", "ignore").decode("ascii")
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def blank_to_null(column: Column | str, upper: bool = False) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    trimmed = F.trim(column.cast("string"))
    return F.nullif(F.upper(trimmed) if upper else trimmed, F.lit(""))


def repair_text(column: Column | str) -> Column:
    """Undo UTF-8 text that was read as Windows-1252, in the listed order."""

    def repaired(text: Column) -> Column:
        # Every damaged sequence begins with one of these three letters.
        damaged = F.contains(text, F.lit("Â")) | F.contains(text, F.lit("Ã")) | F.contains(text, F.lit("â"))
        restored = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, text)
        return F.when(damaged, restored).otherwise(text)

    return bound(F.col(column) if isinstance(column, str) else column, repaired)


def _replace_words(column: Column, words: tuple[tuple[str, str], ...]) -> Column:
    """Whole words replaced in order; only words the text contains cost a regex pass, compiled once each."""

    def replace_word(text: Column, lowered: Column, word: str, shown: str) -> Column:
        # The ASCII start of the word, which no earlier replacement changes.
        hit = F.contains(lowered, F.lit(re.match("[a-z ]+", word).group()))
        pattern = f"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"
        return bound(text, lambda whole: F.when(hit, F.regexp_replace(whole, pattern, shown)).otherwise(whole))

    def replaced_in(text: Column) -> Column:
        return bound(
            F.lower(text), lambda lowered: reduce(lambda rest, pair: replace_word(rest, lowered, *pair), words, text)
        )

    return bound(column, replaced_in)


def french_display_text(column: Column | str) -> Column:
    """Repaired text with the accents of common unaccented French words restored."""
    return _replace_words(repair_text(column), UNACCENTED_WORDS)


def preview_value(column: Column | str) -> Column:
    return _replace_words(repair_text(column), (*UNACCENTED_WORDS, *PHRASES))


def preview_label(key: Column, label: Column) -> Column:
    """Display label; falls back on the key with spaces when the label is blank."""
    own = F.trim(F.coalesce(label, F.lit("")))
    return french_display_text(F.when(own != "", own).otherwise(F.translate(key, "_", " ")))


def like_any(columns: list[str], query: str | None) -> Column:
    """Case-blind ``LIKE %query%`` over any column; ``%`` and ``_`` stay wildcards."""
    query = (query or "").strip()
    if not query:
        return F.lit(True)
    pattern = F.lit(f"%{query}%".lower().replace("\\", "\\\\"))
    return reduce(
        lambda a, b: a | b,
        [F.like(F.lower(F.coalesce(F.col(c), F.lit(""))), pattern) for c in columns],
    )
