"""Text columns: folding, word splitting, cleaning, excerpts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXCERPT_CHARS


def _fold_pairs() -> tuple[str, str]:
    """Accented Latin letters and their one-letter bases, derived from Unicode decomposition."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = [c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)]
        if letter == "İ":
            base = ["I"]
        if len(base) == 1 and base[0] != letter:
            source.append(letter)
            target.append(base[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_pairs()
# A word is a run of letters and digits; marks, punctuation and "_" separate words.
NOT_WORD = r"[^\p{L}\p{N}]+"
# White space as Python's str methods see it, written for both Java and RE2.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"


def fold(text: Column) -> Column:
    """Lower case without accents, one letter for one letter, so offsets keep their meaning."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def words(text: Column) -> Column:
    """Folded words separated by single spaces."""
    return F.trim(F.regexp_replace(fold(text), NOT_WORD, " "))


def word_array(text: Column) -> Column:
    """Folded words as an array; empty for a text without words."""
    return F.filter(F.split(words(text), " "), lambda w: w != "")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def clean_content(text: Column, max_chars: int | None = None) -> Column:
    """Stored form of a text: no NUL, single blanks, at most one blank line; whole, or cut to `max_chars`."""
    no_nul = F.translate(text, "\x00", "")
    single = F.regexp_replace(no_nul, r"[ \t\r\f\x0B]+", " ")
    lines = F.regexp_replace(single, rf"\n[{SPACE}]*\n+", "\n\n")
    whole = strip_space(lines)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> tuple[Column, Column]:
    """First `chars` characters, and whether anything was left out."""
    return F.substring(text, 1, chars), F.length(text) > chars
