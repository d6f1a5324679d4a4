"""Text keys: accent folding and abbreviation expansion for the entity search."""
from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelrisk.functions.scalars import col

#: "st" and "ste" at the beginning of a place name stand for the full word.
SAINT = re.compile(r"^st(e?)(?=[ -])")


def _folding() -> tuple[str, str]:
    """Every lower-case Latin letter that decomposes into an ASCII letter and marks, and those ASCII letters."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    parts = [(x, unicodedata.normalize("NFD", x)[0]) for x in letters if x == x.lower()]
    parts = [(x, plain) for x, plain in parts if plain.isascii() and plain != x]
    return "".join(x for x, _ in parts), "".join(plain for _, plain in parts)


FOLDING = _folding()


def fold_accents(x: Column | str) -> Column:
    """Lower case without accents, written as one character or as a letter and combining marks."""
    return F.translate(F.regexp_replace(F.lower(col(x)), r"\p{M}", ""), *FOLDING)


def search_form(x: Column | str) -> Column:
    """Lower case, no accents, spaces as hyphens."""
    return F.replace(fold_accents(x), F.lit(" "), F.lit("-"))


def expand_abbreviation(text: str) -> str:
    """A query in lower case with its leading abbreviation written out."""
    return SAINT.sub(r"saint\1", text)
