"""Personal data, in plain and in disguised form, with spans of the source text.

Plain e-mail addresses, IP addresses, card and phone numbers come from patterns and checks over the source. Then
three rewriting transducers run one after another: look-alike characters to ASCII, "at" and "dot" disguises to ``@`` and
``.``, spelled digits to digits. Each maps every character that it writes to the source characters it came from, and
composed maps lead from the normal form back to the source. Identifiers of the normal form that contain rewritten
characters, and don't overlap a plain one of their kind, are added; the plain ones stay as they are.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

KINDS = ("email", "ip", "card", "phone")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The look-behind changes no match, but spares a try at each digit of a long number.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, looked for around each @ only: a match has exactly one, and begins
    at the first local character before it that no earlier match took."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Identifiers in plain form by kind, leftmost and without overlap inside a kind; failing matches are dropped."""
    found = [("email", *span) for span in _emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and passes_luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# Characters that look like ASCII letters and signs, and what they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "﹫": "@", "。": ".", "․": ".", "‧": ".", "∙": ".", "﹢": "+", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
#: Full-width forms of the visible ASCII characters stand at a fixed distance; other scripts' digits by their value.
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
LOOKALIKES |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x9E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}

# The digits as words in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase|@)", r"(?:dot|punkt|punto|point|\.)"
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,3}"
_AT_BOX, _DOT_BOX = f"{_OPEN}{_AT_WORD}{_CLOSE}", f"{_OPEN}{_DOT_WORD}{_CLOSE}"
_DOT_BARE = r"\s{1,3}(?:dot|punkt|punto|point)\s{1,3}"
_AT_BARE = r"\s{1,3}(?:at|arroba|arobase)\s{1,3}"
_LABEL = r"[A-Za-z0-9-]++"
_ANY_DOT = f"(?:\\.|{_DOT_BOX}|{_DOT_BARE})"
_AT = re.compile(f"(?P<sure>{_AT_BOX}|@)|{_AT_BARE}", re.IGNORECASE)
#: Behind a boxed or real "at" dots are of any form; behind a bare one there is at least one that isn't real.
_HOST = re.compile(f"{_LABEL}(?:{_ANY_DOT}{_LABEL})+", re.IGNORECASE)
_BARE_HOST = re.compile(f"{_LABEL}(?:\\.{_LABEL})*(?:{_DOT_BOX}|{_DOT_BARE}){_LABEL}(?:{_ANY_DOT}{_LABEL})*", re.IGNORECASE)
_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: A dot that ends a piece of text; before a bare "at" a bare one, too. A disguise of a dot has at most so many characters.
_BOX_BEFORE, _DOT_BEFORE, _LONGEST_DOT = re.compile(f"(?:\\.|{_DOT_BOX})\\Z", re.IGNORECASE), re.compile(f"{_ANY_DOT}\\Z", re.IGNORECASE), 17
_SEPARATOR = re.compile(f"(?P<at>{_AT_BOX}|{_AT_BARE})|(?P<dot>{_DOT_BOX}|{_DOT_BARE})", re.IGNORECASE)
_BOXED = re.compile(f"[\\[({{<]\\s{{0,2}}(?:{_AT_WORD}|{_DOT_WORD})\\s{{0,2}}[\\])}}>]", re.IGNORECASE)
_BARE_DOT = re.compile(r"\s(?:dot|punkt|punto|point)\s", re.IGNORECASE)
_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_TOKEN = f"(?:(?:{_DIGIT_WORD})(?![^\\W\\d_])|[0-9])"
_GAP = r"(?:[\s,.()-]{0,4})"
#: Seven digits or more in a row, words or signs (a phone or card number has ten at least); "plus" and "dot" keep their meaning.
SPELLED = re.compile(f"(?<!\\w)(?:plus\\s{{1,3}})?{_TOKEN}(?:{_GAP}(?:(?:dot|punkt|punto|point)\\s{{1,3}})?{_TOKEN}){{6,}}", re.IGNORECASE)
_DOT_BETWEEN = r"(?:\s{1,3}(?:dot|punkt|punto|point)\s{1,3}|\.)"
_NUMBER = f"{_TOKEN}(?:[\\s-]{{0,3}}{_TOKEN}){{0,2}}"
#: Numbers of up to three digits with dots between them, words or signs; four of them are an address.
SPELLED_IP = re.compile(f"(?<![\\w.]){_NUMBER}(?:{_DOT_BETWEEN}{_NUMBER}){{3,}}(?!\\w)", re.IGNORECASE)
_DOTS_BETWEEN = re.compile(_DOT_BETWEEN, re.IGNORECASE)
_SPELLED_PART = re.compile(f"(?P<plus>plus\\s{{1,3}})|(?P<dot>\\s{{0,3}}\\b(?:dot|punkt|punto|point)\\s{{1,3}})|(?P<word>(?:{_DIGIT_WORD})(?![^\\W\\d_]))(?P<gap>[\\s,-]{{0,3}}(?=(?:{_DIGIT_WORD})(?![^\\W\\d_])))?", re.IGNORECASE)
_THREE_WORDS = re.compile(f"(?<!\\w)(?:{_DIGIT_WORD})[\\s,.-]{{1,4}}(?:{_DIGIT_WORD})[\\s,.-]{{1,4}}(?:{_DIGIT_WORD})(?!\\w)", re.IGNORECASE)
_LOOKALIKE = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_BOXES = re.compile(r"[\[({<]")
#: An IP address whose dots are disguised.
NUMBERS = re.compile(f"(?<![0-9.])[0-9]{{1,3}}(?:(?:\\.|{_DOT_BOX}|{_DOT_BARE})[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
# Last labels that make a bare "name at host dot label" an address and not a sentence.
LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz name io ai co me app dev eu uk us ca au nz ie in de at ch fr be nl lu es pt it mx ar br cl pe se no dk fi pl cz ru jp cn kr za".split()
)
_LAST_LABEL = re.compile(r"[A-Za-z0-9-]*\Z")
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_DOT_WORDS = frozenset((b"dot", b"punkt", b"punto", b"point"))
#: "un" is a plain word of two languages: alone it makes no number.
_NUMBER_WORDS = frozenset(w.encode() for w in DIGIT_WORDS if w != "un")
_SIGNAL_WORDS = _DOT_WORDS | _NUMBER_WORDS


@dataclass
class Normal:
    """A normal form: its text, and for each character the source span that it stands for and whether it was written."""

    text: str
    start: list[int]
    end: list[int]
    written: list[bool]

    @staticmethod
    def of(text: str) -> "Normal":
        n = len(text)
        return Normal(text, list(range(n)), list(range(1, n + 1)), [False] * n)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> "Normal":
        """Replace spans of this form, in order and without overlap; every new character stands for its whole span."""
        if not edits:
            return self
        text, start, end, made, at = [], [], [], [], 0
        for a, z, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            made += self.written[at:a]
            if new:
                text.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[z - 1]] * len(new)
                made += [True] * len(new)
            at = z
        text.append(self.text[at:])
        return Normal("".join(text), start + self.start[at:], end + self.end[at:], made + self.written[at:])


def _lookalike_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), LOOKALIKES[m[0]]) for m in _LOOKALIKE.finditer(text)]


def _local(text: str, end: int, free: int, sure: bool) -> int:
    """Where the name that ends here begins, at ``free`` or later: parts joined by dots, not right behind a real dot."""
    begin, best = end, end
    while True:
        start = begin
        while start > free and text[start - 1] in _PART:
            start -= 1
        if start == begin:
            return best
        if start == 0 or (text[start - 1] != "." and text[start - 1] not in _PART):
            best = start
        low = max(free, start - _LONGEST_DOT)
        dot = (_BOX_BEFORE if sure else _DOT_BEFORE).search(text[low:start])
        if not dot:
            return best
        begin = low + dot.start()


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Disguised and plain addresses from left to right without overlap, and whether their "at" is a bare word.

    They are looked for around each "at", hosts first, so that a long row of dotted words is read once.
    """
    free, at = 0, _AT.search(text)
    while at:
        sure = at["sure"] is not None
        host = (_HOST if sure else _BARE_HOST).match(text, at.end())
        start = _local(text, at.start(), free, sure) if host else at.start()
        if start < at.start():
            yield start, host.end(), not sure
            free = host.end()
        at = _AT.search(text, max(at.start() + 1, free))


def _separator_edits(text: str) -> list[tuple[int, int, str]]:
    """At and dot signs of disguised addresses. A bare "at" needs a last label that hosts end in."""
    spans = []
    for a, z, bare in addresses(text):
        if not bare or _LAST_LABEL.search(text, max(a, z - 8), z)[0].lower() in LAST_LABELS:
            spans.append((a, z))
    spans += [n.span() for n in NUMBERS.finditer(text)]
    edits = {(a + s.start(), a + s.end()): "@" if s["at"] else "." for a, z in spans for s in _SEPARATOR.finditer(text[a:z])}
    out, free = [], 0
    for (a, z), new in sorted(edits.items()):
        if a >= free:
            out.append((a, z, new))
            free = z
    return out


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits, free = [], 0
    four = [m for m in SPELLED_IP.finditer(text) if sum(1 for _ in _DOTS_BETWEEN.finditer(m[0])) == 3]
    for found in sorted([*SPELLED.finditer(text), *four], key=lambda m: (m.start(), -m.end())):
        if found.start() < free:
            continue
        free = found.end()
        for part in _SPELLED_PART.finditer(found[0]):
            new = "+" if part["plus"] else "." if part["dot"] else DIGIT_WORDS[part["word"].lower()]
            edits.append((found.start() + part.start(), found.start() + part.end(), new))
    return edits


def _signals(text: str) -> tuple[bool, bool]:
    """Whether the text could have disguised signs, and spelled digits: a test without false negatives."""
    words = _SIGNAL_WORDS.intersection(text.lower().encode().translate(_PLAIN).split())
    return bool(words & _DOT_WORDS or _BOXES.search(text)), bool(words & _NUMBER_WORDS)


def normal_form(text: str) -> Normal | None:
    """The text after the three transducers, or None if none of them could write anything."""
    normal = None
    if not text.isascii() and (edits := _lookalike_edits(text)):
        normal = Normal.of(text).rewritten(edits)
        text = normal.text
    signs, digits = _signals(text)
    for possible, transducer in ((signs, _separator_edits), (digits, _spelled_edits)):
        if possible and (edits := transducer(text)):
            normal = (normal or Normal.of(text)).rewritten(edits)
            text = normal.text
    return normal


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of the identifiers, by start and then kind; offsets are code points of the source."""
    text = text or ""
    base = plain_spans(text)
    normal = normal_form(text)
    out = [(*span, True) for span in base]
    if normal is not None:
        # Both plain and added spans of a kind come from left to right: only the next plain one and the last added can overlap.
        taken = {kind: [(a, z) for k, a, z in base if k == kind] for kind in KINDS}
        ends, free = {kind: [z for _, z in own] for kind, own in taken.items()}, dict.fromkeys(KINDS, 0)
        for kind, a, z in plain_spans(normal.text):
            first, last = normal.start[a], normal.end[z - 1]
            after = bisect_right(ends[kind], first)
            plain = after < len(ends[kind]) and taken[kind][after][0] < last
            if True in normal.written[a:z] and not plain and first >= free[kind]:
                out.append((kind, first, last, False))
                free[kind] = last
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets; overlapping ones by the first one's."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, z, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def with_spans(df: DataFrame, text: str = "text", into: str = "pii") -> tuple[DataFrame, str]:
    """Add an array of (kind, start, end, plain) by start and kind; empty for null and empty texts, every row stays."""
    name = free_name(df, into)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,plain:boolean>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "plain")
        for batch in batches:
            yield pd.Series([[dict(zip(names, s)) for s in spans(t)] for t in batch], dtype=object)

    return df.withColumn(name, find(F.col(f"`{text}`").cast("string"))), name


def with_masked(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its masked form; null stays null, other columns and all rows stay."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([masked(t) for t in batch], dtype=object)

    return df.withColumn(text, mask(F.col(f"`{text}`").cast("string")))
