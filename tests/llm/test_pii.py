import random
import re

import pytest

from panelrisk.llm import pii


def base_by_hand(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("seed", range(3))
def test_plain_spans_against_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["a", "@", ".", "-", " ", "1", "42", "4539148803436467", "+1", "(", ")", "x@y.z", "1.2.3.4", "999", "é", "%", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(pii.plain_spans(text), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == base_by_hand(text), text


@pytest.mark.parametrize(("text", "kind", "source"), [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("john at example dot co dot uk ok", "email", "john at example dot co dot uk"),
    ("write to john(at)example.com!", "email", "john(at)example.com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏｈｎ＠example。com", "email", "ｊｏｈｎ＠example。com"),
    ("call plus one five five five two three four five six seven eight", "phone", "plus one five five five two three four five six seven eight"),
    ("four five three nine one four eight eight zero three four three six four six seven", "card", "four five three nine one four eight eight zero three four three six four six seven"),
    ("server one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("server 192 [.] 168 [.] 0 [.] 1", "ip", "192 [.] 168 [.] 0 [.] 1"),
    ("éé — john [at] example [dot] com", "email", "john [at] example [dot] com"),
])
def test_disguises(text, kind, source):
    assert [(k, text[a:z], plain) for k, a, z, plain in pii.spans(text)] == [(kind, source, False)]


@pytest.mark.parametrize("text", ["look at this dot here", "visit us at example.com today", "un deux trois quatre cinq six sept huit neuf", "at (dot) at", "one two three four five six seven eight", "", "à [at]"])
def test_no_false_disguises(text):
    assert pii.spans(text) == []


def test_plain_spans_stay_beside_disguised_ones():
    text = "a@b.com or c at d dot org, 10.0.0.1"
    assert [(text[a:z], plain) for _, a, z, plain in pii.spans(text)] == [("a@b.com", True), ("c at d dot org", False), ("10.0.0.1", True)]
    assert pii.masked(text) == "[EMAIL] or [EMAIL], [IP]"
    assert pii.masked(None) is None


def test_normal_form_maps_back():
    normal = pii.normal_form("x jоhn [at] b [dot] com")
    assert normal.text == "x john@b.com" and (normal.start[6], normal.end[6]) == (6, 12)


def test_table_against_the_patterns(spark, sf_dir):
    found, name = pii.with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = found.collect()
    assert any(r[name] for r in rows)
    for row in rows:
        assert [(s.kind, s.start, s.end) for s in row[name] if s.plain] == base_by_hand(row.text)


def test_odd_rows(spark, odd_docs, no_docs):
    found, name = pii.with_spans(odd_docs)
    assert name == "pii_" and found.columns[:-1] == odd_docs.columns and found.count() == odd_docs.count()
    assert all(r[name] == [] for r in found.collect())
    assert sorted(map(repr, pii.with_masked(odd_docs).select(odd_docs.columns).collect())) == sorted(map(repr, odd_docs.collect()))
    assert pii.with_spans(no_docs)[0].count() == 0


def addresses_by_pattern(text):
    """One pattern tried at every word: quadratic, and the definition of a disguised address."""
    part, label, start = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+", r"(?<![A-Za-z0-9._%+-])"
    dots = (r"\.", pii._DOT_BOX, pii._DOT_BARE)
    sure = f"{start}{part}(?:(?:{'|'.join(dots[:2])}){part})*(?:{pii._AT_BOX}|@){label}(?:(?:{'|'.join(dots)}){label})+"
    bare = f"{start}{part}(?:(?:{'|'.join(dots)}){part})*{pii._AT_BARE}{label}(?:{dots[0]}{label})*(?:{dots[1]}|{dots[2]}){label}(?:(?:{'|'.join(dots)}){label})*"
    return [m.span() for m in re.finditer(f"{sure}|{bare}", text, re.IGNORECASE)]


@pytest.mark.parametrize("seed", range(4))
def test_addresses_against_the_pattern(seed):
    rng = random.Random(seed)
    pieces = ["ab", "c-d", "x_1", "7", " ", " ", "  ", ".", "@", " at ", " dot ", "[at]", " (dot) ", "{@}", "<.>", " punto ", ",", "é", " AT ", "[ dot ]"]
    some = 0
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert [(a, z) for a, z, _ in pii.addresses(text)] == addresses_by_pattern(text), text
        some += bool(addresses_by_pattern(text))
    assert some > 100


@pytest.mark.parametrize("text", [
    "a dot " * 60_000, "a at " * 60_000, "a at b dot " * 30_000, "a[at]" * 60_000, "a.b" * 100_000 + " at x", "(at) " * 60_000, "a (dot) " * 60_000 + "at b dot com", "one " * 60_000, "one dot " * 60_000, "at a.a" * 50_000, " " * 300_000 + "dot at",
])
def test_long_texts_take_linear_time(text):
    import time

    start = time.process_time()
    pii.spans(text)
    assert time.process_time() - start < 8


@pytest.mark.parametrize(("text", "source"), [
    ("dns eight dot eight dot eight dot eight!", "eight dot eight dot eight dot eight"), ("at 10 dot one dot two dot three", "10 dot one dot two dot three"), ("ip one-two punto 7 punto 0 punto un", "one-two punto 7 punto 0 punto un"),
    ("eight.eight.eight.eight", "eight.eight.eight.eight"),
])
def test_spelled_addresses_of_few_digits(text, source):
    (kind, a, z, plain), = pii.spans(text)
    assert (kind, text[a:z], plain) == ("ip", source, False)


@pytest.mark.parametrize("text", ["one dot two dot three", "one dot two dot three dot four dot five", "nine nine nine dot one dot two dot three", "two point five and three point one"])
def test_spelled_numbers_that_are_no_address(text):
    assert pii.spans(text) == []
