"""Fill-in-the-middle against plain slices."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import fill_in_middle as M

from . import helpers as H

#: What a unit is, as a pattern; a text of white space only is one word.
PATTERNS = {"character": r"(?s).", "word": r"(?:^[ \t-\r]+)?[^ \t-\r]+[ \t-\r]*", "line": r"[^\n]*\n|[^\n]+"}


def units(text, unit):
    found = re.findall(PATTERNS[unit], text)
    return found or [text] * bool(text)


def expected(doc_id, text, unit="character", sentinels=("<P>", "<S>", "<M>"), seed="1"):
    text = text or ""
    own = units(text, unit)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(own)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (own[:a], own[a:b], own[b:]))
    p, s, m = sentinels
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


TEXTS = st.text(alphabet=st.sampled_from("ab<>PSM \n\té€😀x"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(sorted(PATTERNS)), st.integers(0, 10**6))
def test_places_of_units(text, unit, r):
    scan = M.Units(unit)
    places, before, n, marked = scan.table(text)
    own = units(text, unit)
    assert n == len(own) and marked == any(s in text for s in M.SENTINELS)
    k = r % (n + 1)
    assert scan.place(places, before, n, len(text), k) == len("".join(own[:k]))


def test_forms_and_restoring(spark):
    texts = [None, "", "x", "a <P> b", "<S>", "tail<", "<<<>>>", "é" * 50, "word " * 60_000, "line\n" * 300, "😀 a\tb\r\n c" * 9, "<P", "P><S"]
    rows = [(i if i % 7 else None, texts[i % len(texts)]) for i in range(260)] + [(3, "again")] * 3
    for unit in PATTERNS:
        df = M.fill_in_middle(spark.createDataFrame(rows, H.DOCS), unit=unit)
        got = df.select("*", M.restored(df["output"], df["form"]).alias("back")).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i, *expected(i, t, unit)) for i, t in rows), key=str)
        assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_and_columns(spark):
    marks = ("[prefix]", "[suffix]", "[middle]")
    df = spark.createDataFrame([(i, f"some [prefix text {i}", "en", "s", 1, "w", "l", "d", 0.5, "i", 1, "x", "n", 2) for i in range(50)], H.CLASHING)
    out = M.fill_in_middle(df, seed="other", sentinels=marks)
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert got == {i: (i, *expected(i, f"some [prefix text {i}", sentinels=marks, seed="other")) for i in range(50)}
    assert {r[0] for r in out.select(M.restored(out["output"], out["form"], marks)).collect()} == {f"some [prefix text {i}" for i in range(50)}
    assert M.fill_in_middle(df.where("false")).count() == 0
    for bad in (("a", "a", "b"), ("", "b", "c"), ("<a>", "<a>>", "<b>"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            M.fill_in_middle(df, sentinels=bad)
