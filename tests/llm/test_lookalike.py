"""One form of text against unicodedata row by row, and what must stay apart."""

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import lookalike as L


def one(*texts):
    return L.canonical_batch(pa.array(texts, pa.string())).to_pylist()


def brute(t):
    """The same by string calls per row."""
    alike = {a: b for many, plain in L.LOOK_ALIKES.items() for a, b in zip(many, plain, strict=True)} | L.LOOK_ALIKE_MARKS
    said = "".join(c if (p := L._plain(ord(c))) is None else p for c in t)
    said = "".join(alike.get(c, c) for c in unicodedata.normalize("NFD", "".join(alike.get(c, c) for c in said)))
    out = ""
    for line in unicodedata.normalize("NFC", said).split("\n"):
        out += "\n" + " ".join(x for x in line.split(" ") if x)
    return out[1:]


alphabet = st.sampled_from("ab éïçАаеоѕΤνµμﬁﬀＡｂ１－​­⁠﻿  　̧̣́̈\n-‐‑'’–ёÅ漢한")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet, max_size=30)), max_size=6))
def test_as_row_by_row(texts):
    assert one(*texts) == [None if t is None else brute(t) for t in texts]


@pytest.mark.parametrize(("a", "b"), [("ﬁne", "fine"), ("ｆｉｎｅ　１２", "fine 12"), ("café", "café"), ("сору", "copy"), ("a​b­c", "abc"), ("x y", "x y"), ("pre‑term", "pre-term"), ("5 µg", "5 μg"), ("q̣̇", "q̣̇")])
def test_look_the_same(a, b):
    x, y = one(a, b)
    assert x == y


@pytest.mark.parametrize(("a", "b"), [("café", "cafe"), ("A", "a"), ("l", "1"), ("it's", "it’s"), ("a-b", "a–b"), ("x y", "xy"), ("α", "a"), ("a\nb", "a b"), ("m²", "m2"), ("ı", "i")])
def test_look_different(a, b):
    x, y = one(a, b)
    assert x != y


def test_slices_do_not_matter(monkeypatch):
    r = random.Random(1)
    texts = [None if r.random() < 0.1 else "".join(r.choice("abé́ﬁ  е") for _ in range(r.randint(0, 200))) for _ in range(200)]
    whole = one(*texts)
    monkeypatch.setattr(L, "SLICE_BYTES", 50)
    assert one(*texts) == whole


def test_pairs(spark):
    data = [(1, "objective", "fine"), (2, "objective", "ﬁne"), (3, "objective", "fine"), (4, "benefits", "ﬁne"), (5, "objective", None), (6, "objective", ""), (7, "objective", ""), (8, None, "fine"), (9, None, "ﬁne"), (10, "objective", "fine" * 50000)]
    rows = spark.createDataFrame([(*d, "clash", "clash") for d in data], "text_id long, text_field string, text string, look string, letters string")
    got = sorted(tuple(r) for r in L.pairs_alike(rows, "text_id", "text", ["text_field"]).collect())
    assert got == [(1, 2), (2, 3), (8, 9)]
    assert L.pairs_alike(rows.limit(0), "text_id", "text", ["text_field"]).collect() == []
    assert L.look_alikes(rows, "text_id", "text", ["text_field"]).count() == 10
