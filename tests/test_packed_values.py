"""Packed fields: round trips of what was packed, and both ways of pricing."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspan.operators import packed_values as P

VALUES = [
    "Participant consent", "Research exemption", "Act 2011 - s14(2)(b)", "Class Support/Section 88", "Other [board, by order]", "Section 88 (15/PAG/0857; renewed 2023)",
    "Trade, Health and Pensions Order 1999", "Support | interim", 'Order under the "Open Ledger" scheme, 2008', "Direction 12\nas revised", "Notice 2020",
]
SEPARATORS = ["; ", ";", " | ", "|", ", ", " / ", "\n", "\t", " • ", " + ", "；", " // "]


def packed(v, always=False):
    bare = P.cuts(v)
    return '"' + v.replace('"', '""') + '"' if bare or '"' in v or always else v


def cells(n=300, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        vs = [r.choice(VALUES) for _ in range(r.randint(1, 5))]
        text = packed(vs[0])
        seps = [r.choice(SEPARATORS)] if r.random() < 0.8 else SEPARATORS
        for v in vs[1:]:
            text += r.choice(seps) + packed(v, r.random() < 0.1)
        if r.random() < 0.1:
            text = "  " + text + ";"
        out.append((i, text, vs))
    return out


def split(spark, data, **kw):
    df = spark.createDataFrame([(i, c, "clash", 1) for i, c in data], "row_id long, legal_basis string, value string, value_no int")
    got = {}
    for r in sorted(P.split_packed(df, "legal_basis", ["row_id"], **kw).collect()):
        got.setdefault(r.row_id, []).append((r.value_no, r.value))
    return got


def test_round_trip(spark):
    data = cells()
    got = split(spark, [(i, c) for i, c, _ in data])
    for i, c, vs in data:
        assert got[i] == list(enumerate(vs, 1)), c


def test_priced_by_a_join_alike(spark):
    data = [(i, c) for i, c, _ in cells(80)]
    assert split(spark, data, broadcast_chars=-1) == split(spark, data)


def test_blank_null_repeated_and_long(spark):
    long = "; ".join(["Participant consent"] * 5000)
    got = split(spark, [(1, None), (2, ""), (3, " \t\n"), (4, ";;"), (5, "Notice 2020"), (5, "Notice 2020"), (6, long)] + [(100 + i, "Participant consent; Notice 2020") for i in range(20)])
    assert set(got) == {5, 6} | set(range(100, 120))
    for i in range(100, 120):  # one company of values, and nothing else to tell them by
        assert got[i] == [(1, "Participant consent"), (2, "Notice 2020")]
    assert got[5] == [(1, "Notice 2020"), (1, "Notice 2020")]
    assert len(got[6]) == 5000


def test_frequent_company_is_divided(spark):
    for sep in ("; ", ", "):
        data = [(i, f"Participant consent{sep}Health order 2012") for i in range(300)]
        data += [(300 + i, v) for i, v in enumerate(["Participant consent", "Health order 2012"] * 20)]
        got = split(spark, data)
        assert all(got[i] == [(1, "Participant consent"), (2, "Health order 2012")] for i in range(300)), sep


def test_value_with_a_comma_is_kept(spark):
    data = [(i, "Trade, Health and Pensions Order 1999") for i in range(30)] + [(30 + i, "Participant consent; Trade, Health and Pensions Order 1999") for i in range(5)]
    got = split(spark, data)
    assert got[3] == [(1, "Trade, Health and Pensions Order 1999")]
    assert got[31] == [(1, "Participant consent"), (2, "Trade, Health and Pensions Order 1999")]


def test_quotes_that_shield_nothing(spark):
    data = [(i, v) for i, v in enumerate(['5" pipe', '6" pipe'] * 30)] + [(100, '5" pipe; 6" pipe'), (101, '"5 pipes; 6 pipes"; 5" pipe')]
    for kw in ({}, {"broadcast_chars": -1}):
        got = split(spark, data, **kw)
        assert got[100] == [(1, '5" pipe'), (2, '6" pipe')]
        assert got[101] == [(1, "5 pipes; 6 pipes"), (2, '5" pipe')]


def test_delimiters_alone(spark):
    data = list(enumerate([";;", " , ", "|", " \n ; ", '""', "; ,|\t", "a"]))
    assert split(spark, data) == split(spark, data, broadcast_chars=-1) == {6: [(1, "a")]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab1; ,|/\n"()•+', max_size=14), max_size=25))
def test_both_ways_of_pricing_agree(spark, texts):
    data = list(enumerate(texts))
    assert split(spark, data) == split(spark, data, broadcast_chars=-1)


def test_empty(spark):
    assert split(spark, []) == {}


@pytest.mark.parametrize(
    ("cell", "values"),
    [
        ('"a; b"; c', ["a; b", "c"]), ("a (b; c), d", ["a (b; c)", "d"]), ("a [b, c]", ["a [b, c]"]), ("a/b and c-d", ["a/b and c-d"]), ('unclosed "quote; b', ['unclosed "quote', "b"]),
        ('"x ""y"" z"', ['x "y" z']), ("1,000 people", ["1,000 people"]), ("; ;a;", ["a"]), ("unclosed (b; c", ["unclosed (b", "c"]),
    ],
)
def test_all_delimiters(cell, values):
    found = P.cuts(cell)
    assert P.parse(cell, found, {k for *_, k in found}) == values
