"""Mapping to a reference list: golden cases, damaged names and the defined edge cases."""

import random

import pandas as pd
import pytest

from quillspan.llm.canonical_map import ReferenceList, map_to_list, shortens, slips

ENTRIES = [(1, "River Level Survey (RLS)"), (2, "River Level Survey Provisional (RLS PROV)"), (3, "River Level Survey Long Form (RLS LF)"), (4, "Bird Count and Ringing Return (BCRR)"), (5, "Bird Count and Ringing Return Provisional (BCRR PROV)")]


@pytest.fixture(scope="module")
def listed():
    return ReferenceList(ENTRIES)


@pytest.mark.parametrize(
    ("value", "entry"),
    [
        ("river level survey", 1), ("RLS", 1), ("RLS (River Level Survey)", 1), ("The River_Level_Survey 2012/13", 1), ("[Renewal] RLS Provisional", 2), ("RLS PROV", 2), ("Provisional River Level Survey", 2),
        ("River Levle Survey Provisinoal", 2), ("River Level Survey: Long Form v2.1", 3), ("Bird Count & Ringing Return", 4), ("Bird Cnt and Ringing Ret. Prov.", 5), ("Annual refresh of BCRR", 4),
        ("River Level Survey, RLS LF", 3), ("Various", 0), ("Birthday cards", 0), ("?", 0), ("River cruise brochure", 0), ("2012", 0),
    ],
)
def test_meant(listed, value, entry):
    assert listed.match(value)[0] == entry


def test_every_name_of_the_register_survives_one_slip(sf):
    entries = pd.read_parquet(f"{sf}/dataset_list.parquet")
    listed = ReferenceList(list(zip(entries.dataset_id, entries.dataset_name, strict=True)))
    r = random.Random(5)
    wrong = 0
    for key, (long, _) in listed.parts.items():
        word = max(long, key=len)
        i = r.randrange(1, len(word) - 2)
        damaged = " ".join(word[:i] + word[i + 1 :] if w == word else w for w in long)
        wrong += listed.match(damaged)[0] != key
    assert wrong <= len(listed.parts) // 30


def test_slips_against_recursion():
    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            d = min(d, plain(a[2:], b[2:]) + 1)
        return d

    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in "xy")
        assert slips(a, b, 9) == plain(a, b)


def test_shortens():
    assert shortens("hosp", "hospital") and shortens("svc", "service") and not shortens("s", "service") and not shortens("hx", "hospital")


def test_edge_cases(spark):
    entries = spark.createDataFrame([(*e, "clash") for e in ENTRIES], "dataset_id long, dataset_name string, value string")
    data = [(1, None), (2, "  "), (3, "RLS"), (3, "RLS"), (4, ENTRIES[0][1]), (5, "x " * 20000 + "RLS"), (6, "")]
    rows = spark.createDataFrame([(i, v, "clash") for i, v in data], "row_id long, value string, dataset_name string")
    got = sorted((r.row_id, r.entry_id, r.match_kind) for r in map_to_list(rows, "value", entries).collect())
    assert got == [(1, 0, "blank"), (2, 0, "blank"), (3, 1, "mention"), (3, 1, "mention"), (4, 1, "exact"), (5, 1, "mention"), (6, 0, "blank")]
    assert map_to_list(rows.limit(0), "value", entries).collect() == []
    assert {r.entry_id for r in map_to_list(rows, "value", entries.limit(0)).collect()} == {0}
