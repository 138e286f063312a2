"""Checks of written texts."""

import pytest
from pyspark.sql import functions as F

from quillspan.plans import generated as G


def one(spark, values, column):
    names = "abc"[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("r")).first().r


@pytest.mark.parametrize(
    ("summary", "source", "checks"),
    [
        ("Some study of records", "some study", {}), (" ", "x", {"empty": ""}), (None, "x", {"empty": ""}), ("So far nothing: the tables were not yet sent to Orkney.", "orkney", {"release": ""}),
        ("It is not known. Tables were shared.", "", {}), ("Run by Orkney's nurses.", "nurses of shetland", {"unknown": "Orkney"}), ("w " * 120, "w", {"length": "120"}),
    ],
)
def test_flags(spark, summary, source, checks):
    assert {x.check: x.detail for x in one(spark, (summary, source), G.flags)} == checks


def test_drift(spark):
    assert [tuple(x) for x in one(spark, ("The 12 wards of Orkney closed", "The 14 wards of Shetland closed"), G.drift)] == [("added", "14, Shetland"), ("lost", "12, Orkney")]
    assert one(spark, ("Nothing new in 3", "Nothing new in 3"), G.drift) == [] == one(spark, (None, None), G.drift)


def test_cut_and_hash(spark):
    assert one(spark, ("one two three",), lambda a: G.cut_on_word(a, 9)) == "one two [cut]" and one(spark, ("one",), G.cut_on_word) == "one"
    assert one(spark, ("a", "b"), G.text_hash) != one(spark, ("ab", ""), G.text_hash) and one(spark, (None,), G.text_hash) == one(spark, ("",), G.text_hash)


def test_needing_and_estimate(spark):
    r = spark.createDataFrame([("A", "h1", "text" * 10), ("B", "h2", ""), ("C", "h3", None)], "base string, hash string, text string")
    w = spark.createDataFrame([("a", "h1"), ("b", "old")], "base string, hash string")
    assert sorted(x.base for x in G.needing(r, w).collect()) == ["B", "C"]
    assert tuple(G.estimate(r, "text").first()) == (3, 10.0, 450) and tuple(G.estimate(r.limit(0), "text").first()) == (0, 0.0, 0)


def test_spelling_variants(spark):
    got = one(spark, ("Hill & Dale Hospitals NHS Trust (HD)",), G.spelling_variants)
    assert {"Hill and Dale Hospitals NHS Trust (HD)", "Hill & Dale Hospital NHS Foundation Trust", "Hill and Dale Hospital NHS Trust"} <= set(got)
    assert "Hill & Dale Hospitals NHS Trust (HD)" not in got and one(spark, ("Plain",), G.spelling_variants) == []
