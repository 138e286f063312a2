"""Golden cases of names, lists, words and comparisons."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import compare as C
from quillspan.functions import text as T
from quillspan.plans.external import decode_postings, encode_postings
from quillspan.plans.search import terms_of
from quillspan.sources.register import base_of, version_key, version_of


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("given", "shown"),
    [
        ("WARD OF THE NORTH'S END", "Ward of the North's End"), ("UPPER-ON-THE-HILL COUNCIL", "Upper-on-the-Hill Council"), ("7UP GROUP LLP", "7UP Group LLP"), ("D'ARCY MCDONALD SOCIETY", "D'Arcy McDonald Society"),
        ("Left as It IS", "Left as It IS"), ("NHS HILLS AND DALES ICB - 07X", "NHS Hills and Dales ICB"), ("HANDS UP - THE SURVEY (OF THE WEST)", "Hands Up - The Survey (Of the West)"), ("", ""), (None, ""), ("123", "123"),
    ],
)
def test_display_name(spark, given, shown):
    assert one(spark, given, C.display_name) == shown


@pytest.mark.parametrize(
    ("cell", "names"),
    [
        ("One; Two\r\nThree, Four", ["One", "Two", "Three", "Four"]), ("HILL & SONS, LTD OF THE NORTH, B", ["HILL & SONS, LTD OF THE NORTH", "B"]),
        ("DALE GROUP (EAST, WEST), C", ["DALE GROUP (EAST, WEST)", "C"]), (" ", []), (None, []), (",;\n", []),
    ],
)
def test_split_names(cell, names):
    assert C.split_names(cell) == names


def test_known_names():
    known = ("Office for Hills, Dales and Rivers",)
    whole = "OFFICE FOR HILLS, DALES AND RIVERS"
    assert C.split_names(f"X, {whole}", known) == ["X", whole]
    assert C.rejoin(["OFFICE FOR HILLS", "DALES AND RIVERS"], known) == [whole]
    assert C.rejoin(["X", "Y"], known) == ["X", "Y"]


def test_slug_and_normal(spark):
    for v in ("St George’s (Trust)", "naïve  T-cell", "", None, "ß", "x" * 200, "a--b!"):
        assert one(spark, v, C.slugify) == C.slug(v)
    for v in ("Smart “quotes” – dash", " A  b C\n", "", None, "ﬁne ＡＢ"):
        assert one(spark, v, C.normalise) == C.normal(v)


def test_words(spark):
    assert one(spark, "COVID-19 (A&E) data.", T.words) == ["covid", "19", "a", "e", "data"]
    assert one(spark, "King’s College, the patient's GP", T.words) == ["kings", "college", "the", "patients", "gp"]
    assert terms_of("King's  the THE") == ["kings", "the"]


def test_clean(spark):
    assert one(spark, None, T.clean_line) == "" and one(spark, "  a b\t", T.clean_line) == "a b"
    assert one(spark, " a\r\n\n\n\nb ", T.clean) == "a\n\nb"
    assert one(spark, " x \n\n y\n ", T.paragraphs) == ["x", "y"]


@pytest.mark.parametrize(("most", "step"), [(745, 200), (2805, 1000), (3, 1), (0, 1), (4, 1), (5, 2), (40, 10), (41, 20)])
def test_nice_step(spark, most, step):
    assert one(spark, most, T.nice_step, "long") == step


def test_references(spark):
    r = spark.createDataFrame([("DARS-NIC-1-AAAAA-V4.2",), ("X",)], "k string").select(base_of(F.col("k")).alias("b"), version_of(F.col("k")).alias("v")).withColumn("n", version_key(F.col("v"))).collect()
    assert [tuple(x) for x in r] == [("DARS-NIC-1-AAAAA", "4.2", [4, 2]), ("X", "", [0])]


def rows(spark, before, after, column):
    df = spark.createDataFrame([(before, after)], "a string, b string").select(column(F.col("a"), F.col("b")).alias("r"))
    return [tuple(x) for x in df.first().r]


def test_word_edits(spark):
    assert rows(spark, "keep five of them", "keep ten of", C.word_edits) == [("", "", 1), ("five", "ten", 0), ("", "", 1), ("them", "", 0)]
    assert rows(spark, "", None, C.word_edits) == []


def test_compared(spark):
    kept, old, new = "This one stays.", "Rows are held for six years here", "Rows are held for nine years here"
    got = rows(spark, f"{kept}\n{old}\nThis goes", f"THIS one  stays.\n\n{new}", C.diff_parts)
    assert got == [(0, "same", "", "", 1), (1, "kept", "Rows are held for", "", 4), (1, "reworded", "six", "nine", 2), (1, "kept", "years here", "", 2), (2, "removed", "This goes", "", 2)]
    assert [x[1] for x in rows(spark, "a b c", "d e f", C.diff_parts)] == ["removed", "added"]
    assert rows(spark, None, "", C.diff_parts) == []
    long = " ".join(f"w{i}" for i in range(100))
    assert rows(spark, long + " x", long + " y", C.diff_parts)[0][2].split(" (… 76 words …) ")[1].startswith("w88")


def test_redline(spark):
    def redline(a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string").select(C.diff_parts(F.col("a"), F.col("b")).alias("p"))
        return df.select(C.redline_of(F.col("p")).alias("r")).first().r

    assert redline("Held for six years", "Held for nine years") == "Held for <del>six</del> <ins>nine</ins> years"
    assert redline("A b c\nGone", "A b c") == "(1 paragraphs the same) <del>Gone</del>"
    many = redline("\n".join(f"alpha{i} beta{i}" for i in range(15)), "")
    assert many.count("<del>") == 10 and many.endswith("(and 5 more changes)")
    assert redline("", "w " * 70).endswith("(+10 words)</ins>") and redline("same", "same") == "(1 paragraphs the same)"


@pytest.mark.parametrize("numbers", [[0], [10], [10, 11], [0, 99], [2, 3, 13], list(range(50)), []])
def test_postings(numbers):
    assert decode_postings(encode_postings(numbers, 100)) == numbers
    assert encode_postings([2, 3, 13], 100) == "3,1,a" and encode_postings(list(range(50)), 100).startswith("x")
