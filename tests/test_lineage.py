"""Successions of bodies, reviewed successions, merges and groups of aliases."""

import pytest

from quillspan.plans import lineage as L

BODIES = "code string, name string, icb string, roles array<struct<id: string, start: string>>, successors array<struct<code: string, date: string>>, predecessors array<struct<code: string, date: string>>"


@pytest.fixture(scope="module")
def tables(spark):
    bodies = spark.createDataFrame(
        [
            ("15C", "Bristol location", "QUY", [("RO98", "2013-04-01"), ("RO319", "2022-07-01")], [], []),
            ("QUY", "Bristol board", "", [("RO318", "2022-07-01")], [], []),
            ("11H", "Bristol group", None, [("RO98", "2013-04-01")], [("15C", "2018-04-01")], []),
            ("11T", "Somerset group", None, [("RO98", "2013-04-01")], [], []),
            ("15D", "Joined", None, [], [], [("11T", "2019-01-01")]),  # one-sided
            ("X1", "Stranger", None, None, None, None),
        ],
        BODIES,
    )
    codes = spark.createDataFrame([("Bristol CCG", "15C", True), ("Bristol ICB", "QUY", False), ("Bristol ICB - 15C", "15C", False), ("Old Bristol CCG", "11H", True), ("Somerset CCG", "11T", True), ("Joined", "15D", False), ("Stranger", "X1", False), ("Info Centre", "X1", False)], "name string, code string, as_ccg boolean")
    aliases = spark.createDataFrame([("BRISTOL  ccg ltd", "Bristol CCG")], "variant string, canonical string")
    successions = spark.createDataFrame([("Info Centre", "Joined", "2016-08-01")], "was string, now string, date string")
    return bodies, codes, aliases, successions


def test_relations(spark, tables):
    pairs = [("Bristol CCG", "Bristol ICB"), ("bristol ccg ltd", "Bristol ICB"), ("Bristol ICB - 15C", "Bristol ICB"), ("Old Bristol CCG", "Bristol ICB"), ("Somerset CCG", "Joined"), ("Info Centre", "Joined"), ("Stranger", "Joined"), ("Bristol ICB", "Bristol CCG"), ("Nobody", "Joined"), ("Stranger", "stranger")]
    got = {(r.old, r.new): (r.relation, r.date) for r in L.relations(spark.createDataFrame(pairs, "old string, new string"), *tables).collect()}
    assert got == {
        ("Bristol CCG", "Bristol ICB"): ("succeeded", "2022-07-01"), ("bristol ccg ltd", "Bristol ICB"): ("succeeded", "2022-07-01"), ("Bristol ICB - 15C", "Bristol ICB"): ("same", ""),
        ("Old Bristol CCG", "Bristol ICB"): ("succeeded", "2022-07-01"), ("Somerset CCG", "Joined"): ("succeeded", "2019-01-01"), ("Info Centre", "Joined"): ("succeeded", "2016-08-01"), ("Stranger", "stranger"): ("same", ""),
    }


@pytest.mark.parametrize(
    ("a", "b", "reason"),
    [
        ("HILL & DALE", "hill dale", "letters"), ("Dale Cohort [2nd wave]", "dale cohort", "bracket"), ("Dale Cohort", "Dale Cohort (DC)", "bracket"), ("Hill Data Ltd.", "HILL DATA", "form"),
        ("Hill", "Hills", None), ("Ltd", "PLC", None), ("", "x", None), (None, "x", None),
    ],
)
def test_merge_reason(spark, a, b, reason):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(a, b)], "a string, b string").select(L.merge_reason(F.col("a"), F.col("b")).alias("r")).first().r == reason


def test_groups(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "xx"), ("self", "self")]
    got = {r.name: r.canonical for r in L.alias_groups(spark.createDataFrame(chain, "first string, second string")).collect()}
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and got["x"] == got["xx"] == "xx" and "self" not in got


def test_first_page(spark):
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "name string")
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "was string, now string")
    pages = spark.createDataFrame([("c", "C"), ("d", "D")], "name string, page string")
    assert {r.name: r.page for r in L.first_page(names, "name", steps, pages).collect()} == {"a": "C", "b": "C"}
