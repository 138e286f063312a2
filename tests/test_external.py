"""Papers, onward registers, links, page entries and rank-based measures on small fixtures."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspan.plans import external as E

PAPERS = "pos int, agreement string, doi string, pmcid string, title string, year int, basis string"


def papers(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAPERS)


def test_papers(spark):
    p = papers(spark, [("a-1", "10.1234/x", "", "First", 2020, "found"), ("A-1", "10.1234/X", "", "Again", 2021, "cited"), ("B-1", "", "PMC7", "Other", 2012, "cited"), ("B-1", "10.1234/x", "", "First", 2020, "found"), (None, "10.1/x", "", "", None, "guess")])
    links = E.paper_links(p)
    assert sorted((r.base, r.paper, r.title) for r in links.collect()) == [("A-1", "10.1234/x", "First"), ("B-1", "10.1234/x", "First"), ("B-1", "PMC7", "Other")]
    years = {r.year: (r.papers, r.found) for r in E.papers_by_year(links, 2021).collect()}
    assert years[2020] == (1, 1) and years[2012] == (1, 0) and years[2015] == (0, 0) and min(years) == 2010
    ag = spark.createDataFrame([("a-1", "NHS"), ("c-1", "NHS"), ("b-1", "Academic")], "base_reference string, sector string")
    assert sorted(tuple(r) for r in E.coverage(ag, links, "sector").collect()) == [("Academic", 1, 1, 2), ("NHS", 2, 1, 1)]
    problems = E.paper_problems(p)
    assert {r.problem for r in problems.collect()} == {"unknown basis", "malformed doi", "no title"}
    with pytest.raises(ValueError):
        E.assert_empty(problems, "papers")


@pytest.mark.parametrize(("n", "want"), [(25, (2, 3, 4)), (19, (None, None, None))])
def test_quartiles(spark, n, want):
    gaps = spark.createDataFrame([(1 + i % 5,) for i in range(n)], "gap int")
    r = E.rank_quartiles(gaps, "gap").first()
    ordered = sorted(1 + i % 5 for i in range(n))
    if n >= 20:
        want = tuple(ordered[min(n - 1, int(s * n))] for s in (0.25, 0.5, 0.75))
    assert (r.lower_quartile, r.median, r.upper_quartile) == want


def test_onward(spark):
    schema = "holder string, organisation string, agreements array<string>, registers array<struct<kind: string, checked: string>>, commissioning boolean"
    h = spark.createDataFrame([("H", "O", ["a-1", "z-9"], [("list", "2024-01-01"), ("list", "")], False), ("H", "Q", [], [], True), ("K", "O", [], [("map", "2024-01-01")], True)], schema)
    ag, org = spark.createDataFrame([("A-1",)], "base_reference string"), spark.createDataFrame([("O",)], "organisation string")
    assert sorted((r.holder, r.problem) for r in E.onward_problems(h, ag, org).collect()) == [("H", "listed twice"), ("H", "no checked date"), ("H", "no register"), ("H", "unknown agreement"), ("H", "unknown organisation")]
    assert sorted(tuple(r) for r in E.onward_counts(h).collect()) == [("list", 1, 0), ("map", 0, 1)]


def test_relations(spark):
    r = spark.createDataFrame([("A", "hosted by", "B"), ("C", "merged into", "D")], "one string, relation string, other string")
    assert sorted(tuple(x) for x in E.relation_lines(r).collect()) == [("A", "Hosted by B"), ("B", "Hosts A"), ("C", "Merged into D"), ("D", "Took in C")]
    pages = spark.createDataFrame([("A",)], "one string")
    assert sorted(x.one for x in E.unknown_names(r, pages, "one").collect()) == ["C"]


def test_links(spark):
    pages = spark.createDataFrame(
        [("/index.html", '<a href="a/">x</a><a href="/b.html#two">y</a><a href="/b.html#one">y</a><a href="https://x.org">z</a><a href="mailto:x">m</a><a href="#here">h</a><p id="here">'), ("/a/", '<a href="../b.html">x</a><a href="../c.html">x</a><a href="">e</a>'), ("/b.html", '<h1 id="one">'), ("/n", None)],
        "url string, html string",
    )
    assert sorted(tuple(r) for r in E.broken_links(pages).collect()) == [("/", "/b.html#two", "no such fragment"), ("/a/", "../c.html", "no such page")]


def test_page_entries_and_retired(spark):
    changes = spark.createDataFrame([("A", "added"), ("Z", "added")], "base string, kind string")
    pages = spark.createDataFrame([("A", "org", ["org", "other"], ["data", ""])], "base string, applicant string, controllers array<string>, datasets array<string>")
    assert sorted(r.page for r in E.page_entries(changes, pages).collect()) == ["data", "org", "other"]
    names = spark.createDataFrame([("b", "b", ["old", "a"]), ("a", "a", ["old"])], "page string, own string, slugs array<string>")
    assert [tuple(r) for r in E.retired_slugs(names).collect()] == [("old", "a")]


def test_greedy(spark):
    p = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.5), ("c", "y", 0.6)]
    used, want = set(), []
    for s, w, n in sorted(((s, w, n) for w, n, s in p), reverse=True):
        if ("w", w) not in used and ("n", n) not in used:
            used |= {("w", w), ("n", n)}
            want.append((w, n))
    got = E.greedy_matches(spark.createDataFrame(p, "was string, now string, score double"))
    assert sorted((r.was, r.now) for r in got.collect()) == sorted(want)
    assert E.greedy_matches(got.limit(0)).collect() == []


def test_plurals(spark):
    d = spark.createDataFrame([(0, "Two GPs and MRIs each."), (1, "Uses GP data."), (2, "Uses ECG data")], "n int, text string")
    got = {}
    for r in E.with_plurals(d, "n", "text").collect():
        got.setdefault(r.word, set()).add(r.n)
    assert got["gp"] == {0, 1} and got["gps"] == {0, 1} and got["mri"] == {0} and "ecgs" not in got


def test_period_label(spark):
    r = spark.createDataFrame([(date(2017, 3, 1), date(2017, 5, 1)), (date(2017, 3, 1), date(2017, 3, 9)), (date(2017, 3, 1), date(2018, 5, 1))], "a date, b date")
    assert [x.l for x in r.select(E.period_label(F.col("a"), F.col("b")).alias("l")).collect()] == ["March to May 2017", "March 2017", "March 2017 to May 2018"]
