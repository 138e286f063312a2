"""Joins with hand-kept files: papers, onward registers, relations, links, and page feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import parse_day

#: How a paper was tied to an agreement.
BASES = ("found", "cited")
#: Papers that quartiles need at least; years that the columns start from.
LEAST_PAPERS, FIRST_YEAR = 20, 2010


def paper_problems(papers: DataFrame) -> DataFrame:
    """``pos, problem`` of rows that break the rules: basis, DOI, PMCID, title."""
    rules = {
        "unknown basis": ~F.coalesce(F.col("basis"), F.lit("")).isin(*BASES),
        "malformed doi": F.coalesce(F.col("doi"), F.lit("")).rlike(".") & ~F.coalesce(F.col("doi"), F.lit("")).rlike(r"^10\.\d{4,9}/\S+$"),
        "malformed pmcid": F.coalesce(F.col("pmcid"), F.lit("")).rlike(".") & ~F.coalesce(F.col("pmcid"), F.lit("")).rlike(r"^PMC\d+$"),
        "no identifier": F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.nullif(F.col("pmcid"), F.lit(""))).isNull(),
        "no title": F.coalesce(F.trim("title"), F.lit("")) == "",
    }
    named = F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return papers.select("pos", F.explode(named).alias("problem"))


def assert_empty(problems: DataFrame, what: str) -> None:
    """Fail loudly, naming the first few problems."""
    rows = problems.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def paper_links(papers: DataFrame) -> DataFrame:
    """One row per agreement and paper, the first in the file: ``base, paper, year, basis, title``."""
    key = F.coalesce(F.nullif(F.lower("doi"), F.lit("")), F.nullif(F.upper("pmcid"), F.lit("")))
    p = papers.select(F.upper(F.trim("agreement")).alias("base"), key.alias("paper"), F.col("year").cast("int").alias("year"), "basis", "title", "pos").filter("base <> '' and paper is not null")
    return p.groupBy("base", "paper").agg(F.min_by(F.struct("year", "basis", "title"), "pos").alias("r")).select("base", "paper", "r.*")


def papers_by_year(links: DataFrame, last: int) -> DataFrame:
    """Distinct papers per year, found and cited, years without any included."""
    each = links.groupBy("paper").agg(F.min("year").alias("year"), F.bool_or(F.col("basis") == "found").alias("found"))
    n = each.filter("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("papers"), F.count_if("found").alias("found"))
    axis = links.sparkSession.range(FIRST_YEAR, last + 1).select(F.col("id").cast("int").alias("year"))
    return axis.join(n, "year", "left").select("year", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("found", F.lit(0)).alias("found"))


def coverage(agreements: DataFrame, links: DataFrame, sector: str) -> DataFrame:
    """Per sector: agreements, agreements with a paper, distinct papers."""
    j = agreements.select(F.upper("base_reference").alias("base"), sector).join(links, "base", "left")
    return j.groupBy(sector).agg(F.count_distinct("base").alias("agreements"), F.count_distinct(F.when(F.col("paper").isNotNull(), F.col("base"))).alias("with_paper"), F.count_distinct("paper").alias("papers"))


def rank_quartiles(gaps: DataFrame, value: str) -> DataFrame:
    """Quartiles by rank, null for fewer than LEAST_PAPERS values: the histogram alone is ordered."""
    bars = gaps.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = bars.withColumn("upto", F.sum("k").over(Window.orderBy("v"))).crossJoin(bars.agg(F.sum("k").alias("n")))  # few distinct values; one row
    at = lambda s: F.min(F.when((F.col("n") >= LEAST_PAPERS) & (F.col("upto") >= F.least("n", F.floor(s * F.col("n")) + 1)), F.col("v")))
    return upto.agg(F.max("n").alias("n"), at(0.25).alias("lower_quartile"), at(0.5).alias("median"), at(0.75).alias("upper_quartile"))


def onward_problems(holders: DataFrame, agreements: DataFrame, organisations: DataFrame) -> DataFrame:
    """``holder, problem``: unknown agreements and organisations, holders listed twice or without a
    register, registers without a checked date."""
    h = holders.select("holder", "organisation", "agreements", "registers")
    named = h.select("holder", F.explode("agreements").alias("base")).withColumn("base", F.upper("base"))
    parts = [
        named.join(agreements.select(F.upper("base_reference").alias("base")), "base", "left_anti").select("holder", F.lit("unknown agreement").alias("problem")),
        h.join(organisations.select("organisation"), "organisation", "left_anti").select("holder", F.lit("unknown organisation").alias("problem")),
        h.groupBy("holder").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("holder", F.lit("listed twice").alias("problem")),
        h.filter(F.size("registers") <= 0).select("holder", F.lit("no register").alias("problem")),
        h.select("holder", F.explode("registers").alias("r")).filter(parse_day(F.col("r.checked")).isNull()).select("holder", F.lit("no checked date").alias("problem")).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts)


def onward_counts(holders: DataFrame) -> DataFrame:
    """Holders per kind of register, those that commission counted apart."""
    kinds = holders.select("holder", "commissioning", F.explode(F.array_distinct(F.transform("registers", lambda r: r["kind"]))).alias("kind"))
    return kinds.groupBy("kind").agg(F.count_if(~F.col("commissioning")).alias("holders"), F.count_if("commissioning").alias("commissioners"))


def relation_lines(relations: DataFrame) -> DataFrame:
    """Sentences for both sides of ``one, relation, other`` (hosts, part of, merged into)."""
    says = {"hosted by": "hosts", "part of": "includes", "merged into": "took in"}
    back = reduce(lambda c, kv: c.when(F.col("relation") == kv[0], kv[1]), says.items(), F.when(F.lit(False), ""))
    both = F.array(F.struct(F.col("one").alias("page"), F.col("relation").alias("said"), F.col("other").alias("about")), F.struct(F.col("other").alias("page"), back.alias("said"), F.col("one").alias("about")))
    return relations.select(F.inline(both)).filter("said is not null").select("page", F.concat(F.upper(F.substring("said", 1, 1)), F.substring(F.col("said"), F.lit(2), F.length("said")), F.lit(" "), F.col("about")).alias("line"))


def unknown_names(names: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Names that no page has."""
    return names.select(key).distinct().join(pages.select(key), key, "left_anti")


def broken_links(pages: DataFrame, base: str = "/") -> DataFrame:
    """``url, href, problem`` of internal links whose page or fragment does not exist.

    ``pages`` has ``url`` (a path) and ``html``.  Links to other sites and mail are not checked; a
    path ending in a slash stands for its index; paths outside ``base`` are broken.
    """
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"index\.html$", ""), r"/+", "/")
    at = pages.select(tidy(F.col("url")).alias("page"), "html")
    ids = at.select("page", F.explode(F.concat(F.array(F.lit("")), F.regexp_extract_all("html", F.lit(r"\bid\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)))).alias("fragment"))
    links = at.select("page", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)))).alias("href"))
    own = links.filter(~F.col("href").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)") & (F.col("href") != ""))
    path = F.regexp_extract("href", "^([^?#]*)", 1)
    folder = F.regexp_replace("page", "[^/]*$", "")
    whole = F.when(path == "", F.col("page")).when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    up = r"/(?!\.\.)[^/]+/\.\./"
    flat = reduce(lambda c, _: F.regexp_replace(c, up, "/"), range(4), F.regexp_replace(whole, r"/\./", "/"))
    aim = own.select("page", "href", tidy(flat).alias("to"), F.regexp_extract("href", "#(.*)$", 1).alias("frag"))
    known = ids.select("page").distinct().select(F.col("page").alias("to"), F.lit(True).alias("there"))
    there = aim.join(known, "to", "left").join(ids.select(F.col("page").alias("to"), F.col("fragment").alias("frag"), F.lit(True).alias("marked")).distinct(), ["to", "frag"], "left")
    problem = F.when(~F.col("to").startswith(base), "outside the site").when(F.col("there").isNull(), "no such page").when(F.col("marked").isNull(), "no such fragment")
    return there.select(F.col("page").alias("url"), "href", problem.alias("problem")).filter("problem is not null")


def page_entries(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """Changes of each page: an agreement's changes go to its applicant's, controllers' and data
    sets' pages, each once.  ``pages``: ``base, applicant, controllers, datasets``."""
    fan = pages.select("base", F.explode(F.array_distinct(F.concat(F.array("applicant"), "controllers", "datasets"))).alias("page")).filter("page <> ''")
    return changes.join(fan, "base")


def retired_slugs(names: DataFrame) -> DataFrame:
    """``slug, page``: slugs of earlier names that no page has now; the first page wins.
    ``names``: ``page, own, slugs``."""
    own = names.select(F.col("own").alias("slug"))
    old = names.select("page", F.explode("slugs").alias("slug")).join(own, "slug", "left_anti")
    return old.groupBy("slug").agg(F.min("page").alias("page"))


def encode_postings(numbers: list[int], total: int) -> str:
    """Gaps in hexadecimal, or ``x`` and a bitset where more than a twelfth of all are listed."""
    ordered = sorted(set(numbers))
    if len(ordered) * 12 > total:
        return "x" + format(sum(1 << n for n in ordered), "x")
    return ",".join(format(b - a, "x") for a, b in zip([-1, *ordered], ordered))


def decode_postings(text: str) -> list[int]:
    if text.startswith("x"):
        bits = int(text[1:] or "0", 16)
        return [n for n in range(bits.bit_length()) if bits >> n & 1]
    out, at = [], -1
    for gap in filter(None, text.split(",")):
        at += int(gap, 16)
        out.append(at)
    return out


def period_label(start: Column, end: Column) -> Column:
    """``March to May 2017``, ``March 2017``, ``March 2017 to May 2018``."""
    same_year = F.year(start) == F.year(end)
    return (
        F.when(F.date_format(start, "yyyyMM") == F.date_format(end, "yyyyMM"), F.date_format(start, "MMMM yyyy"))
        .when(same_year, F.concat(F.date_format(start, "MMMM"), F.lit(" to "), F.date_format(end, "MMMM yyyy")))
        .otherwise(F.concat_ws(" to ", F.date_format(start, "MMMM yyyy"), F.date_format(end, "MMMM yyyy")))
    )


def with_plurals(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word``: index words, where an acronym and its plural find each other: a document
    with ``GPs`` also has ``gp``, and one with ``GP`` also ``gps`` if any document writes ``GPs``."""
    from quillspan.functions.text import words

    plain = documents.select(key, F.explode(words(F.col(text))).alias("word"))
    plurals = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,})s\b"), F.lit(1)))).alias("a"))
    singles = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,})\b"), F.lit(1)))).alias("a"))
    corpus = plurals.select("a").distinct()
    more = plurals.select(key, F.lower("a").alias("word")).unionByName(singles.join(corpus, "a", "left_semi").select(key, F.concat(F.lower("a"), F.lit("s")).alias("word")))
    return plain.unionByName(more).distinct()


def greedy_matches(pairs: DataFrame, was: str = "was", now: str = "now", score: str = "score") -> DataFrame:
    """One partner each, best pairs first (score, then names, descending).

    In each round every pair that is the best of both its names is kept and all pairs of those
    names leave, which gives what taking pairs one by one in order gives.
    """
    from quillspan.session import cut

    left, kept = cut(pairs.select(was, now, score)), None
    order = F.struct(score, was, now)
    while True:
        best = left.groupBy(was).agg(F.max(order).alias("b")).select("b.*").join(left.groupBy(now).agg(F.max(order).alias("b")).select("b.*"), [was, now, score])
        best = cut(best)
        if best.isEmpty():
            return kept if kept is not None else left
        kept = best if kept is None else kept.unionByName(best)
        left = cut(left.join(best.select(was), was, "left_anti").join(best.select(now), now, "left_anti"))


def register_spark(spark: SparkSession) -> None:
    """Functions for SQL sessions."""
    from quillspan.functions.compare import register_functions

    register_functions(spark)
    spark.udf.register("encode_postings", encode_postings)
