"""Full-text and faceted search over the newest edition, by an inverted index of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import END, START, clean_line, words
from quillspan.plans.base import HELD, Book, latest, line_sql

BOOK = Book()

_PROSE = ("objective", "activities", "expected_output", "expected_benefits", "yielded_benefits")
_TEXT_SQL = "concat_ws(' ', title, key, organisation, " + ", ".join(f"coalesce({c}, '')" for c in _PROSE) + ")"
_WORDS_SQL = "list_distinct(regexp_extract_all(lower(regexp_replace({t}, '[''’]', '', 'g')), '[a-z0-9]+'))"
#: The newest edition's versions with their search words, in SQL.
DOCS = HELD + f", doc as (select l.key, l.title, l.organisation, l.organisation_type, l.commercial, {_WORDS_SQL.format(t=_TEXT_SQL.replace('title', 'l.title').replace('key', 'l.key', 1).replace('organisation,', 'l.organisation,'))} as ws from lat l join held h on h.key = l.key and h.no = (select max(no) from held)), num as (select *, row_number() over (order by lower(organisation), key) - 1 as number from doc) "


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``key, title, organisation, organisation_type, commercial, text`` of the newest edition."""
    v = latest(spark, folder, "title", "organisation", "organisation_type", "commercial", *_PROSE)
    line = {c: clean_line(F.col(c)) for c in ("title", "organisation")}
    return v.select(
        "key", line["title"].alias("title"), line["organisation"].alias("organisation"), F.lower(clean_line(F.col("organisation_type"))).alias("organisation_type"), F.lower(clean_line(F.col("commercial"))).alias("commercial"),
        F.concat_ws(" ", line["title"], "key", line["organisation"], *[F.coalesce(c, F.lit("")) for c in _PROSE]).alias("text"),
    )


def _begins(t: str):
    return lambda w: w.startswith(t)


def matches(ws: Column, terms: list[str]) -> Column:
    """Every term is a whole word, or from four letters on the beginning of one."""
    found = F.lit(True)
    for t in terms:
        found = found & (F.array_contains(ws, t) if len(t) < 4 else F.exists(ws, _begins(t)))
    return found


def terms_of(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall("[a-z0-9]+", re.sub("['’]", "", query).lower())))


def postings(docs: DataFrame) -> DataFrame:
    """``word, shard, key``: one row per word and document."""
    return docs.select("key", F.explode(words(F.col("text"))).alias("word")).withColumn("shard", F.substring("word", 1, 1))


@BOOK.add(DOCS + "select unnest(ws) as word, count(*) as documents from num group by 1")
def t2_word_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the index with the number of documents that hold them."""
    return postings(documents(spark, folder)).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))


@BOOK.add(DOCS + "select substr(word, 1, 1) as shard, count(distinct word) as words, count(*) as postings from (select unnest(ws) as word from num) group by 1")
def t4_shards(spark: SparkSession, folder: str) -> DataFrame:
    p = postings(documents(spark, folder)).groupBy("shard", "word").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("shard").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("postings"))


def number_documents(docs: DataFrame) -> DataFrame:
    """Documents numbered from 0 by organisation and key, without one task seeing them all: rows
    are range-partitioned in that order and each partition counts on from those before it."""
    n = docs.sparkSession
    ordered = docs.withColumn("__o", F.lower("organisation")).repartitionByRange(F.col("__o"), F.col("key")).sortWithinPartitions("__o", "key")
    from quillspan.session import cut

    placed = cut(ordered.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}  # one row per partition
    start, at = [], 0
    for p in sorted(sizes):
        start.append((p, at))
        at += sizes[p]
    offsets = n.createDataFrame(start or [(0, 0)], "__p int, __s long")
    return placed.join(F.broadcast(offsets), "__p").withColumn("number", F.col("__s") + F.col("__i")).drop("__p", "__s", "__i", "__o")


@BOOK.add(DOCS + ", p as (select unnest(ws) as word, number from num), g as (select word, number - lag(number, 1, -1) over (partition by word order by number) as gap, number from p) select word, string_agg(format('{:x}', gap), ',' order by number) as encoded, count(*) as documents from g group by word having count(*) * 12 <= (select count(*) from num)")
def w10_gap_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse postings as gaps in hexadecimal: words that at most a twelfth of the documents hold."""
    docs = number_documents(documents(spark, folder))
    total = docs.count()
    p = docs.select("number", F.explode(words(F.col("text"))).alias("word"))
    rare = p.groupBy("word").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") * 12 <= total)
    gap = F.col("number") - F.lag("number", 1, -1).over(Window.partitionBy("word").orderBy("number"))
    g = p.join(rare, "word").withColumn("gap", F.lower(F.hex(gap)))
    listed = g.groupBy("word", "documents").agg(F.sort_array(F.collect_list(F.struct("number", "gap"))).alias("l"))
    return listed.select("word", F.array_join("l.gap", ",").alias("encoded"), "documents")


def _search_sql(terms: list[str]) -> str:
    return " and ".join(f"list_contains(ws, '{t}')" if len(t) < 4 else f"len(list_filter(ws, lambda w: starts_with(w, '{t}'))) > 0" for t in terms)


QUERY_AND, QUERY_PREFIX = "records linked to vaccination", "vacc patien"


@BOOK.add(DOCS + f"select key, title from num where {_search_sql(terms_of(QUERY_AND))}")
def t5_search_and(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold every term of a query."""
    d = documents(spark, folder)
    return d.filter(matches(words(F.col("text")), terms_of(QUERY_AND))).select("key", "title")


@BOOK.add(DOCS + f"select key, title from num where {_search_sql(terms_of(QUERY_PREFIX))}")
def t5_prefix_search(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    return d.filter(matches(words(F.col("text")), terms_of(QUERY_PREFIX))).select("key", "title")


@BOOK.add(DOCS + f"select key from (select distinct key, t from (select key, unnest(ws) as w from num), (values {', '.join(f'({chr(39)}{t}{chr(39)})' for t in terms_of(QUERY_AND))}) q(t) where w = t or (length(t) >= 4 and starts_with(w, t))) group by key having count(*) = {len(terms_of(QUERY_AND))}")
def j25_postings_and(spark: SparkSession, folder: str) -> DataFrame:
    """The same conjunction by postings: postings are made from the texts here, not read from a stored index."""
    terms = terms_of(QUERY_AND)
    p = postings(documents(spark, folder)).filter(F.col("shard").isin(*{t[0] for t in terms}))
    hit = lambda t: (F.col("word") == t) if len(t) < 4 else F.col("word").startswith(t)
    each = p.select("key", F.explode(F.filter(F.array(*[F.when(hit(t), t) for t in terms]), lambda x: x.isNotNull())).alias("t"))
    return each.groupBy("key").agg(F.count_distinct("t").alias("n")).filter(F.col("n") == len(terms)).select("key")


@BOOK.add(DOCS + f"select key, title from num where {_search_sql(terms_of(QUERY_PREFIX))} and organisation_type = 'academic' and commercial <> 'yes'")
def f8_faceted_search(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).filter((F.col("organisation_type") == "academic") & (F.col("commercial") != "yes"))
    return d.filter(matches(words(F.col("text")), terms_of(QUERY_PREFIX))).select("key", "title")


@BOOK.add(DOCS + f"select count(*) filter (ok) as shown, count(*) filter (not ok) as hidden from (select organisation_type = 'academic' and commercial <> 'yes' as ok from num where {_search_sql(terms_of(QUERY_PREFIX))})")
def f9_hidden_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches that the facets show, and those they hide."""
    ok = (F.col("organisation_type") == "academic") & (F.col("commercial") != "yes")
    return documents(spark, folder).filter(matches(words(F.col("text")), terms_of(QUERY_PREFIX))).agg(F.count_if(ok).alias("shown"), F.count_if(~ok).alias("hidden"))


@BOOK.add("select text_id, len(regexp_extract_all(lower(text), '\\b(patients?|people)\\b')) as marks, regexp_replace(text, '(?i)\\b(patients?|people)\\b', '<mark>\\1</mark>', 'g') as marked from earlier_texts where regexp_matches(lower(text), '\\b(patients?|people)\\b')")
def t8_highlight_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Matches marked in the text, and their number."""
    from quillspan.sources.register import table

    p = rf"(?i){START}(patients?|people){END}"
    t = table(spark, folder, "earlier_texts")
    return t.filter(F.col("text").rlike(p)).select("text_id", F.regexp_count("text", F.lit(p)).cast("long").alias("marks"), F.regexp_replace("text", p, "<mark>$1</mark>").alias("marked"))


@BOOK.add(DOCS + "select key, number from num")
def o1_numbering(spark: SparkSession, folder: str) -> DataFrame:
    return number_documents(documents(spark, folder)).select("key", "number")


@BOOK.add(HELD + ", o as (select lower(organisation) as name, count(*) as n from agr where organisation <> '' group by 1) select name, n from o where len(list_filter(regexp_extract_all(name, '[a-z0-9]+'), lambda w: starts_with(w, 'univ') or starts_with(w, 'inst'))) > 0")
def t6_name_search(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations with a word that begins like one of the terms."""
    from quillspan.plans.base import agreements

    o = agreements(spark, folder).filter("organisation <> ''").groupBy(F.lower("organisation").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return o.filter(F.exists(words(F.col("name")), lambda w: w.startswith("univ") | w.startswith("inst")))


@BOOK.add("select text_id, lower(text) like '%linked%' and lower(text) like '%records%' as found from earlier_texts")
def f15_substring_search(spark: SparkSession, folder: str) -> DataFrame:
    from quillspan.sources.register import table

    low = F.lower("text")
    return table(spark, folder, "earlier_texts").select("text_id", (low.contains("linked") & low.contains("records")).alias("found"))


__all__ = ["BOOK", "documents", "line_sql", "matches", "number_documents", "postings", "terms_of"]
