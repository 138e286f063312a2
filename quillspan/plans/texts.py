"""Queries over prose: slugs, normal forms, edits between editions, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.compare import ACRONYMS, OWN_CAPITALS, SMALL_WORDS, diff_parts, display_name, normalise, redline_of, slugify, split_list, word_edits
from quillspan.functions.text import END, START
from quillspan.plans.base import Book
from quillspan.plans.store import differing
from quillspan.sources.register import table

BOOK = Book()


@BOOK.add("""select title, case when s = '' then 'unknown' else s end as slug from (select distinct title, trim(substr(trim(lower(regexp_replace(strip_accents(coalesce(title, '')), '[^a-zA-Z0-9]+', '-', 'g')), '-'), 1, 80), '-') as s from agreement_snapshots)""")
def x3_slugify(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "agreement_snapshots").select("title").distinct().select("title", slugify(F.col("title")).alias("slug"))


@BOOK.add()
def x6_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "earlier_texts").select("text_id", normalise(F.col("text")).alias("normal"))


@BOOK.add(r"""
with p as (
  select snapshot_id, regexp_extract_all(regexp_replace(array_to_string(controllers, ', '), ',(\s*(?i:INC|INCORPORATED|LTD|LIMITED|LLC|LLP|PLC|GMBH|CORP|CORPORATION|PTY|PTE|SARL|SRL|BV|NV)\b)', chr(1) || '\1', 'g'), '(?:[(\[][^()\[\]]*[)\]]|[^,;\n\r])+') as ps
  from agreement_snapshots
)
select snapshot_id, list_filter(list_transform(ps, lambda v: trim(regexp_replace(replace(v, chr(1), ','), '\s+', ' ', 'g'))), lambda v: v <> '') as names from p
""")
def x9_split_list(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "agreement_snapshots").select("snapshot_id", F.array_join("controllers", ", ").alias("cell"))
    return cells.select("snapshot_id", split_list(F.col("cell")).alias("names"))


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in sorted(xs)) + "]"
_OWN = " ".join(f"when w = '{k}' then '{v}'" for k, v in OWN_CAPITALS.items())
_CAP = "(upper(substr({w}, 1, 1)) || lower(substr({w}, 2)))"
_X12 = f"""
with n as (select name_id, coalesce(party_name, '') as given from party_names),
c as (select name_id, case when regexp_matches(given, '\\s[-–]\\s+[A-Z0-9]*[0-9][A-Z0-9]*$') then rtrim(regexp_replace(given, '\\s+[-–]\\s+[A-Z0-9]*[0-9][A-Z0-9]*$', '')) else given end as name from n),
p as (select name_id, name, regexp_extract_all(name, '[\\pL\\pN&]+|[^\\pL\\pN&]+') as ps from c),
t as (select name_id, name, unnest(ps) as w, unnest(range(1, len(ps) + 1)) as i, unnest(list_concat([''], ps[:-2])) as before from p),
u as (
  select name_id, i, case
    when not regexp_matches(w, '[\\pL\\pN&]') then w
    {_OWN}
    when regexp_matches(before, '[''’]$') and w = 'S' then 's'
    when list_contains({_LIST(ACRONYMS)}, w) or length(w) = 1 or regexp_matches(w, '[&0-9]') then w
    when list_contains({_LIST(SMALL_WORDS)}, lower(w)) and not (i = 1 or regexp_matches(before, '[(\\[]') or regexp_matches(before, '\\s[-–—]\\s*$') or (i = 2 and not regexp_matches(before, '\\w'))) then lower(w)
    when regexp_matches(w, '^MC[A-Z]{{3,}}$') then 'Mc' || {_CAP.format(w="substr(w, 3)")}
    else {_CAP.format(w="w")} end as w
  from t
),
j as (select name_id, string_agg(w, '' order by i) as joined from u group by name_id)
select c.name_id, case when name = upper(name) and name <> lower(name) then joined else name end as shown from c left join j using (name_id)
"""


@BOOK.add(_X12)
def x12_display_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "party_names").select("name_id", display_name(F.col("party_name")).alias("shown"))


def rewritten(spark: SparkSession, folder: str, field: str) -> DataFrame:
    """``no, key, was, now`` of every reference whose field changed from one edition to the next."""
    blank = lambda side: F.coalesce(F.col(f"{side}.{field}"), F.lit("")).alias(side)
    return differing(spark, folder, field).select("no", "key", blank("was"), blank("now"))


@BOOK.add()
def d9_word_edits(spark: SparkSession, folder: str) -> DataFrame:
    """What was taken out of and put into the objective, run by run, and the words that stayed."""
    r = rewritten(spark, folder, "objective").withColumn("e", word_edits(F.col("was"), F.col("now")))
    kept = F.aggregate("e", F.lit(0), lambda n, x: n + x["kept"])
    return r.select("no", "key", kept.alias("kept"), F.explode_outer(F.filter("e", lambda x: x["kept"] == 0)).alias("x")).select("no", "key", "kept", F.col("x.was").alias("removed"), F.col("x.now").alias("added"))


@BOOK.add()
def d11_diff_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of the expected benefits that were removed, added and reworded, and how."""
    return rewritten(spark, folder, "expected_benefits").select("no", "key", F.inline(diff_parts(F.col("was"), F.col("now"))))


@BOOK.add()
def d12_redline(spark: SparkSession, folder: str) -> DataFrame:
    r = rewritten(spark, folder, "objective").select("no", "key", diff_parts(F.col("was"), F.col("now")).alias("parts"))
    return r.select("no", "key", redline_of(F.col("parts")).alias("redline"))


#: Phrases that a plain style does without, by name.
LINT = {
    "in_order_to": r"\bin order to\b",
    "findings_should": r"\bfindings should\b",
    "will_be_used": r"\bwill be (used|shared|reviewed)\b",
    "first_view": r"\bfirst view of\b",
    "only_by": r"\bby only\b",
}




def _ascii(pattern: str) -> str:
    """A pattern that begins and ends at a word of ASCII, for Java."""
    return START + pattern.removeprefix(r"\b").removesuffix(r"\b") + END


@BOOK.add("with r(rule, pattern) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in LINT.items()) + ") select rule, count(*) as documents, cast(sum(len(regexp_extract_all(lower(text), pattern))) as bigint) as hits from documents, r where regexp_matches(lower(text), pattern) group by rule")
def q8_cliche_lint(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and hits per rule; every rule is counted in one pass over the texts."""
    low = F.lower("text")
    counts = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count(low, F.lit(_ascii(p))).cast("long").alias("n")) for k, p in LINT.items()])
    d = table(spark, folder, "documents").select(F.inline(counts)).filter("n > 0")
    return d.groupBy("rule").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("hits"))


@BOOK.add("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def ext_tumbling_window(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@BOOK.add("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as opens from events), s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as no from g) select user_id, min(ts) as first_at, count(*) as n from s group by user_id, no")
def ext_session_window(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("first_at"), "n")


@BOOK.add("with w as (select event_type, unnest([time_bucket(interval 12 hours, ts), time_bucket(interval 12 hours, ts) - interval 12 hours]) as start from events) select start as from_at, event_type, count(*) as n from w group by all")
def ext_sliding_window(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("from_at"), "event_type", "n")


@BOOK.add("select sha256(coalesce(text, '')) as digest, count(*) as copies, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def x25_text_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that occur more than once, by digest."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")
