"""Further register views: point reads, the earlier registers, orders, runs and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, parse_day
from quillspan.functions.text import END, START, clean_line, iso, name_key, words
from quillspan.plans.base import HELD, NO_SQL, Book, agreements, dataset_rows, files, first_by, held, latest, line_sql
from quillspan.plans.found import _DAY
from quillspan.plans.resolve import _RENAMES, renames
from quillspan.plans.search import DOCS, documents, number_documents
from quillspan.sources.register import base_of, reference_key, table, version_key, version_of

BOOK = Book()

#: The agreement of the point reads: the one with most released files in the test tables.
POINT = "DARS-NIC-2000000-F7E6J"


@BOOK.add(f"select file_ref, edition, release_month, opt_outs from released_files where base_reference = '{POINT}'")
def s5_point_read(spark: SparkSession, folder: str) -> DataFrame:
    """The release history of one agreement; the filter reaches the scan."""
    return table(spark, folder, "released_files").filter(F.col("base_reference") == POINT).select("file_ref", "edition", "release_month", "opt_outs")


@BOOK.add(f"select edition, min({NO_SQL}) as no, count(*) as n_rows, min(delivered_at) as first_delivered, max(delivered_at) as last_delivered from agreement_snapshots group by edition")
def s8_editions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "agreement_snapshots").groupBy("edition").agg(F.min(edition_no(F.col("edition"))).alias("no"), F.count(F.lit(1)).alias("n_rows"), F.min("delivered_at").alias("first_delivered"), F.max("delivered_at").alias("last_delivered"))


@BOOK.add("select reference, count(*) as n from agreement_snapshots where reference is not null and regexp_matches(reference, '[0-9]') group by reference")
def f2_valid_reference(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "agreement_snapshots").filter(F.col("reference").rlike("[0-9]")).groupBy("reference").agg(F.count(F.lit(1)).alias("n"))


_EARLY = HELD + ", er as (select *, upper(trim(base_reference)) as base, upper(trim(reference)) as ref from earlier_releases), now as (select distinct base from lat), known as (select distinct key from held) "


@BOOK.add(_EARLY + "select er.base, (n.base is not null) as known, count(distinct er.ref) as n_references, count(distinct er.ref) filter (k.key is null) as not_held from er left join now n on n.base = er.base left join known k on k.key = er.ref group by all")
def j18_earlier_agreements(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements of the earlier registers: whether the newest edition has them, and how many of
    their references no edition holds."""
    e = table(spark, folder, "earlier_releases").select(reference_key(F.col("base_reference")).alias("base"), reference_key(F.col("reference")).alias("ref")).distinct()
    now = latest(spark, folder).select("base").distinct().withColumn("known", F.lit(True))
    has = table(spark, folder, "agreement_snapshots").select(reference_key(F.col("reference")).alias("ref"), F.lit(True).alias("has")).distinct()
    j = e.join(now, "base", "left").join(has, "ref", "left")
    return j.groupBy("base", F.coalesce("known", F.lit(False)).alias("known")).agg(F.count_distinct("ref").alias("n_references"), F.count_distinct(F.when(F.col("has").isNull(), F.col("ref"))).alias("not_held"))


@BOOK.add(_EARLY + f", p as (select base, {line_sql('dataset')} as dataset, form, row_count, release_id, unnest(periods) as p from er), d as (select *, {_DAY.format(c='p.from_date')} as s, {_DAY.format(c='p.to_date')} as e from p) select base, dataset, count(distinct release_id) as releases, coalesce(strftime(min(s), '%Y-%m-%d'), '') as first_day, coalesce(strftime(max(e), '%Y-%m-%d'), '') as last_day, coalesce(array_to_string(list_sort(list(distinct lower({line_sql('form')})) filter ({line_sql('form')} <> '')), ';'), '') as forms from d group by all")
def a31_earlier_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What the earlier registers released per agreement and data set."""
    r = table(spark, folder, "earlier_releases").select(reference_key(F.col("base_reference")).alias("base"), clean_line(F.col("dataset")).alias("dataset"), F.lower(clean_line(F.col("form"))).alias("form"), "release_id", F.explode("periods").alias("p"))
    d = r.withColumn("s", parse_day(F.col("p.from_date"))).withColumn("e", parse_day(F.col("p.to_date")))
    return d.groupBy("base", "dataset").agg(F.count_distinct("release_id").alias("releases"), iso(F.min("s")).alias("first_day"), iso(F.max("e")).alias("last_day"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("form") != "", F.col("form")))), ";").alias("forms"))


@BOOK.add(_EARLY + ", v as (select distinct base, ref, regexp_extract(ref, '-V([0-9]+(\\.[0-9]+)?)$', 1) as ver from er), k as (select *, case when ver = '' then [0] else list_transform(string_split(ver, '.'), lambda x: cast(x as int)) end as vk from v) select base, ref as older, lead(ref) over (partition by base order by vk, ref) as newer from k")
def j28_next_version(spark: SparkSession, folder: str) -> DataFrame:
    """Each earlier version beside the next newer one."""
    v = table(spark, folder, "earlier_releases").select(reference_key(F.col("base_reference")).alias("base"), reference_key(F.col("reference")).alias("older")).distinct()
    w = Window.partitionBy("base").orderBy(version_key(version_of(F.col("older"))), "older")
    return v.select("base", "older", F.lead("older").over(w).alias("newer"))


#: What a confidentiality answer rests on.
BASES_OF = {"section 88": "section 88", "consent": "consent", "not identifiable": "none"}
_BASES_SQL = "case confidentiality " + " ".join(f"when '{k}' then '{v}'" for k, v in BASES_OF.items()) + " else 'not-recorded' end"


@BOOK.add(HELD + f", b as (select distinct base, {_BASES_SQL} as basis from dat), x as (select base, list_sort(list(basis)) as l from b group by base) select base, case when len(list_filter(l, lambda y: y <> 'none')) > 0 then array_to_string(list_filter(l, lambda y: y <> 'none'), ';') else 'none' end as bases from x")
def a16_confidentiality(spark: SparkSession, folder: str) -> DataFrame:
    """The set of confidentiality bases over an agreement's data sets; 'none' only if it is alone."""
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASES_OF.items() for x in kv]), F.col("confidentiality")), F.lit("not-recorded"))
    s = dataset_rows(spark, folder).groupBy("base").agg(F.sort_array(F.collect_set(of)).alias("l"))
    some = F.filter("l", lambda y: y != "none")
    return s.select("base", F.when(F.size(some) > 0, F.array_join(some, ";")).otherwise("none").alias("bases"))


@BOOK.add(_RENAMES + ", r as (select was, now, no from chg where was is not null and was <> now) select was, now, count(*) as versions, count(distinct no) as editions from r group by all")
def a28_rename_tally(spark: SparkSession, folder: str) -> DataFrame:
    """How often one organisation name gave way to another, and in how many editions."""
    h = held(spark, folder, "organisation").select("no", "key", name_key(F.col("organisation")).alias("now")).filter("now <> ''")
    c = h.withColumn("was", F.lag("now").over(Window.partitionBy("key").orderBy("no"))).filter("was is not null and was <> now")
    return c.groupBy("was", "now").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("no").alias("editions"))


@BOOK.add("with n as (select name_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(party_name, '[''’]', '', 'g')), '[a-z0-9]+'))) as token from party_names) select token, count(*) as names, round(1 / ln(2 + count(*)), 6) as weight from n group by token")
def a29_token_frequency(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "party_names").select(F.explode(words(F.col("party_name"))).alias("token"))
    return n.groupBy("token").agg(F.count(F.lit(1)).alias("names")).withColumn("weight", F.round(1 / F.log(2.0 + F.col("names")), 6))


@BOOK.add(_RENAMES + f", u as (select name, count(*) as uses from nm group by name) select u.name, coalesce(r.now, u.name) as resolved, u.uses from u left join ren r on r.was = u.name")
def j5_alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Every organisation name with the name it resolves to, itself if no rule speaks of it."""
    u = held(spark, folder, "organisation").select(name_key(F.col("organisation")).alias("name")).filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    r = renames(spark, folder).select(F.col("was").alias("name"), "now")
    return u.join(r, "name", "left").select("name", F.coalesce("now", "name").alias("resolved"), "uses")


@BOOK.add(HELD + ", o as (select distinct base, key, name_key, name, regexp_extract(key, '-V([0-9]+(\\.[0-9]+)?)$', 1) as ver from dat), k as (select *, case when ver = '' then [0] else list_transform(string_split(ver, '.'), lambda x: cast(x as int)) end as vk from o) select base, name_key, name as spelling, key from (select *, row_number() over (partition by base, name_key order by vk desc, key desc, name) as rn from k) where rn = 1")
def w9_latest_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """How an agreement's newest version that names a data set spells it."""
    d = dataset_rows(spark, folder).select("base", "key", "name_key", "name").distinct().withColumn("vk", version_key(version_of(F.col("key"))))
    return first_by(d, ["base", "name_key"], [F.desc("vk"), F.desc("key"), "name"]).select("base", "name_key", F.col("name").alias("spelling"), "key")


@BOOK.add(DOCS + ", p as (select unnest(ws) as word, number from num) select word, cast(sum(number) as bigint) as numbers, count(*) as documents from p group by word having count(*) * 12 <= (select count(*) from num)")
def w11_gap_decoding(spark: SparkSession, folder: str) -> DataFrame:
    """The encoded postings decoded again by running sums of their gaps."""
    from quillspan.plans.search import w10_gap_encoding

    g = w10_gap_encoding(spark, folder).select("word", F.posexplode(F.split("encoded", ",")).alias("pos", "gap"))
    run = Window.partitionBy("word").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = g.withColumn("number", F.sum(F.conv("gap", 16, 10).cast("long")).over(run) - 1)
    return n.groupBy("word").agg(F.sum("number").alias("numbers"), F.count(F.lit(1)).alias("documents"))


@BOOK.add("""with s as (select text_id, unnest(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda x: regexp_replace(x, '^[ \n]+', ''))) as sentence, generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]'), 1) as i from earlier_texts where len(regexp_extract_all(text, '[^.!?]+[.!?]')) > 0),
o as (select text_id, i, lower(regexp_extract(sentence, '^([A-Za-z]+)', 1)) as opener from s), g as (select *, i - row_number() over (partition by text_id, opener order by i) as island from o)
select text_id, opener, count(*) as sentences from g where opener <> '' group by text_id, opener, island having count(*) >= 2""")
def w12_same_openers(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of sentences that open with the same word, by the difference of two row numbers."""
    s = table(spark, folder, "earlier_texts").select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]"), F.lit(0))).alias("i", "sentence"))
    o = s.select("text_id", "i", F.lower(F.regexp_extract(F.regexp_replace("sentence", "^[ \n]+", ""), "^([A-Za-z]+)", 1)).alias("opener")).filter("opener <> ''")
    g = o.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("text_id", "opener").orderBy("i")))
    return g.groupBy("text_id", "opener", "island").agg(F.count(F.lit(1)).alias("sentences")).filter("sentences >= 2").drop("island")


@BOOK.add(HELD + "select base_reference, coverage_end, row_number() over (order by nullif(coverage_end, '') desc nulls last, base_reference) as place from agr")
def o7_blanks_last(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements by end date, newest first, those without one always last."""
    a = agreements(spark, folder).select("base_reference", "coverage_end", F.nullif("coverage_end", F.lit("")).alias("o"))
    # places are counted on from partition to partition of a range sort
    from quillspan.session import cut

    placed = cut(a.repartitionByRange(F.desc_nulls_last("o"), F.asc("base_reference")).sortWithinPartitions(F.desc_nulls_last("o"), "base_reference").withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}  # one row per partition
    start, at = [], 1
    for p in sorted(sizes):
        start.append((p, at))
        at += sizes[p]
    return placed.join(F.broadcast(spark.createDataFrame(start or [(0, 1)], "__p int, __s long")), "__p").select("base_reference", "coverage_end", (F.col("__s") + F.col("__i")).alias("place"))


@BOOK.add(HELD + ", d as (select base, list_sort(list(distinct name)) as l from dat group by base) select base, array_to_string(l[1:5], ', ') || case when len(l) > 5 then ' and ' || (len(l) - 5) || ' more' else '' end as shown from d")
def o10_first_five(spark: SparkSession, folder: str) -> DataFrame:
    """The first five data sets of an agreement, and how many more."""
    d = dataset_rows(spark, folder).groupBy("base").agg(F.sort_array(F.collect_set("name")).alias("l"))
    more = F.when(F.size("l") > 5, F.concat(F.lit(" and "), (F.size("l") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return d.select("base", F.concat(F.array_join(F.slice("l", 1, 5), ", "), more).alias("shown"))


@BOOK.add()
def o11_seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Forty agreements, the same for the same seed (sampling is the feature)."""
    return agreements(spark, folder).select("base_reference").orderBy(F.xxhash64("base_reference", F.lit(7))).limit(40)


@BOOK.add(HELD + "select key, base from lat l where not exists (select 1 from earlier_releases e where upper(trim(e.base_reference)) = l.base)")
def f13_without_history(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of agreements that the earlier registers never had."""
    e = table(spark, folder, "earlier_releases").select(reference_key(F.col("base_reference")).alias("base")).distinct()
    return latest(spark, folder).select("key", "base").join(e, "base", "left_anti").select("key", "base")


@BOOK.add(HELD + "select name, base from dat union select " + line_sql("dataset") + " as name, upper(trim(base_reference)) as base from release_groups where " + line_sql("dataset") + " <> ''")
def u7_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Which agreements use a data set name, in their data sets or in what was released: a row per
    owner, so a name that a third of all agreements use is no long list."""
    d = dataset_rows(spark, folder).select("name", "base")
    g = table(spark, folder, "release_groups").select(clean_line(F.col("dataset")).alias("name"), reference_key(F.col("base_reference")).alias("base")).filter("name <> ''")
    return d.unionByName(g).distinct()


_WINDOW = HELD + ", v as (select *, case when ver = '' then [0] else list_transform(string_split(ver, '.'), lambda x: cast(x as int)) end as vk from (select no, key, regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '') as base, regexp_extract(key, '-V([0-9]+(\\.[0-9]+)?)$', 1) as ver from held)) "


@BOOK.add(_WINDOW + ", t as (select base, max(vk) as top from v where no = (select max(no) from held) group by base), s as (select base, key, vk, max(no) as last_no from v group by all) select s.base, s.key, s.last_no from s join t using (base) where s.vk > t.top and s.last_no < (select max(no) from held)")
def w8_dropped_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions newer than the newest now listed, which an earlier edition had."""
    h = held(spark, folder).select("no", "key", "base", version_key(F.col("version")).alias("vk"))
    seen = h.groupBy("base", "key", "vk").agg(F.max("no").alias("last_no"))
    top = h.agg(F.max("no").alias("newest"))  # one row
    flag = seen.crossJoin(top)
    now = flag.filter("last_no = newest").groupBy("base").agg(F.max("vk").alias("top"))
    return flag.join(now, "base").filter("vk > top and last_no < newest").select("base", "key", "last_no")


_SETS = HELD + ", e as (select no, lag(no) over (order by no) as prev from (select distinct no from held)), d as (select b.no, b.key, regexp_replace(b.key, '-V[0-9]+(\\.[0-9]+)?$', '') as base, unnest([{'f': 'title', 'w': coalesce(a.title, ''), 'n': coalesce(b.title, '')}, {'f': 'end_date', 'w': coalesce(a.end_date, ''), 'n': coalesce(b.end_date, '')}, {'f': 'sublicensing', 'w': coalesce(a.sublicensing, ''), 'n': coalesce(b.sublicensing, '')}, {'f': 'commercial', 'w': coalesce(a.commercial, ''), 'n': coalesce(b.commercial, '')}]) as x from held b join e on e.no = b.no join held a on a.key = b.key and a.no = e.prev), s as (select no, key, array_to_string(list_sort(list(x.f)), '+') as fields from d where x.w <> x.n group by no, key) "


@BOOK.add(_SETS + "select no, fields, count(*) as n from s group by all")
def a27_edit_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Amendments grouped by the set of fields they touch together."""
    fields = ("title", "end_date", "sublicensing", "commercial")
    h = held(spark, folder, *fields)
    pairs = h.select("no").distinct().select("no", F.lag("no").over(Window.orderBy("no")).alias("prev"))  # editions are months: few
    j = h.join(F.broadcast(pairs), "no").withColumn("l", F.lag(F.struct("no", *fields)).over(Window.partitionBy("key").orderBy("no"))).filter("l.no = prev")
    touched = F.filter(F.array(*[F.when(F.coalesce(F.col(f"l.{c}"), F.lit("")) != F.coalesce(F.col(c), F.lit("")), c) for c in fields]), lambda x: x.isNotNull())
    return j.select("no", F.array_join(F.sort_array(touched), "+").alias("fields")).filter("fields <> ''").groupBy("no", "fields").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(HELD + ", m as (select base, min(month) filter (month <> '') as first, max(month) as last, count(*) as n, count(distinct month) filter (month <> '') as months from fil group by base) select a.base_reference, m.first as first_month, m.last as last_month, m.n as files, m.months, (a.coverage_end <> '' and substr(a.coverage_end, 1, 7) < m.last) as runs_on from agr a join m on m.base = a.base_reference where m.first is not null")
def c2_agreement_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Per agreement: the months it released in, and whether files went out after its term."""
    f = files(spark, folder).groupBy("base").agg(F.min(F.when(F.col("month") != "", F.col("month"))).alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("files"), F.count_distinct(F.when(F.col("month") != "", F.col("month"))).alias("months"))
    a = agreements(spark, folder)
    return a.join(f, a.base_reference == f.base).filter("first_month is not null").select("base_reference", "first_month", "last_month", "files", "months", ((F.col("coverage_end") != "") & (F.substring("coverage_end", 1, 7) < F.col("last_month"))).alias("runs_on"))


@BOOK.add("select doc_id, len(regexp_extract_all(text, '\\b[A-Z]{2,}\\b')) as acronyms, len(string_split(coalesce(text, ''), chr(10))) as lines from documents where text is not null")
def x15_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "documents").filter("text is not null")
    return t.select("doc_id", F.regexp_count("text", F.lit(rf"{START}[A-Z]{{2,}}{END}")).cast("long").alias("acronyms"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@BOOK.add(HELD + ", t as (select lower(organisation) as org, organisation_type as t, count(*) as n from agr where organisation <> '' group by all) select org, count(*) as types, array_to_string(list_sort(list(t)), ';') as listed from t where t <> '' group by org having count(*) > 1")
def q3_conflicting_types(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations that the newest edition gives more than one type."""
    t = agreements(spark, folder).filter("organisation <> '' and organisation_type <> ''").select(F.lower("organisation").alias("org"), "organisation_type").distinct()
    return t.groupBy("org").agg(F.count(F.lit(1)).alias("types"), F.array_join(F.sort_array(F.collect_list("organisation_type")), ";").alias("listed")).filter("types > 1")


__all__ = ["BOOK", "base_of", "documents", "number_documents"]
