"""Further views of the register: pages and their history, names beside each other, papers,
guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.compare import slugify
from quillspan.functions.dates import parse_day
from quillspan.functions.text import clean_line, name_key
from quillspan.plans import external, generated, lineage
from quillspan.plans.base import HELD, Book, agreements, dataset_rows, files, groups, held, latest, line_sql
from quillspan.plans.found import _DAY
from quillspan.plans.store import _D3, _D7, _changes, change_kinds
from quillspan.sources.register import base_of, reference_key, table
from quillspan.sources.sheets import references_in

BOOK = Book()


@BOOK.add(HELD + """, f as (select fil.base, lower(grp.dataset) as name_key, month, file_ref from fil join grp using (group_id) where month <> '' and grp.dataset <> '')
select base, name_key, month, count(*) as files from f group by all""")
def a12_files_per_dataset_month(spark: SparkSession, folder: str) -> DataFrame:
    """Files per agreement, dataset and month.  Files are counted per group and month before groups
    are looked up, so an agreement with a tenth of all files brings few rows to the join."""
    n = files(spark, folder).filter("month <> ''").groupBy("base", "group_id", "month").agg(F.count(F.lit(1)).alias("files"))
    g = groups(spark, folder).select("group_id", F.lower("dataset").alias("name_key")).filter("name_key <> ''")
    return n.join(g, "group_id").groupBy("base", "name_key", "month").agg(F.sum("files").alias("files"))


@BOOK.add(HELD + """, o as (select d.name_key, count(distinct lower(a.organisation)) as organisations from (select distinct name_key, base from dat) d join agr a on a.base_reference = d.base where a.organisation <> '' group by all),
f as (select lower(grp.dataset) as name_key, count(*) as files, count(distinct fil.base) as released_to from fil join grp using (group_id) where grp.dataset <> '' group by all)
select coalesce(o.name_key, f.name_key) as name_key, coalesce(organisations, 0) as organisations, coalesce(files, 0) as files, coalesce(released_to, 0) as released_to from o full outer join f on o.name_key = f.name_key""")
def a5_dataset_organisations_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per dataset the organisations whose agreements name it, the files released and to how many agreements."""
    a = agreements(spark, folder).filter("organisation <> ''").select("base_reference", F.lower("organisation").alias("org"))
    d = dataset_rows(spark, folder).select("name_key", "base").distinct()
    o = d.join(a, d.base == a.base_reference).groupBy("name_key").agg(F.count_distinct("org").alias("organisations"))
    g = groups(spark, folder).select("group_id", F.lower("dataset").alias("name_key")).filter("name_key <> ''")
    n = files(spark, folder).groupBy("group_id", "base").agg(F.count(F.lit(1)).alias("n"))
    f = n.join(g, "group_id").groupBy("name_key", "base").agg(F.sum("n").alias("n")).groupBy("name_key").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("released_to"))
    return o.join(f, "name_key", "full_outer").na.fill(0, ["organisations", "files", "released_to"])


@BOOK.add(HELD + f""", c as (select distinct {line_sql("c")} as shown, lower({line_sql("c")}) as name, regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '') as base from (select key, unnest(controllers) as c from held where no = (select max(no) from held)))
select c.name, count(distinct c.base) as agreements, count(distinct c.base) filter (lower(a.organisation) <> c.name) as for_others, count(distinct c.base) filter (lower(a.organisation) = c.name) as own
from c join agr a on a.base_reference = c.base where c.name <> '' group by c.name""")
def a4_controller_agreements(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements each controller stands in, its own applications and others' apart."""
    c = latest(spark, folder, "controllers").select("base", F.explode("controllers").alias("c")).select("base", name_key(F.col("c")).alias("name")).filter("name <> ''").distinct()
    a = agreements(spark, folder).select("base_reference", F.lower("organisation").alias("org"))
    own = F.col("org") == F.col("name")
    return c.join(a, c.base == a.base_reference).groupBy("name").agg(F.count(F.lit(1)).alias("agreements"), F.count_if(~own).alias("for_others"), F.count_if(own).alias("own"))


@BOOK.add("""with t as (select distinct trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) as name from agreement_snapshots where regexp_matches(coalesce(title, ''), '^[\\x00-\\x7F]*$')), s as (
  select lower(name) as name, trim(substr(trim(lower(regexp_replace(name, '[^a-zA-Z0-9]+', '-', 'g')), '-'), 1, 80), '-') as slug from t where name <> '')
select case when slug = '' then 'unknown' else slug end as slug, count(distinct name) as names from s group by 1 having count(distinct name) > 1""")
def v5_slug_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that several titles of ASCII would share; a page may be written only if none does
    (``assert_no_collisions``)."""
    t = table(spark, folder, "agreement_snapshots").select(clean_line(F.col("title")).alias("t")).filter(F.col("t").rlike(r"^[\x00-\x7F]+$")).distinct()
    return collisions(t.select(F.lower("t").alias("name"), slugify(F.col("t")).alias("slug")))


def collisions(names: DataFrame) -> DataFrame:
    """``slug, names`` of slugs that several of ``names(name, slug)`` share."""
    return names.groupBy("slug").agg(F.count_distinct("name").alias("names")).filter("names > 1")


def assert_no_collisions(names: DataFrame) -> None:
    external.assert_empty(collisions(names), "names that share an address")


@BOOK.add(HELD + """, e as (select no, row_number() over (order by no) as seq from (select distinct no from held)), b as (select distinct regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '') as base, no from held),
s as (select base, no, seq, lead(no) over w as back, lead(seq) over w as back_seq from b join e using (no) window w as (partition by base order by no))
select base, no as last_no, back as back_no, back_seq - seq - 1 as editions_missed from s where back_seq > seq + 1""")
def d5_timeline_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Editions in between that do not list an agreement they listed before and after."""
    h = held(spark, folder).select("no", "base").distinct()
    e = h.select("no").distinct().withColumn("seq", F.row_number().over(Window.orderBy("no")))  # editions are months: few
    w = Window.partitionBy("base").orderBy("no")
    s = h.join(F.broadcast(e), "no").select("base", "no", "seq", F.lead("no").over(w).alias("back_no"), F.lead("seq").over(w).alias("back_seq"))
    return s.filter("back_seq > seq + 1").select("base", F.col("no").alias("last_no"), "back_no", (F.col("back_seq") - F.col("seq") - 1).cast("long").alias("editions_missed"))


@BOOK.add(_D7 + "select no, key, count(*) as fields from d where x.k is not null group by no, key having bool_and(x.k = 'cosmetic')")
def f6_only_rewordings(spark: SparkSession, folder: str) -> DataFrame:
    """References whose every difference is one of typography, spacing or case."""
    return change_kinds(spark, folder).groupBy("no", "key").agg(F.count(F.lit(1)).alias("fields"), F.bool_and(F.col("kind") == "cosmetic").alias("only")).filter("only").drop("only")


@BOOK.add(_D3 + """, ends as (select max(no) as b from held), l as (select key, base, max(case when kind = 'added' then 2 when kind = 'amended' then 1 end) as k from c where kind in ('added', 'amended') and no = (select b from ends) group by all)
select st.key, case l.k when 2 then 'added' when 1 then 'amended' else '' end as flag from st left join l using (key) where st.no = (select b from ends)""")
def d16_change_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Current versions with what the newest edition did to them; added goes before amended."""
    now = latest(spark, folder).select("key")
    last = held(spark, folder).agg(F.max("no").alias("last"))
    c = _changes(spark, folder).join(F.broadcast(last), F.col("no") == F.col("last")).filter("kind <> 'removed'").groupBy("key").agg(F.min("kind").alias("flag"))  # one row; added sorts before amended
    return now.join(c, "key", "left").select("key", F.coalesce("flag", F.lit("")).alias("flag"))


_RAW = HELD + f""", nm as (select no, key, {line_sql("organisation")} as name from held where {line_sql("organisation")} <> ''),
ch as (select distinct lag(name) over (partition by key order by no) as was, name as now from nm), pr as (select was, now from ch where was is not null and was <> now) """


def name_changes(spark: SparkSession, folder: str) -> DataFrame:
    """``was, now``: organisation names as written that follow each other on one reference."""
    h = held(spark, folder, "organisation").select("no", "key", clean_line(F.col("organisation")).alias("now")).filter("now <> ''")
    return h.withColumn("was", F.lag("now").over(Window.partitionBy("key").orderBy("no"))).filter("was is not null and was <> now").select("was", "now").distinct()


_BARE = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_FORM = r"trim(regexp_replace({}, '\b(?:limited|ltd|plc|llp|llc|inc|incorporated|corp|corporation)$', ''))"
_CUT = r"regexp_replace({}, '[(\[][^()\[\]]*[)\]]\s*$', '')"


@BOOK.add(_RAW + f"""select was, now, case when {_BARE.format("was")} = '' or {_BARE.format("now")} = '' then null when {_BARE.format("was")} = {_BARE.format("now")} then 'letters'
  when {_BARE.format(_CUT.format("was"))} = {_BARE.format("now")} or {_BARE.format(_CUT.format("now"))} = {_BARE.format("was")} then 'bracket'
  when {_FORM.format(_BARE.format("was"))} = {_FORM.format(_BARE.format("now"))} and {_FORM.format(_BARE.format("was"))} <> '' then 'form' end as reason from pr""")
def x31_merge_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Names that follow each other on one reference, and what alone tells them apart."""
    return name_changes(spark, folder).select("was", "now", lineage.merge_reason(F.col("was"), F.col("now")).alias("reason"))


@BOOK.add(_RAW.replace("with ", "with recursive ", 1) + """, ties as (select was as a, now as b from pr union select now, was from pr), reach as (select a, b from ties union select r.a, t.b from reach r join ties t on t.a = r.b),
lab as (select a as name, least(a, min(b)) as l from reach group by a), canon as (select l, arg_min(name, (-length(name), name)) as canonical from lab group by l) select name, canonical from lab join canon using (l)""")
def e2_alias_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Names tied by having followed each other, with the longest spelling of each group."""
    return lineage.alias_groups(name_changes(spark, folder).select(F.col("was").alias("first"), F.col("now").alias("second")))


@BOOK.add(_RAW + """, m as (select distinct was, now from pr), top as (select lower(organisation) as name from agr) select was, now, exists (select 1 from top where name = lower(was)) as still_used from m where lower(was) <> lower(now)""")
def f10_outstanding_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of names that nobody has settled: they differ by more than letter case; whether an
    agreement still goes by the earlier one."""
    used = agreements(spark, folder).select(F.lower("organisation").alias("name"), F.lit(True).alias("still_used")).distinct()
    p = name_changes(spark, folder).filter("lower(was) <> lower(now)")
    return p.join(used, F.lower("was") == F.col("name"), "left").select("was", "now", F.coalesce("still_used", F.lit(False)).alias("still_used"))


@BOOK.add(f"select name_id, {_BARE.format('coalesce(party_name, $$$$)')} as bare from party_names")
def x7_bare_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "party_names").select("name_id", lineage.bare(F.col("party_name")).alias("bare"))


@BOOK.add(r"""select doc_id, list_transform(regexp_extract_all(upper(text), '(?:DARS-)?(NIC-[0-9]+-[A-Z0-9]{5}(?:-V[0-9]+(?:\.[0-9]+)?)?)', 1), lambda x: 'DARS-' || x) as named from documents where text is not null""")
def x22_references_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    """References written in documents, prefixed alike, in their order."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", references_in(F.col("text")).alias("named"))


@BOOK.add(HELD + """select base, array_to_string(list(version order by vkey, key), ' ') as versions, arg_max(version, (vkey, key)) as newest from lat group by base""")
def o8_version_order(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of each agreement in the order of their numbers, V10 after V9."""
    v = latest(spark, folder).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("vkey", "key", "version"))).alias("v"))
    return v.select("base", F.array_join("v.version", " ").alias("versions"), F.element_at("v", -1)["version"].alias("newest"))


@BOOK.add("""select text_id, length(c) as chars, sha256(c) as digest from (select text_id, case when length(text) <= 500 then text else regexp_replace(substr(text, 1, 500), '(?s)^(.*) .*$', '\\1') || ' [cut]' end as c from earlier_texts where text is not null)""")
def x36_cut_on_word(spark: SparkSession, folder: str) -> DataFrame:
    """Prose cut at a word, as it is put before a reader."""
    t = table(spark, folder, "earlier_texts").filter("text is not null").select("text_id", generated.cut_on_word(F.col("text"), 500).alias("c"))
    return t.select("text_id", F.length("c").cast("long").alias("chars"), F.sha2("c", 256).alias("digest"))


@BOOK.add("""select count(*) as texts, coalesce(sum(length(text)) / 4, 0.0) as tokens_in, count(*) * 150 as tokens_out from earlier_texts""")
def a22_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """What reading all earlier prose and writing a text on each would take, in tokens."""
    return generated.estimate(table(spark, folder, "earlier_texts"), "text")


@BOOK.add(HELD + """, e as (select min(no) as a, max(no) as b from held), r as (select key as base, sha256(coalesce(objective, '')) as hash from held where no = (select b from e)), w as (select key as base, sha256(coalesce(objective, '')) as hash from held where no = (select a from e))
select r.base from r left join w using (base) where w.hash is null or w.hash <> r.hash""")
def f11_needing_text(spark: SparkSession, folder: str) -> DataFrame:
    """References whose text was written from another objective, or never: the first edition's
    objectives stand for what texts were written from."""
    h = held(spark, folder, "objective").select("no", F.col("key").alias("base"), F.sha2(F.coalesce("objective", F.lit("")), 256).alias("hash"))
    e = h.agg(F.min("no").alias("a"), F.max("no").alias("b"))
    at = lambda c: h.join(F.broadcast(e), F.col("no") == F.col(c)).select("base", "hash")  # noqa: E731  (one row)
    return generated.needing(at("b"), at("a")).select("base")


@BOOK.add("""select distinct upper(trim(g.base_reference)) as base, count(*) as groups from release_groups g where trim(coalesce(g.base_reference, '')) <> '' and not exists (select 1 from agreement_snapshots s where regexp_replace(upper(trim(s.reference)), '-V[0-9]+(\\.[0-9]+)?$', '') = upper(trim(g.base_reference))) group by 1""")
def j3_dangling_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Release groups of agreements that no edition lists."""
    g = table(spark, folder, "release_groups").select(reference_key(F.col("base_reference")).alias("base")).filter("base <> ''").groupBy("base").agg(F.count(F.lit(1)).alias("groups"))
    known = table(spark, folder, "agreement_snapshots").select(base_of(reference_key(F.col("reference"))).alias("base")).distinct()
    return g.join(known, "base", "left_anti")


_EARLIER = f"""with p as (select upper(trim(base_reference)) as base, lower({line_sql("dataset")}) as name_key, unnest(periods) as p from earlier_releases),
d as (select base, name_key, {_DAY.format(c="p.from_date")} as s, {_DAY.format(c="p.to_date")} as e from p) """


@BOOK.add(_EARLIER + "select name_key, base, strftime(min(s), '%Y-%m-%d') as first_day, strftime(max(e), '%Y-%m-%d') as last_day, count(*) as periods from d where s is not null and e is not null and s <= e and name_key <> '' group by all")
def a32_earlier_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier datasets with the first and the last day they were released for, per agreement."""
    r = table(spark, folder, "earlier_releases").select(reference_key(F.col("base_reference")).alias("base"), name_key(F.col("dataset")).alias("name_key"), F.explode("periods").alias("p"))
    d = r.select("base", "name_key", parse_day(F.col("p.from_date")).alias("s"), parse_day(F.col("p.to_date")).alias("e")).filter("s <= e and name_key <> ''")
    return d.groupBy("name_key", "base").agg(F.date_format(F.min("s"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("e"), "yyyy-MM-dd").alias("last_day"), F.count(F.lit(1)).alias("periods"))


@BOOK.add(HELD + f""", o as (select lower({line_sql("organisation")}) as name, count(distinct upper(trim(base_reference))) as agreements from earlier_releases where {line_sql("organisation")} <> '' group by 1) select name, agreements from o where name not in (select lower(organisation) from agr)""")
def j21_earlier_applicants(spark: SparkSession, folder: str) -> DataFrame:
    """Applicants of the earlier registers that no current agreement has."""
    o = table(spark, folder, "earlier_releases").select(name_key(F.col("organisation")).alias("name"), reference_key(F.col("base_reference")).alias("base")).filter("name <> ''")
    return o.groupBy("name").agg(F.count_distinct("base").alias("agreements")).join(agreements(spark, folder).select(F.lower("organisation").alias("name")), "name", "left_anti")


@BOOK.add(HELD + "select organisation_type as sector, base_reference, organisation, count(*) over (partition by organisation_type) as of_sector from agr where organisation_type <> ''")
def j26_sector_agreements(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements of each sector beside the sector's number of them."""
    a = agreements(spark, folder).filter("organisation_type <> ''").select(F.col("organisation_type").alias("sector"), "base_reference", "organisation")
    n = a.groupBy("sector").agg(F.count(F.lit(1)).alias("of_sector"))
    return a.join(n, "sector")


@BOOK.add(HELD + f""", cur as (select lower(organisation) as name, count(*) as n from agr where organisation <> '' group by 1), gone as (select lower({line_sql("organisation")}) as name from held where no < (select max(no) from held) and {line_sql("organisation")} <> ''),
ear as (select lower({line_sql("organisation")}) as name from earlier_releases where {line_sql("organisation")} <> ''), u as (select name, 'current' as kind from cur union select name, 'archived' from gone where name not in (select name from cur) union select name, 'earlier' from ear where name not in (select name from cur) and name not in (select name from gone))
select u.name, u.kind, coalesce(cur.n, 0) as agreements, row_number() over (order by u.kind <> 'current', -coalesce(cur.n, 0), u.name) as place from u left join cur using (name)""")
def u5_names_of_all_registers(spark: SparkSession, folder: str) -> DataFrame:
    """Names of current, archived and earlier pages, each once, current ones first and the most used
    of them on top; places are counted on from partition to partition."""
    cur = agreements(spark, folder).filter("organisation <> ''").groupBy(F.lower("organisation").alias("name")).agg(F.count(F.lit(1)).alias("agreements"))
    gone = held(spark, folder, "organisation").select(name_key(F.col("organisation")).alias("name"))
    ear = table(spark, folder, "earlier_releases").select(name_key(F.col("organisation")).alias("name"))
    ranked = [cur.select("name", F.lit(0).alias("k"), "agreements")] + [d.select("name", F.lit(k).alias("k"), F.lit(0).cast("long").alias("agreements")) for k, d in ((1, gone), (2, ear))]
    each = reduce(DataFrame.unionByName, ranked).filter("name <> ''").groupBy("name").agg(F.min("k").alias("k"), F.max("agreements").alias("agreements"))
    kind = F.element_at(F.array(F.lit("current"), F.lit("archived"), F.lit("earlier")), F.col("k") + 1)
    return placed(each.select("name", kind.alias("kind"), "agreements"), [F.col("kind") != "current", -F.col("agreements"), F.col("name")], "place")


def placed(df: DataFrame, order: list, place: str) -> DataFrame:
    """``df`` with its rows' places in a global order: sorted by range, counted in each partition,
    and on from partition to partition; nothing is ordered in one task."""
    from quillspan.session import cut

    at = cut(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    n = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    first = at.groupBy("__p").agg(F.min("__i").alias("__first"))
    return at.join(F.broadcast(n.join(first, "__p").drop("__n")), "__p").select(*df.columns, (F.col("__before") + F.col("__i") - F.col("__first") + 1).alias(place))


# ---- papers: documents that name an agreement stand for them ----
_PAPERS = """with papers as (select doc_id as pos, upper(trim(base_reference)) as base, 'PMC' || n_chars as paper, year(published) as year, case when coalesce(doc_section, '') <> '' then 'found' else 'cited' end as basis, substr(text, 1, 40) as title
  from documents where trim(coalesce(base_reference, '')) <> ''), links as (select base, paper, arg_min({'y': year, 'b': basis}, pos) as r from papers group by all) """


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    basis = F.when(F.coalesce("doc_section", F.lit("")) != "", "found").otherwise("cited")
    return d.select(
        F.col("doc_id").alias("pos"), F.col("base_reference").alias("agreement"), F.lit("").alias("doi"), F.concat(F.lit("PMC"), F.col("n_chars").cast("string")).alias("pmcid"), F.year("published").alias("year"), basis.alias("basis"), F.substring("text", 1, 40).alias("title")
    )


@BOOK.add(_PAPERS + "select base, paper, r.y as year, r.b as basis from links")
def j15_paper_links(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements and papers, each pair once as first listed."""
    return external.paper_links(_papers(spark, folder)).select("base", "paper", "year", "basis")


@BOOK.add(_PAPERS + ", p as (select paper, min(r.y) as year, bool_or(r.b = 'found') as found from links group by paper) select coalesce(cast(year as varchar), 'undated') as year, count(*) as papers, count(*) filter (found) as found from p group by 1")
def a20_papers_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct papers per year, undated ones too."""
    p = external.paper_links(_papers(spark, folder)).groupBy("paper").agg(F.min("year").alias("year"), F.bool_or(F.col("basis") == "found").alias("found"))
    return p.groupBy(F.coalesce(F.col("year").cast("string"), F.lit("undated")).alias("year")).agg(F.count(F.lit(1)).alias("papers"), F.count_if("found").alias("found"))


@BOOK.add(HELD.replace("with ", _PAPERS + ", ", 1) + "select a.organisation_type as organisation_type, count(distinct upper(a.base_reference)) as agreements, count(distinct case when l.paper is not null then upper(a.base_reference) end) as with_paper, count(distinct l.paper) as papers from agr a left join links l on l.base = upper(a.base_reference) group by 1")
def a21_paper_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per sector: agreements, those with a paper, distinct papers."""
    return external.coverage(agreements(spark, folder), external.paper_links(_papers(spark, folder)), "organisation_type")


@BOOK.add(HELD.replace("with ", _PAPERS + ", ", 1) + "select lower(a.organisation) as organisation, count(distinct l.paper) as papers, count(distinct l.base) as agreements from agr a join links l on l.base = upper(a.base_reference) where a.organisation <> '' group by 1")
def a19_papers_by_organisation(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct papers per organisation."""
    a = agreements(spark, folder).filter("organisation <> ''").select(F.upper("base_reference").alias("base"), F.lower("organisation").alias("organisation"))
    return external.paper_links(_papers(spark, folder)).join(a, "base").groupBy("organisation").agg(F.count_distinct("paper").alias("papers"), F.count_distinct("base").alias("agreements"))


@BOOK.add("""select count(*) filter (where trim(coalesce(substr(text, 1, 40), '')) = '') as n, 'no title' as problem from documents having count(*) filter (where trim(coalesce(substr(text, 1, 40), '')) = '') > 0""")
def q2_paper_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that rows of the papers break, with how often."""
    return external.paper_problems(_papers(spark, folder)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
