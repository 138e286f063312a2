"""Entity views: agreements, organisations and datasets rolled up from versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import clean, clean_line, name_key
from quillspan.plans.base import HELD, Book, agreements, dataset_rows, files, first_by, groups, last_edition, latest, line_sql
from quillspan.sources.register import table

BOOK = Book()


@BOOK.add(f"select snapshot_id, {line_sql('title')} as title, {line_sql('organisation')} as organisation, length(coalesce(objective, '')) as objective_chars from agreement_snapshots where trim(coalesce(reference, '')) <> ''")
def s1_scan_clean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "agreement_snapshots").filter("trim(coalesce(reference, '')) <> ''")
    return rows.select("snapshot_id", clean_line(F.col("title")).alias("title"), clean_line(F.col("organisation")).alias("organisation"), F.length(F.coalesce("objective", F.lit(""))).cast("long").alias("objective_chars"))


@BOOK.add(HELD + ", f as (select base, count(*) as n from fil group by base), d as (select base, list_sort(list(distinct name)) as names from dat group by base) select a.*, coalesce(f.n, 0) as files, coalesce(array_to_string(d.names, ' | '), '') as datasets from agr a left join f on f.base = a.base_reference left join d on d.base = a.base_reference")
def a3_agreement_rollup(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder).groupBy("base").agg(F.count(F.lit(1)).alias("files"))
    d = dataset_rows(spark, folder).groupBy("base").agg(F.array_join(F.sort_array(F.collect_set("name")), " | ").alias("datasets"))
    a = agreements(spark, folder)
    return a.join(f, a.base_reference == f.base, "left").drop("base").join(d, a.base_reference == d.base, "left").drop("base").withColumn("files", F.coalesce("files", F.lit(0))).withColumn("datasets", F.coalesce("datasets", F.lit("")))


@BOOK.add(HELD + ", f as (select base, count(*) as n from fil group by base) select lower(organisation) as organisation_key, min(organisation) as organisation, count(*) as agreements, cast(sum(coalesce(n, 0)) as bigint) as files, max(coverage_end) as latest_end, bool_or(commercial = 'yes') as commercial from agr left join f on f.base = base_reference where organisation <> '' group by 1")
def a4_organisation_rollup(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder).groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    a = agreements(spark, folder).filter("organisation <> ''")
    return (
        a.join(f, a.base_reference == f.base, "left")
        .groupBy(F.lower("organisation").alias("organisation_key"))
        .agg(F.min("organisation").alias("organisation"), F.count(F.lit(1)).alias("agreements"), F.sum(F.coalesce("n", F.lit(0))).alias("files"), F.max("coverage_end").alias("latest_end"), F.bool_or(F.col("commercial") == "yes").alias("commercial"))
    )


@BOOK.add(HELD + """select name_key, count(distinct base) as agreements, count(distinct key) as "references", coalesce(array_to_string(list_sort(list(distinct type_of_data) filter (type_of_data <> '')), ';'), '') as types,
  coalesce(array_to_string(list_sort(list(distinct sensitivity) filter (sensitivity <> '')), ';'), '') as sensitivities from dat group by name_key""")
def a5_dataset_rollup(spark: SparkSession, folder: str) -> DataFrame:
    seen = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ";")
    return dataset_rows(spark, folder).groupBy("name_key").agg(F.count_distinct("base").alias("agreements"), F.count_distinct("key").alias("references"), seen("type_of_data").alias("types"), seen("sensitivity").alias("sensitivities"))


@BOOK.add(HELD + ", r as (select d.name_key, lower(a.organisation) as org, count(distinct a.base_reference) as agreements, max(a.coverage_end) as latest_end from (select distinct name_key, base from dat) d join agr a on a.base_reference = d.base where organisation <> '' group by all) select name_key, org, agreements, latest_end, row_number() over (partition by name_key order by agreements desc, org) as place from r")
def a6_dataset_recipients(spark: SparkSession, folder: str) -> DataFrame:
    d, a = dataset_rows(spark, folder).select("name_key", "base").distinct(), agreements(spark, folder).filter("organisation <> ''")
    r = d.join(a, d.base == a.base_reference).groupBy("name_key", F.lower("organisation").alias("org")).agg(F.count_distinct("base_reference").alias("agreements"), F.max("coverage_end").alias("latest_end"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("name_key").orderBy(F.desc("agreements"), "org")).cast("long"))


@BOOK.add(HELD + ", n as (select name_key, name, count(*) as n from dat group by all) select name_key, name as title, n as uses from (select *, row_number() over (partition by name_key order by n desc, name) as rn from n) where rn = 1")
def a8_modal_spelling(spark: SparkSession, folder: str) -> DataFrame:
    n = dataset_rows(spark, folder).groupBy("name_key", "name").agg(F.count(F.lit(1)).alias("uses"))
    return n.groupBy("name_key").agg(F.min_by(F.struct(F.col("name").alias("title"), "uses"), F.struct(-F.col("uses"), F.col("name"))).alias("r")).select("name_key", "r.*")


@BOOK.add(HELD + """, today as (select strftime(make_date(cast(max(no) // 12 as int), cast(max(no) % 12 + 1 as int), 1), '%Y-%m-%d') as d from held)
select (select count(*) from lat) as versions, count(*) as agreements, count(distinct lower(organisation)) filter (organisation <> '') as organisations, count(*) filter (commercial = 'yes') as commercial,
  count(*) filter (coverage_end >= (select d from today)) as in_term, coalesce(min(first_start) filter (first_start <> ''), '') as earliest_start, max(coverage_end) as latest_end, cast((select count(*) from fil) as bigint) as files from agr""")
def a9_headline_stats(spark: SparkSession, folder: str) -> DataFrame:
    no = last_edition(spark, folder)
    today = f"{no // 12:04d}-{no % 12 + 1:02d}-01"
    one = agreements(spark, folder).agg(
        F.sum("versions").alias("versions"),
        F.count(F.lit(1)).alias("agreements"),
        F.count_distinct(F.when(F.col("organisation") != "", F.lower("organisation"))).alias("organisations"),
        F.count_if(F.col("commercial") == "yes").alias("commercial"),
        F.count_if(F.col("coverage_end") >= today).alias("in_term"),
        F.coalesce(F.min(F.when(F.col("first_start") != "", F.col("first_start"))), F.lit("")).alias("earliest_start"),
        F.max("coverage_end").alias("latest_end"),
    )
    return one.crossJoin(files(spark, folder).agg(F.count(F.lit(1)).alias("files")))  # one row each


#: Organisation types in the order they are listed.
TYPES = ("academic", "nhs trust", "icb", "local authority", "charity", "commercial", "individual")


@BOOK.add(HELD + f", o(organisation_type, ord) as (values {', '.join(f"('{t}', {i})" for i, t in enumerate(TYPES))}) select o.organisation_type, o.ord, count(*) as agreements from agr join o using (organisation_type) group by all")
def a11_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TYPES) for x in (t, i)])
    return agreements(spark, folder).withColumn("ord", F.element_at(order, F.col("organisation_type"))).filter("ord is not null").groupBy("organisation_type", "ord").agg(F.count(F.lit(1)).alias("agreements"))


@BOOK.add(HELD + "select organisation_type, count(*) as agreements from agr group by all")
def a10_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return agreements(spark, folder).groupBy("organisation_type").agg(F.count(F.lit(1)).alias("agreements")).orderBy(F.desc("agreements"), "organisation_type")


@BOOK.add(HELD + "select lower(organisation) as organisation_key, count(*) as agreements from agr where organisation <> '' group by 1 order by 2 desc, 1 limit 15")
def o3_top_organisations(spark: SparkSession, folder: str) -> DataFrame:
    return agreements(spark, folder).filter("organisation <> ''").groupBy(F.lower("organisation").alias("organisation_key")).agg(F.count(F.lit(1)).alias("agreements")).orderBy(F.desc("agreements"), "organisation_key").limit(15)


@BOOK.add(HELD + """, today as (select strftime(make_date(cast(max(no) // 12 as int), cast(max(no) % 12 + 1 as int), 1), '%Y-%m-%d') as d from held)
select base_reference, case when coverage_end = '' then 'End not stated' when coverage_end >= (select d from today) then 'In term' else 'Expired' end as status from agr""")
def f4_status_in_term(spark: SparkSession, folder: str) -> DataFrame:
    no = last_edition(spark, folder)
    today = f"{no // 12:04d}-{no % 12 + 1:02d}-01"
    status = F.when(F.col("coverage_end") == "", "End not stated").when(F.col("coverage_end") >= today, "In term").otherwise("Expired")
    return agreements(spark, folder).select("base_reference", status.alias("status"))


@BOOK.add(HELD + ", c as (select upper(trim(reference)) as key, unnest(controllers) as controller from held where no = (select max(no) from held)) select lower(" + line_sql("controller") + ") as controller_key, count(distinct " + "regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '')" + ") as agreements from c where " + line_sql("controller") + " <> '' group by 1")
def j7_controllers(spark: SparkSession, folder: str) -> DataFrame:
    """Controllers as organisations of their own: agreements each controls."""
    rows = latest(spark, folder, "controllers").select("base", F.explode("controllers").alias("controller"))
    return rows.select("base", name_key(F.col("controller")).alias("controller_key")).filter("controller_key <> ''").groupBy("controller_key").agg(F.count_distinct("base").alias("agreements"))


@BOOK.add(HELD + ", n as (select lower(organisation) as org, organisation_type as t, count(*) as n from agr where organisation <> '' group by all) select org, t as sector, n from (select *, row_number() over (partition by org order by n desc, t) as rn from n) where rn = 1")
def a18_dominant_sector(spark: SparkSession, folder: str) -> DataFrame:
    n = agreements(spark, folder).filter("organisation <> ''").groupBy(F.lower("organisation").alias("org"), F.col("organisation_type").alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    return first_by(n, ["org"], [F.desc("n"), "sector"])


@BOOK.add(HELD + "select organisation_type, commercial, count(*) as agreements, grouping(organisation_type) as all_types, grouping(commercial) as all_commercial from agr group by grouping sets ((organisation_type, commercial), (organisation_type), ())")
def ext_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    a = agreements(spark, folder)
    c, t = F.col("commercial"), F.col("organisation_type")
    return a.groupingSets([[t, c], [t], []], t, c).agg(F.count(F.lit(1)).alias("agreements"), F.grouping("organisation_type").cast("long").alias("all_types"), F.grouping("commercial").cast("long").alias("all_commercial"))


@BOOK.add(HELD + "select f.file_ref, f.base, g.dataset, g.channel, f.month from fil f left join grp g using (group_id)")
def j4_files_with_datasets(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).join(groups(spark, folder), "group_id", "left").select("file_ref", "base", "dataset", "channel", "month")


@BOOK.add("""select snapshot_id, array_to_string(list_filter(list_transform(string_split(coalesce(objective, ''), chr(10)), lambda x: trim(regexp_replace(x, '^[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+|[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+$', '', 'g'))), lambda x: x <> ''), '|') as paras from agreement_snapshots""")
def x16_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    from quillspan.functions.text import paragraphs

    return table(spark, folder, "agreement_snapshots").select("snapshot_id", F.array_join(paragraphs(F.col("objective")), "|").alias("paras"))


@BOOK.add("select text_id, trim(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) as text from earlier_texts")
def x1_clean_prose(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "earlier_texts").select("text_id", clean(F.col("text")).alias("text"))
