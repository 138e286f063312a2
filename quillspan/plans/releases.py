"""Released files: summaries, monthly series, terms and what a file was said to be as at an edition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, parse_day, parse_month
from quillspan.functions.text import nice_step
from quillspan.plans.base import HELD, NO_SQL, Book, files, groups, last_edition, latest, month_sql
from quillspan.sources.register import reference_key, table

BOOK = Book()


@BOOK.add(HELD + """select f.base, g.channel, g.dataset, count(*) as files, coalesce(min(month) filter (month <> ''), '') as first_month, coalesce(max(month) filter (month <> ''), '') as last_month,
  case count(distinct opt_outs) filter (opt_outs <> '') when 0 then '' when 1 then max(opt_outs) else 'Mixed' end as opt_outs_applied from fil f join grp g using (group_id) group by all""")
def a1_release_summary(spark: SparkSession, folder: str) -> DataFrame:
    answers = F.collect_set(F.when(F.col("opt_outs") != "", F.col("opt_outs")))
    month = F.when(F.col("month") != "", F.col("month"))
    return (
        files(spark, folder)
        .join(groups(spark, folder), "group_id")
        .groupBy("base", "channel", "dataset")
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.min(month), F.lit("")).alias("first_month"), F.coalesce(F.max(month), F.lit("")).alias("last_month"), answers.alias("a"))
        .withColumn("opt_outs_applied", F.when(F.size("a") > 1, "Mixed").otherwise(F.coalesce(F.try_element_at("a", F.lit(1)), F.lit(""))))
        .drop("a")
    )


@BOOK.add(HELD + "select base, month, count(*) as files from fil where month <> '' group by all")
def a12_files_per_month(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).filter("month <> ''").groupBy("base", "month").agg(F.count(F.lit(1)).alias("files"))


@BOOK.add(HELD + "select month, count(*) as files, count(distinct base) as agreements from fil where month <> '' group by month")
def a13_monthly_files_agreements(spark: SparkSession, folder: str) -> DataFrame:
    """Files and distinct agreements per month.  Files are first counted per agreement and month,
    so an agreement with a tenth of all files sends one row per month onwards."""
    return a12_files_per_month(spark, folder).groupBy("month").agg(F.sum("files").alias("files"), F.count(F.lit(1)).alias("agreements"))


@BOOK.add(HELD + "select substr(month, 1, 4) as year, count(*) as files from fil where month <> '' group by 1")
def a14_yearly_totals(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).filter("month <> ''").groupBy(F.substring("month", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("files"))


@BOOK.add(HELD + "select base, count(*) as files, count(*) filter (opt_outs = 'Yes') as applied, case when count(*) filter (opt_outs = 'Yes') = count(*) then 'all' when count(*) filter (opt_outs = 'Yes') = 0 then 'none' else 'some' end as state from fil group by base")
def a15_opt_out_state(spark: SparkSession, folder: str) -> DataFrame:
    c = files(spark, folder).groupBy("base").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("opt_outs") == "Yes").alias("applied"))
    return c.withColumn("state", F.when(F.col("applied") == F.col("files"), "all").when(F.col("applied") == 0, "none").otherwise("some"))


_LAG = HELD + """, m as (select base, min(month) as first from fil where month <> '' group by base),
g as (select organisation_type as sector, (cast(substr(first, 1, 4) as int) * 12 + cast(substr(first, 6, 2) as int)) - (cast(substr(first_start, 1, 4) as int) * 12 + cast(substr(first_start, 6, 2) as int)) as gap
      from agr join m on m.base = base_reference where first_start <> ''),
s as (select sector, list_sort(list(gap)) as gaps, count(*) as n from g group by sector)
select sector, n, case when n >= 20 then cast(gaps[least(n, cast(floor(0.25 * n) as bigint) + 1)] as double) end as lower_quartile, case when n >= 20 then cast(gaps[least(n, cast(floor(0.5 * n) as bigint) + 1)] as double) end as median,
       case when n >= 20 then cast(gaps[least(n, cast(floor(0.75 * n) as bigint) + 1)] as double) end as upper_quartile from s"""


@BOOK.add(_LAG)
def a23_lag_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Months from an agreement's start to its first file, quartiles by rank per organisation
    type; the rank comes from a histogram of the gaps, so no list of gaps is gathered."""
    from quillspan.plans.base import agreements

    first = files(spark, folder).filter("month <> ''").groupBy("base").agg(F.min("month").alias("first"))
    months = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    a = agreements(spark, folder).filter("first_start <> ''")
    gaps = a.join(first, a.base_reference == first.base).select(F.col("organisation_type").alias("sector"), (months("first") - months("first_start")).alias("gap"))
    bars = gaps.groupBy("sector", "gap").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("sector")
    ranked = bars.withColumn("n", F.sum("k").over(w)).withColumn("upto", F.sum("k").over(w.orderBy("gap")))
    at = lambda share: F.min(F.when((F.col("n") >= 20) & (F.col("upto") >= F.least(F.col("n"), F.floor(share * F.col("n")) + 1)), F.col("gap").cast("double")))
    return ranked.groupBy("sector", "n").agg(at(0.25).alias("lower_quartile"), at(0.5).alias("median"), at(0.75).alias("upper_quartile"))


@BOOK.add(HELD + ", t as (select base, count(*) as n from fil group by base), r as (select *, row_number() over (order by n desc, base) as rn from t) select cast(sum(n) filter (rn <= 100) as bigint) as top_files, cast(sum(n) as bigint) as files, round(cast(sum(n) filter (rn <= 100) as double) / sum(n), 6) as share from r")
def a24_top_share(spark: SparkSession, folder: str) -> DataFrame:
    n = files(spark, folder).groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "base").limit(100).agg(F.sum("n").alias("top_files"))
    return top.crossJoin(n.agg(F.sum("n").alias("files"))).withColumn("share", F.round(F.col("top_files") / F.col("files"), 6))  # one row each


@BOOK.add(HELD + """, m as (select month, count(*) as files, count(distinct base) as agreements from fil where month >= '2020-01' group by month),
ax as (select strftime(cast(d as date), '%Y-%m') as month from (select unnest(generate_series(date '2020-01-01', cast((select make_date(cast(max(no) // 12 as int), cast(max(no) % 12 + 1 as int), 1) from held) - interval 1 month as date), interval 1 month)) as d))
select ax.month, coalesce(files, 0) as files, coalesce(agreements, 0) as agreements from ax left join m using (month)""")
def c1_gap_filled_chart(spark: SparkSession, folder: str) -> DataFrame:
    """Every month from January 2020 to the one before the newest edition, zero where nothing went out."""
    no = last_edition(spark, folder) - 1
    axis = spark.range(1).select(F.explode(F.sequence(F.lit("2020-01-01").cast("date"), F.lit(f"{no // 12:04d}-{no % 12 + 1:02d}-01").cast("date"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return axis.join(a13_monthly_files_agreements(spark, folder), "month", "left").select("month", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("agreements", F.lit(0)).alias("agreements"))


@BOOK.add(HELD + """, m as (select month, count(*) as files from fil where month <> '' group by month), x as (select max(files) as most, max_by(month, (files, month)) as any_peak from m),
s as (select most, list_filter(flatten(list_transform(generate_series(0, 12), lambda k: [cast(pow(10, k) as bigint), cast(2 * pow(10, k) as bigint), cast(5 * pow(10, k) as bigint)])), lambda s: most / s <= 4)[1] as step from x)
select most, step, cast(step * ceil(most / step) as bigint) as top, (select min(month) from m where files = most) as peak from s""")
def c1_axis_nice_top(spark: SparkSession, folder: str) -> DataFrame:
    m = a13_monthly_files_agreements(spark, folder)
    one = m.agg(F.max("files").alias("most"), F.max_by("month", F.struct("files", (-F.replace("month", F.lit("-"), F.lit("")).cast("int")).alias("o"))).alias("peak"))
    step = nice_step(F.col("most"))
    return one.select("most", step.alias("step"), (step * F.ceil(F.col("most") / step)).cast("long").alias("top"), "peak")


@BOOK.add(HELD + """select key, greatest(start, '2016-04-01') as from_day, least("end", (select strftime(make_date(cast(max(no) // 12 as int), cast(max(no) % 12 + 1 as int), 1), '%Y-%m-%d') from held)) as to_day from lat
where start <> '' and greatest(start, '2016-04-01') <= least(case when "end" = '' then start else "end" end, (select strftime(make_date(cast(max(no) // 12 as int), cast(max(no) % 12 + 1 as int), 1), '%Y-%m-%d') from held)) and "end" <> ''""")
def j30_term_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the newest edition clipped to the axis; those outside it are dropped."""
    from quillspan.functions.text import iso

    no = last_edition(spark, folder)
    today = f"{no // 12:04d}-{no % 12 + 1:02d}-01"
    v = latest(spark, folder, "start_date", "end_date").select("key", iso(parse_day(F.col("start_date"))).alias("s"), iso(parse_day(F.col("end_date"))).alias("e")).filter("s <> '' and e <> ''")
    return v.select("key", F.greatest("s", F.lit("2016-04-01")).alias("from_day"), F.least("e", F.lit(today)).alias("to_day")).filter("from_day <= to_day")


@BOOK.add(HELD + f""", ob as (select file_ref, {NO_SQL} as no, loaded_at, release_row_id, {month_sql("release_month")} as month, upper(trim(base_reference)) as base from released_files),
eds2 as (select distinct no from held),
j as (select e.no as cutoff, o.*, row_number() over (partition by e.no, o.file_ref order by o.no desc, o.loaded_at desc, o.release_row_id desc) as rn from eds2 e join ob o on o.no <= e.no)
select cutoff, count(*) as files, count(distinct base) as agreements, count(*) filter (month = '') as undated from j where rn = 1 group by cutoff""")
def v4_as_at_edition(spark: SparkSession, folder: str) -> DataFrame:
    """Files as at every edition: the newest description at or before it.

    Each description counts from its edition until the file's next one, so the totals are
    running sums of what each edition adds and takes away: rows are never multiplied by editions.
    """
    rows = table(spark, folder, "released_files").select(
        "file_ref", edition_no(F.col("edition")).alias("no"), F.struct("loaded_at", "release_row_id").alias("w"), parse_month(F.col("release_month")).alias("month"), reference_key(F.col("base_reference")).alias("base")
    )
    one = rows.groupBy("file_ref", "no").agg(F.max_by(F.struct("month", "base"), "w").alias("r")).select("file_ref", "no", "r.*")
    file = Window.partitionBy("file_ref").orderBy("no")
    spans = one.withColumn("until", F.lead("no").over(file))
    moves = spans.select("base", F.explode(F.filter(F.array(F.struct(F.col("no").alias("at"), F.lit(1).alias("d")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("d"))), lambda x: x["at"].isNotNull())).alias("m"), (F.col("month") == "").cast("int").alias("u"))
    per_base = moves.groupBy("base", "m.at").agg(F.sum("m.d").alias("files"), F.sum(F.col("m.d") * F.col("u")).alias("undated"))
    run = Window.partitionBy("base").orderBy("at")
    level = per_base.withColumn("held", F.sum("files").over(run))
    was = F.coalesce(F.lag("held").over(run), F.lit(0))
    steps = level.withColumn("agreements", (F.col("held") > 0).cast("int") - (was > 0).cast("int")).groupBy("at").agg(F.sum("files").alias("files"), F.sum("agreements").alias("agreements"), F.sum("undated").alias("undated"))
    editions = table(spark, folder, "agreement_snapshots").select(edition_no(F.col("edition")).alias("cutoff")).filter("cutoff is not null").distinct()
    joined = editions.join(steps, F.col("at") <= F.col("cutoff"))  # months against months
    return joined.groupBy("cutoff").agg(F.sum("files").alias("files"), F.sum("agreements").alias("agreements"), F.sum("undated").alias("undated"))


@BOOK.add(HELD + ", t as (select base, dataset, count(*) as n from fil join grp using (group_id) where dataset <> '' group by all), p as (select dataset, cast(sum(n) as bigint) as files from t group by dataset) select p.dataset, p.files, coalesce(m.files, 0) - p.files as difference from p left join (select dataset, count(*) as files from fil join grp using (group_id) group by dataset) m using (dataset) where coalesce(m.files, 0) <> p.files")
def q1_totals_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Files per dataset summed over agreements against files counted per dataset: no rows if they agree."""
    f = files(spark, folder).join(groups(spark, folder).filter("dataset <> ''"), "group_id")
    per = f.groupBy("base", "dataset").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset").agg(F.sum("n").alias("files"))
    direct = f.groupBy("dataset").agg(F.count(F.lit(1)).alias("m"))
    return per.join(direct, "dataset", "left").select("dataset", "files", (F.coalesce("m", F.lit(0)) - F.col("files")).alias("difference")).filter("difference <> 0")
