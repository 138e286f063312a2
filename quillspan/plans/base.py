"""The views that register queries start from, and the registry they are entered in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, parse_day, parse_month
from quillspan.functions.text import clean_line, iso, name_key
from quillspan.plans.found import _DAY, _HELD
from quillspan.sources.register import base_of, newest_edition, reference_key, table, version_key, version_of

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries by name, each with the SQL that states the same, if SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def enter(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return enter


def held(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The row that holds per edition and reference, with ``columns`` only."""
    rows = table(spark, folder, "agreement_snapshots").select(
        edition_no(F.col("edition")).alias("no"), reference_key(F.col("reference")).alias("key"), F.struct("delivered_at", "snapshot_id").alias("__w"), F.struct(*columns or ["snapshot_id"]).alias("__r")
    )
    best = rows.filter("no is not null and key <> ''").groupBy("no", "key").agg(F.max_by("__r", "__w").alias("__r"))
    return best.select("no", "key", base_of(F.col("key")).alias("base"), version_of(F.col("key")).alias("version"), "__r.*")


def last_edition(spark: SparkSession, folder: str) -> int:
    """The newest edition; the editions are few by nature."""
    return newest_edition(table(spark, folder, "agreement_snapshots"))[0]


def latest(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The versions of the newest edition; older editions are left out by the scan itself."""
    snapshots = table(spark, folder, "agreement_snapshots")
    rows = snapshots.filter(F.col("edition").isin(newest_edition(snapshots)[1]))
    picked = rows.select(reference_key(F.col("reference")).alias("key"), F.struct("delivered_at", "snapshot_id").alias("__w"), F.struct(*columns or ["snapshot_id"]).alias("__r")).filter("key <> ''")
    best = picked.groupBy("key").agg(F.max_by("__r", "__w").alias("__r"))
    return best.select("key", base_of(F.col("key")).alias("base"), version_of(F.col("key")).alias("version"), "__r.*").withColumn("vkey", version_key(F.col("version")))


def agreements(spark: SparkSession, folder: str) -> DataFrame:
    """One row per base reference of the newest edition: what its latest version says."""
    v = latest(spark, folder, "title", "organisation", "organisation_type", "commercial", "start_date", "end_date").select(
        "base", "vkey", "version", clean_line(F.col("title")).alias("title"), clean_line(F.col("organisation")).alias("organisation"),
        F.lower(clean_line(F.col("organisation_type"))).alias("organisation_type"), F.lower(clean_line(F.col("commercial"))).alias("commercial"),
        iso(parse_day(F.col("start_date"))).alias("start"), iso(parse_day(F.col("end_date"))).alias("end"), "key",
    )
    order = F.struct("vkey", "start", "key")
    last = F.max_by(F.struct("title", "organisation", "organisation_type", "commercial", "end"), order)
    return (
        v.groupBy("base")
        .agg(
            F.count(F.lit(1)).alias("versions"),
            last.alias("last"),
            F.min(F.when(F.col("start") != "", F.col("start"))).alias("first_start"),
            F.max("end").alias("most_end"),
        )
        .select(
            F.col("base").alias("base_reference"),
            "versions",
            "last.title",
            "last.organisation",
            "last.organisation_type",
            "last.commercial",
            F.coalesce("first_start", F.lit("")).alias("first_start"),
            F.when(F.col("last.end") != "", F.col("last.end")).otherwise(F.col("most_end")).alias("coverage_end"),
        )
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per released file as last described: the newest edition wins, then the later load,
    then the later row.  A file's group gives its dataset and channel."""
    rows = table(spark, folder, "released_files").select(
        "file_ref", "group_id", reference_key(F.col("base_reference")).alias("base"), parse_month(F.col("release_month")).alias("month"),
        F.initcap(clean_line(F.col("opt_outs"))).alias("opt_outs"), F.struct(edition_no(F.col("edition")).alias("no"), "loaded_at", "release_row_id").alias("__w"),
    )
    return rows.groupBy("file_ref").agg(F.max_by(F.struct("group_id", "base", "month", "opt_outs"), "__w").alias("r")).select("file_ref", "r.*")


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "release_groups").select("group_id", clean_line(F.col("dataset")).alias("dataset"), F.lower(clean_line(F.col("channel"))).alias("channel"), "reference")


def dataset_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets of references, names on one line, blank ones left out."""
    return table(spark, folder, "state_datasets").select(
        reference_key(F.col("reference")).alias("key"), clean_line(F.col("dataset_name")).alias("name"), name_key(F.col("dataset_name")).alias("name_key"),
        *[F.lower(clean_line(F.regexp_replace(F.coalesce(c, F.lit("")), "-", " "))).alias(c) for c in ("type_of_data", "sensitivity", "frequency", "confidentiality")],
        "dataset_row_id",
    ).filter("name <> '' and key <> ''").withColumn("base", base_of(F.col("key")))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


# ---- the same views in SQL ----
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x0B]"


def line_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g'))"


def month_sql(c: str) -> str:
    m = f"trim(coalesce({c}, ''))"
    return f"""case
      when regexp_matches({m}, '^\\d{{4}}-\\d{{2}}$') then {m}
      when regexp_matches({m}, '^[A-Za-z]{{3}}-\\d{{2}}$') then strftime(strptime({m}, '%b-%y'), '%Y-%m')
      when regexp_matches({m}, '^[A-Za-z]+ \\d{{4}}$') then strftime(strptime({m}, '%B %Y'), '%Y-%m') else '' end"""


NO_SQL = "cast(regexp_extract(edition, '(\\d{4})$', 1) as int) * 12 - 1 + list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(trim(edition), 1, 3)))"
BASE_SQL = "regexp_replace({k}, '-V[0-9]+(\\.[0-9]+)?$', '')"
VERSION_SQL = "regexp_extract({k}, '-V([0-9]+(\\.[0-9]+)?)$', 1)"
VKEY_SQL = "case when {v} = '' then [0] else list_transform(string_split({v}, '.'), lambda x: cast(x as int)) end"

HELD = "with " + _HELD + f"""
lat as (
  select key, {BASE_SQL.format(k="key")} as base, {VERSION_SQL.format(k="key")} as version, {VKEY_SQL.format(v=VERSION_SQL.format(k="key"))} as vkey,
         {line_sql("title")} as title, {line_sql("organisation")} as organisation, lower({line_sql("organisation_type")}) as organisation_type, lower({line_sql("commercial")}) as commercial,
         coalesce(strftime({_DAY.format(c="start_date")}, '%Y-%m-%d'), '') as start, coalesce(strftime({_DAY.format(c="end_date")}, '%Y-%m-%d'), '') as "end"
  from held where no = (select max(no) from held)
),
agr as (
  select base as base_reference, count(*) as versions, max_by(title, (vkey, start, key)) as title, max_by(organisation, (vkey, start, key)) as organisation,
         max_by(organisation_type, (vkey, start, key)) as organisation_type, max_by(commercial, (vkey, start, key)) as commercial,
         coalesce(min(start) filter (start <> ''), '') as first_start,
         case when max_by("end", (vkey, start, key)) <> '' then max_by("end", (vkey, start, key)) else max("end") end as coverage_end
  from lat group by base
),
fil as (
  select file_ref, max_by(group_id, w) as group_id, max_by(base, w) as base, max_by(month, w) as month, max_by(opt_outs, w) as opt_outs
  from (select file_ref, group_id, upper(trim(base_reference)) as base, {month_sql("release_month")} as month,
               case when trim(coalesce(opt_outs, '')) = '' then '' else upper(substr(trim(opt_outs), 1, 1)) || lower(substr(trim(opt_outs), 2)) end as opt_outs,
               ({NO_SQL}, loaded_at, release_row_id) as w from released_files)
  group by file_ref
),
grp as (select group_id, {line_sql("dataset")} as dataset, lower({line_sql("channel")}) as channel, reference from release_groups),
dat as (
  select *, {BASE_SQL.format(k="key")} as base from (
    select upper(trim(reference)) as key, {line_sql("dataset_name")} as name, lower({line_sql("dataset_name")}) as name_key, dataset_row_id,
           {", ".join(f"lower({line_sql(f"replace(coalesce({c}, ''), '-', ' ')")}) as {c}" for c in ("type_of_data", "sensitivity", "frequency", "confidentiality"))}
    from state_datasets) where name <> '' and key <> ''
)
"""  # fmt: skip
