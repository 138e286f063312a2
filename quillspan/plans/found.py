"""The queries of the general problems over the register tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, parse_day
from quillspan.operators.history import build, history_values
from quillspan.operators.intervals import merge_intervals
from quillspan.operators.packed_values import split_packed
from quillspan.operators.snapshot_diff import diff_snapshots, with_values
from quillspan.sources.register import base_of, reference_key, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return diff_snapshots(table(spark, folder, "agreement_snapshots")).select("edition", "reference", "change_kind")


def p1_changed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Objective and end date before and after, for every reference that changed."""
    rows = table(spark, folder, "agreement_snapshots")
    return with_values(diff_snapshots(rows), rows, ("objective", "end_date"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "agreement_snapshots").select(
        reference_key(F.col("reference")).alias("key"), edition_no(F.col("edition")).alias("no"), "delivered_at", "snapshot_id", "start_date", "end_date"
    )
    held = rows.filter("no is not null and key <> ''").groupBy("key").agg(F.max_by(F.struct("start_date", "end_date"), F.struct("no", "delivered_at", "snapshot_id")).alias("row"))
    return held.select(
        F.lit("term").alias("span_source"),
        base_of(F.col("key")).alias("base_reference"),
        F.lit("").alias("dataset"),
        parse_day(F.col("row.start_date")).alias("from_day"),
        parse_day(F.col("row.end_date")).alias("to_day"),
    )


def _released(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "earlier_releases").select(reference_key(F.col("base_reference")).alias("base_reference"), "dataset", F.explode("periods").alias("p"))
    return rows.select(
        F.lit("release").alias("span_source"), "base_reference", F.coalesce("dataset", F.lit("")).alias("dataset"), parse_day(F.col("p.from_date")).alias("from_day"), parse_day(F.col("p.to_date")).alias("to_day")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = merge_intervals(_terms(spark, folder).unionByName(_released(spark, folder)), ["span_source", "base_reference", "dataset"])
    return spans.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("from_date", "to_date")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return build(table(spark, folder, "agreement_snapshots"), ("objective", "end_date")).select("reference", "valid_from", "valid_to")


def p3_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of objective and end date with its values."""
    rows = table(spark, folder, "agreement_snapshots")
    return history_values(build(rows, ("objective", "end_date")), rows, ("objective", "end_date"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    cells = [
        table(spark, folder, name).select(F.lit(name).alias("source_table"), F.col(key).cast("long").alias("row_id"), "legal_basis")
        for name, key in (("state_datasets", "dataset_row_id"), ("earlier_releases", "release_id"))
    ]
    return split_packed(cells[0].unionByName(cells[1]), "legal_basis", ["source_table", "row_id"]).withColumnRenamed("value", "basis")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_changed_values, p2_found, p3_found, p3_history, p6_found)
}

_HELD = """
snap as (
  select *, upper(regexp_replace(reference, '^\\s+|\\s+$', '', 'g')) as key,
         cast(regexp_extract(edition, '(\\d{4})$', 1) as int) * 12 - 1
           + list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(trim(edition), 1, 3))) as no
  from agreement_snapshots
),
held as (
  select * from (
    select *, row_number() over (partition by no, key order by delivered_at desc, snapshot_id desc) as rn from snap where key <> ''
  ) where rn = 1
),
eds as (select no, min(edition) as edition, row_number() over (order by no) as seq from held group by no),
"""

_STATE = "[" + ", ".join(
    f"coalesce({c}, '')" if c != "controllers" else "cast(coalesce(controllers, []) as varchar) || '#' || len(coalesce(controllers, []))"
    for c in ("title", "organisation", "organisation_type", "controllers", "controller_basis", "start_date", "end_date", "sublicensing", "commercial", "objective", "activities", "expected_output", "expected_benefits", "yielded_benefits")
) + "]"

_DAY = """
case
  when regexp_matches(trim({c}), '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}([T ].*)?$') then try_cast(regexp_extract(trim({c}), '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})', 1) as date)
  when regexp_matches(trim({c}), '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}( .*)?$') then cast(try_strptime(regexp_extract(trim({c}), '^(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), '%d/%m/%Y') as date)
  when regexp_matches(trim({c}), '^\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}}$') then cast(try_strptime(trim({c}), '%d %b %Y') as date)
  when regexp_matches(trim({c}), '^\\d{{1,2}} [A-Za-z]+ \\d{{4}}$') then cast(try_strptime(trim({c}), '%d %B %Y') as date)
end
"""

_P2_INPUT = f"""
iv as (
  select 'term' as span_source, regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '') as base_reference, '' as dataset, {_DAY.format(c="start_date")} as s, {_DAY.format(c="end_date")} as e
  from (select *, row_number() over (partition by key order by no desc) as last from held) where last = 1
  union all
  select 'release', upper(trim(base_reference)), coalesce(dataset, ''), {_DAY.format(c="p.from_date")}, {_DAY.format(c="p.to_date")}
  from (select base_reference, dataset, unnest(periods) as p from earlier_releases)
),
ok as (select * from iv where s is not null and e is not null and s <= e),
reach as (
  select *, max(e) over (partition by span_source, base_reference, dataset order by s, e rows between unbounded preceding and 1 preceding) as seen from ok
),
isle as (
  select *, sum(case when seen is null or s > seen + 1 then 1 else 0 end) over (partition by span_source, base_reference, dataset order by s, e rows unbounded preceding) as no from reach
),
per as (
  select span_source, base_reference, dataset, no, min(s) as s, max(e) as e from isle group by all
),
nxt as (select *, lead(s) over (partition by span_source, base_reference, dataset order by s) as after from per)
"""

#: What the cells of these tables come to when every delimiter outside quotes and brackets divides.
_P6 = r"""
with cells as (
  select 'state_datasets' as source_table, dataset_row_id as row_id, legal_basis as cell from state_datasets
  union all select 'earlier_releases', release_id, legal_basis from earlier_releases
),
signs as (  -- delimiters of several characters, and commas within numbers, as one character each
  select source_table, row_id,
         replace(replace(replace(regexp_replace(cell, '(\d),(\d)', '\1' || chr(1) || '\2', 'g'), ' / ', chr(2)), '//', chr(3)), ' + ', chr(4)) as cell
  from cells where cell is not null and regexp_matches(cell, '[^\s]')
),
parts as (
  select source_table, row_id,
         regexp_extract_all(cell, '(?:"(?:[^"]|"")*"|\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\]|[^;；,，、|¦\r\n\t•‣●▪\x02\x03\x04])+') as vs
  from signs
),
trimmed as (
  select source_table, row_id,
         list_transform(vs, lambda v: replace(replace(replace(replace(regexp_replace(v, '^\s+|\s+$', '', 'g'), chr(1), ','), chr(2), ' / '), chr(3), '//'), chr(4), ' + ')) as vs
  from parts
),
bare as (
  select source_table, row_id,
         list_filter(list_transform(vs, lambda v: case when regexp_full_match(v, '"(?:[^"]|"")*"') then trim(replace(v[2:-2], '""', '"')) else v end), lambda v: v <> '') as vs
  from trimmed
)
select source_table, row_id, cast(unnest(range(1, len(vs) + 1)) as bigint) as value_no, unnest(vs) as basis from bare
"""

SQL: dict[str, str] = {
    "p6_found": _P6,
    "p1_found": "with " + _HELD + f"""
st as (select h.key, e.seq, e.edition, {_STATE} as state from held h join eds e using (no)),
pairs as (
  select coalesce(b.key, a.key) as reference, coalesce(b.seq, a.seq + 1) as seq,
         case when a.key is null then 'added' when b.key is null then 'removed' when a.state <> b.state then 'changed' end as change_kind
  from st a full outer join st b on a.key = b.key and a.seq + 1 = b.seq
)
select e.edition, p.reference, p.change_kind from pairs p join eds e on e.seq = p.seq where p.seq > 1 and p.change_kind is not null
""",
    "p1_changed_values": "with " + _HELD + f"""
st as (select h.key, e.seq, e.edition, h.objective, h.end_date, {_STATE} as state from held h join eds e using (no)),
pairs as (
  select coalesce(b.key, a.key) as reference, coalesce(b.seq, a.seq + 1) as seq, a.objective as old_objective, b.objective as new_objective, a.end_date as old_end_date, b.end_date as new_end_date,
         case when a.key is null then 'added' when b.key is null then 'removed' when a.state <> b.state then 'changed' end as change_kind
  from st a full outer join st b on a.key = b.key and a.seq + 1 = b.seq
)
select e.edition, p.* exclude (seq) from pairs p join eds e on e.seq = p.seq where p.seq > 1 and p.change_kind is not null
""",
    "p3_history": "with " + _HELD + """
v as (select h.key, e.seq, objective, end_date, [coalesce(objective, ''), coalesce(end_date, '')] as val from held h join eds e using (no)),
m as (select *, case when lag(seq) over w = seq - 1 and lag(val) over w = val then 0 else 1 end as opens from v window w as (partition by key order by seq)),
r as (select *, sum(opens) over (partition by key order by seq rows unbounded preceding) as run from m),
g as (select key, run, min(seq) as a, max(seq) as b, arg_min(struct_pack(o := objective, e := end_date), seq) as x from r group by all)
select g.key as reference, f.edition as valid_from, coalesce(t.edition, '') as valid_to, x.o as objective, x.e as end_date from g join eds f on f.seq = g.a left join eds t on t.seq = g.b + 1
""",
    "p2_found": "with " + _HELD + _P2_INPUT + """
select span_source, base_reference, dataset, 'period' as span_kind, strftime(s, '%Y-%m-%d') as from_date, strftime(e, '%Y-%m-%d') as to_date from nxt
union all
select span_source, base_reference, dataset, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(after - 1, '%Y-%m-%d') from nxt where after is not null
""",
    "p3_found": "with " + _HELD + """
v as (select h.key, e.seq, [coalesce(objective, ''), coalesce(end_date, '')] as val from held h join eds e using (no)),
m as (select *, case when lag(seq) over w = seq - 1 and lag(val) over w = val then 0 else 1 end as opens from v window w as (partition by key order by seq)),
r as (select *, sum(opens) over (partition by key order by seq rows unbounded preceding) as run from m),
g as (select key, run, min(seq) as a, max(seq) as b from r group by all)
select g.key as reference, f.edition as valid_from, coalesce(t.edition, '') as valid_to from g join eds f on f.seq = g.a left join eds t on t.seq = g.b + 1
""",
}
