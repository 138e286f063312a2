"""The versioned store: distinct states, editions as bridges to them, what an edition held and
what changed between editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no
from quillspan.functions.text import clean_line, name_key
from quillspan.plans.base import HELD, NO_SQL, Book, dataset_rows, held, line_sql
from quillspan.operators.snapshot_diff import values_of
from quillspan.session import cut
from quillspan.sources.register import STATE_COLUMNS, base_of, reference_key, table, version_key, version_of

BOOK = Book()

#: The single-value fields that comparisons look at, in order.
SCALARS = ("title", "organisation", "organisation_type", "controller_basis", "start_date", "end_date", "sublicensing", "commercial")

_STATE_SQL = "[" + ", ".join(f"coalesce({c}, '')" if c != "controllers" else "array_to_string(coalesce(controllers, []), chr(1)) || len(coalesce(controllers, []))" for c in STATE_COLUMNS) + "]"


def digests(spark: SparkSession, folder: str, digest: Column) -> DataFrame:
    """``no, key, base, digest, row_id`` of the row that holds per edition and reference.  The digest
    is made at the scan, so no text is ever shuffled."""
    rows = table(spark, folder, "agreement_snapshots").select(
        edition_no(F.col("edition")).alias("no"), reference_key(F.col("reference")).alias("key"), F.struct("delivered_at", "snapshot_id").alias("w"), F.struct(digest.alias("digest"), F.col("snapshot_id").alias("row_id")).alias("r")
    )
    best = rows.filter("no is not null and key <> ''").groupBy("no", "key").agg(F.max_by("r", "w").alias("r"))
    return best.select("no", "key", base_of(F.col("key")).alias("base"), "r.*")


def states(spark: SparkSession, folder: str) -> DataFrame:
    """``no, key, base, state``: the state of each reference in each edition as a digest."""
    values = [F.coalesce(F.col(c), F.lit("")) if c != "controllers" else F.to_json(F.coalesce(c, F.array().cast("array<string>"))) for c in STATE_COLUMNS]
    return digests(spark, folder, F.sha2(F.to_json(F.struct(*[v.alias(c) for c, v in zip(STATE_COLUMNS, values, strict=True)])), 256)).withColumnRenamed("digest", "state").drop("row_id")


def differing(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """``no, key, was, now`` of every reference of which one of the fields differs from the edition
    before; ``was`` and ``now`` are structs of the fields.  Digests are compared first, and texts
    fetched by row id for those that differ alone."""
    d = digests(spark, folder, F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in fields])), 256))
    pairs = d.select("no").distinct().select("no", F.lag("no").over(Window.orderBy("no")).alias("prev"))  # editions are months: few
    last = F.lag(F.struct("no", "digest", "row_id")).over(Window.partitionBy("key").orderBy("no"))
    found = cut(d.withColumn("l", last).join(F.broadcast(pairs), "no").filter("l.no = prev and l.digest <> digest").select("no", "key", F.col("l.row_id").alias("old_row"), F.col("row_id").alias("new_row")))
    wanted = cut(found.select(F.explode(F.array("old_row", "new_row")).alias("row_id")).distinct())
    values = values_of(table(spark, folder, "agreement_snapshots"), wanted, fields).select("row_id", F.struct(*fields).alias("v"))
    for side, name in (("old_row", "was"), ("new_row", "now")):
        found = found.join(values.select(F.col("row_id").alias(side), F.col("v").alias(name)), side)
    return found.select("no", "key", "was", "now")


def numbered(df: DataFrame) -> DataFrame:
    """States numbered from 0 per reference in the order they were first seen."""
    first = df.groupBy("key", "state").agg(F.min("no").alias("first_no"), F.count(F.lit(1)).alias("editions"))
    return first.withColumn("state_no", (F.row_number().over(Window.partitionBy("key").orderBy("first_no")) - 1).cast("long"))


_V1 = HELD + f", st as (select no, key, {_STATE_SQL} as state from held), f as (select key, state, min(no) as first_no, count(*) as editions from st group by all) "


@BOOK.add(_V1 + "select key, row_number() over (partition by key order by first_no) - 1 as state_no, first_no, editions from f")
def v1_state_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return numbered(states(spark, folder)).select("key", "state_no", "first_no", "editions")


@BOOK.add(_V1 + ", n as (select *, row_number() over (partition by key order by first_no) - 1 as state_no from f) select st.no, st.key, n.state_no from st join n on n.key = st.key and n.state = st.state")
def s6_edition_index(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge: which state of a reference an edition lists."""
    s = states(spark, folder)
    return s.join(numbered(s), ["key", "state"]).select("no", "key", "state_no")


@BOOK.add(HELD + f", nos as (select list_sort(list(distinct no)) as l from held) select key, {line_sql('title')} as title, {line_sql('organisation')} as organisation from held where no = (select l[greatest(1, len(l) // 2)] from nos)")
def s7_time_travel(spark: SparkSession, folder: str) -> DataFrame:
    """The edition in the middle of the register's life exactly as published then."""
    from quillspan.sources.register import editions_of

    nos = [no for no, _ in editions_of(table(spark, folder, "agreement_snapshots"))]
    at = nos[max(1, len(nos) // 2) - 1]
    return held(spark, folder, "title", "organisation").filter(F.col("no") == at).select("key", clean_line(F.col("title")).alias("title"), clean_line(F.col("organisation")).alias("organisation"))


@BOOK.add(HELD + "select e.no, d.name_key, count(distinct d.key) as n_references from (select no, key from held) e join (select distinct key, name_key from dat) d using (key) group by all")
def s9_names_by_edition(spark: SparkSession, folder: str) -> DataFrame:
    """References per data set name in every edition."""
    e, d = held(spark, folder).select("no", "key"), dataset_rows(spark, folder).select("key", "name_key").distinct()
    return e.join(d, "key").groupBy("no", "name_key").agg(F.count(F.lit(1)).alias("n_references"))


@BOOK.add(HELD + ", l as (select key, max(no) as last_no, min(no) as first_no from held group by key), b as (select regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '') as base, max(last_no) as base_last from l group by 1) select key, first_no, last_no, base_last < (select max(no) from held) as agreement_gone from l join b on b.base = regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '') where last_no < (select max(no) from held)")
def v6_archive_last_seen(spark: SparkSession, folder: str) -> DataFrame:
    """References that have left the register, and whether their whole agreement has."""
    h = held(spark, folder).select("no", "key", "base")
    seen = h.groupBy("base", "key").agg(F.min("no").alias("first_no"), F.max("no").alias("last_no"))
    top = h.agg(F.max("no").alias("top"))
    per = seen.withColumn("base_last", F.max("last_no").over(Window.partitionBy("base"))).crossJoin(top)  # one row
    return per.filter("last_no < top").select("key", "first_no", "last_no", (F.col("base_last") < F.col("top")).alias("agreement_gone"))


@BOOK.add(HELD + ", e as (select distinct no from held), g as (select no, lead(no) over (order by no) as nxt from e) select cast(unnest(generate_series(no + 1, nxt - 1)) as int) as missing_no, no as after_no from g where nxt > no + 1")
def w7_missing_editions(spark: SparkSession, folder: str) -> DataFrame:
    """Months between neighbouring editions for which there is none."""
    e = table(spark, folder, "agreement_snapshots").select(edition_no(F.col("edition")).alias("no")).filter("no is not null").distinct()
    nxt = e.withColumn("nxt", F.lead("no").over(Window.orderBy("no")))  # editions are months: few
    return nxt.filter("nxt > no + 1").select(F.explode(F.sequence(F.col("no") + 1, F.col("nxt") - 1)).alias("missing_no"), F.col("no").alias("after_no"))


_VERSIONS = HELD + ", v as (select *, lag(key) over w as older from lat window w as (partition by base order by vkey, start, key)) "


@BOOK.add(_VERSIONS + "select v.base, v.key as newer, v.older, (o.title <> v.title) as title_differs, (lower(o.organisation) <> lower(v.organisation)) as organisation_differs from v join lat o on o.key = v.older")
def w1_consecutive_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Each version of the newest edition beside the one before it."""
    from quillspan.functions.dates import parse_day
    from quillspan.functions.text import iso
    from quillspan.plans.base import latest

    v = latest(spark, folder, "title", "organisation", "start_date").select("base", "key", "vkey", clean_line(F.col("title")).alias("title"), clean_line(F.col("organisation")).alias("organisation"), iso(parse_day(F.col("start_date"))).alias("start"))
    w = Window.partitionBy("base").orderBy("vkey", "start", "key")
    o = F.lag(F.struct("key", "title", "organisation")).over(w)
    return v.withColumn("o", o).filter("o is not null").select("base", F.col("key").alias("newer"), F.col("o.key").alias("older"), (F.col("o.title") != F.col("title")).alias("title_differs"), (F.lower("o.organisation") != F.lower("organisation")).alias("organisation_differs"))


_PAIRS = HELD + ", e as (select no, lag(no) over (order by no) as prev from (select distinct no from held)) "


_D3 = _PAIRS + f""", st as (select no, key, regexp_replace(key, '-V[0-9]+(\\.[0-9]+)?$', '') as base, {_STATE_SQL} as state from held),
c as (select b.no, b.key, b.base, case when a.key is null then 'added' when a.state <> b.state then 'amended' end as kind
      from st b join e on e.no = b.no and e.prev is not null left join st a on a.key = b.key and a.no = e.prev
      union all select e.no, a.key, a.base, 'removed' from st a join e on e.prev = a.no left join st b on b.key = a.key and b.no = e.no where b.key is null) """


@BOOK.add(_D3 + "select no, kind, count(*) as n, count(distinct base) as agreements from c where kind is not null group by all")
def d3_added_amended_removed(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).groupBy("no", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("agreements"))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """``no, key, base, kind`` of every reference added, amended or removed: state digests alone
    are compared, once for all pairs of editions."""
    s = states(spark, folder)
    e = s.select("no").distinct()
    pairs = e.select("no", F.lead("no").over(Window.orderBy("no")).alias("after"), F.lag("no").over(Window.orderBy("no")).alias("prev"))
    at = s.join(F.broadcast(pairs), "no")
    w = Window.partitionBy("key").orderBy("no")
    seen = at.select("no", "key", "base", "after", "prev", "state", F.lag(F.struct("no", "state")).over(w).alias("l"), F.lead("no").over(w).alias("nxt"))
    here = F.when(F.col("prev").isNull(), F.lit(None)).when(F.col("l").isNull() | (F.col("l.no") != F.col("prev")), "added").when(F.col("l.state") != F.col("state"), "amended")
    gone = F.when(F.col("after").isNotNull() & (F.col("nxt").isNull() | (F.col("nxt") != F.col("after"))), "removed")
    events = F.filter(F.array(F.struct(F.col("no"), here.alias("kind")), F.struct(F.col("after").alias("no"), gone.alias("kind"))), lambda x: x["kind"].isNotNull())
    return seen.select("key", "base", F.inline(events))


@BOOK.add(_D3 + ", had as (select distinct no, base from st) select c.no, c.key, case when h.base is null then 'new' else 'renewal' end as kind from c join e on e.no = c.no left join had h on h.no = e.prev and h.base = c.base where c.kind = 'added'")
def d3_renewal_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Added references: renewals of an agreement the edition before listed, or new ones."""
    added = _changes(spark, folder).filter("kind = 'added'").select("no", "key", "base")
    h = held(spark, folder).select("no", "base").distinct()
    pairs = h.select("no").distinct().select("no", F.lead("no").over(Window.orderBy("no")).alias("after"))
    had = h.join(F.broadcast(pairs), "no").select(F.col("after").alias("no"), "base", F.lit(True).alias("had"))
    return added.join(had, ["no", "base"], "left").select("no", "key", F.when(F.col("had"), "renewal").otherwise("new").alias("kind"))


@BOOK.add(_D3 + ", f as (select base, min(no) as first_no from st group by base) select f.base, f.first_no, count(*) filter (kind = 'added' and c.no > f.first_no) as versions_added, count(*) filter (kind = 'amended') as amendments, count(*) filter (kind = 'removed') as removals from f left join c using (base) group by all")
def d5_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Per agreement: its first edition and what happened to its versions since."""
    first = held(spark, folder).groupBy("base").agg(F.min("no").alias("first_no"))
    c = _changes(spark, folder).groupBy("base", "no").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "amended", "removed")])
    j = first.join(c, "base", "left")
    return j.groupBy("base", "first_no").agg(
        F.coalesce(F.sum(F.when(F.col("no") > F.col("first_no"), F.col("added"))), F.lit(0)).alias("versions_added"), F.coalesce(F.sum("amended"), F.lit(0)).alias("amendments"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removals")
    )


_FIELDS = ", ".join(f"case when coalesce(a.{c}, '') <> coalesce(b.{c}, '') then '{c}' end" for c in SCALARS)


@BOOK.add(_PAIRS + f", d as (select b.no, unnest(list_filter([{_FIELDS}], lambda x: x is not null)) as field from held b join e on e.no = b.no join held a on a.key = b.key and a.no = e.prev) select no, field, count(*) as n from d group by all")
def d7_scalar_changes(spark: SparkSession, folder: str) -> DataFrame:
    """How often each single-value field changed from one edition to the next."""
    b = held(spark, folder, *SCALARS)
    e = b.select("no").distinct()
    pairs = e.select("no", F.lag("no").over(Window.orderBy("no")).alias("prev"))
    w = Window.partitionBy("key").orderBy("no")
    j = b.join(F.broadcast(pairs), "no").withColumn("l", F.lag(F.struct("no", *SCALARS)).over(w)).filter("l.no = prev")
    fields = F.filter(F.array(*[F.when(F.coalesce(F.col(f"l.{c}"), F.lit("")) != F.coalesce(F.col(c), F.lit("")), c) for c in SCALARS]), lambda x: x.isNotNull())
    return j.select("no", F.explode(fields).alias("field")).groupBy("no", "field").agg(F.count(F.lit(1)).alias("n"))


_KEYS_SQL = "list_filter(list_transform(coalesce({t}.controllers, []), lambda x: lower(" + line_sql("x") + ")), lambda x: x <> '')"


@BOOK.add(_PAIRS + f", d as (select b.no, b.key, {_KEYS_SQL.replace('{t}', 'a')} as was, {_KEYS_SQL.replace('{t}', 'b')} as now from held b join e on e.no = b.no join held a on a.key = b.key and a.no = e.prev), x as (select no, key, list_sort(list_distinct(list_filter(now, lambda x: not list_contains(was, x)))) as added, list_sort(list_distinct(list_filter(was, lambda x: not list_contains(now, x)))) as removed from d) select no, key, array_to_string(added, '; ') as added, array_to_string(removed, '; ') as removed from x where len(added) + len(removed) > 0")
def u2_list_change(spark: SparkSession, folder: str) -> DataFrame:
    """Controllers added to and removed from a reference between editions, by normalised name."""
    keys = F.filter(F.transform(F.coalesce("controllers", F.array().cast("array<string>")), name_key), lambda x: x != "")
    b = held(spark, folder, "controllers").select("no", "key", keys.alias("now"))
    pairs = b.select("no").distinct().select("no", F.lag("no").over(Window.orderBy("no")).alias("prev"))
    w = Window.partitionBy("key").orderBy("no")
    j = b.join(F.broadcast(pairs), "no").withColumn("l", F.lag(F.struct("no", "now")).over(w)).filter("l.no = prev")
    diff = j.select("no", "key", F.sort_array(F.array_except("now", "l.now")).alias("a"), F.sort_array(F.array_except("l.now", "now")).alias("r"))
    return diff.filter("size(a) + size(r) > 0").select("no", "key", F.array_join("a", "; ").alias("added"), F.array_join("r", "; ").alias("removed"))


_COMBO = "concat_ws('/', type_of_data, sensitivity, confidentiality)"


@BOOK.add(HELD + f", c as (select base, key, name_key, list_sort(list(distinct {_COMBO})) as combos, list_transform(string_split(nullif(regexp_extract(key, '-V([0-9]+(\\.[0-9]+)?)$', 1), ''), '.'), lambda x: cast(x as int)) as vkey from dat group by all), v as (select *, lag(combos) over w as was, lag(key) over w as older from c window w as (partition by base, name_key order by coalesce(vkey, [0]), key)) select base, name_key, older, key as newer, array_to_string(was, '|') as was, array_to_string(combos, '|') as now from v where older is not null and was <> combos")
def d8_attribute_change(spark: SparkSession, folder: str) -> DataFrame:
    """Data set attributes that differ between neighbouring versions of an agreement."""
    combo = F.concat_ws("/", "type_of_data", "sensitivity", "confidentiality")
    c = dataset_rows(spark, folder).groupBy("base", "key", "name_key").agg(F.sort_array(F.collect_set(combo)).alias("combos"))
    w = Window.partitionBy("base", "name_key").orderBy(version_key(version_of(F.col("key"))), "key")
    v = c.withColumn("l", F.lag(F.struct("key", "combos")).over(w)).filter("l is not null and l.combos <> combos")
    return v.select("base", "name_key", F.col("l.key").alias("older"), F.col("key").alias("newer"), F.array_join("l.combos", "|").alias("was"), F.array_join("combos", "|").alias("now"))


#: A rewording seen on this many agreements in one edition is register-wide.
WIDE = 2
_WORDINGS = ", ".join("{'was': " + line_sql(f"a.{c}") + ", 'now': " + line_sql(f"b.{c}") + "}" for c in SCALARS)


@BOOK.add(_PAIRS + f", d as (select b.no, regexp_replace(b.key, '-V[0-9]+(\\.[0-9]+)?$', '') as base, unnest([{_WORDINGS}]) as x from held b join e on e.no = b.no join held a on a.key = b.key and a.no = e.prev) select no, x.was as was, x.now as now, count(distinct base) as agreements from d where x.was <> x.now group by all having count(distinct base) >= {WIDE}")
def a26_wide_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Rewordings that an edition makes on several agreements alike."""
    b = held(spark, folder, *SCALARS)
    pairs = b.select("no").distinct().select("no", F.lag("no").over(Window.orderBy("no")).alias("prev"))
    w = Window.partitionBy("key").orderBy("no")
    j = b.join(F.broadcast(pairs), "no").withColumn("l", F.lag(F.struct("no", *SCALARS)).over(w)).filter("l.no = prev")
    each = j.select("no", "base", F.explode(F.array(*[F.struct(clean_line(F.col(f"l.{c}")).alias("was"), clean_line(F.col(c)).alias("now")) for c in SCALARS])).alias("x")).select("no", "base", "x.*")
    return each.filter("was <> now").groupBy("no", "was", "now").agg(F.count_distinct("base").alias("agreements")).filter(F.col("agreements") >= WIDE)


@BOOK.add(f"with o as (select {NO_SQL} as no, file_ref, loaded_at, release_row_id from released_files), s as (select file_ref, no, row_number() over (partition by file_ref order by no, loaded_at, release_row_id) as rn from o) select no, count(*) filter (rn = 1) as new_files, count(*) filter (rn > 1) as described_again from s group by no")
def a33_ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Per edition: files reported for the first time, and rows that describe a known file again."""
    o = table(spark, folder, "released_files").select(edition_no(F.col("edition")).alias("no"), "file_ref", F.struct("loaded_at", "release_row_id").alias("w"))
    s = o.withColumn("rn", F.row_number().over(Window.partitionBy("file_ref").orderBy("no", "w")))
    return s.groupBy("no").agg(F.count_if(F.col("rn") == 1).alias("new_files"), F.count_if(F.col("rn") > 1).alias("described_again"))


@BOOK.add(f"select upper(trim(f.base_reference)) as base, count(*) as n_rows from released_files f where not exists (select 1 from agreement_snapshots s where regexp_replace(upper(trim(s.reference)), '-V[0-9]+(\\.[0-9]+)?$', '') = upper(trim(f.base_reference))) group by 1")
def q12_orphan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Released files of agreements that no edition lists; counted before the anti-join, so an
    agreement with a tenth of all rows is one row in it."""
    f = table(spark, folder, "released_files").groupBy(reference_key(F.col("base_reference")).alias("base")).agg(F.count(F.lit(1)).alias("n_rows"))
    s = table(spark, folder, "agreement_snapshots").select(base_of(reference_key(F.col("reference"))).alias("base")).distinct()
    return f.join(s, "base", "left_anti")


#: The fields of prose, in order.
PROSE = ("objective", "activities", "expected_output", "expected_benefits", "yielded_benefits")


def _plain_sql(c: str) -> str:
    return f"lower(translate({line_sql(c)}, '‘’“”–—', '''''\"\"--'))"


_KINDS = ", ".join(
    f"{{'f': '{c}', 'k': case when coalesce(a.{c}, '') = coalesce(b.{c}, '') then null when {_plain_sql(f'a.{c}')} = {_plain_sql(f'b.{c}')} then 'cosmetic' when {line_sql(f'a.{c}')} = '' then 'filled in' when {line_sql(f'b.{c}')} = '' then 'emptied' else 'changed' end}}"
    for c in (*SCALARS, *PROSE)
)
_D7 = _PAIRS + f", d as (select b.no, b.key, unnest([{_KINDS}]) as x from held b join e on e.no = b.no join held a on a.key = b.key and a.no = e.prev) "


def change_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """``no, key, field, kind`` of every field that differs from the edition before: cosmetic
    (typography, spacing, case), filled in, emptied or changed.  Only references whose state
    digest differs are compared field by field."""
    fields = (*SCALARS, *PROSE)
    plain = lambda c: F.lower(F.translate(clean_line(c), "‘’“”–—", "''\"\"--"))
    j = differing(spark, folder, *fields)

    def kind(c: str):
        was, now = F.coalesce(F.col(f"was.{c}"), F.lit("")), F.coalesce(F.col(f"now.{c}"), F.lit(""))
        return F.when(was == now, F.lit(None)).when(plain(was) == plain(now), "cosmetic").when(clean_line(was) == "", "filled in").when(clean_line(now) == "", "emptied").otherwise("changed")

    each = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), kind(c).alias("kind")) for c in fields]), lambda x: x["kind"].isNotNull())
    return j.select("no", "key", F.inline(each))


@BOOK.add(_D7 + "select no, x.f as field, x.k as kind, count(*) as n from d where x.k is not null group by all")
def d7_change_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return change_kinds(spark, folder).groupBy("no", "field", "kind").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(_D7 + ", v as (select no, key, bool_or(x.k <> 'cosmetic') as material, count(*) as fields from d where x.k is not null group by no, key) select no, count(*) as amended, count(*) filter (material) as material from v group by no")
def f5_material_amendments(spark: SparkSession, folder: str) -> DataFrame:
    """References amended per edition, and those amended in substance."""
    v = change_kinds(spark, folder).groupBy("no", "key").agg(F.bool_or(F.col("kind") != "cosmetic").alias("m"))
    return v.groupBy("no").agg(F.count(F.lit(1)).alias("amended"), F.count_if("m").alias("material"))


@BOOK.add(_D7 + ", v as (select no, key, array_to_string(list_sort(list(x.f || ': ' || x.k)), ', ') as details from d where x.k is not null and x.k <> 'cosmetic' group by no, key) select * from v")
def d14_details(spark: SparkSession, folder: str) -> DataFrame:
    """What was amended about a reference, in words."""
    k = change_kinds(spark, folder).filter("kind <> 'cosmetic'")
    return k.groupBy("no", "key").agg(F.array_join(F.sort_array(F.collect_list(F.concat("field", F.lit(": "), "kind"))), ", ").alias("details"))
