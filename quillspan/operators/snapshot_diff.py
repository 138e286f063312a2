"""What changed between full snapshots.

Method: a key-to-hash index of the last snapshot, bucketed by key.  A new snapshot is hashed and
bucketed in one narrow shuffle; it is then probed against the last index bucket by bucket (both
sides are bucketed alike, so the probe shuffles nothing), old and new values are fetched for the
keys that changed alone, and the new index is swapped in for the last one.

``SnapshotIndex`` does this for a snapshot that arrives; ``diff_snapshots`` replays all snapshots
of a table in one pass over the buckets, where the entry that a key's row probes and then swaps is
the row before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, strip
from quillspan.session import cut, discard, partitions, work_path
from quillspan.sources.register import STATE_COLUMNS, blank_for_null, editions_of, reference_key


def row_hash(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """128 bits over the columns, character by character; null counts as blank.

    Two independently seeded 64-bit hashes; each column feeds the seed of the next, so text
    that moves from one column to its neighbour changes the hash.
    """
    values = [blank_for_null(df, c) for c in columns]
    return F.struct(F.xxhash64(F.lit(1), *values).alias("h1"), F.xxhash64(F.lit(2), *values).alias("h2"))


def held_rows(snapshots: DataFrame, columns: tuple[str, ...], buckets: int) -> DataFrame:
    """One narrow row per edition and key: ``edition_no, key, h1, h2, row_id``.

    The row delivered last holds (ties: the greatest ``snapshot_id``).  Rows without an edition
    or a reference are left out.  Repeated rows are reduced before they are shuffled; then a key
    has one row per edition, so no key is hot.  Hash-partitioned by key alone: one bucket holds a
    key's every edition.
    """
    narrow = snapshots.select(
        edition_no(F.col("edition")).alias("edition_no"),
        reference_key(F.col("reference")).alias("key"),
        F.struct(
            F.col("delivered_at").cast("timestamp_ntz").alias("at"), F.col("snapshot_id").cast("long").alias("row_id"), row_hash(snapshots, columns).alias("h")
        ).alias("row"),
    ).filter("edition_no is not null and key <> ''")
    return (
        narrow.groupBy("edition_no", "key")
        .agg(F.max_by("row", F.struct("row.at", "row.row_id")).alias("row"))
        .select("edition_no", "key", "row.h.h1", "row.h.h2", "row.row_id")
        .repartition(buckets, "key")
    )


def change_kind(last: Column, new: Column, same: Column) -> Column:
    """What a probe tells, from whether either index has the key and whether the hashes agree."""
    return F.when(~last, "added").when(~new, "removed").when(~same, "changed")


class SnapshotIndex:
    """The bucketed key-to-hash index of the last snapshot, a table of the shared folder."""

    def __init__(self, spark: SparkSession, columns: tuple[str, ...] = STATE_COLUMNS, buckets: int | None = None):
        self.spark, self.columns, self.buckets = spark, columns, buckets or partitions(spark)
        self.edition: str | None = None
        self.last: str | None = None
        self.next: tuple[str, str] | None = None

    def _write(self, snapshot: DataFrame) -> str:
        path = work_path(self.spark, "snapshot-index")
        name = "quillspan_" + path.rsplit("-", 1)[-1]
        rows = held_rows(snapshot, self.columns, self.buckets).select("key", "h1", "h2", "row_id")
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name

    def probe(self, snapshot: DataFrame, edition: str) -> DataFrame:
        """``edition, reference, change_kind, old_row, new_row`` of the keys of one snapshot that
        differ from the last; nothing differs from the first.  ``swap`` ends the step."""
        if self.next:
            raise ValueError("the snapshot probed before has not been swapped in")
        self.next = (self._write(snapshot), edition)
        b = self.spark.table(self.next[0]).alias("b")
        a = (self.spark.table(self.last) if self.last else self.spark.table(self.next[0])).alias("a")
        same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
        kind = change_kind(F.col("a.key").isNotNull(), F.col("b.key").isNotNull(), same)
        joined = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer")
        return joined.select(
            F.lit(edition).alias("edition"), F.coalesce("a.key", "b.key").alias("reference"), kind.alias("change_kind"), F.col("a.row_id").alias("old_row"), F.col("b.row_id").alias("new_row")
        ).filter("change_kind is not null")

    def swap(self) -> None:
        """The index probed last takes the place of the one before, which is dropped; what ``probe``
        returned must have been written by then."""
        if self.next:
            self._forget(self.last)
            (self.last, self.edition), self.next = self.next, None

    def _forget(self, name: str | None) -> None:
        if name:
            self.spark.sql(f"drop table if exists {name}")
            discard(self.spark, name.removeprefix("quillspan_"))

    def drop(self) -> None:
        for name in (self.last, self.next and self.next[0]):
            self._forget(name)
        self.last = self.next = None


def diff_snapshots(snapshots: DataFrame, columns: tuple[str, ...] = STATE_COLUMNS) -> DataFrame:
    """References added, removed or changed from each edition to the next.

    Input: ``snapshot_id, edition, delivered_at, reference`` and ``columns``; other columns are
    ignored.  Output: ``edition, reference, change_kind, old_row, new_row``; the rows are the
    ``snapshot_id`` that held before and now, null where there is none.  The first edition gives
    no rows; an empty table or a single edition gives an empty result.

    One pass, however many editions: a key's index entries stand in one bucket in the order of the
    editions, so the entry a row probes is the one before it, if that is of the edition before; an
    entry that is not probed by the next edition is a key removed.
    """
    spark = snapshots.sparkSession
    editions = editions_of(snapshots)
    if len(editions) < 2:
        return spark.createDataFrame([], "edition string, reference string, change_kind string, old_row long, new_row long")
    ordinal = F.create_map(*[F.lit(x) for i, (no, _) in enumerate(editions, 1) for x in (no, i)])
    labels = F.array(*[F.lit(label) for _, label in editions])
    entries = held_rows(snapshots, columns, partitions(spark)).withColumn("at", F.element_at(ordinal, F.col("edition_no")))
    bucket = Window.partitionBy("key").orderBy("at")
    last = F.lag(F.struct("at", "h1", "h2", "row_id")).over(bucket)
    seen = entries.select("key", "at", "h1", "h2", "row_id", last.alias("last"), F.lead("at").over(bucket).alias("next_at"))
    has_last = F.coalesce(F.col("last.at") == F.col("at") - 1, F.lit(False))
    same = (F.col("last.h1") == F.col("h1")) & (F.col("last.h2") == F.col("h2"))
    here = F.struct(
        F.col("at"), F.when(F.col("at") > 1, change_kind(has_last, F.lit(True), same)).alias("change_kind"), F.when(has_last, F.col("last.row_id")).alias("old_row"), F.col("row_id").alias("new_row")
    )
    unprobed = (F.col("at") < len(editions)) & ~F.coalesce(F.col("next_at") == F.col("at") + 1, F.lit(False))
    gone = F.struct((F.col("at") + 1).alias("at"), F.when(unprobed, "removed").alias("change_kind"), F.col("row_id").alias("old_row"), F.lit(None).cast("long").alias("new_row"))
    events = seen.select(F.col("key").alias("reference"), F.inline(F.filter(F.array(here, gone), lambda x: x["change_kind"].isNotNull())))
    return events.select(F.element_at(labels, F.col("at")).alias("edition"), "reference", "change_kind", "old_row", "new_row")


#: Row ids up to this many are sent to the executors to pick their rows at the scan.
BROADCAST_IDS = 2_000_000


def values_of(snapshots: DataFrame, wanted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``row_id`` and ``columns`` of the rows that ``wanted`` names by ``row_id``.  Rows are picked at
    the scan where the ids are few enough to be sent around (counted, not guessed), so the
    values of all others are never shuffled; beyond that they are picked by a join."""
    values = snapshots.select(F.col("snapshot_id").cast("long").alias("row_id"), *columns)
    return values.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "row_id", "left_semi")


def with_values(changes: DataFrame, snapshots: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``changes`` with ``old_<column>`` and ``new_<column>``, fetched by row id for changed
    references alone."""
    out = changes = cut(changes)
    wanted = changes.select(F.explode(F.array("old_row", "new_row")).alias("row_id")).filter("row_id is not null").distinct()
    values = values_of(snapshots, cut(wanted), columns)
    for side in ("old", "new"):
        picked = values.select(F.col("row_id").alias(f"{side}_row"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(picked, f"{side}_row", "left")
    return out.select("edition", "reference", "change_kind", *[f"{s}_{c}" for c in columns for s in ("old", "new")])


def edition_label(df: DataFrame) -> DataFrame:
    """The editions of ``df``: ``edition_no, edition``."""
    return (
        df.select(edition_no(F.col("edition")).alias("edition_no"), strip(F.col("edition")).alias("edition"))
        .filter("edition_no is not null")
        .groupBy("edition_no")
        .agg(F.min("edition").alias("edition"))
    )
