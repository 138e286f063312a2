"""History of changing attributes: a type-two dimension.

One step of the merge, ``advanced``, takes a key's versions and what the next snapshot says of it:
the attribute hash is compared with the open version; if it differs or the key is gone the version
is closed, and a new one is opened.  ``merge`` takes a snapshot into a stored dimension, ``build``
folds the same step over all snapshots of a table, key by key, with one shuffle of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.dates import strip
from quillspan.operators.snapshot_diff import held_rows, row_hash, values_of
from quillspan.session import cut, partitions
from quillspan.sources.register import editions_of, reference_key

#: A dimension: the key, the attributes' hash, the row they stand in and the editions of validity.
SCHEMA = "key string, h1 long, h2 long, row_id long, from_no int, to_no int"


#: A key's versions while snapshots are taken in, the open one last.
VERSIONS = "array<struct<h1:bigint,h2:bigint,row_id:bigint,from_at:int,to_at:int>>"


def advanced(versions: Column, row: Column, at: Column) -> Column:
    """A key's versions after a snapshot numbered ``at``; ``row`` is its entry there, or null."""
    opened = F.array(F.struct(row["h1"].alias("h1"), row["h2"].alias("h2"), row["row_id"].alias("row_id"), at.cast("int").alias("from_at"), F.lit(None).cast("int").alias("to_at")))
    current = F.get(versions, F.size(versions) - 1)
    is_open = F.coalesce(current["to_at"].isNull() & current["from_at"].isNotNull(), F.lit(False))
    same = is_open & row.isNotNull() & (current["h1"] == row["h1"]) & (current["h2"] == row["h2"])
    closed = F.transform(versions, lambda v, i: F.when(v["to_at"].isNull(), v.withField("to_at", at.cast("int"))).otherwise(v))
    ended = F.when(is_open, closed).otherwise(versions)
    return F.when(F.coalesce(same, F.lit(False)), versions).when(row.isNull(), ended).otherwise(F.concat(ended, opened))


def merge(dimension: DataFrame, snapshot: DataFrame, edition: int, columns: tuple[str, ...]) -> DataFrame:
    """The dimension after one more edition.

    ``to_no`` null marks an open version.  ``snapshot`` has one edition's rows; it must be newer
    than all merged before.  Versions closed earlier pass through untouched and unshuffled.
    """
    now = held_rows(snapshot, columns, partitions(snapshot.sparkSession)).select("key", F.struct("h1", "h2", "row_id").alias("row"))
    current, closed = dimension.filter("to_no is null"), dimension.filter("to_no is not null")
    version = F.struct("h1", "h2", "row_id", F.col("from_no").alias("from_at"), F.col("to_no").alias("to_at"))
    joined = current.select("key", F.array(version).alias("versions")).join(now, "key", "full_outer")
    versions = advanced(F.coalesce("versions", F.array().cast(VERSIONS)), F.col("row"), F.lit(edition))
    after = joined.select("key", F.inline(versions)).select("key", "h1", "h2", "row_id", F.col("from_at").alias("from_no"), F.col("to_at").alias("to_no"))
    return closed.unionByName(after)


def build(snapshots: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The history of ``columns`` per reference over all editions in ``snapshots``.

    Output: ``reference, valid_from, valid_to, row_id`` (the ``snapshot_id`` of the version's
    first row).  One row per longest run of successive editions that list the reference with the
    same values; ``valid_to`` is the edition after the run, ``''`` while the version is open.
    Null counts as blank.  A reference that leaves and returns starts a new version.

    A key has one narrow row per edition, so the array its merges are folded over is bounded by
    the number of editions.
    """
    spark = snapshots.sparkSession
    editions = editions_of(snapshots)
    if not editions:
        return spark.createDataFrame([], "reference string, valid_from string, valid_to string, row_id long")
    ordinal = F.create_map(*[F.lit(x) for i, (no, _) in enumerate(editions) for x in (no, i)])
    labels = F.array(*[F.lit(label) for _, label in editions], F.lit(""))
    rows = held_rows(snapshots, columns, partitions(spark)).select("key", F.struct(F.element_at(ordinal, F.col("edition_no")).alias("at"), "h1", "h2", "row_id").alias("row"))
    listed = rows.groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # one row per edition at most
    end = F.lit(len(editions))

    def step(versions: Column, row: Column, i: Column) -> Column:
        """The snapshots up to ``row``'s: those in between do not list the key, the first of them closes it."""
        before = F.get(F.col("rows"), i - 1)["at"]
        gap = F.coalesce(row["at"] > before + 1, F.lit(False))
        missing = advanced(versions, F.lit(None).cast("struct<at:int,h1:bigint,h2:bigint,row_id:bigint>"), before + 1)
        return advanced(F.when(gap, missing).otherwise(versions), row, row["at"])

    numbered = listed.withColumn("numbered", F.transform("rows", lambda r, i: F.struct(r.alias("row"), i.alias("i"))))
    folded = numbered.select("key", F.get("rows", F.size("rows") - 1)["at"].alias("last"), F.aggregate("numbered", F.array().cast(VERSIONS), lambda v, x: step(v, x["row"], x["i"])).alias("versions"))
    each = folded.select("key", "last", F.inline("versions"))
    closes = F.coalesce("to_at", F.when(F.col("last") + 1 < end, F.col("last") + 1).otherwise(end))
    return each.select(F.col("key").alias("reference"), F.element_at(labels, F.col("from_at") + 1).alias("valid_from"), F.element_at(labels, closes + 1).alias("valid_to"), "row_id")


def history_values(history: DataFrame, snapshots: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``history`` with the attribute values of each version, fetched by row id."""
    history = cut(history)
    return history.join(values_of(snapshots, history.select("row_id"), columns), "row_id", "left").drop("row_id")


def empty_dimension(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SCHEMA)


__all__ = ["build", "empty_dimension", "history_values", "merge", "reference_key", "row_hash", "strip"]
