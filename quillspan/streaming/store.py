"""The versioned store as a sink: editions appended one by one, in a batch job or from a stream.

Tables in the store's folder: ``states`` (distinct states of a reference, numbered as first
seen), ``index`` (which state an edition lists; a partition per edition), ``releases`` (a file's
descriptions, a row only when something changed) and ``withdrawals``.  Appending an edition
again writes nothing new.  A late edition never withdraws a file that a later one described.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no
from quillspan.session import cut
from quillspan.sources.register import STATE_COLUMNS, reference_key

STATES = "key string, state_no long, state string, first_no int, row_id long"
INDEX = "key string, state_no long, edition_no int"
RELEASES = "file_ref string, described string, month string, opt_outs string, edition_no int"
WITHDRAWALS = "file_ref string, edition_no int"


class RegisterStore:
    """Append-only tables under one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        schema = {"states": STATES, "index": INDEX, "releases": RELEASES, "withdrawals": WITHDRAWALS}[name]
        at = f"{self.folder}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at)

    def append(self, rows: DataFrame, files: DataFrame | None = None) -> dict[str, int]:
        """Take in one edition or several; they are appended oldest first."""
        numbered = rows.withColumn("__no", edition_no(F.col("edition"))).filter("__no is not null")
        editions = [r[0] for r in numbered.select("__no").distinct().orderBy("__no").collect()]  # months
        counts = {"new_states": 0, "new_files": 0, "redescribed": 0, "withdrawn": 0}
        for no in editions:
            counts["new_states"] += self._append_states(numbered.filter(F.col("__no") == no), no)
            if files is not None:
                of = files.filter(edition_no(F.col("edition")) == no)
                for k, v in self._append_files(of, no).items():
                    counts[k] += v
        return counts

    def _append_states(self, rows: DataFrame, no: int) -> int:
        values = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c != "controllers" else F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in STATE_COLUMNS]))
        listed = rows.select(reference_key(F.col("reference")).alias("key"), F.struct(F.sha2(values, 256).alias("state"), F.col("snapshot_id").cast("long").alias("row_id")).alias("r"), F.struct("delivered_at", "snapshot_id").alias("w")).filter("key <> ''")
        now = cut(listed.groupBy("key").agg(F.max_by("r", "w").alias("r")).select("key", "r.state", "r.row_id"))
        known = self.read("states")
        fresh = now.join(known.select("key", "state"), ["key", "state"], "left_anti")
        top = known.groupBy("key").agg(F.max("state_no").alias("top"))
        added = cut(fresh.join(top, "key", "left").select("key", (F.coalesce("top", F.lit(-1)) + 1).cast("long").alias("state_no"), "state", F.lit(no).cast("int").alias("first_no"), "row_id"))
        n = added.count()
        if n:
            added.write.mode("append").parquet(f"{self.folder}/states")
        index = now.join(known.select("key", "state", "state_no").unionByName(added.select("key", "state", "state_no")), ["key", "state"])
        done = cut(index.select("key", "state_no", F.lit(no).cast("int").alias("edition_no")))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_no").parquet(f"{self.folder}/index")
        return n

    def _latest(self) -> DataFrame:
        """The newest observation of each file: a description, or that it was withdrawn."""
        seen = self.read("releases").select("file_ref", "edition_no", F.lit(0).alias("gone"), F.struct("described", "month", "opt_outs").alias("d"))
        gone = self.read("withdrawals").select("file_ref", "edition_no", F.lit(1).alias("gone"), F.lit(None).cast("struct<described: string, month: string, opt_outs: string>").alias("d"))
        return seen.unionByName(gone).groupBy("file_ref").agg(F.max_by(F.struct("edition_no", "gone", "d"), F.struct("edition_no", "gone")).alias("l")).select("file_ref", F.col("l.edition_no").alias("was_no"), "l.gone", F.col("l.d").alias("was"))

    def _append_files(self, files: DataFrame, no: int) -> dict[str, int]:
        d = F.struct(F.coalesce(F.col("group_id").cast("string"), F.lit("")).alias("described"), F.coalesce("release_month", F.lit("")).alias("month"), F.coalesce("opt_outs", F.lit("")).alias("opt_outs"))
        now = files.select("file_ref", d.alias("now"), F.struct("loaded_at", "release_row_id").alias("w")).filter("file_ref is not null").groupBy("file_ref").agg(F.max_by("now", "w").alias("now"))
        both = cut(now.join(self._latest(), "file_ref", "full_outer"))
        changed = both.filter("now is not null and (was is null or gone = 1 or now <> was)")
        out = cut(changed.select("file_ref", "now.*", F.lit(no).cast("int").alias("edition_no"), (F.col("was").isNotNull() & (F.col("gone") == 0)).alias("again")))
        leaves = cut(both.filter(f"now is null and gone = 0 and was_no <= {no}").select("file_ref", F.lit(no).cast("int").alias("edition_no")))
        n = {"new_files": out.filter("not again").count(), "redescribed": out.filter("again").count(), "withdrawn": leaves.count()}
        if n["new_files"] + n["redescribed"]:
            out.drop("again").write.mode("append").parquet(f"{self.folder}/releases")
        if n["withdrawn"]:
            leaves.write.mode("append").parquet(f"{self.folder}/withdrawals")
        return n

    def edition(self, no: int) -> DataFrame:
        """An edition as published: the index of that month alone, and the states it names."""
        listed = self.read("index").filter(F.col("edition_no") == no)
        return listed.join(self.read("states"), ["key", "state_no"]).select("key", "state_no", "state", "row_id")

    def files_as_at(self, no: int) -> DataFrame:
        """Files as at an edition: the newest description, unless withdrawn since and by then."""
        newest = Window.partitionBy("file_ref").orderBy(F.desc("edition_no"))
        d = self.read("releases").filter(F.col("edition_no") <= no).withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n").alias("d")
        w = self.read("withdrawals").filter(F.col("edition_no") <= no).alias("w")
        return d.join(w, (F.col("d.file_ref") == F.col("w.file_ref")) & (F.col("w.edition_no") >= F.col("d.edition_no")), "left_anti")

    def dangling(self) -> DataFrame:
        """Index rows whose state is not in the store: none, if the store is whole."""
        return self.read("index").join(self.read("states").select("key", "state_no"), ["key", "state_no"], "left_anti")

    def follow(self, folder: str, schema: str, checkpoint: str, files: DataFrame | None = None):
        """Editions as a stream of files: each micro-batch is appended.  A batch that is run again
        after a failure writes nothing new, so every edition is taken in once."""

        def take(batch: DataFrame, _: int) -> None:
            self.append(batch.persist(), files)
            batch.unpersist()

        return self.spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window; windows close when the watermark has passed them."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
