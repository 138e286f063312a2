"""Writers: idempotent tables, shards, CSV, Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.session import work_path

#: The file that marks a folder as an output of this package, so it may be written over.
MARKER = "_QUILLSPAN"
#: Entries in the register's feed and in a page's feed: the features' own lengths.
NEWEST, PAGE_NEWEST = 24, 50


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def prepare_output(spark: SparkSession, path: str) -> None:
    """Empty an output folder; refuse one that is not empty and was not written by this package."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        if names and MARKER not in names:
            raise ValueError(f"{path} is not an output of this package; it is left as it is")
        fs.delete(p, True)
    fs.mkdirs(p)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(p, MARKER)).close()


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write a Parquet table unless it already holds the same rows; True if it was written."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p):
        old = spark.read.parquet(path)
        if sorted(old.dtypes) == sorted(df.dtypes):
            # one pass over both: row counts that cancel out mean the same bag of rows
            tag = df.select(*old.columns).withColumn("__d", F.lit(1)).unionByName(old.withColumn("__d", F.lit(-1)))
            if tag.groupBy(F.sha2(F.to_json(F.struct(*sorted(old.columns))), 256)).agg(F.sum("__d").alias("d")).filter("d <> 0").isEmpty():
                return False
    new = work_path(spark, "table")
    df.write.parquet(new)  # written beside, so a failure leaves the old table
    fs.delete(p, True)
    fs.mkdirs(p.getParent())
    source = spark._jvm.org.apache.hadoop.fs.Path(new)
    if not fs.rename(source, p):
        spark.read.parquet(new).write.parquet(path)
    return True


def write_index(postings: DataFrame, path: str) -> None:
    """The search index, one folder per first character: ``word, encoded, documents`` and ``shard``."""
    postings.withColumn("shard", F.substring("word", 1, 1)).repartition("shard").sortWithinPartitions("shard", "word").write.mode("overwrite").partitionBy("shard").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with list cells joined by '; '."""
    cells = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").csv(path, header=True)


def xml_text(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def feed_entries(changes: DataFrame, site: str, page: str | None = None) -> DataFrame:
    """Atom entries of ``changes`` (``edition_no, reference, kind, title``), the newest ones: of the
    whole register, or of each value of ``page``.  Columns: ``page?, rank, entry``."""
    order = [F.desc("edition_no"), "reference", "kind"]
    if page:
        ranked = changes.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(*order))).filter(F.col("rank") <= PAGE_NEWEST)
    else:
        top = changes.orderBy(*order).limit(NEWEST)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most NEWEST rows
    month = F.concat(F.lpad(F.floor(F.col("edition_no") / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("edition_no") % 12 + 1).cast("string"), 2, "0"))
    entry = F.concat(
        F.lit("<entry><id>tag:"), xml_text(F.lit(site)), F.lit(","), month, F.lit(":"), xml_text(F.col("reference")), F.lit("/"), xml_text(F.col("kind")), F.lit("</id><title>"), xml_text(F.col("title")),
        F.lit("</title><updated>"), month, F.lit("-01T00:00:00Z</updated><link href=\"https://"), xml_text(F.lit(site)), F.lit("/agreements/"), F.lower(xml_text(F.col("reference"))), F.lit("/\"/></entry>"),
    )
    return ranked.select(*([page] if page else []), "rank", entry.alias("entry"))


def feed_documents(entries: DataFrame, title: str, page: str | None = None) -> DataFrame:
    """One Atom document per page (or one): entries are bounded by the feed's length."""
    listed = entries.groupBy(*([page] if page else [])).agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("e"))
    return listed.select(*([page] if page else []), F.concat(F.lit("<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>"), xml_text(F.lit(title)), F.lit("</title>"), F.array_join("e.entry", ""), F.lit("</feed>")).alias("document"))
