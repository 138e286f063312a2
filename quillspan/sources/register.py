"""The register tables, and what every reader of them needs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, strip

#: The columns of a full copy that state what a version says.
STATE_COLUMNS = (
    "title", "organisation", "organisation_type", "controllers", "controller_basis", "start_date", "end_date",
    "sublicensing", "commercial", "objective", "activities", "expected_output", "expected_benefits", "yielded_benefits",
)

#: Editions are months, so their number is bounded by the age of the register.
MOST_EDITIONS = 5_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``; a file or a folder of files."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def reference_key(c: Column) -> Column:
    """References are the same whatever their letter case and outer white space."""
    return F.upper(strip(c))


def base_of(key: Column) -> Column:
    """The base reference: the key without its ``-V<version>``."""
    return F.regexp_replace(key, r"(?i)-v[0-9]+(?:\.[0-9]+)?$", "")


def version_of(key: Column) -> Column:
    """The version of a key as text, ``''`` if it has none."""
    return F.regexp_extract(key, r"(?i)-v([0-9]+(?:\.[0-9]+)?)$", 1)


def version_key(version: Column) -> Column:
    """Versions in order: an array of numbers, compared element by element, shorter first."""
    return F.when(version == "", F.array(F.lit(0))).otherwise(F.transform(F.split(version, r"\."), lambda p: p.cast("int")))


def blank_for_null(df: DataFrame, c: str) -> Column:
    """Null counts as blank: an empty text, or an empty array; in an array of texts, '' again."""
    kind = dict(df.dtypes)[c]
    if kind.startswith("array"):
        return F.coalesce(F.transform(F.col(c), lambda x: F.coalesce(x, F.lit(""))), F.array().cast(kind)) if kind == "array<string>" else F.coalesce(F.col(c), F.array().cast(kind))
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def editions_of(df: DataFrame) -> list[tuple[int, str]]:
    """(number, label) of the editions in ``df``, oldest first.  Months only, hence bounded."""
    rows = (
        df.select(edition_no(F.col("edition")).alias("no"), strip(F.col("edition")).alias("edition"))
        .filter("no is not null")
        .groupBy("no")
        .agg(F.min("edition").alias("edition"))
        .limit(MOST_EDITIONS + 1)
        .collect()
    )
    if len(rows) > MOST_EDITIONS:
        raise ValueError(f"more than {MOST_EDITIONS} editions")
    return sorted((r.no, r.edition) for r in rows)


def newest_edition(df: DataFrame) -> tuple[int, list[str]]:
    """(number, labels as written) of the newest edition in ``df``: a filter by these labels, unlike
    one by the number they are read as, reaches the scan.  Of an empty table (-1, [])."""
    no = edition_no(F.col("edition"))
    row = df.select("edition", no.alias("no")).filter("no is not null").groupBy("no").agg(F.collect_set("edition").alias("labels")).orderBy(F.desc("no")).limit(1).collect()
    return (row[0].no, row[0].labels) if row else (-1, [])
