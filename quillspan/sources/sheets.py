"""Sheets, rule files and checksums: how register files become tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, strip

#: Rows at the top of a sheet among which its header is looked for.
HEADER_ROWS = 10


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV: the first row names the columns; rows of nothing are dropped."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').dropna("all")


def read_sheet_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The same with fixed columns; a missing sheet is an empty one, a missing column is null."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not glob.getFileSystem(spark._jsc.hadoopConfiguration()).exists(glob):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    sheet = read_sheet(spark, path)
    return sheet.select(*[F.col(f"`{c}`") if c in sheet.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_drifting(spark: SparkSession, path: str, fields: dict[str, tuple[str, ...]], needed: str) -> DataFrame:
    """A sheet whose header moves and whose columns are named differently from file to file.

    ``fields`` gives for each field the spellings of its column; a column is a field's if its
    normalised name equals one of them, or failing that begins with one.  The header is the first
    of the top rows that has the field ``needed``.  Fields without a column are blank.
    """
    norm = lambda t: re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"')
    top = raw.limit(HEADER_ROWS).collect()  # at most HEADER_ROWS rows
    for at, header in enumerate(top):
        names = [norm(c) for c in header]
        place: dict[str, int] = {}
        for test in (lambda n, s: n == s, lambda n, s: n.startswith(s)):
            for field, spellings in fields.items():
                if field not in place:
                    hit = [i for i, n in enumerate(names) if n and i not in place.values() and any(test(n, norm(s)) for s in spellings)]
                    if hit:
                        place[field] = hit[0]
        if needed in place:
            above = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[i])) for i, c in enumerate(raw.columns)]) for row in top[: at + 1]]
            rows = raw.filter(~reduce(lambda a, b: a | b, above))
            picked = rows.select(*[F.col(raw.columns[place[f]]).alias(f) if f in place else F.lit("").alias(f) for f in fields])
            return picked.filter(~F.coalesce(strip(F.col(needed)), F.lit("")).isin(""))
    raise ValueError(f"no header with {needed} in the first {HEADER_ROWS} rows of {path}")


def references_in(c: Column) -> Column:
    """The references written in one cell, prefixed alike, in their order."""
    found = F.regexp_extract_all(F.upper(c), F.lit(r"(?:DARS-)?(NIC-[0-9]+-[A-Z0-9]{5}(?:-V[0-9]+(?:\.[0-9]+)?)?)"), F.lit(1))
    return F.transform(found, lambda x: F.concat(F.lit("DARS-"), x))


def file_edition(path: Column) -> Column:
    """The edition that a file's name tells, ``''`` if none: ``register_july2023.csv``."""
    return F.lower(F.regexp_extract(path, r"(?i)(?:^|[_\-/ ])((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[_\- ]?\d{4})[^/]*$", 1))


def alias_rules(spark: SparkSession, path: str) -> DataFrame:
    """``variant, canonical, reason`` of a JSON file of alias groups."""
    groups = spark.read.schema("aliases array<struct<canonical: string, variants: array<string>, reason: string, source: string>>, ignored array<array<string>>").json(path, multiLine=True)
    return groups.select(F.explode("aliases").alias("a")).select(F.explode("a.variants").alias("variant"), "a.canonical", "a.reason")


def succession_rules(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("successions array<struct<`from`: string, `to`: string, date: string, evidence: string>>").json(path, multiLine=True)
    return rows.select(F.explode("successions").alias("s")).select(F.col("s.from").alias("was"), F.col("s.to").alias("now"), "s.date", "s.evidence")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("agreements array<struct<reference: string, reason: string>>").json(path, multiLine=True)
    return rows.select(F.explode("agreements").alias("a")).select(F.upper(strip(F.col("a.reference"))).alias("base"), "a.reason")


def without_excluded(rows: DataFrame, base: str, excluded: DataFrame) -> DataFrame:
    return rows.join(excluded.select(F.col("base").alias("__x")), F.upper(F.col(base)) == F.col("__x"), "left_anti")


def upsert(manifest: DataFrame, entries: DataFrame, key: str = "edition") -> DataFrame:
    """The manifest with entries put in or in place of those of the same edition, oldest first;
    where the checksum is the recorded one, the recorded entry stays."""
    kept = entries.alias("n").join(manifest.alias("m"), F.col(f"n.{key}") == F.col(f"m.{key}"), "left")
    same = F.col("m.sha256").eqNullSafe(F.col("n.sha256")) & F.col(f"m.{key}").isNotNull()
    fresh = kept.select(*[F.when(same, F.col(f"m.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in entries.columns])
    return manifest.join(entries.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True).orderBy(edition_no(F.col(key)))


def verify(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``file, verdict``: ok, BAD (another checksum), new (not in the manifest), MISSING."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("now"))
    both = files.join(manifest.select(F.col("source_file").alias("file"), "sha256"), "file", "full_outer")
    verdict = F.when(F.col("sha256").isNull(), "new").when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("sha256"), "ok").otherwise("BAD")
    return both.select("file", verdict.alias("verdict"))
