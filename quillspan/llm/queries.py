"""The queries of the text problems over the register's tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.abuse import score_documents, source_rates
from quillspan.llm.canonical_map import map_to_list
from quillspan.llm.leakage import find_leaks
from quillspan.llm.lookalike import look_alikes, pairs_alike
from quillspan.llm.name_variants import link_names, pairs_of
from quillspan.llm.packing import fill_containers
from quillspan.session import cut


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _typed_names(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        _table(spark, folder, t).select(F.lit(t).alias("source_table"), F.col(k).cast("long").alias("row_id"), F.col(c).alias("value"))
        for t, k, c in (("state_datasets", "dataset_row_id", "dataset_name"), ("release_groups", "group_id", "dataset"))
    ]
    return parts[0].unionByName(parts[1])


def p4_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of both tables with its entry and how it was matched."""
    return map_to_list(_typed_names(spark, folder), "value", _table(spark, folder, "dataset_list"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    mapped = p4_mapped(spark, folder).filter(~F.col("match_kind").isin("blank", "exact"))
    return mapped.select("source_table", "row_id", F.col("entry_id").alias("dataset_id"))


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values for which the list has no entry, with the rows that hold them."""
    return p4_mapped(spark, folder).filter("match_kind = 'none'").groupBy("value").agg(F.count(F.lit(1)).alias("rows"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_alike(_table(spark, folder, "earlier_texts"), "text_id", "text", ["text_field"])


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text: the digests of its one form and of its own letters."""
    return look_alikes(_table(spark, folder, "earlier_texts"), "text_id", "text", ["text_field"])


def p7_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per name with the body or person it stands for."""
    return link_names(_table(spark, folder, "party_names"), "name_id", "party_name")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_of(cut(p7_entities(spark, folder)), "name_id", "entity")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return fill_containers(_table(spark, folder, "documents"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with the share of the item that is held and what was re-parameterised."""
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p10_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score."""
    return score_documents(_table(spark, folder, "documents").select("doc_id", "source", "text")).drop("text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scored(spark, folder).filter("abusive").select("doc_id")


def p10_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return source_rates(p10_scored(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p4_found, p4_mapped, p4_unmatched, p5_found, p5_classes, p7_found, p7_entities, p8_containers, p9_found, p9_leaks, p10_found, p10_scored, p10_source_rates)
}
