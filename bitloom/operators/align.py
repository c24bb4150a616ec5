"""Pairing source and target segments by position, and stable ids for the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(source: DataFrame, target: DataFrame, key: str = "doc_id", index: str = "seg_no", text: str = "seg") -> DataFrame:
    """(key, index, src, tgt): the i-th segment of either side; a missing one is empty, two empty ones are no pair."""
    s = source.select(key, index, F.col(text).alias("src"))
    t = target.select(key, index, F.col(text).alias("tgt"))
    return s.join(t, [key, index], "full_outer").na.fill("", ["src", "tgt"]).where(
        (F.col("src") != "") | (F.col("tgt") != "")
    )


def count_mismatches(source: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source_segments, target_segments) of the documents whose sides differ in number."""
    s = source.groupBy(key).agg(F.count(F.lit(1)).alias("source_segments"))
    t = target.groupBy(key).agg(F.count(F.lit(1)).alias("target_segments"))
    return s.join(t, key, "full_outer").na.fill(0).where(F.col("source_segments") != F.col("target_segments"))


def with_unit_ids(pairs: DataFrame, key: str = "doc_id", index: str = "seg_no") -> DataFrame:
    """The pairs with ``unit_id``: seg- and 12 hex digits of the source's SHA-1; the n-th repeat in a document gets -n.

    A pair without source is identified by its position among the pairs of the document.
    """
    c = F.col
    in_order = Window.partitionBy(key).orderBy(index)
    base = F.when(c("src") != "", c("src")).otherwise(
        F.concat(F.lit("_empty_source_"), F.row_number().over(in_order).cast("string"))
    )
    digest = pairs.withColumn("_base", F.substring(F.sha1(base.cast("binary")), 1, 12))
    n = F.row_number().over(Window.partitionBy(key, "_base").orderBy(index))
    return digest.withColumn("unit_id", F.concat(
        F.lit("seg-"), c("_base"), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")
    )).drop("_base")
