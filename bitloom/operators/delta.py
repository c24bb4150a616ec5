"""Comparing the pairs of a document with those of an earlier version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import canonical


def classify(pairs: DataFrame, baseline: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pairs with ``change_type``: new, updated or unchanged against ``baseline`` (key, unit_id, src, tgt)."""
    old = baseline.select(key, "unit_id", F.col("src").alias("_src"), F.col("tgt").alias("_tgt"), F.lit(True).alias("_old"))
    same = (canonical(F.col("src")) == canonical(F.coalesce("_src", F.lit("")))) & (
        canonical(F.col("tgt")) == canonical(F.coalesce("_tgt", F.lit("")))
    )
    return pairs.join(old, [key, "unit_id"], "left").withColumn(
        "change_type", F.when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("updated")
    ).drop("_src", "_tgt", "_old")


def removed(pairs: DataFrame, baseline: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of the baseline that have no pair now, with ``change_type`` removed."""
    return baseline.join(pairs.select(key, "unit_id"), [key, "unit_id"], "left_anti").select(
        key, "unit_id", "src", "tgt"
    ).withColumn("change_type", F.lit("removed"))


def select_records(pairs: DataFrame, only_changed: bool, has_baseline: bool) -> DataFrame:
    """All pairs, or those that aren't unchanged where there is a baseline to compare with."""
    return pairs.where(F.col("change_type") != "unchanged") if only_changed and has_baseline else pairs


def last_per_id(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows with one id the last in order, with all columns; pre-aggregated before the shuffle."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(
        *key, *[F.col(f"_v.{c}").alias(c) for c in columns]
    )
