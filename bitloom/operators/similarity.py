"""How much a revision changed a text."""

from __future__ import annotations

import difflib
import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Up to this many characters the edit distance is exact; above, line and character ratios are blended.
EXACT_CHARS = 4000
LINE_WEIGHT, CHAR_WEIGHT = 0.6, 0.4


def longest(left: Column, right: Column) -> Column:
    return F.greatest(F.length(left), F.length(right), F.lit(1))


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance in code points; equal texts aren't compared."""
    return F.when(left == right, 0).otherwise(F.levenshtein(left, right))


def _blend(left: str, right: str) -> float:
    def ratio(a, b) -> float:
        return difflib.SequenceMatcher(None, a, b).ratio()

    same = ratio(left.splitlines(), right.splitlines()) * LINE_WEIGHT + ratio(left, right) * CHAR_WEIGHT
    return round((1.0 - same) * 100, 2)


@F.pandas_udf(DoubleType())
def _long_rate(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([_blend(a, b) for a, b in zip(left, right)], dtype=float)


@F.pandas_udf(DoubleType())
def _percent(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Rounded as binary doubles are, half to even; the built-in round goes by decimal digits."""
    for part, whole in pairs:
        yield pd.Series([round(a / b * 100, 2) for a, b in zip(part, whole)], dtype=float)


def diff_rates(pairs: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """(keep, distance, max_len, diff_rate); distance is null for long texts.

    Short texts are compared in the JVM; only long ones go to Python, after they were spread over the cluster, as
    their cost can be quadratic.
    """
    c = F.col
    texts = pairs.select(
        *keep, F.coalesce(c(left), F.lit("")).alias("_l"), F.coalesce(c(right), F.lit("")).alias("_r")
    ).withColumn("max_len", longest(c("_l"), c("_r")))
    short = texts.where(c("max_len") <= EXACT_CHARS).select(
        *keep, edit_distance(c("_l"), c("_r")).alias("distance"), "max_len"
    ).withColumn("diff_rate", _percent("distance", "max_len"))
    long = texts.where(c("max_len") > EXACT_CHARS).repartition(*keep).select(
        *keep, F.lit(None).cast("int").alias("distance"), "max_len", _long_rate("_l", "_r").alias("diff_rate")
    )
    return short.unionByName(long)


def quality_gate(rates: DataFrame, threshold: float = 10.0) -> DataFrame:
    """The rates with ``verdict``: PASS up to the threshold, WARNING above."""
    return rates.withColumn("verdict", F.when(F.col("diff_rate") <= threshold, "PASS").otherwise("WARNING"))


def html_diff(left: Column, right: Column, left_name: str = "before", right_name: str = "after") -> Column:
    """A side-by-side page of two texts, with three lines of context, wrapped at 100."""
    def page(a: str, b: str) -> str:
        return difflib.HtmlDiff(wrapcolumn=100).make_file(
            a.splitlines(keepends=True), b.splitlines(keepends=True), fromdesc=html.escape(left_name),
            todesc=html.escape(right_name), context=True, numlines=3,
        )

    @F.pandas_udf(StringType())
    def pages(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([page(x or "", y or "") for x, y in zip(a, b)])

    return pages(left, right)
