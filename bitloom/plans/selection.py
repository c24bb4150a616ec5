"""Which glossary a document is translated with: one that is named, that of its domain, or the default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import glossary
from bitloom.runtime import join_nulls_equal

DEFAULT, AUTO = "default", "auto"


@dataclass(frozen=True)
class Selection:
    path: str
    domain: str
    score: int = 0
    matches: tuple[str, ...] = ()


def select_path(
    spark: SparkSession, paths: dict[str, str], explicit: str | None = None, domain: str | None = None, text: str | None = None
) -> Selection:
    """The terminology of one run: an explicit path before a domain, ``auto`` by the text's score, else the default.

    ``paths`` has a path for each domain, with that of ``default``; a domain without a path, and ``auto`` without a text, take the default.
    """
    if explicit:
        return Selection(explicit, "custom")
    score, matches = 0, ()
    if domain == AUTO:
        found = glossary.domains(spark.createDataFrame([(0, text or "")], "doc_id int, text string")).first()
        domain, score, matches = found.domain, found.score, tuple(m for m in found.matches.split(",") if m)
    chosen = domain if domain in paths else DEFAULT
    if chosen not in paths:
        raise ValueError("there is no default terminology")
    return Selection(paths[chosen], chosen, score, matches)


def select_for_documents(documents: DataFrame, summaries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, selected_domain, term_count): the domain of each document's text if it has terms, else the default.

    ``summaries``: (domain, term_count), a row for each domain; null is the default. Domains are few by nature and joined as Spark sees fit.
    """
    scored = glossary.domains(documents, key, text).select(key, "score", "domain")
    known = summaries.where(F.col("term_count") > 0).select("domain", F.col("term_count").alias("own_terms"))
    default = summaries.where(F.col("domain").isNull()).select(F.lit(DEFAULT).alias("domain"), "term_count")
    own = scored.join(known, "domain", "left").withColumn("selected_domain", F.when(F.col("own_terms").isNotNull(), F.col("domain")).otherwise(DEFAULT))
    whole = join_nulls_equal(own, default.withColumnRenamed("domain", "selected_domain"), ["selected_domain"], "left")
    return whole.select(key, "score", "selected_domain", F.coalesce("own_terms", "term_count", F.lit(0)).cast("long").alias("term_count"))
