"""Problem 6: records that differ only in formatting.

Byte-identical raw rows are collapsed first with their counts; only the distinct
survivors are canonicalised; those are grouped again on their full canonical text,
and the counts are summed. No hash stands in for a text in a grouping.

Defined results: null equals null and nothing else; an empty text equals every text
made only of white space and punctuation; a column of the input that shares a name
with an internal one is ignored, since only the named columns are read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.runtime import checkpoint, hot_keys, salted_join

#: White space (also no-break and ideographic), punctuation as Unicode has it, and all ASCII signs, which includes ``$ + < = > ^ ` | ~``:
#: records are found that differ in those alone (measured on the given tables). Symbols beyond ASCII, such as the euro sign, count as text.
IGNORED = r"[\p{IsWhite_Space}\p{IsPunctuation}\p{Punct}]+"


def canonical(text: Column) -> Column:
    """Lower case without white space and punctuation; accents and all other characters stay."""
    return F.regexp_replace(F.lower(text), IGNORED, "")


def _part(*cols: Column) -> Column:
    """One string that tells null from empty in each column."""
    return F.concat_ws("\x02", *[F.coalesce(F.concat(F.lit("="), c), F.lit("0")) for c in cols])


def collapse_raw(rows: DataFrame, id_col: str, raw: list[str]) -> DataFrame:
    """Distinct raw rows with ``n`` copies and the smallest id, pre-aggregated before the shuffle."""
    return rows.groupBy(*raw).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("low_id"))


def group_canonical(survivors: DataFrame, keys: list[Column]) -> tuple[DataFrame, list[str]]:
    """The survivors with their canonical key columns."""
    names = [f"_k{i}" for i in range(len(keys))]
    return survivors.select("*", *[k.alias(n) for k, n in zip(keys, names)]), names


def collapse(rows: DataFrame, id_col: str, raw: list[str], keys: list[Column]) -> DataFrame:
    """One row per record: ``first_id`` (smallest id), ``copies`` (rows of the input) and ``forms`` (distinct raw rows)."""
    keyed, names = group_canonical(collapse_raw(rows.select(id_col, *raw), id_col, raw), keys)
    return keyed.groupBy(*names).agg(
        F.min("low_id").alias("first_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("forms")
    ).drop(*names)


def members(rows: DataFrame, id_col: str, raw: list[str], keys: list[Column]) -> DataFrame:
    """(first_id, copy_id) for every row but the first of each record.

    The mapping from raw row to record has one row per distinct raw row. It is joined back
    to the rows with hot raw rows spread over several tasks, so a raw row that makes up a
    third of the table doesn't end in one task.
    """
    rows = rows.select(F.col(id_col), *raw)
    keyed, names = group_canonical(collapse_raw(rows, id_col, raw), keys)
    survivors = checkpoint(keyed)  # read for the records and joined with them
    total = rows.count()
    records = survivors.groupBy(*names).agg(
        F.min("low_id").alias("first_id"), F.sum("n").alias("_copies"), F.count(F.lit(1)).alias("_forms")
    ).where(F.col("_copies") > 1)
    # a record may have very many forms
    varied = hot_keys(records, names, "_forms", total)
    forms = salted_join(survivors, records.drop("_copies", "_forms"), names, "low_id", varied).select(*raw, "first_id")
    hot = hot_keys(survivors, raw, "n", total)
    joined = salted_join(rows, forms, raw, id_col, hot)
    return joined.where(F.col(id_col) != F.col("first_id")).select("first_id", F.col(id_col).alias("copy_id"))


TERM_RAW = ["source_lang", "source", "target_lang", "target"]
GLOSSARY_RAW = ["direction", "term", "translation"]


def terminology_keys() -> list[Column]:
    """The two sides with their languages, in either order."""
    a = _part(canonical(F.col("source_lang")), canonical(F.col("source")))
    b = _part(canonical(F.col("target_lang")), canonical(F.col("target")))
    return [F.least(a, b), F.greatest(a, b)]


def glossary_keys() -> list[Column]:
    """The term by its letters; direction and translation as they are."""
    return [_part(F.col("direction")), _part(canonical(F.col("term"))), _part(F.col("translation"))]


def found(terminology: DataFrame, glossary: DataFrame) -> DataFrame:
    t = members(terminology, "term_id", TERM_RAW, terminology_keys()).withColumn("table_name", F.lit("terminology"))
    g = members(glossary, "entry_id", GLOSSARY_RAW, glossary_keys()).withColumn("table_name", F.lit("glossary"))
    return t.unionByName(g).select("table_name", "first_id", "copy_id")


def records(terminology: DataFrame, glossary: DataFrame) -> DataFrame:
    t = collapse(terminology, "term_id", TERM_RAW, terminology_keys()).withColumn("table_name", F.lit("terminology"))
    g = collapse(glossary, "entry_id", GLOSSARY_RAW, glossary_keys()).withColumn("table_name", F.lit("glossary"))
    return t.unionByName(g).select("table_name", "first_id", "copies", "forms")
