"""Readers of documents, baselines, terminologies, glossaries and settings."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.text import newlines, strip, strip_bom


def read_documents(spark: SparkSession, path: str, keep_bom: bool = False) -> DataFrame:
    """(path, text): one row for each file, with LF line ends; a byte order mark goes unless it is kept."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), newlines(F.col("value")).alias("text"))
    return raw if keep_bom else raw.withColumn("text", strip_bom(F.col("text")))


def lines(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return documents.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_pos", "line")).select(
        key, (F.col("_pos") + 1).alias("line_no"), "line"
    )


@dataclass(frozen=True)
class Languages:
    source: str = "en-US"
    target: str = "zh-CN"


def read_languages(spark: SparkSession, path: str) -> Languages:
    """The two languages of a settings file; the defaults for a missing file or blank values."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except Exception as e:  # noqa: BLE001 - Spark has no class of its own for a missing path
        if "PATH_NOT_FOUND" in str(e):
            return Languages()
        raise
    found = json.loads(row.value.lstrip("\ufeff")) if row else {}
    return Languages(
        (found.get("source_language") or Languages.source).strip(), (found.get("target_language") or Languages.target).strip()
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, src, tgt) of an earlier segment map: the last row of each id, without blank ids.

    The language columns are found by prefix; of several the last in the header counts. A missing file, or one
    without such columns, is an empty baseline. The file is a table of one document, in row order.
    """
    empty = spark.createDataFrame([], "unit_id string, src string, tgt string")
    try:
        raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    names = {c.lstrip("\ufeff"): c for c in raw.columns}
    source = [c for c in names if c.startswith("source_")][-1:]
    target = [c for c in names if c.startswith("target_")][-1:]
    if not source or not target or "stable_id" not in names:
        return empty
    rows = raw.select(
        strip(F.coalesce(F.col(f"`{names['stable_id']}`"), F.lit(""))).alias("unit_id"),
        F.coalesce(F.col(f"`{names[source[0]]}`"), F.lit("")).alias("src"),
        F.coalesce(F.col(f"`{names[target[0]]}`"), F.lit("")).alias("tgt"),
        # a file in one piece (multiLine), so rows count up within it; of several files the last by name counts
        F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("_row"),
    ).where(F.col("unit_id") != "")
    return rows.groupBy("unit_id").agg(F.max_by(F.struct("src", "tgt"), "_row").alias("v")).select("unit_id", "v.src", "v.tgt")


_TERMS = "array<struct<source:string,target:string,note:string>>"


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source, target, note) of terminology files: the entries of ``terms`` in order."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(strip_bom(F.col("value")), f"terms {_TERMS}").alias("j"))
    return raw.select(F.posexplode("j.terms").alias("ord", "t")).select("ord", "t.source", "t.target", "t.note")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, translation) of a glossary file: its ``map``, else its ``terms``, of which the last of a term counts.

    Blank entries are left out; a missing or unreadable file is an empty glossary.
    """
    empty = spark.createDataFrame([], "term string, translation string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    parsed = raw.select(F.from_json(strip_bom(F.col("value")), f"map map<string,string>, terms {_TERMS}").alias("j"))
    direct = parsed.select(F.posexplode("j.map").alias("ord", "term", "translation"))
    listed = parsed.where(F.col("j.map").isNull()).select(F.posexplode("j.terms").alias("ord", "t")).select(
        "ord", F.col("t.source").alias("term"), F.col("t.target").alias("translation")
    )
    rows = direct.unionByName(listed).select(
        "ord", strip(F.coalesce("term", F.lit(""))).alias("term"), strip(F.coalesce("translation", F.lit(""))).alias("translation")
    ).where((F.col("term") != "") & (F.col("translation") != ""))
    return rows.groupBy("term").agg(F.max_by("translation", "ord").alias("translation"))
