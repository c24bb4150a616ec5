"""Sections of a document, and packing them into chunks of a size.

A document stays one row until its chunks are exploded; sections and packing are array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import WS, is_blank, strip

DEFAULT_SIZE = 5000
#: Line ends as Python's str.splitlines sees them.
_LINE_ENDS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def sections(text: Column) -> Column:
    """Parts that begin at level-2 headings, trimmed, without blank ones; the untrimmed text if there is none."""
    parts = F.split(text, rf"(?dmU)^##[{WS}]+", -1)
    trimmed = F.transform(parts, lambda p: strip(p))

    def with_heading(part: Column, i: Column) -> Column:
        # one line end of any kind after the title becomes a line feed, as do those of the body
        lines = F.split(part, _LINE_ENDS, -1)
        body = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")
        return F.when(i == 0, part).otherwise(strip(F.concat(F.lit("## "), strip(lines[0]), F.lit("\n"), body)))

    found = F.transform(F.filter(
        F.transform(trimmed, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"] != ""
    ), lambda x: with_heading(x["p"], x["i"]))
    return F.when((F.size(parts) <= 1) | (F.size(found) == 0), F.array(text)).otherwise(found)


def pack(parts: Column, size: int) -> Column:
    """Chunks of at most ``size`` characters where sections and paragraphs allow it, joined by blank lines.

    A section over the size is taken paragraph by paragraph, its first never into a chunk that is open before it; a
    paragraph over the size is cut into slices of the size. What follows goes on with the open chunk.
    """
    if size < 1:
        raise ValueError("size is at least 1")
    item = "array<struct<x:string,f:boolean>>"

    def items(section: Column) -> Column:
        paragraphs = F.filter(F.split(section, "\n\n", -1), lambda p: ~is_blank(p))
        return F.when(
            F.length(section) > size, F.transform(paragraphs, lambda p, i: F.struct(p.alias("x"), (i == 0).alias("f")))
        ).otherwise(F.array(F.struct(section.alias("x"), F.lit(False).alias("f"))))

    # an open chunk is kept as the array of its parts; a section over the size closes it even if it has no paragraph
    def slices(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")),
            lambda k: F.substring(x, k * size + 1, F.lit(size)),
        )

    def close(state: Column) -> Column:
        return F.when(F.size(state["cur"]) > 0, F.concat(state["out"], F.array(F.array_join(state["cur"], "\n\n")))).otherwise(state["out"])

    def step(state: Column, it: Column) -> Column:
        x, n = it["x"], F.length(it["x"])
        full = (F.size(state["cur"]) > 0) & (it["f"] | (state["len"] + n + 2 > size))
        empty = F.array().cast("array<string>")
        return (
            F.when(n > size, F.struct(F.concat(close(state), slices(x)).alias("out"), empty.alias("cur"), F.lit(0).alias("len")))
            .when(full, F.struct(close(state).alias("out"), F.array(x).alias("cur"), n.alias("len")))
            .otherwise(F.struct(
                state["out"].alias("out"), F.concat(state["cur"], F.array(x)).alias("cur"),
                (state["len"] + n + F.when(state["len"] > 0, 2).otherwise(0)).alias("len"),
            ))
        )

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("cur"), F.lit(0).alias("len"))
    done = F.aggregate(
        F.flatten(F.transform(parts, items)).cast(item), start, step, lambda s: close(s)
    )
    return F.when(F.size(done) == 0, F.array(F.lit(""))).otherwise(done)


def chunks(documents: DataFrame, size: int = DEFAULT_SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_no from 1, name, chunk)."""
    packed = pack(sections(F.coalesce(F.col(text), F.lit(""))), size)
    return documents.select(key, F.posexplode(packed).alias("pos", "chunk")).select(
        key, (F.col("pos") + 1).alias("chunk_no"),
        F.format_string("chunk_%03d.md", F.col("pos") + 1).alias("name"), "chunk",
    )


def manifest(documents: DataFrame, size: int = DEFAULT_SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_size, chunk_count, chunks): a row for each document, without a shuffle."""
    packed = pack(sections(F.coalesce(F.col(text), F.lit(""))), size)
    return documents.select(key, packed.alias("parts")).select(
        key, F.lit(size).alias("chunk_size"), F.size("parts").alias("chunk_count"),
        F.transform("parts", lambda _, i: F.format_string("chunk_%03d.md", i + 1)).alias("chunks"),
    )
