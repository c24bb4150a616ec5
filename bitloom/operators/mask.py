"""Protecting regions of a text behind tokens, and putting them back.

A protected text is a struct of the masked text and its regions in order of protection, so that a
document and its regions travel in one row and no shuffle is needed to restore it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of regions in the order of protection, with their patterns.
TAGS = "br|hr|img|span|div|kbd|sup|sub"
PASSES = (
    ("CODE_BLOCK", r"(?s)```.*?```"),
    ("INLINE", r"`[^`]+`"),
    ("MATH_BLOCK", r"(?s)\$\$.*?\$\$"),
    ("MATH_BLOCK", r"(?U)\$[^\s\x1c-\x1f$][^$]*[^\s\x1c-\x1f$]\$"),
    ("HTML", rf"(?iU)<(?:{TAGS})(?:[\s\x1c-\x1f]+[^<>]*?)?[\s\x1c-\x1f]*/>"),
    ("HTML", rf"(?isU)<(?<tag>{TAGS})(?:[\s\x1c-\x1f]+[^<>]*?)?>.*?</\k<tag>>"),
)
_ENTRY = "array<struct<ord:int,token:string,original:string>>"


def _one_pass(state: Column, kind: str, pattern: str) -> Column:
    """Replace every match by a token; numbers run on over all passes."""
    text, entries = state["masked"], state["regions"]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    n = F.size(entries)

    added = F.transform(found, lambda m, i: F.struct(
        (n + i).cast("int").alias("ord"),
        F.concat(F.lit("{{PH_" + kind + "_"), (n + i).cast("string"), F.lit("}}")).alias("token"), m.alias("original"),
    ))
    masked = F.array_join(
        F.zip_with(between, added, lambda part, e: F.concat(part, F.coalesce(e["token"], F.lit("")))), ""
    )
    return F.when(F.size(found) > 0, F.struct(
        masked.alias("masked"), F.concat(entries, added.cast(_ENTRY)).alias("regions")
    )).otherwise(state)


def protect(text: Column) -> Column:
    """struct<masked: string, regions: array<struct<ord, token, original>>>; null for null.

    Each pass is one step of a fold over the kinds, so its input is computed once.
    """
    start = F.struct(text.alias("masked"), F.array().cast(_ENTRY).alias("regions"))

    def fold(state: Column, number: Column) -> Column:
        out = state
        for k, (kind, pattern) in enumerate(PASSES):
            out = F.when(number == k, _one_pass(state, kind, pattern)).otherwise(out)
        return out

    return F.when(text.isNull(), F.lit(None)).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.lit(len(PASSES) - 1)), start, fold)
    )


def restore(text: Column, regions: Column, order: str = "creation") -> Column:
    """Put the regions back, token by token.

    In the order of creation, a token inside another region's original stays as it is, as the
    original comes in after the token was looked for; ``order="reverse"`` restores those too.
    """
    if order not in ("creation", "reverse"):
        raise ValueError("order is creation or reverse")
    entries = regions if order == "creation" else F.reverse(regions)
    return F.aggregate(entries, text, lambda t, e: F.replace(t, e["token"], e["original"]))


def mapping_json(regions: Column) -> Column:
    """The regions as a JSON object from token to original, in order."""
    def quoted(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r'(?s)\A\{"k":(.*)\}\z', 1)

    pairs = F.transform(regions, lambda e: F.concat(quoted(e["token"]), F.lit(": "), quoted(e["original"])))
    return F.concat(F.lit("{"), F.concat_ws(", ", pairs), F.lit("}"))
