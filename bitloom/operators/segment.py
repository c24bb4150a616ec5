"""Segments of Markdown documents: headings, list items, table rows, fenced blocks and paragraphs.

Everything happens inside the row with array expressions, in time in proportion to the text: fences are
numbered by repeating each number over the lines up to the next, segments are slices between their starts.
Nothing shuffles. Each step is a projection of its own, so that no array is computed once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import (
    is_blank, is_fence, is_heading, is_ordered_item, is_table_row, is_unordered_item, newlines, normalize_segment, strip,
)


def _line(x: Column) -> Column:
    kind = (
        F.when(is_fence(x), "fence").when(is_blank(x), "blank").when(is_heading(x), "heading")
        .when(is_unordered_item(x) | is_ordered_item(x), "list").when(is_table_row(x), "table").otherwise("paragraph")
    )
    return F.struct(x.alias("line"), kind.alias("kind"))


def segments(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seg_no from 1, kind, seg), for each row. Null and blank texts have no segments.

    A fence that isn't closed ends with the text. Columns of the input other than the two aren't read.
    """
    c = F.col
    lines = documents.select(
        c(key).alias("_key"), F.transform(F.split(newlines(F.coalesce(c(text), F.lit(""))), "\n", -1), _line).alias("_lines")
    )
    fenced = lines.select("_key", "_lines", F.concat(
        F.array(F.lit(0)),
        F.filter(F.transform("_lines", lambda x, i: F.when(x["kind"] == "fence", i + 1)), lambda i: i.isNotNull()),
        F.array(F.size("_lines") + 1),
    ).alias("_at"))
    # of each line the number of fences up to it; the first entry belongs to no line
    numbered = fenced.select("_key", "_lines", F.flatten(F.transform(
        F.slice("_at", F.lit(1), F.size("_at") - 1),
        lambda a, k: F.array_repeat(k, F.element_at(c("_at"), k + 2) - a),
    )).alias("_fences"))
    typed = numbered.select("_key", F.zip_with(
        "_lines", F.slice("_fences", F.lit(2), F.size("_lines")),
        lambda x, n: F.struct(
            x["line"].alias("line"),
            F.when((x["kind"] == "fence") | (n % 2 == 1), "code").otherwise(x["kind"]).alias("kind"),
            ((x["kind"] == "fence") & (n % 2 == 1)).alias("opening"),
        ),
    ).alias("_lines"))
    started = typed.select("_key", "_lines", F.concat(F.filter(F.transform("_lines", lambda x, i: F.when(
        F.when(x["kind"] == "code", x["opening"])
        .when(x["kind"] == "paragraph", (i == 0) | (F.get(c("_lines"), i - 1)["kind"] != "paragraph"))
        .otherwise(x["kind"] != "blank"),
        i + 1,
    )), lambda i: i.isNotNull()), F.array(F.size("_lines") + 1)).alias("_at"))
    sliced = started.select("_key", F.transform(
        F.slice("_at", F.lit(1), F.size("_at") - 1),
        lambda a, k: F.slice(c("_lines"), a, F.element_at(c("_at"), k + 2) - a),
    ).alias("_parts"))

    def content(part: Column) -> Column:
        kind = part[0]["kind"]
        kept = F.filter(part, lambda x: x["kind"] == "paragraph")
        return F.struct(kind.alias("kind"), (
            F.when(kind == "code", strip(F.array_join(F.transform(part, lambda x: x["line"]), "\n")))
            .when(kind == "paragraph", normalize_segment(F.array_join(F.transform(kept, lambda x: strip(x["line"])), " ")))
            .otherwise(normalize_segment(part[0]["line"]))
        ).alias("seg"))

    found = sliced.select("_key", F.posexplode(F.filter(F.transform("_parts", content), lambda x: x["seg"] != "")).alias("_pos", "_s"))
    return found.select(c("_key").alias(key), (c("_pos") + 1).alias("seg_no"), c("_s.kind").alias("kind"), c("_s.seg").alias("seg"))
