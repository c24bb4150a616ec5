"""Quality flags of translation pairs, a gate on them, and Markdown syntax errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import (
    fence_count, has_token, leftover_tokens, looks_translatable, malformed_links, normalize_segment, unbalanced_backticks,
)
from bitloom.functions.text import contains_term
from bitloom.operators.glossary import term_hits

# Bounds of the length ratio, and the ranks of severities.
SHORTEST, LONGEST = 0.2, 5.0
RANK = {"none": 0, "warning": 1, "error": 2}


def _flag(cond: Column, kind: str, severity: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(cond, F.struct(
        F.lit(kind).alias("flag_type"), F.lit(severity).alias("severity"), text.alias("message")
    ))


def _normal(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "_s": normalize_segment(F.coalesce("src", F.lit(""))), "_t": normalize_segment(F.coalesce("tgt", F.lit("")))
    })


def flags_of(s: Column, t: Column) -> Column:
    """The rules that a pair breaks, as an array; the texts are in normal form. Terminology is in :func:`term_flags`."""
    both = (s != "") & (t != "")
    ratio = F.length(t) / F.length(s)
    shown = F.format_string("%.2f", ratio)
    # Kinds, severities and messages of the rules.
    rules = F.array(
        _flag((s != "") & (t == ""), "missing_target", "error", "target segment is empty"),
        _flag(both & (s == t) & looks_translatable(s), "unchanged_text", "warning", "source and target are identical"),
        _flag(has_token(t), "placeholder_leak", "error", "target still contains placeholder tokens"),
        _flag(both & (ratio < SHORTEST), "length_too_short", "warning",
              F.concat(F.lit("target/source length ratio is very small ("), shown, F.lit(")"))),
        _flag(both & (ratio > LONGEST), "length_too_long", "warning",
              F.concat(F.lit("target/source length ratio is very large ("), shown, F.lit(")"))),
        _flag(fence_count(s) % 2 != fence_count(t) % 2, "code_fence_mismatch", "warning", "source/target code fence parity differs"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def pair_flags(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, flag_type, severity, message) for each rule that a pair breaks."""
    return _normal(pairs).select(*keep, F.explode(flags_of(F.col("_s"), F.col("_t"))).alias("_f")).select(*keep, "_f.*")


def term_flags(pairs: DataFrame, glossary: DataFrame, keep: list[str], on: list[str] | None = None) -> DataFrame:
    """A flag for each glossary term in a source whose translation the target lacks; fenced sources aren't looked at."""
    normal = _normal(pairs).where((F.col("_s") != "") & (F.col("_t") != "") & ~F.startswith("_s", F.lit("```")))
    low = normal.withColumn("_tlow", F.lower("_t"))
    hits = term_hits(low, glossary, "_s", on or []).where(~contains_term(F.col("_t"), F.col("translation"), F.col("_tlow")))
    return hits.select(
        *keep, F.lit("term_inconsistency").alias("flag_type"), F.lit("warning").alias("severity"),
        F.concat(F.lit("expected terminology '"), "term", F.lit("' -> '"), "translation", F.lit("'")).alias("message"),
    )


def rank() -> Column:
    """The rank of a flag's severity."""
    return F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)


def severity(worst: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in RANK]), worst.cast("int") + 1)


def fails(worst: Column, threshold: str) -> Column:
    """Whether a gate at a threshold fails; ``none`` never does."""
    if threshold not in RANK:
        raise ValueError(f"threshold is one of {', '.join(RANK)}")
    return F.lit(RANK[threshold] > 0) & (worst >= RANK[threshold])


def gate(flags: DataFrame, threshold: str) -> DataFrame:
    """One row: highest severity found, and whether the gate fails at ``threshold`` (none never fails)."""
    worst = F.col("max_rank")
    return flags.agg(F.coalesce(F.max(rank()), F.lit(0)).alias("max_rank")).select(severity(worst).alias("max_severity"), fails(worst, threshold).alias("failed"))


def syntax_errors(text: Column) -> Column:
    """Messages on what is wrong with the Markdown of a text, at most four."""
    # The messages.
    tokens = leftover_tokens(text)
    return F.filter(F.array(
        F.when(fence_count(text) % 2 != 0, F.lit("Unclosed code fence detected.")),
        F.when(unbalanced_backticks(text), F.lit("Unbalanced inline backticks detected.")),
        F.when(F.size(tokens) > 0, F.concat(F.lit("Unrestored placeholders detected: "), F.array_join(tokens, ", "))),
        F.when(malformed_links(text), F.lit("Malformed Markdown links detected.")),
    ), lambda x: x.isNotNull())
