"""The bilingual export as one lazy plan: segments, pairs, ids, changes, flags, and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import align, delta, qa
from bitloom.operators.segment import segments
from bitloom.runtime import checkpoint


@dataclass
class Export:
    pairs: DataFrame  # all pairs with unit_id and change_type
    selected: DataFrame  # those that are exported
    removed: DataFrame
    flags: DataFrame
    summary: DataFrame  # one row for each document


def export(
    source: DataFrame, target: DataFrame, baseline: DataFrame | None = None, glossary: DataFrame | None = None,
    only_changed: bool = False, threshold: str = "none", key: str = "doc_id", text: str = "text",
) -> Export:
    """From two tables of documents (key, text) to everything that an export writes.

    The summary has for each document its figures, its worst severity, and the exit code of the gate: 2 from ``threshold`` on, else 0.
    ``changed_pairs`` counts all pairs, ``pairs`` those that are exported.

    Pairs are read by every output, so they are written once to the shared folder.
    """
    s, t = segments(source, key, text), segments(target, key, text)
    pairs = align.with_unit_ids(align.align(s, t, key), key)
    old = baseline if baseline is not None else pairs.sparkSession.createDataFrame(
        [], f"{key} {dict(pairs.dtypes)[key]}, unit_id string, src string, tgt string"
    )
    pairs = checkpoint(delta.classify(pairs, old, key))
    gone = delta.removed(pairs, old, key)
    chosen = delta.select_records(pairs, only_changed, baseline is not None)
    keep = [key, "seg_no", "unit_id", "src", "tgt"]
    flags = qa.pair_flags(chosen, keep)
    if glossary is not None:
        flags = flags.unionByName(qa.term_flags(chosen, glossary, keep))
    counted = pairs.groupBy(key).agg(
        F.count_if(F.col("src") != "").alias("source_segments"), F.count_if(F.col("tgt") != "").alias("target_segments"),
        F.count_if(F.col("change_type") != "unchanged").alias("changed_pairs"), F.count(F.lit(1)).alias("stable_ids"),
    )
    parts = [
        chosen.groupBy(key).agg(F.count(F.lit(1)).alias("pairs")), gone.groupBy(key).agg(F.count(F.lit(1)).alias("removed_pairs")),
        flags.groupBy(key).agg(F.count(F.lit(1)).alias("qa_flags"), F.max(qa.rank()).alias("_rank")),
    ]
    for p in parts:
        counted = counted.join(p, key, "full_outer")
    summary = counted.na.fill(0).withColumns({
        "incremental": F.lit(only_changed and baseline is not None), "glossary_terms": F.lit(glossary.count() if glossary is not None else 0).cast("long"),
        "max_severity": qa.severity(F.col("_rank")), "fail_on_severity": F.lit(threshold), "exit_code": F.when(qa.fails(F.col("_rank"), threshold), 2).otherwise(0),
    }).drop("_rank")
    return Export(pairs, chosen, gone, flags, summary)
