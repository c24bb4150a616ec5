"""Problem 8: mixing sources to target shares of tokens, by balanced sampling with the cube method.

Each source gets a rate (copies per document) from its share of the total; every document of the source gets
the whole part of the rate as copies, and one more with the rest of it as inclusion probability. The
probabilities of a source move through the null space of two constraints, the number of documents and their
tokens, three documents at a time: each step decides at least one of them and changes neither total.
Flights run in groups of about GROUP documents of a source, told by the hash of seed and document, in the order of that hash,
with three open documents in memory; what a group leaves open (two documents at most) takes part in a flight of
the next level, and so on until a source is one group. The two documents that
are left per source in the end are the landing problem, solved with the token constraint dropped. So a source's
tokens miss what was wanted by no more than those of its last two documents, no group is larger for a larger source, and the
selection is the same however the table is partitioned.

The default total is the largest for which every present source reaches its share within its repeats;
the shares of absent sources are spread over the others in proportion. With a larger total, sources give
what their repeats allow, and the report shows what is missing.

Defined results: documents of a source without target, or of null source, aren't drawn; null and empty
texts have no tokens and are drawn like others; a source named twice in the targets counts with its largest
share; null or negative shares are 0, null or negative repeats 0; empty tables give an empty selection.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.runtime import checkpoint, hot_keys, salted_join, spread

#: Folder of the public vocabularies, and the one that sizes are measured with.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a group, on average; what it leaves open is two of them.
GROUP = 4096
NEAR = 1e-9


@functools.cache
def encoding(folder: str, vocabulary: str):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, vocabulary)
        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "source": b["source"],
                "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]],
            })

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id long, source string, tokens long")


def plan(sizes: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    """Per source of the targets: share, largest repeat, what there is, wanted tokens, and rate. ``sizes``: (source, documents, tokens)."""
    want = targets.where(F.col("source").isNotNull()).select("source", F.struct(
        F.greatest(F.lit(0.0), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0))).alias("share"),
        F.greatest(F.lit(0), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0))).alias("repeats"),
    ).alias("v")).groupBy("source").agg(F.max("v").alias("v")).select(
        "source", F.col("v.share").alias("target_share"), F.col("v.repeats").alias("max_repeats")
    )
    known = want.join(sizes, "source", "left").na.fill(0, ["documents", "tokens"])
    present = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    # sums and a least value over one row for each source: two numbers come back
    whole, least = known.where(present).agg(
        F.sum("target_share"), F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    ).first()
    whole = whole or 1.0
    total = (least or 0.0) * whole if total is None else total
    return known.withColumn("wanted", F.when(present, F.lit(float(total)) * F.col("target_share") / whole).otherwise(0.0)).withColumn(
        # rounded, as sums of shares differ in their last digits by the order of the rows
        "rate", F.when(present, F.round(F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("tokens")), 12)).otherwise(0.0)
    )


Unit = tuple[int, int, float]  # document, tokens, probability


def step(units: list[Unit], rng: random.Random) -> tuple[list[Unit], list[tuple[Unit, int]]]:
    """Move the probabilities of open documents along the null space; returns (open, decided with 0 or 1).

    Three documents keep number and tokens, two keep the number; one is decided by itself.
    """
    if len(units) >= 3:
        (_, a, _), (_, b, _), (_, c, _) = units[:3]
        u = [float(b - c), float(c - a), float(a - b)]
        if not any(u):
            u = [1.0, -1.0, 0.0]
    elif len(units) == 2:
        u = [1.0, -1.0]
    else:
        u = [1.0]
    p = [x[2] for x in units]

    def reach(sign: float) -> float:
        return min(((1.0 - q if sign * v > 0 else q) / abs(v)) for q, v in zip(p, u) if v)

    up, down = reach(1.0), reach(-1.0)
    move = up if rng.random() * (up + down) < down else -down
    still, decided = [], []
    for x, v in zip(units, (*u, *[0.0] * (len(units) - len(u)))):
        q = x[2] + move * v
        if q < NEAR:
            decided.append((x, 0))
        elif q > 1.0 - NEAR:
            decided.append((x, 1))
        else:
            still.append((x[0], x[1], q))
    return still, decided


def flight(rows: Iterator[tuple[str, int, int, int, float]], seed: int, level: int, land: bool) -> Iterator[tuple]:
    """(doc_id, source, tokens, pick or None, probability) of a stream of (source, group, doc_id, tokens, probability), sorted by group."""
    for (source, group), members in itertools.groupby(rows, key=lambda r: r[:2]):
        rng, units = random.Random(f"{seed}:{level}:{source}:{group}"), []
        for _, _, doc, tokens, p in members:
            units.append((doc, tokens, p))
            while len(units) >= 3:
                units, decided = step(units, rng)
                for (d, t, _), pick in decided:
                    yield d, source, t, pick, float(pick)
        while land and units:
            units, decided = step(units, rng)
            for (d, t, _), pick in decided:
                yield d, source, t, pick, float(pick)
        for d, t, p in units:
            yield d, source, t, None, p


_FLOWN = "doc_id long, source string, tokens long, pick int, p double"


def _fly(rows: DataFrame, seed: int, level: int, land: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for b in batches for r in zip(b["source"], b["group"], b["doc_id"], b["tokens"], b["p"]))
        for part in itertools.batched(flight(stream, seed, level, land), 10_000):
            f = pd.DataFrame(part, columns=["doc_id", "source", "tokens", "pick", "p"])
            yield f.assign(pick=f["pick"].astype("Int32"))

    return rows.select("source", "group", "doc_id", "tokens", "p").mapInPandas(run, _FLOWN)


def _sized(documents: DataFrame, targets: DataFrame, total: float | None, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their tokens, and a row for each source of the targets with its rate (see :func:`plan`)."""
    sized = checkpoint(token_counts(documents, folder))
    sizes = sized.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")
    )
    return sized, checkpoint(plan(sizes, targets, total))


def _draw(sized: DataFrame, mix: DataFrame, seed: int) -> DataFrame:
    rates = mix.where(F.col("rate") > 0).select("source", F.floor(F.col("rate") + NEAR).cast("int").alias("base"), "rate", "documents")
    rates = rates.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).drop("rate")
    # a source is one row here, and hot sources are spread by the hash of the document
    hot = hot_keys(mix.select("source", "documents"), ["source"], "documents", sized.count())
    known = salted_join(sized.where(F.col("source").isNotNull()), rates, ["source"], "doc_id", hot)
    open_ = (F.col("p") >= NEAR) & (F.col("p") <= 1.0 - NEAR)
    whole = known.where(~open_).select("doc_id", "source", "tokens", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("pick"))
    place = F.xxhash64(F.lit(seed), "doc_id")
    # as many groups as GROUP documents each ask for, by source; a power of two, so that groups of one level make up one of the next
    left = known.where(open_).select("source", "doc_id", "tokens", "p", place.alias("place"), F.greatest(
        F.lit(0), F.ceil(F.log2(F.col("documents") / GROUP)).cast("int")
    ).alias("bits"))
    decided, level = whole, 0
    while True:
        group = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(place, 64 - bits)")).otherwise(F.lit(0).cast("long"))
        grouped = left.withColumn("group", group)
        last = left.agg(F.max("bits")).first()[0]
        if last is None:
            break
        ordered = grouped.repartition("source", "group").sortWithinPartitions("source", "group", "place", "doc_id", "tokens")
        flown = checkpoint(_fly(ordered, seed, level, land=last == 0))
        decided = decided.unionByName(flown.where(F.col("pick").isNotNull()).select("doc_id", "source", "tokens", "pick"))
        if last == 0:
            break
        # of some 4,096 documents two are left, so the next level has fewer groups by the same factor
        left = flown.where(F.col("pick").isNull()).select("source", "doc_id", "tokens", "p", place.alias("place")).join(
            left.groupBy("source").agg(F.max("bits").alias("bits")), "source"
        ).withColumn("bits", F.greatest(F.lit(0), F.col("bits") - int(math.log2(GROUP // 2))))
        level += 1
    return decided.join(rates.select("source", "base"), "source").withColumn("copies", F.col("base") + F.col("pick")).where(
        F.col("copies") > 0
    ).select("doc_id", "source", "tokens", "copies")


def selection(
    documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, folder: str = TOKENIZERS
) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents drawn, with how often each is taken."""
    sized, mix = _sized(documents, targets, total, folder)
    return _draw(sized, mix, seed)


def shares(
    documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, folder: str = TOKENIZERS
) -> DataFrame:
    """A row for each source of the targets: target and actual share, tokens, documents and copies drawn, largest repeat."""
    sized, mix = _sized(documents, targets, total, folder)
    drawn = _draw(sized, mix, seed).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_copies"),
        F.count(F.lit(1)).alias("drawn_documents"), F.max("copies").alias("most_copies"),
    )
    joined = checkpoint(mix.drop("rate").withColumnRenamed("wanted", "wanted_tokens").join(drawn, "source", "left").na.fill(
        0, ["drawn_tokens", "drawn_copies", "drawn_documents", "most_copies"]
    ))
    whole = joined.agg(F.sum("drawn_tokens")).first()[0] or 0
    return joined.withColumn("actual_share", F.col("drawn_tokens") / whole if whole else F.lit(0.0))
