"""Problem 2: cutting items over a size limit into pieces, at natural boundaries, with an overlap.

An item (a text cell, or a file too large for one worker) is read in ranges with a halo on either side.

1. Detection: a worker publishes the boundaries in its range. Whether and how strongly a place is a boundary depends on
   the ``CONTEXT`` characters before it and ``AHEAD`` characters behind it alone, so every worker finds the same whatever its range.
2. Stitching: prefix sums of the ranges' lengths turn the tables' offsets into those of the item. A worker that holds no
   text takes the tables of a span (``SPAN`` pieces' worth of text, wherever ranges end) and chooses the cuts.
   Prefix sums over the spans number the pieces.
3. Emission: a worker that has a range emits the pieces that end in it, by offset.

No worker holds more than a range or the tables of a span. The pieces don't depend on the ranges' size: seams between
spans lie at the best boundary before each multiple of the span's length.

A piece has at most ``limit`` characters (Unicode code points). Every piece but the first begins with
the last ``overlap`` characters of the text before it, or all of that text if it is shorter; without
the overlaps the pieces are the item. A cut goes to the strongest
boundary in the second half of the room (paragraph, sentence, line, clause, word; the latest of
equals), else to any in the first half, else between two grapheme clusters.

Defined results: a null limit is 5000, one below 1 too; a null or negative overlap is 0, one that leaves no room for new
text is limit - 1; null and empty texts, and items within the limit, have no pieces; repeated items are each cut.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.runtime import checkpoint, join_nulls_equal

DEFAULT_LIMIT = 5000
#: Characters of a range.
RANGE = 1_000_000
#: What a boundary depends on before it and behind it, in characters.
CONTEXT, AHEAD = 64, 8
#: Length of a span, in pieces that are full of new text.
SPAN = 64

_PLACES = re.compile(r"\s+|[。！？][”’」）]*\s*|[；：，、—]\s*")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]」）]*\Z")
_HAN_SENTENCE = re.compile(r"[。！？][”’」）]*\Z")
_HEADING = re.compile(r"#{1,6}\s")
_CLAUSE, _HAN_CLAUSE = frozenset(";:,；：，、—"), frozenset("；：，、—")
#: A character that belongs to the grapheme cluster before it.
_JOINED = (
    "\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u200d\u20d0-\u20ff"
    "\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f"
)
#: Places inside a grapheme cluster, told by the character before or behind; of flags every second place is one.
_INSIDE = re.compile(f"(?<=\u200d)|(?=[{_JOINED}])|(?<=\r)(?=\n)|(?<=[\U0001f1e6-\U0001f1ff])(?=[\U0001f1e6-\U0001f1ff])")


def _strength(text: str, at: int) -> int:
    """Of a place in a text: 5 paragraph, 4 sentence, 3 line, 2 clause, 1 word, 0 none."""
    before = text[max(0, at - CONTEXT) : at]
    core = before.rstrip()
    run, tail = before[len(core) :], core[-AHEAD:]
    if not run:
        return 4 if _HAN_SENTENCE.search(tail) else 2 if tail[-1:] in _HAN_CLAUSE else 0
    if run.count("\n") > 1 or run[-1] == "\n" and _HEADING.match(text[at : at + AHEAD]):
        return 5
    if _SENTENCE.search(tail):
        return 4
    return 3 if "\n" in run else 2 if tail[-1:] in _CLAUSE else 1


def boundaries(text: str, first: int = 0, last: int | None = None) -> tuple[list[int], list[int]]:
    """Offsets above ``first`` and up to ``last`` at which the text may be cut, in order, with their strengths."""
    last = len(text) if last is None else last
    at, strength = [], []
    for m in _PLACES.finditer(text, max(0, first - CONTEXT)):
        p = m.end()
        if p > last:
            break
        if p > first and (s := _strength(text, p)):
            at.append(p)
            strength.append(s)
    return at, strength


def chooseable(at: list[int], strength: list[int], room: int) -> list[int]:
    """Indices of the boundaries that a cut may go to.

    One between a stronger one and one at least as strong that are no further apart than half the room never wins.
    """
    n = len(at)
    before, after, open_ = [-(1 << 60)] * n, [1 << 60] * n, []
    for i, s in enumerate(strength):
        while open_ and strength[open_[-1]] <= s:
            after[open_.pop()] = at[i]
        if open_:
            before[i] = at[open_[-1]]
        open_.append(i)
    return [i for i in range(n) if after[i] - before[i] > room // 2]


def inside(text: str, first: int, last: int, at: list[int], room: int) -> list[int]:
    """Places inside grapheme clusters, in stretches without boundaries that are so long that a cut may go there."""
    out, edges = [], [first, *at, last]
    for a, b in zip(edges, edges[1:]):
        if b - a > room // 4 or a == first or b == last:
            for m in _INSIDE.finditer(text, max(0, a - 1), min(len(text), b + 1)):
                p = m.start()
                if first < p <= last and (not out or p > out[-1]) and _joined(text, p):
                    out.append(p)
    return out


def _joined(text: str, p: int) -> bool:
    if not 0 < p < len(text):
        return False

    def letter(c: str) -> bool:
        return "\U0001f1e6" <= c <= "\U0001f1ff"

    if letter(text[p]) and letter(text[p - 1]):
        n = 0
        while n < CONTEXT and p - n > 0 and letter(text[p - n - 1]):
            n += 1
        return n % 2 == 1
    return text[p - 1] == "\u200d" or text[p - 1 : p + 1] == "\r\n" or bool(re.match(f"[{_JOINED}]", text[p]))


def best_cut(at: list[int], strength: list[int], joined: set[int], low: int, high: int) -> int:
    """Where to cut after ``low``, at ``high`` or before."""
    middle = low + (high - low) // 2
    last = bisect.bisect_right(at, high)
    for first in (bisect.bisect_right(at, middle), bisect.bisect_right(at, low)):
        if first < last:
            return at[max(range(first, last), key=lambda k: (strength[k], k))]
    cut = high
    while cut > low and cut in joined:
        cut -= 1
    return cut if cut > low else high


def sizes(limit: int | None, overlap: int | None) -> tuple[int, int]:
    limit = DEFAULT_LIMIT if limit is None or limit < 1 else int(limit)
    return limit, max(0, min(int(overlap or 0), limit - 1))


def span_cuts(
    span: int, total: int, limit: int, overlap: int, at: list[int], strength: list[int], joined: set[int]
) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a span, in offsets of the item, from the boundaries around and in it."""
    room = limit - overlap
    size = SPAN * room

    def seam(k: int) -> int:
        return 0 if k == 0 else total if k * size >= total else best_cut(at, strength, joined, k * size - room, k * size)

    done, stop, out = seam(span), seam(span + 1), []
    while done < stop:
        start = max(0, done - overlap)
        high = start + limit
        cut = stop if stop <= high else best_cut(at, strength, joined, done, high)
        out.append((start, cut))
        done = cut
    return out


def cut_text(text: str, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text that one worker holds: what the ranges give, in one place."""
    limit, overlap = sizes(limit, overlap)
    if len(text) <= limit:
        return []
    at, strength = boundaries(text)
    joined = set(inside(text, 0, len(text), [], limit - overlap))
    spans = -(-len(text) // (SPAN * (limit - overlap)))
    return [c for k in range(spans) for c in span_cuts(k, len(text), limit, overlap, at, strength, joined)]


# The steps over ranges. A range is a row with _item, _range, _limit, _overlap and what a reader needs to get its text.

_TABLE = "_item long, _range long, _limit long, _overlap long, _size long, at array<int>, strength array<int>, inside array<int>"


def _detect(ranges: DataFrame, read) -> DataFrame:
    """The table of each range: its length, and boundaries in offsets from its start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                text, own, size = read(r)
                room = r["_limit"] - r["_overlap"]
                at, strength = boundaries(text, own, own + size)
                joined = inside(text, own, own + size, at, room)
                kept = chooseable(at, strength, room)
                rows.append((
                    r["_item"], r["_range"], r["_limit"], r["_overlap"], size, [at[i] - own for i in kept],
                    [strength[i] for i in kept], [p - own for p in joined],
                ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TABLE.split(", ")])

    return ranges.mapInPandas(run, _TABLE)


def _sums(table: DataFrame, by: str, size: str) -> DataFrame:
    """(_item, by, _before, _total): prefix sums over the parts of each item, from rows of a few numbers."""
    whole = Window.partitionBy("_item")
    before = whole.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return table.select(
        "_item", by, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("_before"),
        F.sum(size).over(whole).cast("long").alias("_total"),
    )


def _by_span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each span needs of the table of a range, in offsets of the item."""
    columns = ["_item", "_span", "_range", "_limit", "_overlap", "_total", "_before", "_size", "at", "strength", "inside"]
    for b in batches:
        rows = []
        for r in b.to_dict("records"):
            room, start = r["_limit"] - r["_overlap"], r["_before"]
            size, end = SPAN * room, start + r["_size"]
            at, strength, joined = (np.asarray(r[c], np.int64) for c in ("at", "strength", "inside"))
            at, joined = at + start, joined + start
            for k in range(max(0, start // size - 1), min((end + room) // size, (r["_total"] - 1) // size) + 1):
                low, high = k * size - room, (k + 1) * size
                if end <= low or start >= high:
                    continue
                a, i = (at > low) & (at <= high), (joined > low) & (joined <= high)
                rows.append((r["_item"], k, r["_range"], r["_limit"], r["_overlap"], r["_total"], start, r["_size"], at[a], strength[a], joined[i]))
        yield pd.DataFrame(rows, columns=columns)


_CUTS = "_item long, _span long, _range long, _no long, starts array<long>, ends array<long>"


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of each span, by the range that each ends in; _no counts the pieces of the span before."""
    for b in batches:
        rows = []
        for r in b.to_dict("records"):
            parts = sorted(r["parts"], key=lambda x: x["_range"])
            at, strength, joined = ([v for x in parts for v in x[c]] for c in ("at", "strength", "inside"))
            found = span_cuts(r["_span"], r["_total"], r["_limit"], r["_overlap"], at, strength, set(joined))
            ends, n = [e for _, e in found], 0
            for x in parts:
                m = bisect.bisect_right(ends, x["_before"] + x["_size"])
                if m > n:
                    rows.append((r["_item"], r["_span"], x["_range"], n, [s for s, _ in found[n:m]], ends[n:m]))
                    n = m
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CUTS.split(", ")])


def plan(ranges: DataFrame, read) -> DataFrame:
    """(_item, _range, _before, cuts): of each range in which pieces end where it begins, and their numbers, starts and ends."""
    table = checkpoint(_detect(ranges, read))
    offsets = checkpoint(_sums(table, "_range", "_size"))
    placed = table.join(offsets.where(F.col("_total") > 0), ["_item", "_range"]).where(F.col("_total") > F.col("_limit"))
    part = F.struct("_range", "_before", "_size", "at", "strength", "inside")
    numbers = ", ".join(f"{c} long" for c in ("_item", "_span", "_range", "_limit", "_overlap", "_total", "_before", "_size"))
    spans = (
        placed.mapInPandas(_by_span, numbers + ", at array<long>, strength array<long>, inside array<long>")
        .groupBy("_item", "_span", "_limit", "_overlap", "_total").agg(F.collect_list(part).alias("parts"))
    )
    cuts = checkpoint(spans.mapInPandas(_choose, _CUTS))
    counted = cuts.groupBy("_item", "_span").agg(F.sum(F.size("ends")).alias("_n"))
    numbered = cuts.join(_sums(counted, "_span", "_n").withColumnRenamed("_before", "_first"), ["_item", "_span"])
    of_range = numbered.groupBy("_item", "_range").agg(
        F.collect_list(F.struct((F.col("_first") + F.col("_no")).alias("no"), "starts", "ends")).alias("cuts")
    )
    return of_range.join(offsets.drop("_total"), ["_item", "_range"])


_PIECES = "piece_no long, start long, length int, piece string"


def _emit(ranges: DataFrame, planned: DataFrame, key: list[str], read) -> DataFrame:
    """The pieces of each range, by offset; the text before the range reaches as far as a piece can."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                text, own, _ = read(r)
                k, shift, rows = tuple(r[c] for c in key), own - r["_before"], []
                for c in r["cuts"]:
                    for i, (s, e) in enumerate(zip(c["starts"], c["ends"]), 1):
                        rows.append((*k, c["no"] + i, s, e - s, text[s + shift : e + shift]))
                yield pd.DataFrame(rows, columns=[*key, "piece_no", "start", "length", "piece"])

    types = dict(ranges.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in key) + _PIECES
    return ranges.join(planned, ["_item", "_range"]).mapInPandas(run, schema)


def _read_cell(r: dict) -> tuple[str, int, int]:
    return r["_part"], r["_own"], r["_own_size"]


def cell_ranges(items: DataFrame, key: list[str], text: str, limit: Column, overlap: Column, least: int = RANGE) -> DataFrame:
    """The ranges of the items with more than ``limit`` characters, written once; each item has a number of its own."""
    sized = items.select(
        *key, F.col(text).alias("_text"),
        F.when(limit.isNull() | (limit < 1), DEFAULT_LIMIT).otherwise(limit).cast("long").alias("_limit"),
        F.greatest(F.lit(0), F.coalesce(overlap, F.lit(0))).cast("long").alias("_asked"),
    ).where(F.length("_text") > F.col("_limit")).withColumns({
        "_overlap": F.least("_asked", F.col("_limit") - 1), "_item": F.monotonically_increasing_id(),
    }).drop("_asked")
    columns = [*key, "_item", "_range", "_limit", "_overlap", "_part", "_own", "_own_size"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                whole, rows, held = r["_text"], [], 0
                k, halo = tuple(r[c] for c in key), max(CONTEXT, r["_limit"])
                for n, a in enumerate(range(0, len(whole), least)):
                    low, end = max(0, a - halo), min(len(whole), a + least)
                    rows.append((*k, r["_item"], n, r["_limit"], r["_overlap"], whole[low : end + AHEAD], a - low, end - a))
                    held += end - low
                    if held > RANGE:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    types = dict(sized.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in key) + "_item long, _range long, _limit long, _overlap long, _part string, _own long, _own_size long"
    return checkpoint(sized.mapInPandas(run, schema))


def split_items(items: DataFrame, key: list[str], text: str, limit: Column, overlap: Column, least: int = RANGE) -> DataFrame:
    """(key, piece_no, start, length, piece) of the items with more than ``limit`` characters."""
    ranges = cell_ranges(items, key, text, limit, overlap, least)
    return _emit(ranges, plan(ranges, _read_cell), key, _read_cell)


def file_ranges(spark: SparkSession, files: list[tuple[str, int | None, int | None]], least: int = RANGE) -> DataFrame:
    """The byte ranges of files; only paths and offsets, no text."""
    from pyarrow import fs

    rows = []
    for item, (path, limit, overlap) in enumerate(files):
        limit, overlap = sizes(limit, overlap)
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        total = system.get_file_info(inner).size
        rows.append((path, item, limit, overlap, total))
    listed = spark.createDataFrame(rows, "path string, _item long, _limit long, _overlap long, _total_bytes long").where("_total_bytes > 0")
    ranges = listed.withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_total_bytes - 1) div {least}"))))
    return ranges.select(
        "path", "_item", "_range", "_limit", "_overlap", (F.col("_range") * least).alias("_byte"),
        F.least(F.lit(least), F.col("_total_bytes") - F.col("_range") * least).cast("long").alias("_bytes"),
    ).repartition("_item", "_range")


def split_files(spark: SparkSession, files: list[tuple[str, int | None, int | None]], least: int = RANGE) -> DataFrame:
    """(path, piece_no, start, length, piece) of UTF-8 files over their limit, read by byte ranges.

    A character belongs to the range in which its first byte lies. Only paths, offsets and tables pass between
    the two readings; each worker opens the file at its range. Any file system that pyarrow can open will do.
    """
    ranges = file_ranges(spark, files, least)
    return _emit(ranges, plan(ranges, _read_bytes), ["path"], _read_bytes)


def _read_bytes(r: dict) -> tuple[str, int, int]:
    return read_range(r["path"], r["_byte"], r["_bytes"], max(CONTEXT, r["_limit"]))


def read_range(path: str, start: int, size: int, halo: int) -> tuple[str, int, int]:
    """(text with halos, offset of the range in it, characters of the range)."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    low, high = max(0, start - 4 * halo), start + size + 4 * (AHEAD + 1)
    with system.open_input_file(inner) as f:
        f.seek(low)
        raw = f.read(high - low)

    def aligned(k: int) -> int:
        while k < len(raw) and raw[k] & 0xC0 == 0x80:
            k += 1
        return k

    a, b, z = aligned(0), aligned(start - low), aligned(min(len(raw), start - low + size))
    before, own, after = (x.decode("utf-8", "replace") for x in (raw[a:b], raw[b:z], raw[z:]))
    return before[-halo:] + own + after[:AHEAD], min(len(before), halo), len(own)


#: Characters of a range of a delivered chunk: several to a chunk over the usual sizes.
CHUNK_RANGE = 4096


def _delivered(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    limits = manifests.select("manifest_id", "chunk_size", "chunk_overlap").where(F.col("manifest_id").isNotNull())
    delivered = chunks.where(F.col("chunk_text").isNotNull()).select("manifest_id", "chunk_no", "chunk_text")
    return delivered.join(limits, "manifest_id")


_KEY = ["manifest_id", "chunk_no"]


def _ranges(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    return cell_ranges(
        _delivered(manifests, chunks), _KEY, "chunk_text", F.col("chunk_size"), F.col("chunk_overlap"), CHUNK_RANGE
    )


def pieces(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(manifest_id, chunk_no, piece_no, start, length, piece) of the delivered chunks over their manifest's chunk_size."""
    ranges = _ranges(manifests, chunks)
    return _emit(ranges, plan(ranges, _read_cell), _KEY, _read_cell)


def found(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(manifest_id, chunk_no) of the chunks that come out in several pieces."""
    ranges = _ranges(manifests, chunks)
    several = plan(ranges, _read_cell).select("_item", F.explode("cuts").alias("c")).where(
        F.col("c.no") + F.size("c.ends") > 1
    ).select("_item").distinct()
    firsts = ranges.where(F.col("_range") == 0).select("_item", *_KEY)
    return firsts.join(several, "_item", "left_semi").select(*_KEY).distinct()


def tiling(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each chunk over its limit: whether its pieces are within the limit, overlap as asked and make up the text.

    Of a piece number k the new text begins where piece k - 1 ends.
    """
    texts = _delivered(manifests, chunks).groupBy(*_KEY).agg(
        F.min_by(F.struct("chunk_text", "chunk_size", "chunk_overlap"), "chunk_text").alias("v")
    ).select(*_KEY, "v.*")
    limit = F.when(F.col("chunk_size") >= 1, F.col("chunk_size")).otherwise(DEFAULT_LIMIT)
    overlap = F.least(F.greatest(F.coalesce("chunk_overlap", F.lit(0)), F.lit(0)), limit - 1)
    ends = F.col("start") + F.col("length")
    before = F.coalesce(F.lag(ends).over(Window.partitionBy(*_KEY).orderBy("piece_no")), F.lit(0))
    cut = pieces(manifests, chunks).withColumn("before", before)
    return cut.join(texts, _KEY).groupBy(*_KEY).agg(
        F.first(F.length("chunk_text")).alias("n_chars"),
        F.bool_and((F.col("length") <= limit) & (F.col("length") == F.length("piece"))).alias("within"),
        F.bool_and(F.col("start") == F.greatest(F.lit(0), F.col("before") - F.when(F.col("piece_no") > 1, overlap).otherwise(0))).alias("overlapping"),
        (F.sum(ends - F.col("before")) == F.first(F.length("chunk_text"))).alias("tiled"),
        F.bool_and(F.substr("chunk_text", (F.col("start") + 1).cast("int"), F.col("length")) == F.col("piece")).alias("verbatim"),
    )


def delivery(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each manifest: listed, delivered and oversized chunks, and the pieces they come out in."""
    listed = manifests.select("manifest_id", F.explode("chunks").alias("chunk_path")).distinct()
    texts = chunks.select("chunk_path", "chunk_no", F.col("chunk_text").isNotNull().alias("has_text"))
    cut = pieces(manifests, chunks).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    per_chunk = join_nulls_equal(listed.join(texts, "chunk_path", "left"), cut, _KEY, "left")
    return per_chunk.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("has_text")).alias("delivered"),
        F.count("n").alias("oversized"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
    )
