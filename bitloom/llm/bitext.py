"""Problem 5: sentence alignment in bilingual documents whose cells are out of step.

Length-based dynamic programming over the sentences of a document finds the optimal path of
one-to-one, omission, insertion, merge (two to one) and split (one to two) beads. The cost of a bead
is the negative logarithm of its length ratio's probability under a normal model (Gale and Church 1993), plus what the words say
that have a known translation, and numbers, codes and names: their share without a counterpart on the other side, less that with one.
Words without a known translation say nothing, so where none is known the lengths decide alone.
All links of the path are kept but those that known words speak against. Sentences that the path leaves alone on both sides are then
paired across it if they share enough, which covers reordering.

Word translations come from the lexicon table and from counts over all paired rows, by pair of languages. They are
handed to every task up to a counted bound; beyond it each block is joined with those of its own words.

A document is cut into blocks of ``BLOCK`` source cells, each with the target cells of a window around
its place, so that no task holds more than a block. In longer documents the window follows the
drift of tokens that occur once on either side, from the nearest blocks that have such, and is as wide as the drift is spread,
up to WIDEST. Sentences that no block links are then paired across blocks, by an equi-join on words that they share.

Defined results: null, empty and blank cells have no sentences; of several rows with one file_id and seg_no
that with the smallest unit_key counts; files without rows, or with one side empty, give no pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.pairs import LENGTH, sentences, tag, width
from bitloom.runtime import checkpoint, semi_join_ids, spread

#: Source cells in a block, and target cells of the window before and behind it.
BLOCK, HALO = 300, 120
#: Cells by which the spread of the drift may widen a window to either side; what lies beyond is paired across blocks.
WIDEST = 600
#: Pairs of words that a task looks at together, and different ones that it counts before it hands them on.
MET_AT_ONCE, MET_HELD = 1_000_000, 400_000
#: Length of the table of word counts (by the hash of the word) that tells which pairs can't reach LEAST_DICE.
BUCKETS = 1 << 21
#: Up to so many translations are handed to every task, after they were counted.
BROADCAST_WORDS = 200_000
#: Counts and association that make two words a translation.
LEAST_COUNT, LEAST_DICE = 4, 0.12
# Standard deviation of a length per character, and costs of the beads.
SPREAD = 6.8
SKIP = 1.7
JOIN = 0.6
LENGTH_WEIGHT, SHARED_WEIGHT = 1.0, 4.4
#: A length ratio's cost is bounded, as renderings may leave out asides.
LONGEST = 3.0
#: Share of a pair's words that must be known before they can speak against it.
COVERED = 0.3
#: What two sentences must share to be paired across the path, and at all.
CROSSING, JOINED, LEAST = 0.36, 0.5, 0.36
#: What names that differ on both sides take from it.
CONFLICT = 0.15

_ASCII = re.compile(r"[a-z]++(?:-\d++)?|\d+(?:[.,]\d+)*")
_LATIN = re.compile(r"[A-Za-z]++(?:-\d+)|\d+(?:[.,]\d+)*|[^\W\d_㐀-鿿]+")
_HAN_RUN = re.compile(r"[㐀-鿿]+")


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers and codes; Chinese text by pairs of characters."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    out = [w.lower() for w in _LATIN.findall(text)]
    for run in _HAN_RUN.findall(text):
        out += map(add, run, run[1:]) if len(run) > 1 else [run]
    return out


Lexicon = dict[str, dict[str, float]]
_NAME = re.compile(r"[A-Z]+-\d+|[A-Z][a-z]{2,}")


def names(text: str, lexicon: Lexicon, capitals: bool) -> set[str]:
    """Codes, and capitalised words that aren't among the words with a translation (where capitals mean a name)."""
    return {w for w in _NAME.findall(text) if "-" in w or capitals and w.lower() not in lexicon}


def weight(n, left, right, rows):
    """Dice of what two words meet more often than by chance; words that most rows hold meet without being translations."""
    return 2 * (n - left * right / rows) / (left + right)


def _sides(b: pd.DataFrame) -> Iterator[tuple[str, list[set[str]]]]:
    """(pair of languages, words of either side); both directions count together."""
    for sl, tl, s, t in zip(b["sl"], b["tl"], b["source"], b["target"]):
        la, lb = sl or "", tl or ""
        if lb < la:
            la, lb, s, t = lb, la, t, s
        yield f"{la} {lb}", [{w for w in tokens(x) if not w[0].isdigit()} for x in (s, t)]


def _alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pair, side, word, n): rows with the word, in parts, which add up; the empty word stands for all rows."""
    for b in batches:
        counts: dict[tuple[str, int], Counter] = {}
        for pair, sides in _sides(b):
            sides[0].add("")
            for k, words in enumerate(sides):
                counts.setdefault((pair, k), Counter()).update(words)
        rows = [(*key, w, n) for key, c in counts.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["pair", "side", "word", "n"])


def merged_counts(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two counts, each by distinct rising keys."""
    at = np.searchsorted(a, b)
    known = np.zeros(len(b), bool)
    inside = at < len(a)
    known[inside] = a[at[inside]] == b[inside]
    na = na.copy()
    na[at[known]] += nb[known]
    return np.insert(a, at[~known], b[~known]), np.insert(na, at[~known], nb[~known])


def _meeting(
    least: np.ndarray, most: np.ndarray, at_once: int, held: int, batches: Iterator[pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """(pair, word, other, n): rows in which two words meet, in parts, which add up.

    ``least`` and ``most`` bound the count of a word by its bucket; what they rule out can't reach LEAST_COUNT or LEAST_DICE.
    """
    ids: dict[tuple[str, int], dict[str, int]] = {}
    low, high, parts, sides_of, room = [], [], [], ([], []), 0
    ratio = LEAST_DICE / (2 - LEAST_DICE) * 0.999

    def number(key: tuple[str, int], word: str) -> int:
        bucket = zlib.crc32(f"{key[0]}\0{key[1]}\0{word}".encode()) % len(most)
        if most[bucket] < LEAST_COUNT:
            return -1
        low.append(least[bucket])
        high.append(most[bucket])
        words.append((key[0], word))
        return len(low) - 1

    def numbers(key: tuple[str, int], side: set[str]) -> list[int]:
        known = ids.setdefault(key, {})
        for w in side:
            if w not in known:
                known[w] = number(key, w)
        return [i for w in side if (i := known[w]) >= 0]

    def count() -> None:
        (a, b), (na, nb) = ([np.array([i for x in side for i in x], np.int64) for side in sides_of], [np.array([len(x) for x in side], np.int64) for side in sides_of])
        lo, hi = np.array(low, np.float32), np.array(high, np.float32)
        times = np.repeat(nb, na)  # of each word of one side, the words that it meets
        first = np.repeat(np.cumsum(nb) - nb, na)
        x = np.repeat(a, times)
        y = b[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(x))]
        keep = (hi[x] >= ratio * lo[y]) & (hi[y] >= ratio * lo[x])
        met, n = np.unique((x[keep] << 32) | y[keep], return_counts=True)
        if parts:
            met, n = merged_counts(*parts[0], met, n)
        parts[:] = [(met, n)]
        for side in sides_of:
            side.clear()

    def counted() -> pd.DataFrame:
        (met, n), x, y = parts[0], parts[0][0] >> 32, parts[0][0] & 0xFFFFFFFF
        rows = [(*words[i], words[j][1]) for i, j in zip(x.tolist(), y.tolist())]
        return pd.DataFrame(rows, columns=["pair", "word", "other"]).assign(n=n)

    words: list[tuple] = []
    for b in batches:
        for pair, sides in _sides(b):
            found = [numbers((pair, k), side) for k, side in enumerate(sides)]
            room += len(found[0]) * len(found[1])
            for k in (0, 1):
                sides_of[k].append(found[k])
            if room >= at_once:
                count()
                room = 0
                if len(parts[0][0]) >= held:
                    yield counted()
                    for x in (ids, low, high, words, parts):
                        x.clear()
    if sides_of[0]:
        count()
    if parts:
        yield counted()


def _entry_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(c, lang, w) for c, lang, word in zip(b["concept_id"], b["lang"], b["word"]) for w in tokens(word)]
        yield pd.DataFrame(rows, columns=["concept_id", "lang", "word"])


def translations(units: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, other, weight), either way round: from all paired rows, and from the lexicon table."""
    paired = files.where(F.col("layout") == "paired").select("file_id").distinct()
    rows = semi_join_ids(units, paired, "file_id").where(F.col("source").isNotNull() & F.col("target").isNotNull()).select(
        tag(F.col("source_lang")).alias("sl"), tag(F.col("target_lang")).alias("tl"), "source", "target"
    )
    rows = spread(rows)
    alone = checkpoint(
        rows.mapInPandas(_alone, "pair string, side int, word string, n long")
        .groupBy("pair", "side", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_COUNT) | (F.col("word") == ""))
    )
    least, most = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    bucket = F.crc32(F.concat_ws("\0", "pair", F.col("side").cast("string"), "word").cast("binary")) % BUCKETS
    bounds = alone.groupBy(bucket.alias("bucket")).agg(F.min("n").alias("least"), F.max("n").alias("most")).toArrow()
    least[bounds["bucket"].to_numpy()], most[bounds["bucket"].to_numpy()] = bounds["least"].to_numpy(), bounds["most"].to_numpy()
    shared = units.sparkSession.sparkContext.broadcast((least, most))
    at_once, held = MET_AT_ONCE, MET_HELD
    met = (
        rows.mapInPandas(lambda batches: _meeting(*shared.value, at_once, held, batches), "pair string, word string, other string, n long")
        .groupBy("pair", "word", "other").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_COUNT) & (F.col("word") != F.col("other")))
    )
    left = alone.where(F.col("side") == 0).select("pair", "word", F.col("n").alias("n_word"))
    right = alone.where(F.col("side") == 1).select("pair", F.col("word").alias("other"), F.col("n").alias("n_other"))
    every = alone.where(F.col("word") == "").select("pair", F.col("n").alias("n_rows"))
    total = F.col("n_word") + F.col("n_other")
    counted = (
        met.join(left, ["pair", "word"]).join(right, ["pair", "other"]).join(every, "pair").where(2 * F.col("n") / total >= LEAST_DICE)
        .select("word", "other", weight(F.col("n"), F.col("n_word"), F.col("n_other"), F.col("n_rows")).alias("weight"))
        .withColumn("weight", F.greatest("weight", F.lit(0.0)))
    )
    entries = lexicon.where(F.col("word").isNotNull() & F.col("concept_id").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("concept_id").cast("long").alias("concept_id"), "lang", "word"
    ).mapInPandas(_entry_tokens, "concept_id long, lang string, word string").distinct()
    others = entries.select("concept_id", F.col("lang").alias("other_lang"), F.col("word").alias("other"))
    listed = entries.join(others, "concept_id").where(F.col("lang") != F.col("other_lang")).select(
        "word", "other", F.lit(0.9).alias("weight")
    )
    both = counted.unionByName(counted.select(F.col("other").alias("word"), F.col("word").alias("other"), "weight"))
    return both.unionByName(listed).groupBy("word", "other").agg(F.max("weight").alias("weight"))


def as_lexicon(words: Iterable, others: Iterable, weights: Iterable) -> Lexicon:
    out: Lexicon = {}
    for x, y, weight in zip(words, others, weights):
        out.setdefault(x, {})[y] = weight
    return out


def _words(cells: DataFrame, key: list[str]) -> DataFrame:
    """The distinct words of the cells under each key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(*k, w) for *k, s, t in zip(*(b[c] for c in key), b["source"], b["target"]) for w in tokens(f"{s or ''} \n {t or ''}")}
            yield pd.DataFrame(list(rows), columns=[*key, "word"])

    return cells.select(*key, "source", "target").mapInPandas(run, "".join(f"{k} long, " for k in key) + "word string").distinct()


def associations(pairs: Iterable[tuple[str, str]], entries: Iterable[tuple[int, str, str]] = ()) -> Lexicon:
    """The same on one machine, for rows of one pair of languages."""
    rows = [tuple({w for w in tokens(x) if not w[0].isdigit()} for x in pair) for pair in pairs]
    left, right = Counter(w for a, _ in rows for w in a), Counter(w for _, b in rows for w in b)
    # rare words (mostly names) can't reach LEAST_COUNT
    words_left, words_right = ([w for w, n in c.items() if n >= LEAST_COUNT] for c in (left, right))
    number_left, number_right = ({w: i for i, w in enumerate(ws)} for ws in (words_left, words_right))
    size = max(1, len(words_right))
    codes = [
        np.add.outer(
            np.array([number_left[w] for w in a if w in number_left], dtype=np.int64) * size,
            np.array([number_right[w] for w in b if w in number_right], dtype=np.int64),
        ).ravel()
        for a, b in rows
    ]
    met, times = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
    out: Lexicon = {}
    for code, n in zip(met[times >= LEAST_COUNT].tolist(), times[times >= LEAST_COUNT].tolist()):
        x, y = words_left[code // size], words_right[code % size]
        if x != y and (dice := 2 * n / (left[x] + right[y])) >= LEAST_DICE:
            dice = max(0.0, weight(n, left[x], right[y], len(rows)))
            out.setdefault(x, {})[y] = dice
            out.setdefault(y, {}).setdefault(x, dice)
    concepts: dict[int, list[tuple[str, str]]] = {}
    for concept, lang, word in entries:
        concepts.setdefault(concept, []).append((lang, word))
    for words in concepts.values():
        for la, a in words:
            for lb, b in words:
                if la != lb:
                    for x in tokens(a):
                        for y in tokens(b):
                            out.setdefault(x, {})[y] = 0.9
    return out


class Shared:
    """What the sentences of two sides share: of each sentence, the weighted share of tokens with a counterpart."""

    def __init__(self, source_texts: list[str], target_texts: list[str], lexicon: Lexicon, capitals: tuple[bool, bool]):
        source, target = [tokens(x) for x in source_texts], [tokens(x) for x in target_texts]
        df = Counter(w for x in (*source, *target) for w in set(x))
        n = len(source) + len(target)
        self.s, vs = self._weights(source, df, n)
        self.t, vt = self._weights(target, df, n)
        links = np.zeros((max(1, len(vs)), max(1, len(vt))))
        for w, i in vs.items():
            known = lexicon.get(w, {})
            for y in known.keys() & vt.keys():
                links[i, vt[y]] = min(1.0, 1.4 * known[y])
            if w in vt:
                links[i, vt[w]] = 1.0
        # of each token of one side, its best counterpart in each sentence of the other
        self.in_t = np.stack([links[:, x > 0].max(axis=1, initial=0.0) for x in self.t], axis=1)
        self.in_s = np.stack([links[x > 0].max(axis=0, initial=0.0) for x in self.s], axis=1)
        self.s_total, self.t_total = np.maximum(self.s.sum(axis=1), 1e-9), np.maximum(self.t.sum(axis=1), 1e-9)
        # tokens that would have a counterpart in a rendering: words with translations, and what stays as it is
        self.s_known, self.t_known = (
            np.array([w in lexicon or not w[0].isalpha() or "-" in w or w in other for w in words] or [False], dtype=float)
            for words, other in ((vs, vt), (vt, vs))
        )
        self.s_covered, self.t_covered = self.s @ self.s_known / self.s_total, self.t @ self.t_known / self.t_total
        self.covered = (self.s_covered[:, None] + self.t_covered[None, :]) / 2
        self.pairs = (
            (self.s @ self.in_t) / self.s_total[:, None] + ((self.t @ self.in_s) / self.t_total[:, None]).T
        ) / 2

        self._conflicts(*(
            [names(x, lexicon, capital) for x in texts] for texts, capital in zip((source_texts, target_texts), capitals)
        ))

    def _conflicts(self, source: list[set[str]], target: list[set[str]]) -> None:
        """Names that each side has for itself speak against a pair; a rendering may drop a name, not change it."""
        for i, j in zip(*np.nonzero(self.pairs >= LEAST - CONFLICT)):
            a, b = source[i], target[j]
            if a and b and not a <= b and not b <= a:
                self.pairs[i, j] -= CONFLICT

    @staticmethod
    def _weights(side: list[list[str]], df: Counter, n: int) -> tuple[np.ndarray, dict[str, int]]:
        words = {w: i for i, w in enumerate(dict.fromkeys(w for x in side for w in x))}
        out = np.zeros((len(side), max(1, len(words))))
        for k, x in enumerate(side):
            for w in x:
                out[k, words[w]] += math.log((n + 1) / df[w])
        return out, words

    def against(self, a: list[int], b: list[int]) -> float:
        """Of several sentences taken together: the share of known tokens less that of those with a counterpart."""
        s, t = self.s[a].sum(axis=0), self.t[b].sum(axis=0)
        covered = s @ self.s_known / max(s.sum(), 1e-9) + t @ self.t_known / max(t.sum(), 1e-9)
        return float(covered) / 2 - self.of(a, b)

    def of(self, a: list[int], b: list[int]) -> float:
        """What several sentences taken together share."""
        s, t = self.s[a].sum(axis=0), self.t[b].sum(axis=0)
        of_s = s @ self.in_t[:, b].max(axis=1) / max(s.sum(), 1e-9)
        of_t = t @ self.in_s[:, a].max(axis=1) / max(t.sum(), 1e-9)
        return float(of_s + of_t) / 2


def align(
    source: list[str], target: list[str], ratio: float, lexicon: Lexicon, capitals: tuple[bool, bool] = (True, True)
) -> list[tuple[int, int, float]]:
    """Links between sentence numbers of the two sides, with what they share.

    ``ratio`` is the usual length of a target against its source; ``capitals`` says of either side whether
    capitals inside a sentence mark names (in German they mark all nouns).
    """
    n, m = len(source), len(target)
    if not n or not m:
        return []
    both = Shared(source, target, lexicon, capitals)
    sim = both.pairs.tolist()
    sw, tw = np.array([width(x) for x in source]) * ratio, np.array([width(x) for x in target])

    def length(a, b):
        return np.minimum(LENGTH_WEIGHT * (b - a) ** 2 / (SPREAD * np.maximum(2.0, a + b)), LONGEST)

    s_long, t_long = sw.tolist(), tw.tolist()
    unknown = (both.covered < COVERED).tolist()

    def merged(a, b):
        """Cost of a bead of several sentences on one side."""
        x, y = sum(s_long[i] for i in a), sum(t_long[j] for j in b)
        cost = JOIN + min(LENGTH_WEIGHT * (y - x) ** 2 / (SPREAD * max(2.0, x + y)), LONGEST)
        return cost if all(unknown[i][j] for i in a for j in b) else cost + SHARED_WEIGHT * both.against(a, b)

    one = (length(sw[:, None], tw[None, :]) + SHARED_WEIGHT * (both.covered - both.pairs)).tolist()
    kept = ((both.pairs >= LEAST) | (both.covered < COVERED)).tolist()
    joined = ((both.pairs >= JOINED) | (both.covered < COVERED)).tolist()
    inf = math.inf
    best = [[inf] * (m + 1) for _ in range(n + 1)]
    back = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row, up, up2 = best[i], best[i - 1], best[i - 2]
        steps, joins, before, ones = back[i], joined[i - 1], joined[i - 2], one[i - 1]
        for j in range(m + 1):
            value, step = row[j], (0, 0)
            if i and up[j] + SKIP < value:
                value, step = up[j] + SKIP, (1, 0)
            if j:
                if row[j - 1] + SKIP < value:
                    value, step = row[j - 1] + SKIP, (0, 1)
                if i:
                    if up[j - 1] + ones[j - 1] < value:
                        value, step = up[j - 1] + ones[j - 1], (1, 1)
                    if i > 1 and up2[j - 1] + JOIN < value and before[j - 1] and joins[j - 1]:
                        v = up2[j - 1] + merged([i - 2, i - 1], [j - 1])
                        if v < value:
                            value, step = v, (2, 1)
                    if j > 1 and up[j - 2] + JOIN < value and joins[j - 2] and joins[j - 1]:
                        v = up[j - 2] + merged([i - 1], [j - 2, j - 1])
                        if v < value:
                            value, step = v, (1, 2)
            row[j] = value
            steps[j] = step
    links, i, j = [], n, m
    while i or j:
        a, b = back[i][j]
        if a and b:
            links.extend((x, y, sim[x][y]) for x in range(i - a, i) for y in range(j - b, j) if kept[x][y])
        i, j = i - a, j - b
    return links + _crossing(n, m, links, sim)


def _crossing(n: int, m: int, links: list[tuple], sim: list[list[float]]) -> list[tuple[int, int, float]]:
    """Pairs of sentences left alone on both sides that share enough, best first."""
    left = sorted(set(range(n)) - {a for a, *_ in links})
    right = sorted(set(range(m)) - {b for _, b, _ in links})
    ranked = sorted(((sim[a][b], -abs(a - b), a, b) for a in left for b in right), reverse=True)
    out, used_a, used_b = [], set(), set()
    for s, _, a, b in ranked:
        if s >= CROSSING and a not in used_a and b not in used_b:
            out.append((a, b, s))
            used_a.add(a)
            used_b.add(b)
    return out


def align_cells(cells: pd.DataFrame, lexicon: Lexicon) -> list[tuple[int, int, int]]:
    """(source seg_no, target seg_no, linked sentences) of one block; ``own`` marks the source cells of the block."""
    links = Counter((a, b) for a, _, b, _ in align_sentences(cells, lexicon))
    return [(int(a), int(b), k) for (a, b), k in links.items()]


def align_sentences(cells: pd.DataFrame, lexicon: Lexicon) -> list[tuple[int, int, int, int]]:
    """(source seg_no, its sentence, target seg_no, its sentence) of the links of one block."""
    cells = cells.sort_values("seg_no")
    source, target, s_seg, t_seg = [], [], [], []
    for seg, own, s, t in zip(cells["seg_no"], cells["own"], cells["source"], cells["target"]):
        if own and s:
            parts = [x.strip() for x in sentences(s)]
            source += parts
            s_seg += [(seg, k) for k in range(len(parts))]
        if t:
            parts = [x.strip() for x in sentences(t)]
            target += parts
            t_seg += [(seg, k) for k in range(len(parts))]
    sl, tl = cells["sl"].iloc[0], cells["tl"].iloc[0]
    ratio = LENGTH.get(tl, 1.0) / LENGTH.get(sl, 1.0)
    found = align(source, target, ratio, lexicon, (sl != "de", tl != "de"))
    return [(*s_seg[a], *t_seg[b]) for a, b, _ in found]


def cells_of(units: DataFrame, files: DataFrame) -> DataFrame:
    """One row per cell pair of the raw_import files: file_id, seg_no, source, target and language tags."""
    raw = files.where(F.col("layout") == "raw_import").select("file_id").distinct()
    rows = semi_join_ids(units, raw, "file_id").select(
        "file_id", F.col("seg_no").cast("long").alias("seg_no"), "unit_key", "source", "target",
        tag(F.col("source_lang")).alias("sl"), tag(F.col("target_lang")).alias("tl"),
    ).where(F.col("seg_no").isNotNull())
    value = F.struct("unit_key", "source", "target", "sl", "tl")
    return rows.groupBy("file_id", "seg_no").agg(F.min_by(value, "unit_key").alias("v")).select("file_id", "seg_no", "v.*")


def drift(cells: DataFrame) -> DataFrame:
    """(file_id, block, shift): how far behind its source a target stands in each block of a long document: low, median, high."""
    sizes = cells.groupBy("file_id").agg(F.max("seg_no").alias("last")).where(F.col("last") > BLOCK)
    long = cells.join(sizes.select("file_id"), "file_id", "left_semi")

    def once(side: str) -> DataFrame:
        pattern = F.lit(r"([A-Z]+-\d+|\d{3,}|[A-Z][a-z]{3,})")
        words = long.select("file_id", "seg_no", F.explode(F.regexp_extract_all(side, pattern)).alias("w"))
        return words.groupBy("file_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("seg_no").alias(side)).where(
            F.col("n") == 1
        ).drop("n")

    both = once("source").join(once("target"), ["file_id", "w"])
    return both.groupBy("file_id", F.floor((F.col("source") - 1) / BLOCK).alias("block")).agg(
        F.percentile_approx(F.col("target") - F.col("source"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), 1000).alias("shift")
    )


def blocks(cells: DataFrame) -> DataFrame:
    """The cells with the block they are aligned in; those of a window around it stand in it with own = false."""
    block = F.floor((F.col("seg_no") - 1) / BLOCK)
    owned = cells.withColumn("block", block)
    sources = owned.select("*", F.lit(True).alias("own")).withColumn("target", F.lit(None).cast("string"))
    # each block asks for the target cells of its window, which lie in few blocks
    asked = owned.select("file_id", F.col("block").alias("asking")).distinct().join(
        drift(cells).withColumnRenamed("block", "asking"), ["file_id", "asking"], "left"
    )
    along = Window.partitionBy("file_id").orderBy("asking")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    own, last, following = F.col("shift"), F.last("shift", True).over(before), F.first("shift", True).over(after)
    asked = asked.select(
        "file_id", "asking", F.coalesce(own[1], last[1], following[1], F.lit(0)).alias("shift"),
        F.coalesce(F.least(own[0], last[1], following[1]), F.lit(0)).alias("least"),
        F.coalesce(F.greatest(own[2], last[1], following[1]), F.lit(0)).alias("most"),
    )
    low = F.col("asking") * BLOCK + 1 + F.greatest(F.col("least"), F.col("shift") - WIDEST) - HALO
    high = (F.col("asking") + 1) * BLOCK + F.least(F.col("most"), F.col("shift") + WIDEST) + HALO
    windows = asked.select("file_id", "asking", low.alias("low"), high.alias("high")).withColumn(
        "block", F.explode(F.sequence(F.floor((F.col("low") - 1) / BLOCK), F.floor((F.col("high") - 1) / BLOCK)))
    )
    targets = (
        owned.where(F.col("target").isNotNull()).join(windows, ["file_id", "block"])
        .where(F.col("seg_no").between(F.col("low"), F.col("high")))
        .withColumn("block", F.col("asking")).withColumn("own", F.lit(False)).withColumn("source", F.lit(None).cast("string"))
    )
    columns = ["file_id", "block", "seg_no", "own", "source", "target", "sl", "tl"]
    return sources.select(columns).unionByName(targets.select(columns))


def links(units: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(file_id, source_seg_no, target_seg_no, sentences): cells that translate each other, with their linked sentences."""
    cells = checkpoint(cells_of(units, files))  # read several times below, and a small part of the units
    known = checkpoint(translations(units, files, lexicon).join(_words(cells, []), "word", "left_semi"))
    sizes = checkpoint(cells.groupBy("file_id").agg(F.max("seg_no").alias("last")).where(F.col("last") > BLOCK))
    if sizes.isEmpty():
        return align_blocks(blocks(cells), known)
    linked = checkpoint(align_blocks(blocks(cells), known, True))
    rest = across(cells.join(sizes, "file_id", "left_semi"), linked, known)
    return linked.unionByName(rest).groupBy("file_id", "source_seg_no", "target_seg_no").agg(F.count(F.lit(1)).cast("int").alias("sentences"))


def across(cells: DataFrame, linked: DataFrame, known: DataFrame) -> DataFrame:
    """Links of sentences that no block has linked on either side, best first: those that share enough, wherever they stand.

    Sides that share enough have a word in common, or two that translate each other, among the heaviest of one of them.
    """
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (file, side, seg, k, tokens(x), sorted(names(x, {}, lang != "de")))
                for file, seg, *both in zip(b["file_id"], b["seg_no"], b["source"], b["target"], b["sl"], b["tl"])
                for side, text, lang in ((0, both[0], both[2]), (1, both[1], both[3])) for k, x in enumerate(sentences(text or ""))
            ]
            yield pd.DataFrame(rows, columns=["file_id", "side", "seg", "k", "words", "names"])

    schema = "file_id long, side int, seg int, k int, words array<string>, names array<string>"
    every = checkpoint(cells.mapInPandas(split, schema))
    words = every.select("file_id", "side", "seg", "k", F.explode("words").alias("word")).groupBy("file_id", "side", "seg", "k", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = words.groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("df")).join(every.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")), "file_id")
    done = linked.select("file_id", F.lit(0).alias("side"), F.col("source_seg_no").alias("seg"), F.col("source_k").alias("k")).unionByName(
        linked.select("file_id", F.lit(1).alias("side"), F.col("target_seg_no").alias("seg"), F.col("target_k").alias("k")))
    key = ["file_id", "side", "seg", "k"]
    whole, rising = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("w", "word")
    left = checkpoint(
        words.join(done, key, "left_anti").join(df, ["file_id", "word"])
        .withColumn("w", F.col("tf") * F.log((F.col("n") + 1) / F.col("df")))
        .withColumn("share", F.col("w") / F.greatest(F.sum("w").over(whole), F.lit(1e-9)))
        .withColumn("heavy", F.sum("share").over(rising) >= CROSSING - 1e-9)
        .select("file_id", "side", F.struct("seg", "k").alias("at"), "word", "share", "heavy")
    )
    a = left.where(F.col("side") == 0).select("file_id", F.col("at").alias("a"), F.col("word").alias("x"), F.col("share").alias("share_x"), F.col("heavy").alias("heavy_x"))
    b = left.where(F.col("side") == 1).select("file_id", F.col("at").alias("b"), F.col("word").alias("y"), F.col("share").alias("share_y"), F.col("heavy").alias("heavy_y"))
    same = a.withColumn("y", F.col("x")).withColumn("link", F.lit(1.0))
    other = a.join(known.select(F.col("word").alias("x"), F.col("other").alias("y"), F.least(F.lit(1.0), 1.4 * F.col("weight")).alias("link")).where((F.col("link") > 0) & (F.col("x") != F.col("y"))), "x")
    shared = same.unionByName(other).join(b, ["file_id", "y"])
    pair = ["file_id", "a", "b"]
    candidates = checkpoint(shared.where(F.col("heavy_x") | F.col("heavy_y")).select(*pair).distinct())
    meets = checkpoint(shared.join(candidates, pair, "left_semi").select(*pair, "x", "y", "share_x", "share_y", "link"))
    of_a, of_b = (
        meets.groupBy(*pair, w).agg((F.max("link") * F.first(f"share_{w}")).alias("s")).groupBy(*pair).agg(F.sum("s").alias(f"of_{w}")) for w in "xy"
    )
    own = every.select("file_id", "side", F.struct("seg", "k").alias("at"), F.explode("names").alias("name")).withColumn("word", F.lower("name"))
    own = own.where(F.col("name").contains("-")).unionByName(
        own.where(~F.col("name").contains("-")).join(known.select("word").distinct(), "word", "left_anti").select(own.columns)
    ).groupBy("file_id", "side", "at").agg(F.collect_set("name").alias("names"))
    na, nb = (own.where(F.col("side") == i).select("file_id", F.col("at").alias(c), F.col("names").alias(f"names_{c}")) for i, c in enumerate("ab"))
    differ = (F.size(F.array_except("names_a", "names_b")) > 0) & (F.size(F.array_except("names_b", "names_a")) > 0)
    ranked = checkpoint(
        of_a.join(of_b, pair).join(na, ["file_id", "a"], "left").join(nb, ["file_id", "b"], "left")
        .withColumn("s", (F.col("of_x") + F.col("of_y")) / 2 - F.when(differ, CONFLICT).otherwise(0.0)).where(F.col("s") >= CROSSING)
        .select(*pair, F.struct("s", (-F.abs(F.col("a.seg") - F.col("b.seg"))).alias("near"), "a", "b").alias("r"))
    )
    out = linked.limit(0)
    while not ranked.isEmpty():  # each round takes the pairs that are the best of both their sentences
        best = ranked.withColumns({f"best_{c}": F.max("r").over(Window.partitionBy("file_id", c)) for c in "ab"})
        taken = checkpoint(best.where((F.col("r") == F.col("best_a")) & (F.col("r") == F.col("best_b"))).select(*pair))
        out = out.unionByName(taken.select(
            "file_id", F.col("a.seg").alias("source_seg_no"), F.col("a.k").alias("source_k"), F.col("b.seg").alias("target_seg_no"), F.col("b.k").alias("target_k")))
        ranked = checkpoint(ranked.join(taken.select("file_id", "a"), ["file_id", "a"], "left_anti").join(taken.select("file_id", "b"), ["file_id", "b"], "left_anti"))
    return out


def align_blocks(parts: DataFrame, known: DataFrame, single: bool = False) -> DataFrame:
    """The links of all blocks by cells, or by sentences (``single``)."""
    schema, align_one = "file_id long, source_seg_no int, target_seg_no int, sentences int", align_cells
    if single:
        schema, align_one = "file_id long, source_seg_no int, source_k int, target_seg_no int, target_k int", align_sentences
    columns = [x.split()[0] for x in schema.split(", ")]
    if known.count() <= BROADCAST_WORDS:
        table = known.select("word", "other", "weight").toArrow()
        lexicon = as_lexicon(*(table[c].to_pylist() for c in ("word", "other", "weight")))

        def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(key[0], *x) for x in align_one(cells, lexicon)], columns=columns)

        return parts.groupBy("file_id", "block").applyInPandas(run, schema)

    def run_with(key: tuple, cells: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if cells.empty:
            return pd.DataFrame([], columns=columns)
        rows = align_one(cells, as_lexicon(own["word"], own["other"], own["weight"]))
        return pd.DataFrame([(key[0], *x) for x in rows], columns=columns)

    own = _words(parts, ["file_id", "block"]).join(known, "word")
    return parts.groupBy("file_id", "block").cogroup(own.groupBy("file_id", "block")).applyInPandas(run_with, schema)


def found(units: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    return links(units, files, lexicon).select("file_id", "source_seg_no", "target_seg_no").distinct()
