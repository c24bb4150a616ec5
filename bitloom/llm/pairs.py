"""Problem 4: broken prompt and response pairs (source and target of a translation unit).

Ordered rules look for emptiness, refusal phrases in four languages, copied text, the language
of the answer, abrupt endings, missing sentences, unclosed delimiters and copied beginnings. ``defects`` gives every
defect that a pair shows, ``found`` the first in the order of DEFECTS that makes it a broken pair.
Units with template residue (problem 1) are left out by that problem's own result.

The language of a text is told by word counts per language over all source cells; all else looks at every row alone.

Defined results: a null or blank target is ``empty``; a null source can't be copied, refused or
cut, so only emptiness, refusal and language are looked at; language tags are compared by their
first two letters in any spelling, and a null or unknown tag has no wrong language; repeated rows each count.
"""

from __future__ import annotations

import functools
import itertools
import math
import os.path
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import residue
from bitloom.llm.refusals import refuses
from bitloom.runtime import checkpoint, semi_join_ids, spread

#: Every defect, in order; a pair's first one that isn't among DETAILS is its defect.
DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated", "unclosed_delimiter", "copied_prefix")
#: What says how a truncated text breaks off, and what a sound text may show as well.
DETAILS = ("unclosed_delimiter", "copied_prefix")
#: A copied beginning is at least this share of the source, with so many words (or Chinese characters).
PREFIX_SHARE, PREFIX_WORDS, PREFIX_HAN = 0.5, 3, 8
#: Different words that a task counts before it hands them on.
WORDS_HELD = 400_000
LANGUAGES = ("en", "zh", "de", "es")
#: How much more likely (natural logarithm) another language must be than the wanted one.
MARGIN = 3.0
#: Share that is added to every word's in every language. Words that make up less of each language (mostly names) hardly tell
#: languages apart; all are counted, but the model is of the others, so it has at most 1 / FLOOR words a language.
FLOOR = 1e-5

# Usual length of the same text in each language, relative to English; a Chinese character counts HAN_WIDTH.
LENGTH = {"en": 1.0, "de": 1.18, "es": 1.18, "zh": 1.0}
HAN_WIDTH = 2.8
#: A finished clause has at least this share of its usual length.
LEAST_SHARE = 0.62
#: From this share of the usual length of the whole sentence on, nothing is missing; with an open end, from FULL_SHARE on.
SOUND_SHARE, FULL_SHARE = 0.95, 0.9

_TOKEN = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+")
#: Code, addresses, slots and identifiers, which stay as they are in a translation.
_KEPT = re.compile(
    r"```.*?```|`[^`]*`|https?://[!-~]+|[!-~]+@[!-~]+|\{\{[^{}]*\}\}|<[^<>]*>|%[sd]"
    r"|[A-Za-z0-9_.-]*\d[A-Za-z0-9_.-]*|[A-Za-z0-9]+[:/_.][A-Za-z0-9]+", re.S
)
#: What may stay over several words; what anything else that stays as it is has.
_SPANNING = re.compile(r"[`{<]")
_KEPT_SIGN = re.compile(r"[\d@%]|[:/_.][A-Za-z0-9/]")
_LOWER_WORD = re.compile(r"\b[^\W\d_A-Z㐀-鿿][^\W\d_㐀-鿿]{2,}")
_ANY = re.compile(r"[^\W_]")
_STOP = re.compile(r"[.!?。！？]+[\"”’»」)\]]*(?=\s|$|[㐀-䶿一-鿿A-Z\"“«„])")
_CLOSED = re.compile(r"[.!?。！？:：][\"'”’»」)\]`*_]*$")
_CUT = re.compile(r"(?:\.\.\.|…|[,，、;；]|\s[-–—])$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…+)[\"”’»」)]*$")
_ASIDE = re.compile(r"\s(?:because|within|except|weil|innerhalb|ausgenommen|porque|en un plazo|salvo)\b")
_PAIRS = (("(", ")"), ("[", "]"), ("«", "»"), ("（", "）"), ("「", "」"))
_HAN = re.compile(r"[㐀-䶿一-鿿]")


def tag(lang: Column) -> Column:
    """A language tag by its first two letters, lower case."""
    return F.substring(F.lower(F.regexp_replace(lang, r"[^A-Za-z]", "")), 1, 2)


def bare(text: str) -> str:
    """The text without what stays as it is in a translation."""
    return _KEPT.sub(" ", text)


class Model:
    """Word counts per language as logarithms of shares."""

    def __init__(self, logs: dict[str, tuple[float, ...]]):
        self.logs = logs
        #: The words that are likeliest in each language.
        self.own = [{w for w, v in logs.items() if v[i] == max(v) > min(v)} for i in range(len(LANGUAGES))]

    def other_language(self, tokens: list[str], wanted: str) -> bool:
        """The tokens are rather of another language than the wanted one."""
        i, distinct = LANGUAGES.index(wanted), set(tokens)
        known = distinct & self.logs.keys()
        mine = len(known & self.own[i])
        if mine >= 0.8 * len(known):
            return False
        if len(known) < 2 or not self.own[i]:
            return False
        found = [self.logs[w] for w in tokens if w in known]
        scores = [sum(x) for x in zip(*found)]
        return max(scores) - scores[i] > MARGIN


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n): how often a word occurs in the cells of a language, in parts, which add up; the empty word stands for all."""
    counts: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}

    def counted() -> pd.DataFrame:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in (("", c.total()), *c.items())]
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    for b in batches:
        for lang, texts in b.groupby("lang")["source"]:
            if lang in counts:
                counts[lang].update(count_words(texts))
        if sum(map(len, counts.values())) >= WORDS_HELD:
            yield counted()
            for c in counts.values():
                c.clear()
    yield counted()


def count_words(texts: Iterable[str]) -> Counter:
    """The words of the bare texts, in lower case. What stands between blanks is counted first, and looked at once for all its places."""
    out: Counter = Counter()
    pieces: Counter = Counter()
    for text in texts:
        if _SPANNING.search(text):
            out.update(_TOKEN.findall(bare(text).lower()))
        else:
            pieces.update(text.split())
    for piece, n in pieces.items():
        for w in _TOKEN.findall((bare(piece) if _KEPT_SIGN.search(piece) else piece).lower()):
            out[w] += n
    return out


def fit_languages(units: DataFrame) -> Model:
    """token -> logarithm of its share among the tokens of each of LANGUAGES, counted over all source cells."""
    cells = units.select(tag(F.col("source_lang")).alias("lang"), "source").where(F.col("source").isNotNull() & F.col("lang").isin(*LANGUAGES))
    counts = checkpoint(
        spread(cells).mapInPandas(_word_counts, "lang string, word string, n long")
        .groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(x) for x in LANGUAGES])
    )
    every = counts.where(F.col("word") == "").first()
    totals = {x: every[x] if every else 0 for x in LANGUAGES}
    usual = [(F.col(x) > 1) & (F.col(x) > FLOOR * totals[x]) for x in LANGUAGES]
    rows = counts.where((F.col("word") != "") & functools.reduce(Column.__or__, usual)).toArrow().to_pylist()
    return _model({r["word"]: tuple(r[x] for x in LANGUAGES) for r in rows}, totals)


def language_model(samples: Iterable[tuple[str, str]]) -> Model:
    """The same on one machine."""
    texts: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for lang, text in samples:
        if lang in texts:
            texts[lang].append(text)
    counts = [count_words(texts[lang]) for lang in LANGUAGES]
    totals = {lang: c.total() for lang, c in zip(LANGUAGES, counts)}
    words = {w for lang, c in zip(LANGUAGES, counts) for w, n in c.items() if n > 1 and n > FLOOR * totals[lang]}
    return _model({w: tuple(c[w] for c in counts) for w in words}, totals)


def _model(counts: dict[str, tuple[int, ...]], totals: dict[str, int]) -> Model:
    return Model({w: tuple(math.log(n / (totals[x] or 1) + FLOOR) for x, n in zip(LANGUAGES, ns)) for w, ns in counts.items()})


def _copy_key(text: str) -> str:
    return "".join(text.split()).casefold().rstrip(".。")


def sentences(text: str) -> list[str]:
    return [x for x in _STOP.split(text) if _ANY.search(x)]


def width(text: str) -> float:
    """Length by which texts in different scripts can be compared."""
    return len(text) if text.isascii() else len(text) + (HAN_WIDTH - 1) * len(_HAN.findall(text))


def truncated(source: str, target: str, source_lang: str, target_lang: str, model: Model) -> bool:
    return _breaks_off(source.rstrip(), target.rstrip(), source_lang, target_lang, model) and bool(
        _TOKEN.search(bare(source))
    )


def unclosed(source: str, target: str) -> bool:
    """The target opens a bracket or a code fence that it doesn't close, as the source does."""
    if "`" in target and target.count("```") % 2 and not source.count("```") % 2:
        return True
    return any(a in target and target.count(a) > target.count(b) and source.count(a) <= source.count(b) for a, b in _PAIRS)


def wordy(text: str, model: Model) -> bool:
    """The text has words that a translation would change, by their shape; capitalised ones alone must be known as words."""
    rest = bare(text)
    if _LOWER_WORD.search(rest) or _HAN.search(rest):
        return True
    return any(len(w) > 2 and w in model.logs for w in _TOKEN.findall(rest.lower()))


def _first(text: str) -> str:
    return text.lstrip()[:1].casefold()[:1]


def copied_prefix(source: str, target: str) -> bool:
    """The target begins with the source, or the greater part of it, and goes on otherwise."""
    if _first(source) != _first(target):
        return False
    s, t = _copy_key(source), _copy_key(target)
    n = len(os.path.commonprefix([s, t]))
    if s == t or n < PREFIX_SHARE * len(s):
        return False
    # where in the target the copied characters end
    at = next((i for i, k in enumerate(itertools.accumulate(not c.isspace() for c in target), 1) if k >= n), len(target))
    copied = bare(target[:at])
    return len(_LOWER_WORD.findall(copied)) >= PREFIX_WORDS or len(_HAN.findall(copied)) >= PREFIX_HAN


def _breaks_off(s: str, t: str, source_lang: str, target_lang: str, model: Model) -> bool:
    s_end, t_end = s[-12:], t[-12:]
    trailing = _CUT.search(s_end) or _ELLIPSIS.search(s_end)
    if not trailing and _CUT.search(t_end):
        return True
    open_end = not _CLOSED.search(t_end) and not trailing
    if open_end and _CLOSED.search(s_end):
        return True
    if unclosed(s, t):
        return True
    ss, tt = sentences(s), sentences(t)
    if len(tt) < len(ss):
        return True
    if not ss or not tt or source_lang not in LENGTH or target_lang not in LENGTH:
        return False
    # the last sentence may lack its asides, not its main clause
    last, ratio = tt[-1].strip(), LENGTH[target_lang] / LENGTH[source_lang]
    whole = width(ss[-1].strip()) * ratio
    have = width(last)
    if have >= SOUND_SHARE * whole:
        return False
    main = width(_main_clause(ss[-1].strip())) * ratio
    if have < LEAST_SHARE * main:
        return True
    if open_end and have < FULL_SHARE * whole:
        # an open end can't be told from a full clause by a mark; then its last word must be a word
        words = _TOKEN.findall(last)
        if words and words[-1].islower() and len(words[-1]) > 1 and last.endswith(words[-1]):
            return words[-1] not in model.logs
    return False


def _main_clause(sentence: str) -> str:
    """The sentence without a trailing aside; an opening clause before a comma stays."""
    cut = max(sentence.rfind(x) for x in (", ", "; ", "，", "；"))
    if cut > len(sentence) * 0.45:
        return sentence[:cut]
    m = _ASIDE.search(sentence)
    return sentence[: m.start()] if m and m.start() > len(sentence) * 0.35 else sentence


def examine(source: str | None, target: str | None, source_lang: str | None, target_lang: str | None, model: Model) -> list[str]:
    """Every defect that the pair shows, in the order of DEFECTS. A copy of what stays as it is is sound in any language."""
    if target is None or not _ANY.search(target):
        return ["empty"]
    found = []
    if refuses(source, target):
        found.append("refusal")
    if source and _first(source) == _first(target) and _copy_key(source) == _copy_key(target):
        if not wordy(target, model):
            return found
        found.append("copy")
    elif source:
        if truncated(source, target, source_lang, target_lang, model):
            found.append("truncated")
            if unclosed(source, target):
                found.append("unclosed_delimiter")
        if copied_prefix(source, target):
            found.append("copied_prefix")
    if target_lang in LANGUAGES and model.other_language(_TOKEN.findall(target.lower()), target_lang):
        found.append("wrong_language")
    return sorted(found, key=DEFECTS.index)


def candidates(units: DataFrame, model: Model) -> DataFrame:
    """(unit_key, file_id, defects) of the units with defects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, file, s, t, sl, tl in zip(b["unit_key"], b["file_id"], b["source"], b["target"], b["sl"], b["tl"]):
                if found := examine(s, t, sl, tl, model):
                    rows.append((key, file, found))
            yield pd.DataFrame(rows, columns=["unit_key", "file_id", "defects"])

    wanted = units.select(
        "unit_key", "file_id", "source", "target", tag(F.col("source_lang")).alias("sl"), tag(F.col("target_lang")).alias("tl")
    )
    return spread(wanted).mapInPandas(run, "unit_key long, file_id long, defects array<string>")


def defects(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_key, defects) of the units in paired files; units with template residue aren't looked at."""
    paired = files.where(F.col("layout") == "paired").select("file_id").distinct()
    model = fit_languages(units)
    shown = checkpoint(candidates(semi_join_ids(units, paired, "file_id"), model))
    return shown.join(residue.found(units), "unit_key", "left_anti").select("unit_key", "defects")


def found(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_key, defect): the first defect of each broken pair."""
    broken = F.filter("defects", lambda x: ~x.isin(*DETAILS))
    return defects(units, files).select("unit_key", F.get(broken, F.lit(0)).alias("defect")).where(F.col("defect").isNotNull())
