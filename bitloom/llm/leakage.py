"""Problem 7: passages of evaluation items inside training documents.

One Aho-Corasick automaton holds every shortest leaking passage of every item (12 words
in a row, or 24 letters or digits in a row for items in Chinese) in normalised form: case
folded, only letters and digits. Each document is normalised the same way, with a map from
normalised offsets to original ones (also where the original holds letters and accents apart), and scanned once. A hit of a word passage counts
only if words of the document begin and end where those of the item do.

The automaton grows with the items alone. Items are taken in blocks of at most
``BLOCK_CHARS`` characters, one automaton and one pass for each block, so what is sent to a task is
bounded whatever the number of items (160 items are one block). The driver passes a block on before it reads the next;
the values that it passed on lie in files of the session.

Defined results: null or empty documents and items contain nothing; items shorter
than a passage can't leak; a null ``item_lang`` counts as a language with words; equal
items or passages each report their hits; documents of any length are scanned whole.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.runtime import spread

WORDS = 12
CHARACTERS = 24
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


#: A character with the combining marks (or Hangul vowels and finals) that may be composed with it.
_CLUSTER = re.compile(r"[\x00-\x7f]+(?![^\x00-\x7f])|(?s:.)[\u0300-\u036f\u0483-\u0487\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u093c\u094d\u09be\u09d7\u0b3e\u0b56\u0b57\u0bbe\u0bd7\u0cc2\u0cd5\u0cd6\u0d3e\u0d57\u0dcf\u0ddf\u102e\u1161-\u1175\u11a8-\u11c2\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]*")


@dataclass
class Normalised:
    text: str
    starts: list[int]  # normalised offset of each word
    words: list[tuple[int, int, int]]  # of each word: normalised start, original start and end
    source: list[tuple[int, int]] | None = None  # where the original isn't composed: (composed, original) offset of each cluster

    def original(self, at: int, end: bool) -> int:
        """The original offset of a composed one; an end comes after all marks."""
        if self.source is None:
            return at
        i = bisect.bisect_left(self.source, (at, -1)) if end else bisect.bisect_right(self.source, (at, 1 << 60)) - 1
        return self.source[min(i, len(self.source) - 1)][1]


def composed(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The text in composed form, with the offsets of its clusters on both sides; None where it is composed already."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, source, n = [], [], 0
    for m in _CLUSTER.finditer(text):
        part = unicodedata.normalize("NFC", m.group())
        if len(part) > 1 and part == m.group():
            source += [(n + k, m.start() + k) for k in range(len(part))]
        else:
            source.append((n, m.start()))
        out.append(part)
        n += len(part)
    return "".join(out), [*source, (n, len(text))]


def normalise(text: str) -> Normalised:
    """Letters and digits alone, composed and case folded, with the offsets of the words in the original."""
    text, source = composed(text)
    out, words, n = [], [], 0
    for m in _WORD.finditer(text):
        w = m.group().casefold()
        words.append((n, m.start(), m.end()))
        out.append(w)
        n += len(w)
    return Normalised("".join(out), [w[0] for w in words], words, source)


def passages(lang: str | None, text: str | None) -> Iterator[tuple[str, tuple[int, ...] | None]]:
    """The shortest leaking passages of an item, with the offsets of their words (None: word ends don't count)."""
    if not text:
        return
    norm = normalise(text)
    if (lang or "").strip().lower().startswith("zh"):
        for i in range(len(norm.text) - CHARACTERS + 1):
            yield norm.text[i : i + CHARACTERS], None
        return
    ends = [*norm.starts[1:], len(norm.text)]
    for i in range(len(norm.starts) - WORDS + 1):
        a = norm.starts[i]
        yield norm.text[a : ends[i + WORDS - 1]], tuple(e - a for e in ends[i : i + WORDS])


def automaton(items: list[tuple[int, str | None, str | None]]) -> ahocorasick.Automaton:
    """Passage -> [(item id, word ends or None)]."""
    found: dict[str, dict] = {}
    for item_id, lang, text in items:
        for passage, ends in passages(lang, text):
            found.setdefault(passage, {})[(item_id, ends)] = None
    auto = ahocorasick.Automaton()
    for passage, hits in found.items():
        auto.add_word(passage, (len(passage), list(hits)))
    if found:
        auto.make_automaton()
    return auto


def scan(auto: ahocorasick.Automaton, text: str | None) -> dict[int, tuple[int, int, int]]:
    """Item id -> (hits, start and end of the first hit in the original text)."""
    if not text or not len(auto):
        return {}
    norm = normalise(text)
    found: dict[int, tuple[int, int, int]] = {}
    starts: set[int] | None = None
    for last, (length, hits) in auto.iter(norm.text):
        a = last + 1 - length
        for item_id, ends in hits:
            if ends is not None:
                if starts is None:
                    starts = {*norm.starts, len(norm.text)}
                if a not in starts or any(a + e not in starts for e in ends):
                    continue
                # no word of the document may begin inside one of the item's words
                if sum(1 for s in range(a, a + length) if s in starts) != len(ends):
                    continue
            if item_id in found:
                n, b, e = found[item_id]
                found[item_id] = (n + 1, b, e)
            else:
                found[item_id] = (1, _origin(norm, a, False), _origin(norm, last, True))
    return found


def _origin(norm: Normalised, at: int, end: bool) -> int:
    """The original offset of a normalised one; exact at word ends, inside a word by distance from its start."""
    i = bisect.bisect_right(norm.starts, at) - 1
    n, start, stop = norm.words[i]
    size = (norm.starts[i + 1] if i + 1 < len(norm.starts) else len(norm.text)) - n
    if end:
        return norm.original(stop if at == n + size - 1 else min(stop, start + at - n + 1), True)
    return norm.original(start + min(at - n, stop - start), False)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None, str | None]]]:
    """The items in blocks of bounded size, one after the other: no more than a block is held."""
    block, size = [], 0
    for r in items.select("item_id", "item_lang", "item_text").toLocalIterator():
        n = len(r.item_text or "") * WORDS
        if block and size + n > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.item_lang, r.item_text))
        size += n
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, hits, first_start, first_end), one row for each document and item that leaked into it."""
    spark, schema = documents.sparkSession, "doc_id long, item_id long, hits int, first_start int, first_end int"
    texts = documents.select("doc_id", "text").where(F.length("text") >= F.lit(min(WORDS, CHARACTERS)))
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            auto = automaton(held.value)
            for b in batches:
                rows = [
                    (d, item, *hit) for d, t in zip(b["doc_id"], b["text"]) for item, hit in scan(auto, t).items()
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "hits", "first_start", "first_end"])

        out = out.unionByName(spread(texts).mapInPandas(run, schema))
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def by_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each item that leaked: in how many documents, and with how many passages."""
    return leaks(documents, items).groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("documents"), F.sum("hits").alias("hits")
    )
