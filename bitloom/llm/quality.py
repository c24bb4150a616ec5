"""Problem 9: per-document text statistics that tell natural prose from lists, tables and junk.

Statistics are counted in Arrow batches by vectorised functions over arrays of lines and words (measured: counting
with the JVM's regular expressions takes over ten times the CPU time); shares, thresholds and
reasons are column expressions on the counts. There is no shuffle.

Rules with fixed thresholds, as published for large web corpora, each add their name to ``reasons``:

* word count, mean word length, symbols to words, bullet and ellipsis lines, alphabetic words, and stop words,
  as in Rae et al. 2021 (Gopher);
* lines that are kept: running text, which ends in a mark and has enough words, as in Raffel et al. 2020 (C4), with
  common words and few symbols instead of its word lists; a document of which less than half is kept fails;
* lines that end in punctuation, as in Penedo et al. 2024 (FineWeb).

Rules about form decide ``found``; those that also fail short but sound prose (``HINTS``) are only recorded.

Defined results: null and empty texts have zero counts and shares and the reason ``empty``
(and ``not_running_text``); repeated rows are measured each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import WS_CHARS
from bitloom.runtime import spread

#: The list of common words goes to every worker as an Arrow array, so its size is checked: this is some 20 MB.
MAX_COMMON_WORDS = 1_000_000

#: Bytes of text that are measured together.
PART_BYTES = 4_000_000

# Thresholds of the rules.
MIN_PROSE_SHARE = 0.5
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_WORD, MAX_MEAN_WORD = 3.0, 10.0
MAX_SYMBOLS_PER_WORD = 0.1
MAX_BULLET_LINES = 0.9
MAX_ELLIPSIS_LINES = 0.3
MIN_ALPHABETIC_WORDS = 0.8
MIN_COMMON_WORDS = 2
MIN_ENDED_LINES = 0.12
# What makes a line running text.
LINE_WORDS, LINE_WORDS_UNENDED, LINE_HAN, LINE_HAN_UNENDED = 5, 6, 10, 14
ITEM_WORDS, ITEM_HAN = 12, 24
LINE_COMMON, LINE_COMMON_HAN, LINE_SYMBOLS = 0.08, 0.08, 0.12
#: Rules that are recorded but say nothing about form by themselves.
HINTS = ("word_count", "word_length", "symbols", "alphabetic_words", "ended_lines", "ellipsis_lines")

# Patterns of lines and their parts, in the dialect that the SQL of these statistics shares.
NOT_TEXT = r"<ref[^>]*/>|<ref[^>]*>.*?</ref>|\{\{[^{}]*\}\}|</?(?:blockquote|p|i|b|em|strong|small|br)\b[^>]*>"
BULLET = r"^(?:[*#:;•·]|[-–—+]\s|\d{1,3}[.)]\s)"
TABLE = r"^(?:\{\||\||!\s.*!!|.*\t.*\t|.*\|\s.*\s\|)"
OTHER = r"(?i)^(?:=+.*=+$|(?:<[^>]*>\s*)*(?:script|expression|lua|template|parser|cite|syntax)\s+error\b)"
MARK = r"[.!?。！？]"
END = r"[.!?。！？…][\"'”’»)\]]*$"
LETTERS = r"\p{L}+"
NO_LETTERS = r"\P{L}+"
HAN = r"[㐀-䶿一-鿿豈-﫿]"
SYMBOL = r"[^\p{L}\p{N}\s.,;:!?'\"()\[\]，。；：！？、“”‘’«»（）\-–—]"
SIGN = r"#|\.\.\.|…"
_WS = WS_CHARS.replace("\x1c", "").replace("\x1d", "").replace("\x1e", "").replace("\x1f", "")
WORD = f"[^{_WS}]+"
WORD_WITH_LETTER = rf"[^{_WS}]*\p{{L}}[^{_WS}]*"

COUNTS = (
    "n_chars", "n_lines", "n_words", "letters", "alphabetic", "symbols", "signs", "common", "units", "han",
    "line_chars", "running", "bullet", "table", "ended", "ellipsis",
)


def common_words(words: DataFrame) -> pa.Array:
    """The parameter table, lower case; refuses a table that isn't small."""
    rows = words.select(F.lower("word").alias("word")).where(F.col("word").isNotNull()).distinct().limit(MAX_COMMON_WORDS + 1).toArrow()
    if rows.num_rows > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    return rows["word"].combine_chunks().cast(pa.string())


def count(texts: pa.Array, common: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\r\n", "\n"), "\r", "\n"), "\n")
    lines = pc.utf8_trim(pc.list_flatten(split), characters=WS_CHARS)
    doc = pc.list_parent_indices(split).to_numpy()
    whole = pc.greater(pc.utf8_length(lines), 0)
    lines, doc = lines.filter(whole), doc[whole.to_numpy(zero_copy_only=False)]

    def times(pattern: str, of: pa.Array) -> np.ndarray:
        return pc.count_substring_regex(of, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    def has(pattern: str, of: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(of, pattern).to_numpy(zero_copy_only=False).astype(bool)

    def size(of: pa.Array) -> np.ndarray:
        return pc.utf8_length(of).to_numpy(zero_copy_only=False).astype(np.int64)

    def per_document(of: np.ndarray) -> np.ndarray:
        return np.bincount(doc, of, n).astype(np.int64)

    chars = size(lines)
    bare = pc.utf8_lower(pc.replace_substring_regex(lines, NOT_TEXT, ""))
    words = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(bare, NO_LETTERS, " "), characters=" "), " ")
    of_line, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    known = pc.is_in(flat, value_set=common).to_numpy(zero_copy_only=False)
    n_found, hits = (np.bincount(of_line[x], minlength=len(lines)) for x in (full, full & known))
    # words written together with Chinese characters aren't set apart; there the characters are counted
    han = times(HAN, bare)
    single = "".join(w for w in common.to_pylist() if len(w) == 1 and w > "\x7f")
    hits_han = np.zeros(len(lines), np.int64)
    if single and (some := han > 0).any():
        hits_han[some] = times(f"[{single}]", bare.filter(pa.array(some)))
    symbols = times(SYMBOL, lines)
    listed, tabled, mark, ended = has(BULLET, lines), has(TABLE, lines), has(MARK, bare), has(END, lines)
    littered = symbols > chars * LINE_SYMBOLS
    if littered.any():
        rest = bare.filter(pa.array(littered))
        littered[littered] = times(SYMBOL, rest) > size(rest) * LINE_SYMBOLS
    good = np.where(
        han >= LINE_HAN, (mark | (han >= LINE_HAN_UNENDED)) & (hits_han > han * LINE_COMMON_HAN),
        (n_found >= np.where(mark, LINE_WORDS, LINE_WORDS_UNENDED)) & (hits > n_found * LINE_COMMON),
    )
    # a list mark before a whole sentence is a stray mark of running text
    good &= ~tabled & ~has(OTHER, lines) & ~littered & ~(listed & (n_found < ITEM_WORDS) & (han < ITEM_HAN))
    spaces = times(f"[{_WS}]", lines)
    return dict(zip(COUNTS, (
        size(texts), np.bincount(doc, minlength=n), per_document(times(WORD, lines)), per_document(chars - spaces),
        per_document(times(WORD_WITH_LETTER, lines)), per_document(symbols), per_document(times(SIGN, lines)),
        per_document(np.where(han > 0, hits_han, hits)), per_document(np.where(han > 0, han, n_found)), per_document(han),
        per_document(chars), per_document(np.where(good, chars, 0)), per_document(listed), per_document(tabled), per_document(ended),
        per_document(has(r"(?:\.\.\.|…)$", lines)),
    ), strict=True))


def counts(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, COUNTS), one row for each row of ``documents``."""
    common = common_words(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # parts of bounded size, as a batch of long texts takes several times their memory
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole["text"]), 0).to_numpy(zero_copy_only=False)) // PART_BYTES
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for a, z in zip(edges, edges[1:]):
                b = whole.slice(a, z - a)
                done = count(b["text"].cast(pa.string()), common)
                yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(done[c], pa.int64()) for c in COUNTS]], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def statistics(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, counts and shares, prose_share, reasons), one row for each row of ``documents``."""
    c = F.col
    stats = counts(documents, words).select(
        "doc_id", "n_chars", "n_words", "n_lines", c("common").alias("n_common"),
        _share("letters", "n_words").alias("mean_word_length"),
        _share("symbols", "n_chars").alias("symbol_ratio"),
        _share("signs", "n_words").alias("symbols_per_word"),
        _share("ended", "n_lines").alias("ended_lines"),
        _share("bullet", "n_lines").alias("bullet_lines"),
        _share("table", "n_lines").alias("table_lines"),
        _share("ellipsis", "n_lines").alias("ellipsis_lines"),
        _share("alphabetic", "n_words").alias("alphabetic_words"),
        _share("common", "units").alias("common_share"),
        _share("han", "n_chars").alias("han_share"),
        _share("running", "line_chars").alias("prose_share"),
    )
    worded = c("han_share") < 0.2  # word rules hold for scripts that set words apart
    rules = [
        ("empty", c("n_lines") == 0),
        ("word_count", worded & ((c("n_words") < MIN_WORDS) | (c("n_words") > MAX_WORDS))),
        ("word_length", worded & ((c("mean_word_length") < MIN_MEAN_WORD) | (c("mean_word_length") > MAX_MEAN_WORD))),
        ("symbols", worded & (c("symbols_per_word") > MAX_SYMBOLS_PER_WORD)),
        ("bullet_lines", c("bullet_lines") > MAX_BULLET_LINES),
        ("ellipsis_lines", c("ellipsis_lines") > MAX_ELLIPSIS_LINES),
        ("alphabetic_words", worded & (c("alphabetic_words") < MIN_ALPHABETIC_WORDS)),
        ("common_words", c("n_common") < MIN_COMMON_WORDS),
        ("ended_lines", c("ended_lines") <= MIN_ENDED_LINES),
        ("not_running_text", c("prose_share") < MIN_PROSE_SHARE),
    ]
    return stats.withColumn(
        "reasons", F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())
    )


def found(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id) of the documents that fail a rule about form."""
    decisive = F.array_except("reasons", F.array(*[F.lit(x) for x in HINTS]))
    return statistics(documents, words).where(F.size(decisive) > 0).select("doc_id")
