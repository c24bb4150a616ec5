"""Problem 3: texts that look the same but are built of different characters.

A transducer over grapheme clusters is compiled once from rules: width forms and
ligatures (from the Unicode character database), spaces that look like a space,
characters that can't be seen, hyphens that look like the ASCII hyphen, look-alike
letters, and base letter plus accent. The rules are checked for conflicts when compiled:
no input may have two outputs, and every output must map to itself.

Letter case, accents, space, tab and line breaks, and the choice of punctuation marks are
visible and stay as they are.

Defined results: null stays null, an empty text stays empty; texts of any length are
read whole; repeated rows give one pair for each two rows whose strings differ.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.runtime import checkpoint, hot_keys, salted_join

# Letters that look like a Latin letter, per script, and the Latin letters they look like.
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТУХҮӀѴҺԌԚԜ", "ABESIJKMHOPCTYXYIVhGQW"),
    ("аеѕіјорсухүѵӏһԁԛԝԍ", "aesijopcyxyvlhdqwg"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("ονϲϳ", "ovcj"),
    ("ɑɡ", "ag"),
    ("օոսհցզԼՕՏՍ", "onuhgqLOSU"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
)
# Spaces that look like a space; characters that can't be seen; hyphens that look like "-".
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
UNSEEN = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
)
HYPHENS = "\u2010\u2011"
#: Decomposition kinds of the character database under which two characters look the same.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Blocks whose compatibility characters (ligatures, radicals, presentation forms) look like their decomposition.
SAME_LOOK_BLOCKS = ((0xFB00, 0xFB06), (0x2E80, 0x2FD5), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x2160, 0x217F), (0x0132, 0x0133), (0x01C7, 0x01CC))

#: Combining marks and variation selectors, as a character class.
_MARKS = "\\u0300-\\u036f\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\ufe00-\\ufe0f\\ufe20-\\ufe2f" + UNSEEN
#: Pictographs that a joiner or a variation selector turns into another picture: they look different with and without.
_PICTURE = "[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff]"
_PICTURES = f"{_PICTURE}[\ufe0e\ufe0f\u20e3\U0001f3fb-\U0001f3ff]+(?:\u200d{_PICTURE}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*)*|{_PICTURE}(?:\u200d{_PICTURE}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*)+"
#: A grapheme cluster that isn't a lone ASCII character.
_CLUSTER = re.compile(f"(?P<picture>{_PICTURES})|(?:[^\\x00-\\x7f]|[\\x00-\\x7f](?=[{_MARKS}]))[{_MARKS}]*")


class RuleConflict(ValueError):
    pass


class Transducer:
    """Longest-match rewriting of grapheme clusters, in one pass over the text."""

    def __init__(self, rules: dict[str, str]):
        self.trie: dict = {}
        for key, out in rules.items():
            node = self.trie
            for ch in key:
                node = node.setdefault(ch, {})
            node[""] = out
        self.memo: dict[str, str] = {}
        for key, out in rules.items():
            if self.cluster(out) != out:
                raise RuleConflict(f"{key!r} gives {out!r}, which is rewritten to {self.cluster(out)!r}")

    def cluster(self, text: str) -> str:
        """One cluster: split into base and marks, rewritten by longest match, composed again."""
        parts, i, out = unicodedata.normalize("NFD", text), 0, []
        while i < len(parts):
            node, best, j = self.trie, None, i
            while j < len(parts) and (node := node.get(parts[j])) is not None:
                j += 1
                if "" in node:
                    best = (j, node[""])
            if best:
                i = best[0]
                out.append(best[1])
            else:
                out.append(parts[i])
                i += 1
        return unicodedata.normalize("NFC", "".join(out))

    def _memo(self, m: re.Match) -> str:
        key = m.group()
        if m.lastgroup:
            return key
        out = self.memo.get(key)
        if out is None:
            out = self.cluster(key)
            if len(self.memo) < 65536:
                self.memo[key] = out
        return out

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        done = _CLUSTER.sub(self._memo, text)
        return done if done.isascii() else unicodedata.normalize("NFC", done)


def add_rule(rules: dict[str, str], key: str, out: str) -> None:
    if rules.setdefault(key, out) != out:
        raise RuleConflict(f"{key!r} gives both {rules[key]!r} and {out!r}")


@functools.cache
def transducer() -> Transducer:
    first: dict[str, str] = {}
    for letters, latin in LOOK_ALIKES:
        for a, b in zip(letters, latin, strict=True):
            add_rule(first, a, b)
    for a in SPACES:
        add_rule(first, a, " ")
    for a in UNSEEN:
        add_rule(first, a, "")
    for a in range(0xFE00, 0xFE10):  # variation selectors
        add_rule(first, chr(a), "")
    for a in HYPHENS:
        add_rule(first, a, "-")
    rules = dict(first)
    for cp in (*range(0xA0, 0x3400), *range(0xA700, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        ch = chr(cp)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        same = kind in SAME_LOOK or kind.startswith("<") and any(a <= cp <= b for a, b in SAME_LOOK_BLOCKS)
        if same and rest and ch not in first:
            out = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
            add_rule(rules, ch, unicodedata.normalize("NFC", "".join(first.get(x, x) for x in out)))
    return Transducer(rules)


def _unify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    t = transducer()
    for texts in batches:
        yield texts.map(lambda s: None if s is None else t(s))


def unify(text: Column) -> Column:
    """The one consistent form of a text."""
    return F.pandas_udf(_unify, "string")(text)


def unify_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_unified`` for each column. Existing columns of that name are replaced."""
    return df.withColumns({f"{c}_unified": unify(F.col(c)) for c in columns})


def classes(rows: DataFrame) -> DataFrame:
    """Distinct (field, text) with row count ``n``, smallest id and ``form``, for the forms that two or more texts share."""
    texts = rows.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n"), F.min("term_id").alias("low_id")).withColumn("form", unify(F.col("text")))
    shared = texts.groupBy("field", "form").agg(F.count(F.lit(1)).alias("_t"), F.sum("n").alias("n_class")).where(
        F.col("_t") > 1
    )
    return texts.join(shared.drop("_t"), ["field", "form"])


def members(terminology: DataFrame) -> DataFrame:
    """(field, term_id, class_id, links): each row whose text looks like another text, with the smallest term_id of its class and
    the number of rows of the class whose texts differ from its own."""
    rows = _rows(terminology)
    cls = checkpoint(classes(rows))
    first = cls.groupBy("field", "form").agg(F.min("low_id").alias("class_id"), F.count(F.lit(1)).alias("_texts"))
    total = 2 * terminology.count()
    varied = hot_keys(first, ["field", "form"], "_texts", total)
    known = salted_join(cls, first.drop("_texts"), ["field", "form"], "text", varied).select(
        "field", "text", "class_id", (F.col("n_class") - F.col("n")).alias("links")
    )
    hot = hot_keys(cls, ["field", "text"], "n", total)
    return salted_join(rows, known, ["field", "text"], "term_id", hot).select("field", "term_id", "class_id", "links")


def _rows(terminology: DataFrame) -> DataFrame:
    return terminology.select(
        F.col("term_id"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("source", "target")
        ])).alias("x"),
    ).select("x.field", "term_id", "x.text").where(F.col("text").isNotNull())


def found(terminology: DataFrame) -> DataFrame:
    """(field, term_id_a, term_id_b): all pairs of rows whose texts look the same and differ.

    Different texts of a class are paired first, each two once; only then are their rows
    brought in. So the work is in proportion to the pairs that come out, however many
    rows share one text, and rows of a hot text are salted.
    """
    rows = _rows(terminology)
    cls = checkpoint(classes(rows))
    total = 2 * terminology.count()
    hot = hot_keys(cls, ["field", "text"], "n", total)
    texts = cls.select("field", "text", "form")
    other = texts.select("field", "form", F.col("text").alias("text_b"))
    varied = hot_keys(cls.groupBy("field", "form").agg(F.count(F.lit(1)).alias("n")), ["field", "form"], "n", total)
    pairs = salted_join(texts, other, ["field", "form"], "text", varied).where(F.col("text") < F.col("text_b")).drop("form")
    first = salted_join(rows, pairs, ["field", "text"], "term_id", hot).select(
        "field", F.col("term_id").alias("a"), F.col("text_b").alias("text")
    )
    both = salted_join(rows, first, ["field", "text"], "term_id", hot)
    return both.select(
        "field", F.least("a", "term_id").alias("term_id_a"), F.greatest("a", "term_id").alias("term_id_b")
    )
