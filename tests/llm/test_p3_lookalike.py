import random
import unicodedata

import pytest

from bitloom.llm import lookalike as L


@pytest.mark.parametrize("text,form", [
    ("Ｗｉｄｅ　１２", "Wide 12"), ("Ѕеrvеr", "Server"), ("Ρumρ".replace("ρ", "p"), "Pump"), ("a​b﻿c­", "abc"), ("a b c", "a b c"),
    ("café", "café"), ("cafе́", "café"), ("e‍́", "é"), ("ﬁne ﬂat", "fine flat"), ("⼩", "小"), ("a‑b‐c－d", "a-b-c-d"), ("", ""),
])
def test_unified(text, form):
    assert L.transducer()(text) == form


@pytest.mark.parametrize("a,b", [("A", "a"), ("e", "é"), ("a b", "a  b"), ("a b", "a\tb"), ("a\nb", "a b"), ("“a”", '"a"'), ("a–b", "a-b"), ("x²", "x2"), ("0", "O"), ("1", "l")])
def test_visible_differences_stay(a, b):
    assert L.transducer()(a) != L.transducer()(b)


def test_rules_are_checked():
    with pytest.raises(L.RuleConflict):
        L.Transducer({"a": "b", "b": "c"})
    rules = {"x": "y"}
    with pytest.raises(L.RuleConflict):
        L.add_rule(rules, "x", "z")
    assert L.Transducer({"б": "b", "б́": "Q"})("б́б") == "Qb"  # longest match


def test_one_pass_is_enough():
    t, rng = L.transducer(), random.Random(4)
    signs = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA0, 0x24F), *range(0x300, 0x340), *range(0x370, 0x460), *range(0x2000, 0x2070), *range(0xFF00, 0xFFEF), *range(0xFB00, 0xFB07), 0x4E00, 0x1F469, 0x1D400)]
    signs = [s for s in signs if unicodedata.category(s) != "Cn"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(8)))
        assert t(t(text)) == t(text), ascii(text)


def brute(rows):
    t, out = L.transducer(), set()
    for k, field in enumerate(("source", "target")):
        for a in rows:
            for b in rows:
                x, y = a[1 + k], b[1 + k]
                if a[0] < b[0] and x is not None and y is not None and x != y and t(x) == t(y):
                    out.add((field, a[0], b[0]))
    return out


def test_pairs_against_brute_force(spark):
    rng, forms = random.Random(8), ["pump", "рump", "pum​p", "ｐump", "Pump", "pump ", "pump ", None, "", "​", "é", "é", "x" * 5000 + "а", "x" * 5000 + "a"]
    rows = [(i, rng.choice(forms), rng.choice(forms[:4])) for i in range(120)]
    df = spark.createDataFrame([(*r, "n", "f") for r in rows], "term_id long, source string, target string, n string, form string")
    got = [tuple(r) for r in L.found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert L.found(df.limit(0)).count() == 0


def test_unify_columns(spark):
    df = spark.createDataFrame([("ａ", None)], "a string, b string")
    assert tuple(L.unify_columns(df, ["a", "b"]).first()) == ("ａ", None, "a", None)


def test_pictures_with_joiners_and_selectors_stay():
    t = L.transducer()
    family, heart = "\U0001f468‍\U0001f469‍\U0001f467", "❤️"
    assert t(family) == family != t("\U0001f468\U0001f469\U0001f467") and t(heart) == heart != t("❤")
    assert t("a‍b️") == "ab" and t("ӏӀꓐ") == "lIB"


def test_class_rows(spark):
    rows = [(1, "ab", "x"), (2, "a​b", None), (3, "ab", "x"), (4, "аb", "y"), (5, "zz", "ｘ"), (6, "zz", "")]
    df = spark.createDataFrame(rows, "term_id long, source string, target string")
    got = sorted(map(tuple, L.members(df).collect()))
    assert got == [("source", 1, 1, 2), ("source", 2, 1, 3), ("source", 3, 1, 2), ("source", 4, 1, 3), ("target", 1, 1, 1), ("target", 3, 1, 1), ("target", 5, 1, 2)]
    pairs = L.found(df)
    assert sum(r[3] for r in got) == 2 * pairs.count()
    assert L.members(df.limit(0)).count() == 0
