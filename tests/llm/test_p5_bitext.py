import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitloom.llm import bitext as B

NOUNS = ["pump", "valve", "loom", "tower", "gear", "lamp", "song", "map", "ferry", "bridge", "canal", "mill"]
PAIRS = {n: n[::-1] + "en" for n in NOUNS}


def document(rng, n):
    source = [f"The {rng.choice(NOUNS)} of V{rng.randrange(10**6)} takes {rng.randrange(100, 999)} {rng.choice(NOUNS)} items." for _ in range(n)]
    target = [" ".join(PAIRS.get(w.strip("."), w) for w in s.replace("The", "Das").replace("takes", "nimmt").split()) + ("" if s.endswith("..") else "") for s in source]
    return source, [t.rstrip(".") + "." for t in target]


LEXICON = B.associations([(s, t) for s, t in zip(*document(random.Random(0), 400))], [(i, lang, w) for i, (a, b) in enumerate(PAIRS.items()) for lang, w in (("en", a), ("de", b))])


def cells(source, target):
    n = max(len(source), len(target))
    return [(i + 1, source[i] if i < len(source) else None, target[i] if i < len(target) else "") for i in range(n)]


def frame(spark, files):
    rows = [(f, s, f * 10_000 + s, a, b, "en-US", "de-DE", 1, "x") for f, cs in files.items() for s, a, b in cs]
    return spark.createDataFrame(rows, "file_id long, seg_no int, unit_key long, source string, target string, source_lang string, target_lang string, block int, own string")


def run(spark, files, raw=None):
    layouts = spark.createDataFrame([(f, "raw_import") for f in (files if raw is None else raw)] or [(0, "paired")], "file_id long, layout string")
    lexicon = spark.createDataFrame([(i, lang, w) for i, (a, b) in enumerate(PAIRS.items()) for lang, w in (("en", a), ("de", b))], "concept_id int, lang string, word string")
    return {tuple(r) for r in B.found(frame(spark, files), layouts, lexicon).collect()}


def test_omissions_merges_and_swaps(spark):
    rng = random.Random(1)
    s, t = document(rng, 14)
    swapped = t[:3] + [t[4], t[3]] + t[5:]
    omitted = t[:6] + t[7:]
    merged = t[:2] + [t[2] + " " + t[3]] + t[4:]
    inserted = t[:5] + document(rng, 1)[1] + t[5:]
    got = run(spark, {1: cells(s, t), 2: cells(s, swapped), 3: cells(s, omitted), 4: cells(s, merged), 5: cells(s, inserted), 6: cells(s, []), 7: cells([], t)})
    same = [(i, i) for i in range(1, 15)]
    want = {(1, a, b) for a, b in same} | {(2, a, {4: 5, 5: 4}.get(a, a)) for a, _ in same}
    want |= {(3, a, a - (a > 7)) for a, _ in same if a != 7} | {(4, a, a - (a > 3)) for a, _ in same} | {(5, a, a + (a > 5)) for a, _ in same}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert not {g for g in got if g[0] in (6, 7)}


def test_long_documents_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 40)
    monkeypatch.setattr(B, "HALO", 12)
    rng = random.Random(2)
    s, t = document(rng, 300)
    t = [x for i, x in enumerate(t) if i % 10]  # a tenth is missing, so the drift grows to thirty
    place = {x: i + 1 for i, x in enumerate(t)}
    full = document(random.Random(2), 300)[1]
    want = {(1, i + 1, place[x]) for i, x in enumerate(full) if x in place}
    got = run(spark, {1: cells(s, t)})
    assert len(got & want) >= 0.93 * len(want) and len(got - want) <= 0.05 * len(want)


def test_edges(spark):
    s, t = document(random.Random(3), 5)
    rows = cells(s, t) + [(6, None, None), (7, " ", "…"), (2, "The other text of V999999 comes later here.", t[1])]
    df = frame(spark, {1: rows, 2: cells(s, t)}).withColumn("unit_key", F.monotonically_increasing_id())
    files = spark.createDataFrame([(1, "raw_import"), (1, "raw_import"), (2, "paired"), (3, None)], "file_id long, layout string")
    lexicon = spark.createDataFrame([(1, "en", "pump"), (1, "de", None)], "concept_id int, lang string, word string")
    got = {tuple(r) for r in B.found(df, files, lexicon).collect()}
    assert {(1, i, i) for i in range(1, 6)} >= got and len(got) >= 4
    for a, b, c in ((df.limit(0), files, lexicon), (df, files.limit(0), lexicon)):
        assert B.found(a, b, c).count() == 0
    assert B.found(df, files, lexicon.limit(0)).count() >= 4


def test_very_long_cell():
    text = "a b c. " * 3000
    block = pd.DataFrame([(1, True, text, None, "en", "de"), (1, False, None, "x y z.", "en", "de")], columns=["seg_no", "own", "source", "target", "sl", "tl"])
    assert {x[:2] for x in B.align_cells(block, {})} <= {(1, 1)}  # lengths alone


def paired_units(spark, rows):
    return spark.createDataFrame([(1, i, i, s, t, sl, tl) for i, (s, t, sl, tl) in enumerate(rows)], "file_id long, seg_no int, unit_key long, source string, target string, source_lang string, target_lang string")


def test_translations_are_counted_over_all_rows_and_by_pair_of_languages(spark, monkeypatch):
    for name in ("MET_AT_ONCE", "MET_HELD", "BUCKETS"):  # several parts, and words that share a bucket
        monkeypatch.setattr(B, name, 500)
    # a rare pair of languages among many rows of another one, in either direction, and rows of no paired file
    many = [(s, t, "en-US", "de") for s, t in zip(*document(random.Random(4), 14_000))]
    rare = [(f"The pump w{'abcdefgh'[i % 8]} works.", f"La bomba v{'abcdefgh'[i % 8]} marcha.", "EN", "es_ES") for i in range(20)]
    rare += [(t, s, tl, sl) for s, t, sl, tl in rare[:20]]
    units = paired_units(spark, many + rare + [(None, "x", "en", "de")])
    other = paired_units(spark, [("alpha", "beta", "en", "de")] * 9).withColumn("file_id", F.lit(2).cast("long"))
    files = spark.createDataFrame([(1, "paired"), (2, "raw_import")], "file_id long, layout string")
    entries = spark.createDataFrame([(1, "en", "gear"), (1, "zh", "齿轮")], "concept_id int, lang string, word string")
    got = {(r.word, r.other): r.weight for r in B.translations(units.unionByName(other), files, entries).collect()}
    want = {}
    for rows in ([(s, t) for s, t, *_ in many], [(s, t) if sl == "EN" else (t, s) for s, t, sl, _ in rare]):
        for a, ys in B.associations(rows).items():
            for b, weight in ys.items():
                want[a, b] = max(weight, want.get((a, b), 0))
    want |= {("gear", "齿轮"): 0.9, ("齿轮", "gear"): 0.9}
    assert got == pytest.approx(want) and got["wa", "va"] == pytest.approx(0.85)


def test_translations_joined_to_blocks_say_the_same(spark, monkeypatch):
    s, t = document(random.Random(5), 60)
    monkeypatch.setattr(B, "BLOCK", 25)
    handed = run(spark, {1: cells(s, t), 2: cells(s, t[3:])})
    monkeypatch.setattr(B, "BROADCAST_WORDS", 0)
    assert run(spark, {1: cells(s, t), 2: cells(s, t[3:])}) == handed and len(handed) > 100


def test_long_documents_out_of_reach_of_a_window(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 40)
    monkeypatch.setattr(B, "HALO", 12)
    monkeypatch.setattr(B, "WIDEST", 20)
    s, t = document(random.Random(6), 200)
    moved = t[:20] + t[60:180] + t[20:60] + t[180:]  # forty cells go 120 places further
    place = {x: i + 1 for i, x in enumerate(moved)}
    # a drift of sixty, told by numbers in the first half alone
    later = [x if i < 100 else " ".join(w for w in x.split() if not any(c.isdigit() for c in w)) for i, x in enumerate(s)]
    shifted = document(random.Random(7), 60)[1] + t
    got = run(spark, {1: cells(s, moved), 2: cells(later, shifted)})
    want = {(1, i + 1, place[x]) for i, x in enumerate(t)}
    assert len(got & want) >= 0.97 * len(want) and len({g for g in got if g[0] == 1} - want) <= 0.03 * len(want)
    assert len(got & {(2, i + 1, i + 61) for i in range(100)}) >= 93


def test_paths_far_from_the_diagonal():
    s, t = document(random.Random(8), 30)
    target = t[14:20] + [t[20] + " " + t[21]] + t[22:] + document(random.Random(9), 15)[1]
    got = {(a, b) for a, b, _ in B.align(s, target, 1.0, LEXICON)}
    want = {(i, i - 14 - (i > 20)) for i in range(14, 30)}
    assert got >= want


def test_lengths_decide_where_no_word_is_known():
    rng = random.Random(10)

    def words(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."

    sizes = [rng.randrange(4, 40) for _ in range(30)]
    source = [words("abcdefg", n) for n in sizes]
    target = ["h" * (len(x) // 2) + " " + "k" * (len(x) - len(x) // 2 - 2) + "." for x in source]
    full = [(i, i) for i in range(30)]
    assert sorted((a, b) for a, b, _ in B.align(source, target, 1.0, {})) == full
    # an omission and a merge are told by lengths
    short = target[:9] + target[10:19] + [target[19] + " " + target[20]] + target[21:]
    got = {(a, b) for a, b, _ in B.align(source, short, 1.0, {})}
    want = {(i, i) for i in range(9)} | {(i, i - 1) for i in range(10, 20)} | {(i, i - 2) for i in range(20, 30)}
    assert len(got & want) >= 26 and len(got - want) <= 3


def test_blocks_against_the_whole(spark):
    """A document of over two blocks of the real size, with omissions, merges and swaps, against its alignment in one piece."""
    rng = random.Random(11)
    s, t = document(rng, 700)
    out = []
    for i, x in enumerate(t):
        if i % 23 == 5:
            continue
        if i % 31 == 7 and out:
            out[-1] += " " + x
        else:
            out.append(x)
    for i in range(50, len(out) - 1, 97):
        out[i], out[i + 1] = out[i + 1], out[i]
    cell = pd.DataFrame([(k + 1, True, s[k] if k < len(s) else None, None, "en", "de") for k in range(700)]
                        + [(k + 1, False, None, x, "en", "de") for k, x in enumerate(out)], columns=["seg_no", "own", "source", "target", "sl", "tl"])
    whole = {(a, b) for a, b, _ in B.align_cells(cell, LEXICON)}
    got = {(a, b) for _, a, b in run(spark, {1: cells(s, out)})}
    assert len(got & whole) >= 0.98 * len(whole) and len(got - whole) <= 0.02 * len(whole), (len(got), len(whole), len(got & whole))


def test_counts_are_merged_by_key():
    import collections

    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 400):
        a, b = (np.unique(rng.integers(0, 500, n), return_counts=True) for n in (size, 300))
        want = collections.Counter(dict(zip(*map(np.ndarray.tolist, a)))) + collections.Counter(dict(zip(*map(np.ndarray.tolist, b))))
        for x, y in ((a, b), (b, a)):
            keys, n = B.merged_counts(*x, *y)
            assert list(zip(keys.tolist(), n.tolist())) == sorted(want.items())


@pytest.mark.parametrize("text", ["Pump AB-12, ab-1b 1.2,3. x_y-4 _a-5 A-B-7z9", "İx-9 Straße ſ-3 中a中-3文 字", "在启动Vela-9之前 9.5", "", "\u212a-2 K-2"])
def test_tokens_in_ascii_are_those_of_any_text(text):
    tail = "" if not text.isascii() else "é"
    assert B.tokens(text) == B.tokens(f"{text} {tail}")[: len(B.tokens(text))] and len(B.tokens(f"{text} {tail}")) == len(B.tokens(text)) + len(tail)
