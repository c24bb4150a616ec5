import random
import unicodedata
from collections import Counter

from bitloom import runtime
from bitloom.llm import formats as D

TERM = "term_id long, source_lang string, target_lang string, source string, target string, n long, first_id long"
GLOSSARY = "entry_id long, direction string, term string, translation string"


def plain(text):
    return None if text is None else "".join(c for c in text.lower() if not (unicodedata.category(c)[0] in "PZ" or c in "\t\n\r\x0b\x0c$+<=>^`|~"))


def groups(rows):
    out = {}
    for i, sl, tl, s, t in rows:
        k = tuple(sorted([(plain(sl) is not None, plain(sl) or "", plain(s) is not None, plain(s) or ""), (plain(tl) is not None, plain(tl) or "", plain(t) is not None, plain(t) or "")]))
        out.setdefault(k, []).append(i)
    return [sorted(g) for g in out.values()]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], TERM)


def test_against_plain_code(spark):
    rng = random.Random(6)
    forms = ["Fine pump", "FINE  pump", "fine-pump.", "`fine_pump`", "«Fine\tpump»", "fine pumpe", "Fíne pump", "fine　pump", "", " .", None, "pumpe; fein", "€5", "$5", "5"]
    rows = [(i, rng.choice(["en-US", "en_us"]), rng.choice(["de", "en-US"]), rng.choice(forms), rng.choice(forms)) for i in range(300)]
    want = {("terminology", g[0], x) for g in groups(rows) for x in g[1:]}
    empty = spark.createDataFrame([], GLOSSARY)
    got = [tuple(r) for r in D.found(table(spark, rows), empty).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    records = {r.first_id: r.copies for r in D.records(table(spark, rows), empty).collect()}
    assert records == {g[0]: len(g) for g in groups(rows)} and sum(records.values()) == 300


def test_glossary(spark):
    rows = [(1, "en->de", "A b", "x"), (2, "en->de", "a-B", "x"), (3, "en->de", "ab", "X"), (4, "de->en", "ab", "x"), (5, "en->de", "ab!", "x"), (6, None, "ab", "x"), (7, None, "AB", "x")]
    got = D.found(table(spark, []), spark.createDataFrame(rows, GLOSSARY))
    assert sorted(map(tuple, got.collect())) == [("glossary", 1, 2), ("glossary", 1, 5), ("glossary", 6, 7)]


def test_hot_record_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    rows = [(i, "en", "de", "Pump" if i % 3 else "pump.", "Pumpe") for i in range(400)] + [(400 + i, "en", "de", f"t{i}", "x" * 100_000) for i in range(3)]
    got = [tuple(r) for r in D.found(table(spark, rows), spark.createDataFrame([], GLOSSARY)).collect()]
    assert sorted(got) == [("terminology", 0, i) for i in range(1, 400)]
    assert Counter(g[1] for g in got)[0] == 399
    assert D.found(table(spark, []), spark.createDataFrame([], GLOSSARY)).count() == 0
