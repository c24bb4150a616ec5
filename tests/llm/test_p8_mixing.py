import os
import random

import pytest
from pyspark.sql import functions as F

from bitloom.llm import mixing as M

DOCS, TARGETS = "doc_id long, text string, source string, tokens int, copies int", "source string, target_share double, max_repeats int"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{M.TOKENIZERS}/{M.VOCABULARY}"), reason="no vocabulary")


def documents(spark, n=3000):
    rng = random.Random(1)
    sources = ["a"] * 12 + ["b"] * 5 + ["c"] + ["other"]
    return spark.createDataFrame([(i, "word " * rng.randrange(1, 80), rng.choice(sources), 1, 1) for i in range(n)] + [(n, None, "a", 1, 1), (n + 1, "", None, 1, 1), (n + 2, "x " * 900, "a", 1, 1)], DOCS).repartition(6)


def test_shares_are_met(spark):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.1, 3), ("a", 0.1, 1), (None, 0.5, 1)], TARGETS)
    docs = documents(spark)
    got = {r.source: r for r in M.shares(docs, targets).collect()}
    assert set(got) == {"a", "b", "c", "gone"} and got["gone"].drawn_tokens == 0
    for s, share in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(got[s].actual_share - share) < 0.02, (s, got[s])
        assert got[s].most_copies <= got[s].max_repeats
    picked = M.selection(docs, targets).collect()
    assert len({r.doc_id for r in picked}) == len(picked) and {r.source for r in picked} <= {"a", "b", "c"}
    assert {r.doc_id: r.copies for r in M.selection(docs, targets).collect()} == {r.doc_id: r.copies for r in picked}  # the same every time


def test_capped_sources_are_reported(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("c", 0.5, 2), ("b", None, None)], TARGETS)
    got = {r.source: r for r in M.shares(documents(spark, 500), targets, total=1e6).collect()}
    assert got["c"].drawn_tokens == 2 * got["c"].tokens < got["c"].wanted_tokens and got["b"].drawn_tokens == 0


def test_flight_keeps_the_totals():
    rng = random.Random(3)
    rows = [("s", 0, i, rng.randrange(1, 1000), 0.37) for i in range(4000)]
    out = list(M.flight(iter(rows), 1, 0, land=True))
    assert sorted(r[0] for r in out) == list(range(4000))
    tokens, number = sum(r[2] for r in out if r[3]), sum(r[3] for r in out)
    assert abs(number - 0.37 * 4000) <= 1 and abs(tokens - 0.37 * sum(r[3] for r in rows)) <= 2000
    assert sum(1 for r in M.flight(iter(rows), 1, 0, land=False) if r[3] is None) <= 2
    same = list(M.flight(iter([("s", 0, i, 5, 0.5) for i in range(100)]), 1, 0, True))
    assert sum(r[3] for r in same) == 50


def test_inclusion_is_even():
    rows = [("s", 0, i, 10 + 7 * (i % 5), 0.3) for i in range(40)]
    counts = [0] * 40
    for seed in range(600):
        for r in M.flight(iter(rows), seed, 0, True):
            counts[r[0]] += r[3]
    assert all(0.22 < c / 600 < 0.38 for c in counts)


def test_selection_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 32)  # several levels of groups
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 3)], TARGETS)
    docs = documents(spark)
    got = [{(r.doc_id, r.copies) for r in M.selection(docs.repartition(n), targets).collect()} for n in (4, 9)]
    assert got[0] == got[1] and len(got[0]) > 100
    other = {(r.doc_id, r.copies) for r in M.selection(docs, targets, seed=2).collect()}
    assert other != got[0]
    for r in M.shares(docs, targets).collect():
        assert abs(r.actual_share - r.target_share) < 0.02, r


def test_edges(spark):
    docs, targets = documents(spark, 30), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert M.selection(docs.limit(0), targets).count() == M.selection(docs, targets.limit(0)).count() == 0
    assert M.shares(docs.limit(0), targets).first().actual_share == 0.0
    assert {r.copies for r in M.selection(docs, targets).collect()} == {1}
    assert M.selection(docs, targets).count() == docs.where(F.col("source") == "a").count()
