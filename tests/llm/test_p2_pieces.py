import random

import pytest
from pyspark.sql import functions as F

from bitloom.llm import pieces as P

ALPHABET = ["a", "b ", "c. ", "。", "\n", "\n\n", "汉", "é", "é", "👍🏽", "👨‍👩‍👧", "🇩🇪", "## h\n", "\r\n", "long" * 5]


def check(rows, text, limit, overlap):
    at = 0
    for i, r in enumerate(sorted(rows, key=lambda r: r.piece_no)):
        assert r.piece_no == i + 1 and r.length == len(r.piece) <= limit
        assert r.start == max(0, at - overlap if i else 0) and text[r.start : r.start + r.length] == r.piece
        assert r.start + r.length > at
        at = r.start + r.length
    assert at == len(text)


@pytest.mark.parametrize("limit,overlap,least", [(30, 0, 100_000), (30, 7, 400), (25, 24, 500), (40, 100, 600)])
def test_pieces_are_the_text(spark, limit, overlap, least):
    rng = random.Random(limit)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(n)) for n in (0, 5, 60, 500, 2500)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(9, None, 1, "x")], "id int, t string, start int, piece string")
    got = {}
    for r in P.split_items(df, ["id"], "t", F.lit(limit), F.lit(overlap), least).collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {i for i, t in enumerate(texts) if len(t) > limit}
    for i, rows in got.items():
        check(rows, texts[i], limit, min(overlap, limit - 1))


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(1)
    text = "".join(rng.choice(ALPHABET) for _ in range(9000))
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "small.txt").write_text("small")
    files = [(str(tmp_path / "a.txt"), 50, 9), (str(tmp_path / "small.txt"), None, None)]
    rows = P.split_files(spark, files, least=700).collect()
    assert {r.path for r in rows} == {files[0][0]}
    check(rows, text, 50, 9)


def random_text(rng, n):
    """With runs of white space, closing signs and marks that are longer than what a boundary depends on."""
    runs = [" " * 200, "\n" * 90, "」" * 80, "\u0301" * 70, "🇩🇪" * 50, "a!\n" + " " * 200, "。" + "”" * 66]
    return "".join(rng.choice(runs) if rng.random() < 0.02 else rng.choice(ALPHABET) for _ in range(n))


def pieces_by_ranges(text, limit, overlap, least):
    """The steps over ranges in plain Python."""
    limit, overlap = P.sizes(limit, overlap)
    if len(text) <= limit:
        return []
    room, at, strength, joined = limit - overlap, [], [], set()
    for a in range(0, len(text), least):
        low, end = max(0, a - max(P.CONTEXT, limit)), min(len(text), a + least)
        part, own = text[low : end + P.AHEAD], a - low
        x, s = P.boundaries(part, own, own + end - a)
        joined |= {p + low for p in P.inside(part, own, own + end - a, x, room)}
        kept = P.chooseable(x, s, room)
        at += [x[i] + low for i in kept]
        strength += [s[i] for i in kept]
    spans = -(-len(text) // (P.SPAN * room))
    return [c for k in range(spans) for c in P.span_cuts(k, len(text), limit, overlap, at, strength, joined)]


def test_pieces_do_not_depend_on_ranges(monkeypatch):
    monkeypatch.setattr(P, "SPAN", 8)
    rng = random.Random(9)
    for _ in range(400):
        text = random_text(rng, rng.randrange(1, 400))
        limit = rng.randrange(1, 60)
        overlap = rng.randrange(0, limit)
        whole = P.cut_text(text, limit, overlap)
        done = 0
        for i, (s, e) in enumerate(whole):
            assert s == max(0, done - (overlap if i else 0)) and done < e <= s + limit
            done = e
        assert done == (len(text) if whole else 0)
        for least in (rng.randrange(1, 80), 120, 1000):
            assert pieces_by_ranges(text, limit, overlap, least) == whole


def test_ranges_through_spark(spark, monkeypatch):
    rng = random.Random(4)
    texts = [random_text(rng, 500), "word " * 6 + "a!\n" + " " * 200 + "more words here. " * 20, "x" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = {(i, s, e - s) for i, t in enumerate(texts) for s, e in P.cut_text(t, 15, 4)}
    for least in (7, 120, 100_000):
        rows = P.split_items(df, ["id"], "t", F.lit(15), F.lit(4), least).collect()
        assert {(r.id, r.start, r.length) for r in rows} == want
        for i, t in enumerate(texts):
            check([r for r in rows if r.id == i], t, 15, 4)


def test_cuts_are_natural():
    text = "First one. Second one.\n\nNew paragraph follows here. Last words of it"
    assert [text[a:b] for a, b in P.cut_text(text, 30, 0)] == ["First one. Second one.\n\n", "New paragraph follows here. ", "Last words of it"]
    assert P.cut_text("a" * 9 + "e\u0301" + "a" * 9, 10, 0)[0] == (0, 9)
    assert [b for _, b in P.cut_text("🇩🇪🇫🇷🇪🇸", 3, 0)] == [2, 4, 6]


def test_manifests(spark):
    m = spark.createDataFrame([(1, 10, None, ["p1", "p2", "p9"]), (2, None, 3, ["q1"]), (3, 0, -4, ["r1"]), (None, 5, 0, None)],
                              "manifest_id long, chunk_size int, chunk_overlap int, chunks array<string>").withColumn("n", F.lit(1))
    c = spark.createDataFrame([("p1", 1, 1, "x" * 11), ("p2", 1, 2, "x" * 10), ("q1", 2, 1, "y" * 5001), ("r1", 3, 1, "z" * 4999), ("s", 4, 1, "w" * 99), ("p3", 1, 3, None)],
                              "chunk_path string, manifest_id long, chunk_no int, chunk_text string")
    assert sorted(map(tuple, P.found(m, c).collect())) == [(1, 1), (2, 1)]
    got = {r.manifest_id: (r.listed, r.delivered, r.oversized, r.pieces) for r in P.delivery(m, c).collect()}
    assert got == {1: (3, 2, 1, 2), 2: (1, 1, 1, 2), 3: (1, 1, 0, 0)}
    assert P.found(m.limit(0), c).count() == P.found(m, c.limit(0)).count() == 0
    twice = P.pieces(m, c.where("chunk_path = 'p1'").unionByName(c.where("chunk_path = 'p1'")))
    assert twice.count() == 4


def test_giant_items_without_or_with_equal_keys(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(n)) for n in (1500, 1800, 1700)]
    df = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[2])], "id int, t string")
    got = sorted(map(tuple, P.split_items(df, ["id"], "t", F.lit(40), F.lit(5), 400).collect()), key=str)
    want = []
    for k, (i, text) in enumerate([(None, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[2])]):
        rows = P.split_items(spark.createDataFrame([(k, text)], "id int, t string"), ["id"], "t", F.lit(40), F.lit(5), 400).collect()
        check(rows, text, 40, 5)
        want += [(i, *r[1:]) for r in rows]
    assert got == sorted(want, key=str)
    m = spark.createDataFrame([(1, 10, 0, ["p1"])], "manifest_id long, chunk_size int, chunk_overlap int, chunks array<string>")
    c = spark.createDataFrame([("p1", 1, None, "x" * 11)], "chunk_path string, manifest_id long, chunk_no int, chunk_text string")
    assert [(r.oversized, r.pieces) for r in P.delivery(m, c).collect()] == [(1, 2)]
