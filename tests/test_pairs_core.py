import difflib
import hashlib

import pytest
from pyspark.sql import functions as F

from bitloom.operators import align, delta, glossary, qa, similarity
from bitloom.runtime import hot_keys, join_nulls_equal, salted_join


def segs(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, seg_no int, seg string")


def test_align_and_ids(spark):
    s = segs(spark, [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "")])
    t = segs(spark, [(1, 1, "x"), (1, 4, "y"), (2, 1, "")])
    got = [(r.doc_id, r.seg_no, r.src, r.tgt, r.unit_id) for r in align.with_unit_ids(align.align(s, t)).orderBy("doc_id", "seg_no").collect()]

    def h(x):
        return "seg-" + hashlib.sha1(x.encode()).hexdigest()[:12]

    assert got == [(1, 1, "a", "x", h("a")), (1, 2, "b", "", h("b")), (1, 3, "a", "", h("a") + "-2"), (1, 4, "", "y", h("_empty_source_4"))]
    assert [(r.doc_id, r.source_segments, r.target_segments) for r in align.count_mismatches(s, t).collect()] == [(1, 3, 2)]


def test_changes(spark):
    schema = "doc_id int, unit_id string, src string, tgt string"
    now = spark.createDataFrame([(1, "a", "s", "t"), (1, "b", "s", "t2"), (1, "c", "s", "t")], schema)
    old = spark.createDataFrame([(1, "a", " s\r\n", "t"), (1, "b", "s", "t"), (1, "d", "s", "t"), (1, "c", None, None)], schema)
    rows = {r.unit_id: r.change_type for r in delta.classify(now, old).collect()}
    assert rows == {"a": "unchanged", "b": "updated", "c": "updated"}
    assert {r.change_type for r in delta.classify(now, old.limit(0)).collect()} == {"new"}
    assert [(r.unit_id, r.change_type) for r in delta.removed(now, old).collect()] == [("d", "removed")]
    typed = delta.classify(now, old)
    assert delta.select_records(typed, True, True).count() == 2
    assert delta.select_records(typed, True, False).count() == 3
    many = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, None)], "doc_id int, unit_id string, k int, v string")
    assert delta.last_per_id(many, ["doc_id", "unit_id"], "k").first().v is None


def test_glossary(spark):
    rows = [(1, "g", "a", "x"), (2, "g", "a", "y"), (3, "g", " a ", "x"), (4, "g", "", "z"), (5, None, "a", "q"), (6, None, "a", "r"), (7, "h", "b", None)]
    terms = spark.createDataFrame(rows, "id int, domain string, source string, target string")
    entries = glossary.directed(terms, F.lit(False), "id", ["domain"])
    built = {(r.domain, r.term): r.translation for r in glossary.build(entries, "id", ["domain"]).collect()}
    assert built == {("g", "a"): "x", (None, "a"): "q"}
    assert sorted((r.id, r.kept, r.dropped) for r in glossary.collisions(entries, "id", ["domain"]).collect()) == [(2, "x", "y"), (6, "q", "r")]
    got = {r.domain: (r.term_count, r.skipped_count, r.collision_count) for r in glossary.summary(terms, F.lit(False), "id", ["domain"]).collect()}
    assert got == {"g": (1, 1, 1), None: (1, 0, 1), "h": (0, 1, 0)}
    back = glossary.build(glossary.directed(terms, F.lit(True), "id", ["domain"]), "id", ["domain"])
    assert {r.term for r in back.collect()} == {"x", "y", "q", "r"}


def test_domains(spark):
    docs = spark.createDataFrame([(1, "An SKU and a refund"), (2, "a SKUNK"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.score, r.domain, r.matches) for r in glossary.domains(docs).collect()}
    assert got == {1: (3, "ecommerce", "sku,refund"), 2: (2, "default", "sku"), 3: (0, "default", "")}


def test_term_hits_equal_a_nested_loop(spark):
    texts = ["An SKU, a sku-list", "skunk", "库存 here", "C++ and .NET run", "", "net", "a b"]
    terms = ["sku", "SKU-list", "库存", "库", "C++", ".NET", "a b", "und"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    gl = spark.createDataFrame([(t, "v") for t in terms], "term string, translation string")
    got = sorted((r.i, r.term) for r in glossary.term_hits(df, gl, "t", []).collect())
    loop = df.crossJoin(gl).where(qa.contains_term(F.col("t"), F.col("term")))
    assert got == sorted((r.i, r.term) for r in loop.collect()) and (0, "SKU-list") in got and (3, ".NET") in got


def pair(spark, *rows):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "i int, src string, tgt string")


def test_flags(spark):
    pairs = pair(spark, ("a", ""), ("same", "same"), ("123", "123"), ("x", "{{PH_INLINE_1}}"), ("abcdefghijk", "ab"), ("ab", "abcdefghijk"),
                 ("abcde", "a"), ("a", "abcde"), ("```\nx", "y"), (None, None), ("", "t"))
    got = {}
    for r in qa.pair_flags(pairs, ["i"]).collect():
        got.setdefault(r.i, []).append(r.flag_type)
    assert got == {0: ["missing_target"], 1: ["unchanged_text"], 3: ["placeholder_leak", "length_too_long"], 4: ["length_too_short"], 5: ["length_too_long"],
                   8: ["code_fence_mismatch"]}


def test_term_flags_and_gate(spark):
    gl = spark.createDataFrame([("valve", "Ventil"), ("pump", "Pumpe")], "term string, translation string")
    pairs = pair(spark, ("A valve and a pump", "Ein VENTIL"), ("```\nvalve", "x"), ("valves", "x"), ("valve", ""))
    flags = qa.term_flags(pairs, gl, ["i"])
    assert [(r.i, r.message) for r in flags.collect()] == [(0, "expected terminology 'pump' -> 'Pumpe'")]
    assert tuple(qa.gate(flags, "warning").first()) == ("warning", True)
    assert tuple(qa.gate(flags, "error").first()) == ("warning", False)
    assert tuple(qa.gate(flags.limit(0), "error").first()) == ("none", False)
    with pytest.raises(ValueError):
        qa.gate(flags, "fatal")


def test_syntax_errors(spark):
    df = spark.createDataFrame([("```\n[a](",), ("`{{PH_A_1}}",), ("fine",)], "x string")
    got = [r.e for r in df.select(qa.syntax_errors(F.col("x")).alias("e")).collect()]
    assert got == [["Unclosed code fence detected.", "Malformed Markdown links detected."],
                   ["Unbalanced inline backticks detected.", "Unrestored placeholders detected: {{PH_A_1}}"], []]


def test_diff_rates(spark):
    long_a, long_b = "line one\n" * 500 + "x", "line one\n" * 490 + "changed\n" * 10
    rows = [("kitten", "sitting"), ("", ""), ("é", "e"), (None, "ab"), (long_a, long_b)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = {r.i: (r.distance, r.max_len, r.diff_rate) for r in similarity.diff_rates(df, "a", "b", ["i"]).collect()}
    assert got[0] == (3, 7, 42.86) and got[1] == (0, 1, 0.0) and got[2] == (1, 1, 100.0) and got[3] == (2, 2, 100.0)
    m = difflib.SequenceMatcher
    same = 0.6 * m(None, long_a.splitlines(), long_b.splitlines()).ratio() + 0.4 * m(None, long_a, long_b).ratio()
    assert got[4][0] is None and got[4][2] == round((1 - same) * 100, 2)
    verdicts = {r.i: r.verdict for r in similarity.quality_gate(similarity.diff_rates(df, "a", "b", ["i"])).collect()}
    assert verdicts[1] == "PASS" and verdicts[0] == "WARNING"
    assert "<table" in df.limit(1).select(similarity.html_diff(F.col("a"), F.col("b")).alias("h")).first().h


def test_hot_keys_are_spread_and_joined_whole(spark):
    many = spark.range(60_000).select(F.col("id"), F.when(F.col("id") < 40_000, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"))
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(one, ["k"], "n", 60_000)
    assert hot.count() == 1 and hot.first()["_salts"] == 2
    joined = salted_join(many, one, ["k"], "id", hot)
    assert joined.count() == 60_000 and joined.where("k is null").first().n == 40_000
    assert hot_keys(one, ["k"], "n", 100) is None
    assert join_nulls_equal(one, one.withColumnRenamed("n", "m"), ["k"]).where("n = m").count() == 20_001


def test_ways_of_finding_terms_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a", "The Pump and the gear-box, pumps"), (2, "a", "水泵和阀门"), (3, "b", "pump"), (4, "a", ""), (5, "a", "ÉCLAIR pump_x İpump")], "id int, g string, t string")
    terms = spark.createDataFrame([("a", "pump", "x"), ("a", "gear-box", "y"), ("a", "水泵", "z"), ("a", "泵和阀", "q"), ("a", "门", "m"), ("b", "gear", "g"), ("a", "éclair", "e")], "g string, term string, translation string")
    found = []
    for few, rows in ((500, 20_000), (0, 20_000), (0, 0)):
        monkeypatch.setattr(glossary, "FEW_TERMS", few)
        monkeypatch.setattr(glossary, "BROADCAST_TERMS", rows)
        for on in (["g"], []):
            hits = glossary.term_hits(texts, terms if on else terms.drop("g"), "t", on)
            found.append((len(on), sorted((r.id, r.term) for r in hits.select("id", "term").collect())))
    assert all(f == next(x for n, x in found if n == k) for k, f in found)
    assert found[0][1] == [(1, "gear-box"), (1, "pump"), (2, "水泵"), (2, "泵和阀"), (2, "门"), (5, "éclair")]
