import json
import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import chunk, mask, repair, segment

from helpers import column, packed, random_markdown
from helpers import segments as plain_segments

x = F.col("x")


def test_mask_kinds_and_numbers(spark):
    text = "a `b` <div>`c`</div> $x+y$ $z$ ```k\n``` $$q$$ <br/> <br> <SPAN a='1'>s</span>"
    got = column(spark, mask.protect(x), [text])[0]
    assert [(r.ord, r.token, r.original) for r in got.regions][:3] == [
        (0, "{{PH_CODE_BLOCK_0}}", "```k\n```"), (1, "{{PH_INLINE_1}}", "`b`"), (2, "{{PH_INLINE_2}}", "`c`")]
    assert "$z$" in got.masked and "<br>" in got.masked and "SPAN" not in got.masked
    assert got.regions[-1].original == "<SPAN a='1'>s</span>"


def test_restore_orders(spark):
    p = mask.protect(x)
    text = "<div>`c`</div> $1 \\ `a`"
    assert column(spark, mask.restore(p["masked"], p["regions"], "reverse"), [text]) == [text]
    assert column(spark, mask.restore(p["masked"], p["regions"]), [text]) == ["<div>{{PH_INLINE_0}}</div> $1 \\ `a`"]
    with pytest.raises(ValueError):
        mask.restore(x, x, "other")


def test_mask_round_trip_on_random_texts(spark):
    rng, signs = random.Random(3), ["`", "``", "```", "$", "$$", "<div>", "</div>", "<br/>", "a", " ", "\n", "汉", "{{PH_INLINE_0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(400)]
    p = mask.protect(x)
    assert column(spark, mask.restore(p["masked"], p["regions"], "reverse"), texts) == texts
    assert column(spark, mask.protect(x), [None, ""])[0] is None


def test_mapping_json(spark):
    got = column(spark, mask.mapping_json(mask.protect(x)["regions"]), ['`a"\\` ```\nb```', "none"])
    assert list(json.loads(got[0]).items()) == [("{{PH_CODE_BLOCK_0}}", "```\nb```"), ("{{PH_INLINE_1}}", '`a"\\`')]
    assert got[1] == "{}"


def test_repair(spark):
    rows = {"x ** a ** b": "x **a** b", "x **a** b **c**": "x **a**b**c**", "-x": "- x", "**b** c": "* *b** c", "---": "- --", "  ```py  ": "```py",
            "[a] (b)": "[a](b)", "a {{PH_X_1}} b": "a{{PH_X_1}}b", "plain": "plain", "": ""}
    assert column(spark, repair.repair(x), list(rows)) == list(rows.values())


def test_sections(spark):
    rows = ["a\n## B\nc\n##  D\n\n## \n", "no heading ", "## A\r\nb\x0bc", "##x"]
    assert column(spark, chunk.sections(x), rows) == [["a", "## B\nc", "## D"], ["no heading "], ["## A\nb\nc"], ["##x"]]


def test_packing_against_plain_code(spark):
    rng = random.Random(5)
    cases = [[("abcdefgh" * 9)[: rng.randrange(1, 30)] + ("\n\n" + "y" * rng.randrange(1, 40)) * rng.randrange(3) for _ in range(rng.randrange(6))] for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<string>")
    got = [r.v for r in df.select("i", chunk.pack(F.col("c"), 24).alias("v")).orderBy("i").collect()]
    assert got == [packed(c, 24) for c in cases]
    with pytest.raises(ValueError):
        chunk.pack(x, 0)


def test_chunks_and_manifest(spark):
    docs = spark.createDataFrame([(1, "a" * 30), (2, ""), (3, None)], "doc_id int, text string")
    rows = [(r.doc_id, r.chunk_no, r.name, len(r.chunk)) for r in chunk.chunks(docs, 20).orderBy("doc_id", "chunk_no").collect()]
    assert rows == [(1, 1, "chunk_001.md", 20), (1, 2, "chunk_002.md", 10), (2, 1, "chunk_001.md", 0), (3, 1, "chunk_001.md", 0)]
    assert [r.chunk_count for r in chunk.manifest(docs, 20).orderBy("doc_id").collect()] == [2, 1, 1]


def test_segments_against_plain_code(spark):
    rng = random.Random(7)
    texts = [random_markdown(rng) for _ in range(500)] + ["", "```\nopen\n\n", "a\r\nb\rc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("kind", F.lit("clash")).withColumn("_key", F.lit(0))
    got = {}
    for r in segment.segments(df).orderBy("doc_id", "seg_no").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.seg))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_segments(t), repr(t)


def test_segments_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, " \n\t")], "doc_id int, text string")
    assert segment.segments(df).count() == 0
    assert segment.segments(df.limit(0)).count() == 0


def test_segments_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert "Exchange" not in segment.segments(df)._jdf.queryExecution().executedPlan().toString()
