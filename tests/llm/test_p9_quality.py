import pyarrow as pa
import pytest

from bitloom.llm import quality as Q

COMMON = frozenset("the of and in is was to que el la der die das und von 的 是 在 了 有".split())
PROSE = "The river of the valley was moved in 1850, and the people of the town remember it. "


def counts(*texts):
    found = Q.count(pa.array(texts, pa.string()), pa.array(sorted(COMMON)))
    return [{c: int(found[c][i]) for c in Q.COUNTS} for i in range(len(texts))]


def share(text):
    c = counts(text)[0]
    return c["running"] / c["line_chars"] if c["line_chars"] else 0.0


def test_counts():
    a, b, c, d = counts("foo-bar 12\n\n# x…  y_z...", None, "的水 Kito", "é\r\nß1\ra")
    assert (a["n_words"], a["alphabetic"], a["n_lines"], a["signs"], a["ellipsis"], a["letters"]) == (5, 3, 2, 3, 1, 18)
    assert set(b.values()) == {0}
    assert (c["han"], c["units"], c["common"], c["n_words"], c["n_chars"]) == (2, 2, 1, 2, 7)
    assert (d["n_lines"], d["n_words"], d["alphabetic"], d["n_chars"], d["line_chars"]) == (3, 3, 3, 7, 4)


@pytest.mark.parametrize("text", [
    PROSE * 3, "== Notes ==\n" + PROSE * 2, "{{Infobox\n| name = X\n}}\n" + PROSE * 3, PROSE * 2 + "\n%%&&$$##", "* " + PROSE,
    "这条河的水在山谷的中央，有人在这里住了很久，是有名的地方。" * 2, "'''X''' — " + PROSE + "<ref>{{cite web|title=x}}</ref>",
])
def test_prose(text):
    assert share(text) >= 0.5


@pytest.mark.parametrize("text", [
    "", None, "   \n", "#REDIRECT [[X]]", "* the a\n* of b\n* in c", "{|\n! a !! b\n|-\n| the || 1\n|}", "a\t1\t2\nb\t3\t4", "Kito  |  85  |  20\nTore  |  77  |  73",
    "jfkd sdkf jkl; sdfj ksdl jfkl jskd", "$#=#*<*</*=$*&*)/!%", "123 456 789 12 33 44 55", "哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈", "pumps looms mills canals looms mills gears",
    'Script error: no such module "the of and".\n' * 3, "{{#if:{{{a|}}}|{{{4}}}}}",
])
def test_no_prose(text):
    assert share(text) < 0.5


def test_found_and_reasons(spark):
    docs = spark.createDataFrame([(1, PROSE * 9, 1), (2, "", 2), (3, None, 3), (4, "* a\n" * 9, 4), (4, "* a\n" * 9, 4), (5, PROSE * 20_000, 5)], "doc_id long, text string, n_chars long")
    words = spark.createDataFrame([("en", w, i) for i, w in enumerate(COMMON)] + [("en", None, 1)], "lang string, word string, freq_rank int")
    assert sorted(r.doc_id for r in Q.found(docs, words).collect()) == [2, 3, 4, 4]
    got = {r.doc_id: r for r in Q.statistics(docs, words).collect()}
    assert got[1].reasons == [] and got[2].reasons[0] == "empty" and {"bullet_lines", "not_running_text"} <= set(got[4].reasons)
    assert got[1].n_words == 9 * 17 and got[5].n_chars == 20_000 * len(PROSE) and got[3].prose_share == 0.0
    assert Q.found(docs.limit(0), words).count() == 0
    assert Q.found(docs, words.limit(0)).count() == 6  # without common words nothing counts as running text


def test_word_list_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_COMMON_WORDS", 3)
    with pytest.raises(ValueError):
        Q.common_words(spark.createDataFrame([(str(i),) for i in range(5)], "word string"))


def test_labels_agree(spark, data):
    """Against the hand labels of the data folder, of which a small share is wrong."""
    from bitloom.runtime import table

    found = Q.found(table(spark, data, "documents"), table(spark, data, "common_words")).withColumnRenamed("doc_id", "f")
    labels = table(spark, data, "page_labels")
    joined = labels.join(found, labels.doc_id == found.f, "left").selectExpr("(f is not null) = (label <> 'prose') as ok").collect()
    assert sum(r.ok for r in joined) >= 0.8 * len(joined)


def test_batches_are_measured_in_parts(spark, data, monkeypatch):
    from bitloom.runtime import table

    docs, words = table(spark, data, "documents"), table(spark, data, "common_words")
    want = sorted(map(tuple, Q.counts(docs, words).collect()))
    monkeypatch.setattr(Q, "PART_BYTES", 1000)
    assert sorted(map(tuple, Q.counts(docs, words).collect())) == want
    assert Q.counts(docs.limit(0), words).count() == 0
