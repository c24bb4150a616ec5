from pyspark.sql import functions as F

from bitloom.functions import text as X

from helpers import column

x, y = F.col("x"), F.col("y")


def test_normalisation(spark):
    rows = ["  a \t b\r\nc\r ", "　x\x1c", "", None, "a  b"]
    assert column(spark, X.normalize_segment(x), rows) == ["a b\nc", "x", "", None, "a  b"]
    assert column(spark, X.canonical(x), ["\r\na  b\r"]) == ["a  b"]
    assert column(spark, X.strip_bom(x), ["﻿﻿a﻿"]) == ["a﻿"]


def test_line_predicates(spark):
    lines = ["# a", "   ###### b", "    # c", "#", "- a", "* b", "+c", "12. x", "1.x", "|", "| a |", " |a| ", "|a", "```", " ```py", "　"]
    got = {n: column(spark, f(x), lines) for n, f in (
        ("h", X.is_heading), ("u", X.is_unordered_item), ("o", X.is_ordered_item), ("t", X.is_table_row), ("f", X.is_fence), ("b", X.is_blank))}
    on = {n: [lines[i] for i, v in enumerate(vs) if v] for n, vs in got.items()}
    assert on == {"h": ["# a", "   ###### b"], "u": ["- a", "* b"], "o": ["12. x"], "t": ["|", "| a |", " |a| "], "f": ["```", " ```py"], "b": ["　"]}


def test_contains_term(spark):
    rows = [("an SKU here", "sku"), ("skunk", "sku"), ("a.b*c", "b*c"), ("aXb*c", "b*c"), ("有库存", "库存"), ("", "a"), ("a", ""), ("x\\Ey", "x\\Ey"), ("Ä", "ä")]
    assert column(spark, X.contains_term(x, y), rows, ("x", "y")) == [True, False, True, False, True, False, False, True, False]


def test_syntax_parts(spark):
    assert column(spark, X.fence_count(x), ["```\na\n```", " ```", "a```"]) == [2, 0, 0]
    assert column(spark, X.unbalanced_backticks(x), ["a `b` c", "a `b", "``a`` `", "```\n`\n```\n"]) == [False, True, True, False]
    assert column(spark, X.malformed_links(x), ["[a](b)", "[a](", "[](x)"]) == [False, True, True]
    assert column(spark, X.leftover_tokens(x), ["{{PH_B_1}} {{PH_A_2}} {{PH_B_1}} {{ph_c}}"]) == [["{{PH_A_2}}", "{{PH_B_1}}"]]


def test_lengths_and_routes(spark):
    assert column(spark, X.word_count(x), ["a  b　c", "", " "]) == [3, 0, 0]
    assert column(spark, X.token_estimate(x), ["12345678", "é汉"]) == [2, 0]
    assert column(spark, X.route(x, 3), ["abc", "abcd"]) == ["OK", "SPLIT"]


def test_languages(spark):
    assert column(spark, X.lang_prefix(x), [" ZH-cn", "en", None, ""]) == ["zh", "en", "", ""]
    rows = [("zh-CN", "en-US"), ("en-US", "zh-CN"), ("zh", None)]
    assert column(spark, X.reversed_direction(x, y), rows, ("x", "y")) == [True, False, False]


def test_formatting(spark):
    assert column(spark, X.format_seconds(x.cast("int")), ["-5", "59", "60", "125"]) == ["0s", "59s", "1m00s", "2m05s"]
    assert column(spark, X.eta_detail(F.lit(40), F.lit(120)), ["a"]) == ["elapsed=40s eta=1m20s progress=33%"]
    assert column(spark, X.progress_line(F.lit(1), F.lit(6), x, F.lit("DONE"), y), [("s", ""), ("s", "d")], ("x", "y")) == [
        "[PROGRESS] 1/6 s | DONE", "[PROGRESS] 1/6 s | DONE | d"]
    assert column(spark, X.escape_markup(x), ["<a b=\"c\">'&"]) == ["&lt;a b=&quot;c&quot;&gt;&#x27;&amp;"]
