"""Text functions on Latin and CJK cases, against plain restatements of their rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.functions import text as T

CASES = [
    "",
    None,
    "Plain words, twice. Plain words.",
    "第一章 函数与极限\n定义 1.1 极限是指函数的趋势。\n\n\n\n例 1 求极限",
    "  tabs\t\tand　wide  \n 12 \n- 3 -\nPage 4 of 9\n",
    "a = b + c\n....\n____\n！！！！！！！！",
    "x\x07y\x1fz",
]


def column(spark, f, values=CASES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_whitespace(spark):
    def rule(s):
        s = re.sub("[ \t　]+", " ", s or "")
        return re.sub(r"\n{3,}", "\n\n", s).strip()

    assert column(spark, T.normalise_whitespace) == [rule(s) for s in CASES]


def test_control_characters(spark):
    assert column(spark, T.remove_control)[-1] == "xyz"


def test_gibberish_ratio(spark):
    def rule(s):
        return 1 - len(re.findall(r"[一-鿿A-Za-z0-9=+\-*/^<>≤≥≈≠∫∑∏√∞]", s)) / len(s) if s else 0.0

    assert column(spark, T.gibberish_ratio) == pytest.approx([rule(s) for s in CASES])


def test_page_numbers_and_gibberish_lines(spark):
    lines = ["12", "- 3 -", "第 5 页", "Page 4 of 9", "3/10", "定义极限", "????", "Chapter 1", "。。", "a!!!!!!!!!!!!"]
    assert column(spark, T.is_page_number, lines) == [True, True, True, True, True, False, False, False, False, False]
    assert column(spark, T.is_gibberish, lines) == [True, True, True, True, True, False, True, False, True, True]


def test_tokens(spark):
    assert column(spark, T.tokens, ["Ab c_1 函数极限"]) == [["ab", "c_1", "函", "数", "极", "限", "函数", "数极", "极限"]]
    assert column(spark, T.tokens, [None, ""]) == [[], []]


def test_block_types(spark):
    lines = ["定义 极限", "Theorem 2", "Example: x", "证明 略", "Exercises", "小结 完", "a = b", "plain", " "]
    assert column(spark, T.block_type, lines) == ["definition", "theorem", "example", "proof", "exercise", "summary", "formula", "explanation", "empty"]


def test_headings(spark):
    lines = ["第一章 函数", "Chapter 3 Limits", "12 Title", "plain", "1.2 节", "Section 4"]
    assert column(spark, lambda c: T.heading(c, T.CHAPTER), lines) == [True, True, True, False, False, False]
    assert column(spark, lambda c: T.heading(c, T.SECTION), lines)[4:] == [True, True]


def test_difficulty_and_tags(spark):
    assert column(spark, T.difficulty, ["基础概念", "证明极限 a = b", "x" * 2000 + "证明推导"]) == ["基础", "中等", "困难"]
    assert column(spark, T.tags, ["函数的极限定义", "plain"]) == [["概念", "极限", "函数"], ["explanation"]]


def test_citation(spark):
    df = spark.createDataFrame([("高数", "第一章", 12, 15, "a.pdf"), (None, "", None, None, ""), ("c", "d", 3, 3, None)], "c string, h string, a int, b int, f string")
    got = [r[0] for r in df.select(T.citation(*[F.col(x) for x in "chabf"])).collect()]
    assert got == ["高数 第一章 第 12-15 页 a.pdf", "课程资料 正文 页码未知", "c d 第 3 页"]


def test_math_and_nfkc():
    assert batch.math_text("s i n x=1 × 2, $a = b$") == "sin x = 1*2, $a = b$"
    assert batch.nfkc_text("１２（x²）") == "12(x2)"


def test_fuzzy_scores():
    assert batch.ratio("abcd", "abcd") == 100 and batch.ratio("", "a") == 0
    assert batch.common_length("abcbdab", "bdcaba") == 4
    assert batch.partial_ratio("极限", "函数的极限与连续") == 100
    assert batch.token_set_ratio("red part", "part red steel") == 100
    assert batch.weighted_ratio("abc", "xyz") < 30


@pytest.mark.parametrize("raw", ['```json\n{"a": 1,}\n```', "Sure: {'a': 1} done", '{"a": 1} trailing {"b": 2}', '{"a": 1}'])
def test_json_repair(raw):
    assert json.loads(batch.repaired_json(raw)) == {"a": 1}


def test_json_repair_roots():
    assert json.loads(batch.repaired_json('[1, {"x": "a\\q"}]')) == {"questions": [1, {"x": "a\\q"}]}
    assert batch.repaired_json("no json") is None and batch.repaired_json(None) is None


def test_markdown():
    assert batch.markdown({"t": "x", "l": [1, {"k": 2}]}) == ["- **t**: x", "## l", "- 1", "- **k**: 2"]
