"""Results as text, and the templates, on small and odd inputs."""

import json

from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.operators import generators as G
from scholium.operators import rendering as R


def shown(spark, doc, render=R.outline, **options):
    df = spark.createDataFrame([(doc if doc is None or isinstance(doc, str) else json.dumps(doc, ensure_ascii=False),)], "doc string")
    return df.select(render(F.col("doc"), **options).alias("t")).first().t


def test_any_depth(spark):
    deep = {"core": 1}
    for _ in range(40):
        deep = {"a_level": json.dumps(deep)} if len(json.dumps(deep)) < 5_000 else {"a_level": deep}
    lines = shown(spark, deep).split("\n")
    assert len(lines) == 41 and lines[0] == "A level：" and lines[40] == "    " * 40 + "Core：1"


def test_deeper_than_the_stack(spark):
    doc = '{"a":' * 100_000 + "1" + "}" * 100_000
    assert shown(spark, doc) == "内容：" + doc


def test_odd_values(spark):
    assert shown(spark, None) == shown(spark, "") == shown(spark, {}) == ""
    assert shown(spark, "just text") == "内容：just text"
    assert shown(spark, [1, None, "", True, [2]]) == "题目：\n    • 1\n    • True\n    • [2]"
    assert shown(spark, {"raw": "```json\n{\"raw\": \"[{}]\"}\n```"}) == "题目："
    assert shown(spark, {"x": 0, "y": False, "z": None, "w": {}}) == "X：0\nY：False\nW："
    assert shown(spark, '{"a": "\\ud800"}') == "A：?"
    assert shown(spark, {"a": "{not json"}) == "A：{not json"


PAPER = {"questions": [{"stem": "s", "options": {"A": 1, "B": 2}, "answer": "A", "explanation": "e", "知识点": "k"}, "plain", {"question_text": "t", "score": 5, "answers": ["x"]}], "answers": ["A"], "focus": "f"}


def test_markdown_with_and_without_answers(spark):
    full = shown(spark, PAPER, R.markdown).split("\n")
    assert full == ["## 题目", "", "#### 第 1 题", "  s", "  A. 1", "  B. 2", "> 【答案】A", "> 【解析】e", "> 【考查知识点】k", "", "2. plain", "", "#### 第 3 题  (5 分)", "  t", "", "## 答案", "", "- A", "", "**学习重点**：f", ""]
    student = shown(spark, PAPER, R.markdown, answers=False)
    assert "答案" not in student and "解析" not in student and "【考查知识点】k" in student and "学习重点" in student


def test_outline_without_answers(spark):
    student = shown(spark, PAPER, answers=False)
    assert "第 1 题" in student and "答案" not in student and "解析" not in student
    assert "        答案：A" in shown(spark, PAPER).split("\n")


def test_days(spark):
    doc = {"plan": [{"day": 3, "tasks": ["a", "b"]}, {"tasks": []}]}
    assert shown(spark, doc).split("\n") == ["Plan：", "    Day 3", "        任务内容：", "            • a", "            • b", "    Day 2", "        任务内容："]
    assert shown(spark, doc, R.markdown).split("\n") == ["## Plan", "", "**第 3 天**", "### 任务内容", "", "- a", "- b", "", "", "### 任务内容", "", "", ""]


def test_unwrapping(spark):
    df = spark.createDataFrame([(None,), ("",), ('"x"',), ('{"a": "{\\"raw\\": \\"[1, 2]\\"}"}',), ("[1]",)], "j string")
    assert [r.u for r in df.select(batch.unwrap_json("j").alias("u")).collect()] == [None, "{}", '{"内容": "\\"x\\""}', '{"a": [1, 2]}', '{"questions": [1]}']


def test_homework_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, None), ("q", '{"final_answer": "7", "formulas": ["a=b"], "next_step_hint": "go"}')], "question string, result string")
    bad, good = R.homework(df).collect()
    assert (bad.answer_status, bad.question_recognition, bad.insufficient_data_warning) == ("insufficient", "", R.NO_CONTENT)
    assert (good.answer_status, good.final_answer, good.formulas, good.next_step_hint, good.complete_steps) == ("ok", "7", ["a=b"], "go", [])
    assert R.homework(df.limit(0)).count() == 0
    assert R.homework(df, image=F.lit(True)).first().complete_steps[0] == "缺少：" + R.MISSING_IMAGE


def test_profiles(spark):
    who = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    m = spark.createDataFrame([(1, 5, "b", "r"), (1, 2, "a", None), (1, 1, "b", ""), (1, 9, "", "r2"), (None, 1, "x", "y")], "u int, at int, knowledge_point string, error_reason string")
    seen = spark.createDataFrame([(2,)], "u int")
    got = {r.u: r for r in G.profiles(who, m, seen, "u", "at").collect()}
    assert got[1].weak_knowledge_points == ["b", "a"] and got[1].common_error_reasons == ["r", "r2"]
    assert [got[u].insufficient_data_warning for u in (1, 2, 3)] == ["", "", G.FEW_RECORDS] and got[3].weak_knowledge_points == []


def test_templates_with_nulls(spark):
    r = spark.createDataFrame([(None, None, None, None, None, None, None, None)], "points array<string>, fragments array<string>, knowledge_point string, question_text string, standard_answer string, student_answer string, weak_knowledge_points array<string>, exam_date string")
    k = G.keypoints(r).first()
    assert k.key_points[0].core_focus == [] and k.insufficient_data_warning == G.NO_SOURCE["keypoint"]
    assert G.explanation(r).first().concept_explanation == G.CORE_OF_SECTION
    assert not G.diagnosis(r).first().is_correct and G.tutor(r).first().recommended_review == []
    p = G.adaptive_path(r.withColumn("daily_study_time", F.lit(None).cast("int"))).first()
    assert p.tomorrow_tasks[0].estimated_time_minutes == 60 and p.insufficient_data_warning == G.NO_PROFILE
