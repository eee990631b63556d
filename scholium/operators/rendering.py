"""Generated results as readable text: nested JSON of any depth as an outline or as Markdown, for teachers or without answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.functions import text as T
from scholium.operators.generators import is_template_answer

# --- fixed values: labels and texts of the application ---
LABELS = {
    "learning_objectives": "学习目标", "prerequisite_knowledge": "前置知识", "core_knowledge_points": "核心知识点", "daily_tasks": "每日任务安排",
    "review_suggestions": "复习建议", "study_tips": "学习技巧", "summary": "总结", "overview": "概览",
    "name": "名称", "description": "说明", "importance": "重要程度", "difficulty": "难度", "examples": "例题", "formulas": "公式", "notes": "注意事项",
    "day": "第几天", "tasks": "任务内容", "time_minutes": "预计时长（分钟）", "focus": "学习重点",
    "questions": "题目", "exercises": "习题", "question_text": "题干", "question_type": "题型", "stem": "题干", "options": "选项", "answer": "答案", "answers": "答案",
    "explanation": "解析", "explanations": "解析", "score": "分值", "knowledge_point": "考查知识点", "knowledge_points": "知识点", "hints": "提示", "solution": "解题过程",
    "A": "A", "B": "B", "C": "C", "D": "D", "instructions": "答题说明", "exam_instructions": "答题说明",
    "exam_type": "考试类型", "total_questions": "题目数量", "duration_minutes": "考试时长（分钟）", "total_score": "总分", "passing_score": "及格线",
    "sections": "大题", "section_title": "大题名称", "section_score": "大题总分",
    "title": "标题", "content": "内容", "chapter_name": "章节", "course_name": "课程", "created_at": "生成时间", "remark": "备注",
}
HOMEWORK_WRAPPERS = ("final_package", "final_package_structure", "tutor_result", "tutoring")
ONLY_TEMPLATE = "当前模型没有把题目代入求解，只返回了通用辅导模板。"
NO_CONTENT = "未获得有效解题内容。"
MISSING, MISSING_IMAGE = "可用于计算或推导的有效模型输出", "图片题干/OCR识别结果"
MISSING_STEP = "请补充完整题干，或检查模型/OCR服务是否正常返回。"
TEMPLATE_WARNING = "不要把通用解题模板当成真实答案。"
PASTE_HINT = "把题目文字粘贴出来后，我再按题目逐步求解。"
ASK_HINT = "可以继续追问某一步为什么这样做，或让我生成同类题。"
# --- end of fixed values ---


def label(name: Column) -> Column:
    """A field's label; of an unknown field its name with blanks, capitalised."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    said = F.replace(name, F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(known, name), F.concat(F.upper(F.substring(said, 1, 1)), F.lower(F.substring(said, F.lit(2), F.length(said)))))


def _events(doc: Column, audience: str, answers: bool) -> Column:
    events = batch.json_events(doc, audience)
    return events if answers else F.filter(events, lambda e: ~e["secret"])


def outline(doc: Column, answers: bool = True) -> Column:
    """A JSON result as indented lines.

    Values packed as strings (in fences, or under ``raw``) are taken out at any
    depth; fields keep their order; empty values are left out. Text that is not
    JSON is content; null and empty give the empty string. Without ``answers``
    no answer or explanation is shown (the version for students).
    """
    say = lambda e: (
        F.when(e["kind"] == "head", F.concat(label(e["name"]), F.lit("：")))
        .when(e["kind"] == "field", F.concat(label(e["name"]), F.lit("："), e["value"]))
        .when(e["kind"] == "question", F.concat(F.lit("第 "), e["n"].cast("string"), F.lit(" 题")))
        .when(e["kind"] == "day", F.concat(F.lit("Day "), e["value"]))
        .otherwise(F.concat(F.lit("• "), e["value"]))
    )
    return F.coalesce(F.array_join(F.transform(_events(doc, "outline", answers), lambda e: F.concat(F.repeat(F.lit("    "), e["depth"]), say(e))), "\n"), F.lit(""))


def markdown(doc: Column, answers: bool = True) -> Column:
    """A JSON result as Markdown with labels, numbered questions and days; inputs as for ``outline``."""
    one = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    spaced = lambda c: F.array(c, F.lit(""))
    say = lambda e: (
        F.when(e["kind"] == "head", spaced(one(F.repeat(F.lit("#"), e["level"]), " ", label(e["name"]))))
        .when(e["kind"] == "field", spaced(one("**", label(e["name"]), "**：", e["value"])))
        .when(e["kind"] == "question", F.array(one("#### 第 ", e["n"].cast("string"), " 题", e["name"], e["value"])))
        .when(e["kind"] == "numbered", spaced(one(e["n"].cast("string"), ". ", e["value"])))
        .when(e["kind"] == "stem", F.array(one("  ", e["value"])))
        .when(e["kind"] == "option", F.array(one("  ", e["name"], ". ", e["value"])))
        .when(e["kind"] == "note", F.array(one("> 【", e["name"], "】", e["value"])))
        .when(e["kind"] == "day", F.array(F.when(e["value"] == "", "").otherwise(one("**第 ", e["value"], " 天**"))))
        .when(e["kind"] == "end", F.array(F.lit("")))
        .otherwise(F.array(one("- ", e["value"])))
    )
    return F.coalesce(F.array_join(F.flatten(F.transform(_events(doc, "markdown", answers), say)), "\n"), F.lit(""))


def homework(results: DataFrame, doc: str = "result", question: str = "question", image: Column | None = None) -> DataFrame:
    """Adds the tutor's answer as ``answer_status, question_recognition, solving_approach, complete_steps, final_answer, common_mistakes, formulas, next_step_hint, insufficient_data_warning``.

    The result is taken out of up to four wrappers, one in another; ``steps``,
    ``hints`` and ``mistake_tips`` stand in for the fields they are named for
    elsewhere. A result with nothing in it, or with only a template, becomes
    the statement that it doesn't suffice, and why. Null or broken JSON is a
    result with nothing in it.
    """
    get = lambda c, n: F.get_json_object(c, f"$.{n}")
    texts = lambda c: F.from_json(c, "array<string>")
    d = F.col("_doc")
    out = results.withColumn("_doc", batch.unwrap_json(F.coalesce(F.col(doc), F.lit("{}"))))
    for w in HOMEWORK_WRAPPERS:  # each wrapper once, in this order
        out = out.withColumn("_doc", F.when(F.startswith(get(d, w), F.lit("{")), get(d, w)).otherwise(d))
    none = F.array().cast("array<string>")
    steps = F.filter(F.transform(F.coalesce(texts(F.coalesce(get(d, "complete_steps"), get(d, "steps"))), none), lambda x: T.strip(T.text_or_empty(x))), lambda x: x != "")
    said = lambda n: T.strip(T.text_or_empty(get(d, n)))
    tips = get(d, "mistake_tips")
    listed = F.when(F.startswith(tips, F.lit("[")), texts(tips)).when(T.text_or_empty(tips) != "", F.array(tips)).otherwise(none)
    hint = F.when(get(d, "hints").isNotNull(), T.text_or_empty(F.get(texts(get(d, "hints")), F.lit(0)))).otherwise(ASK_HINT)
    out = out.withColumns({"_steps": steps, "_approach": said("solving_approach"), "_final": said("final_answer")})
    reason = F.when(is_template_answer(F.col("_approach"), F.col("_steps"), F.col("_final")), ONLY_TEMPLATE).when((F.col("_final") == "") & (F.size("_steps") == 0) & (F.col("_approach") == ""), NO_CONTENT)
    missing = F.when(image, MISSING_IMAGE).otherwise(MISSING) if image is not None else F.lit(MISSING)
    bad = F.col("_reason").isNotNull()
    either = lambda short, good: F.when(bad, short).otherwise(good)
    asked = T.text_or_empty(F.col(question))
    out = out.withColumn("_reason", reason).withColumns({
        "answer_status": either(F.lit("insufficient"), F.coalesce(F.nullif(get(d, "answer_status"), F.lit("")), F.lit("ok"))),
        "question_recognition": either(asked, F.coalesce(F.nullif(said("question_recognition"), F.lit("")), asked)),
        "solving_approach": either(F.col("_reason"), F.col("_approach")),
        "complete_steps": either(F.array(F.concat(F.lit("缺少："), missing), F.lit(MISSING_STEP)), F.col("_steps")),
        "final_answer": either(F.lit(""), F.col("_final")),
        "common_mistakes": either(F.array(F.lit(TEMPLATE_WARNING)), F.coalesce(texts(get(d, "common_mistakes")), listed)),
        "formulas": either(none, F.coalesce(texts(get(d, "formulas")), none)),
        "next_step_hint": either(F.lit(PASTE_HINT), F.coalesce(get(d, "next_step_hint"), hint)),
        "insufficient_data_warning": either(F.col("_reason"), T.text_or_empty(get(d, "insufficient_data_warning"))),
    })
    return out.drop("_doc", "_steps", "_approach", "_final", "_reason")
