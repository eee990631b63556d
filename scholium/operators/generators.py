"""Deterministic stand-ins for generated material, and the rules that check it.

Each generator takes a DataFrame of requests and gives the template that is
served where no model answers; each check gives an array of findings in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T

# --- fixed values: titles, markers and required fields ---
SLIDE_TITLES = ("学习目标", "核心概念", "方法步骤", "例题演示", "易错提醒", "课堂练习", "总结")
QUESTION_TYPES = ("multiple_choice", "fill_in", "short_answer")
TEMPLATE_MARKERS = ("识别题目", "整理条件", "选择方法", "完成推导", "检查答案", "列出已知条件", "先识别题目考查")
REQUIRED = {
    "study_plan": ("title", "daily_tasks", "total_time_minutes"),
    "keypoint": ("key_points",),
    "explanation": ("concept_explanation", "key_steps"),
    "exercise": ("questions",),
    "exam_paper": ("questions", "paper_title"),
    "homework_tutor": ("solving_approach", "complete_steps"),
    "mistake_diagnosis": ("is_correct",),
    "student_profile": ("current_stage", "weak_knowledge_points"),
    "micro_lesson": ("sections",),
    "ppt_content": ("slides",),
    "knowledge_graph": ("nodes",),
    "learning_package": ("learning_objectives", "daily_tasks"),
}
MAJOR = ("questions", "daily_tasks", "sections", "key_points", "slides")
PLAN_TASK = ("day", "task_name", "task_description", "estimated_time_minutes")
QUESTION = ("question_id", "question_type", "difficulty", "stem", "correct_answer")
LEVELS = ("easy", "medium", "hard")
METHODS = ("用例题对照概念", "整理错题原因", "做同类变式练习")
KEY_STEPS = ("理解定义", "对照例题", "完成练习", "复盘易错点")
CORE_OF_SECTION = " 是本节需要理解和应用的核心内容。"
NO_SOURCE = {"keypoint": "缺少教材片段，重点难点为保守估计。", "explanation": "缺少教材片段，讲解为通用版本。", "diagnosis": "缺少教材片段，诊断为保守版本。"}
TUTOR = {
    "solving_approach": "模型未能生成针对题目的有效解答，不能把通用模板当作答案。",
    "next_step_hint": "请确认题干完整、模型服务正常；如果是图片题，请先完成 OCR/多模态识别。",
    "complete_steps": "等待有效题干识别和模型推导结果",
    "common_mistakes": "只输出解题模板，没有代入题目条件",
    "insufficient_data_warning": "未获得可验证的题目代入解答。",
}
DIFFERS, NO_REASON = "答案与标准答案不一致，需进一步人工或模型诊断。", "缺少足够依据定位具体错误。"
REMEDIES = ("复习相关知识点", "完成 2-3 道同类变式题")
FIRST_STAGE, NEXT_STAGE, FEW_RECORDS = "数据积累阶段", "继续积累答题和学习记录，以便生成更准确画像。", "学习数据较少，画像为保守版本。"
WEAK_TASK, WEAK_TEXT, WEAK_FIRST = "薄弱点复习", "复习薄弱知识点并完成同类练习。", "根据学习画像和错题记录优先补强薄弱点。"
NO_PROFILE = "缺少学习画像，路径为通用版本。"
# --- end of fixed values ---


def _numbers(n: Column) -> Column:
    """1 .. max(n, 1)."""
    return F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1)))


def exercises(requests: DataFrame) -> DataFrame:
    """``questions`` for ``(points, question_types, n, chapter)``: points and types dealt in turn, all medium."""
    kinds = F.when(F.size("question_types") > 0, F.col("question_types")).otherwise(F.array(*[F.lit(x) for x in QUESTION_TYPES]))
    point = lambda i: F.when(F.size("points") > 0, F.get("points", F.pmod(i - 1, F.size("points")))).otherwise("")
    one = lambda i: F.struct(
        F.get("_kinds", F.pmod(i - 1, F.size("_kinds"))).alias("question_type"),
        F.lit("medium").alias("difficulty"),
        point(i).alias("knowledge_point"),
        F.concat(F.lit("请围绕“"), F.coalesce(F.nullif(point(i), F.lit("")), F.col("chapter")), F.lit("”完成一道基础练习。")).alias("stem"),
    )
    return requests.withColumn("_kinds", kinds).withColumn("questions", F.transform(_numbers(F.col("n")), one)).drop("_kinds")


def slides(requests: DataFrame) -> DataFrame:
    """``slides`` for ``(total_slides)``: seven titles in turn, half a minute each."""
    titles = F.array(*[F.lit(t) for t in SLIDE_TITLES])
    one = lambda i: F.struct(i.alias("slide_number"), F.get(titles, F.pmod(i - 1, F.lit(len(SLIDE_TITLES)))).alias("slide_title"), F.lit(30).alias("duration_seconds"))
    return requests.withColumn("slides", F.transform(_numbers(F.col("total_slides")), one))


def course_structure(requests: DataFrame) -> DataFrame:
    """The cautious structure of ``(course_name, chapter_name, chapter_text, fragment_id)``: a summary of 300 characters, nothing guessed."""
    named = F.coalesce(F.nullif("chapter_name", F.lit("")), F.lit("未命名章节"))
    refs = F.when(T.text_or_empty(F.col("fragment_id")) != "", F.array("fragment_id")).otherwise(F.array().cast("array<string>"))
    warn = F.when(T.text_or_empty(F.col("chapter_text")) == "", "未能从材料中稳定抽取结构，已返回保守结果。").otherwise("")
    return requests.select("course_name", named.alias("chapter_name"), F.substring(T.text_or_empty(F.col("chapter_text")), 1, 300).alias("chapter_summary"), refs.alias("references"), warn.alias("insufficient_data_warning"))


def name_graph(requests: DataFrame, key: str) -> DataFrame:
    """Nodes of the named points of each request, without edges."""
    return requests.select(key, F.posexplode("points").alias("place", "name")).select(key, F.concat(F.lit("kp_"), (F.col("place") + 1).cast("string")).alias("node_id"), "name")


def _texts(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def _unsourced(kind: str) -> Column:
    """The warning of a template that had no fragments."""
    return F.when(F.coalesce(F.size("fragments"), F.lit(0)) > 0, "").otherwise(NO_SOURCE[kind])


def keypoints(requests: DataFrame) -> DataFrame:
    """``key_points`` and the warning for ``(points, fragments)``: five points in focus, three of them hard and asked for. Null lists are empty."""
    points = F.coalesce("points", _texts())
    one = F.struct(F.slice(points, 1, 5).alias("core_focus"), F.slice(points, 1, 3).alias("learning_difficulties"), F.slice(points, 1, 3).alias("common_exam_points"), _texts().alias("common_mistakes"), _texts().alias("confusing_concepts"), _texts(*METHODS).alias("breakthrough_methods"), F.lit("").alias("source_reference"))
    return requests.withColumns({"key_points": F.array(one), "insufficient_data_warning": _unsourced("keypoint")})


def explanation(requests: DataFrame) -> DataFrame:
    """``concept_explanation, key_steps`` and the warning for ``(knowledge_point, fragments)``."""
    said = F.concat(T.text_or_empty(F.col("knowledge_point")), F.lit(CORE_OF_SECTION))
    return requests.withColumns({"concept_explanation": said, "key_steps": _texts(*KEY_STEPS), "insufficient_data_warning": _unsourced("explanation")})


def tutor(requests: DataFrame) -> DataFrame:
    """The tutor's statement, for ``(question_text, knowledge_point)``, that there is no answer yet, and what to review."""
    point = T.text_or_empty(F.col("knowledge_point"))
    fixed = {k: _texts(v) if k in ("complete_steps", "common_mistakes") else F.lit(v) for k, v in TUTOR.items()}
    review = F.when(point != "", F.array(point)).otherwise(_texts())
    return requests.withColumns({"answer_status": F.lit("insufficient"), "question_recognition": T.text_or_empty(F.col("question_text")), "difficulty": F.lit("medium"), "final_answer": F.lit(""), "recommended_review": review} | fixed)


def diagnosis(requests: DataFrame) -> DataFrame:
    """``is_correct, score`` and what follows, for ``(standard_answer, student_answer, knowledge_point, fragments)``: right if both are there and alike but for blanks at their ends."""
    a, b, point = (T.text_or_empty(F.col(c)) for c in ("standard_answer", "student_answer", "knowledge_point"))
    right = F.col("is_correct")
    out = requests.withColumn("is_correct", (a != "") & (b != "") & (T.strip(a) == T.strip(b)))
    return out.withColumns({
        "score": F.when(right, 100.0).otherwise(0.0),
        "error_steps": F.when(right, _texts()).otherwise(_texts(DIFFERS)),
        "error_type": F.when(right, "").otherwise("unknown"),
        "error_reason": F.when(right, "").otherwise(NO_REASON),
        "involved_knowledge": F.when(point != "", F.array(point)).otherwise(_texts()),
        "remediation_suggestions": F.when(right, _texts()).otherwise(_texts(*REMEDIES)),
        "recommended_variant_count": F.lit(3),
        "insufficient_data_warning": _unsourced("diagnosis"),
    })


def profiles(learners: DataFrame, mistakes: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """A cautious profile for each of ``learners``: the points and reasons of their mistakes in order, and a warning where nothing is known.

    ``mistakes (key, order, knowledge_point, error_reason)``; of ``records``
    only whether a learner has any counts. Repeated points are listed once, at
    their first place, so a row holds no more than there are points and reasons.
    """

    def listed(column: str, name: str) -> DataFrame:
        first = mistakes.where(F.coalesce(column, F.lit("")) != "").groupBy(key, column).agg(F.min(order).alias("_at"))
        return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", column))), lambda x: x[column]).alias(name))

    known = records.select(key).union(mistakes.select(key)).distinct().withColumn("_known", F.lit(True))
    out = learners.join(listed("knowledge_point", "weak_knowledge_points"), key, "left").join(listed("error_reason", "common_error_reasons"), key, "left").join(known, key, "left")
    lists = {c: F.coalesce(c, _texts()) for c in ("weak_knowledge_points", "common_error_reasons")}
    fixed = {"current_stage": F.lit(FIRST_STAGE), "course_progress": F.lit(0.0), "learning_pace": F.lit("medium"), "next_stage_suggestions": F.lit(NEXT_STAGE)}
    return out.withColumns(lists | fixed | {"insufficient_data_warning": F.when(F.col("_known"), "").otherwise(FEW_RECORDS)}).drop("_known")


def adaptive_path(requests: DataFrame) -> DataFrame:
    """Tomorrow's task and the order of review for ``(weak_knowledge_points, daily_study_time, exam_date)``; a null list is a missing profile."""
    weak = F.coalesce("weak_knowledge_points", _texts())
    task = F.struct(F.lit(1).alias("day"), F.lit(WEAK_TASK).alias("task_name"), F.lit(WEAK_TEXT).alias("task_description"), F.lit("review").alias("task_type"), F.coalesce("daily_study_time", F.lit(60)).alias("estimated_time_minutes"), F.slice(weak, 1, 3).alias("knowledge_points"), F.lit("medium").alias("difficulty"), F.lit("high").alias("priority"))
    warning = F.when(F.col("weak_knowledge_points").isNull(), NO_PROFILE).otherwise("")
    return requests.withColumns({"need_relearn_points": weak, "review_priority": weak, "tomorrow_tasks": F.array(task), "estimated_completion_time": T.text_or_empty(F.col("exam_date").cast("string")), "adjustment_reasons": _texts(WEAK_FIRST), "insufficient_data_warning": warning})


def learning_actions(requests: DataFrame) -> DataFrame:
    """``actions``: review of weak points or else preview, then practice, then remedy; a plea for material where none applies."""
    three = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
    act = lambda kind, about: F.struct(F.lit(kind).alias("type"), about.alias("about"))
    first = F.when(F.size("weak_points") > 0, act("review", three("weak_points"))).when(F.size("points") > 0, act("preview", three("points")))
    found = F.array_compact(F.array(first, F.when(F.col("has_exercises"), act("practice", F.lit(""))), F.when(F.col("has_diagnosis"), act("remediate", F.lit("")))))
    return requests.withColumn("actions", F.when(F.size(found) > 0, found).otherwise(F.array(act("clarify", F.lit("")))))


def is_template_answer(summary: Column, steps: Column, final_answer: Column) -> Column:
    """No final answer, and two or more phrases of the template."""
    said = F.concat(T.text_or_empty(summary), F.lit(" "), F.array_join(steps, " "))
    hits = sum((F.when(F.contains(said, F.lit(m)), 1).otherwise(0) for m in TEMPLATE_MARKERS), F.lit(0))
    return (T.text_or_empty(final_answer) == "") & (hits >= 2)


def _absent(doc: Column, field: str) -> Column:
    """A JSON object lacks a field, or it is null, blank or empty."""
    v = F.get_json_object(doc, f"$.{field}")
    return v.isNull() | (T.strip(v) == "") | v.isin("[]", "{}")


def completeness(results: DataFrame, kind: str = "task_type", doc: str = "result") -> DataFrame:
    """Adds ``issues`` array<struct<field, issue_type, severity>> of JSON results: required fields by task, references, the warning."""
    r, k = F.col(doc), F.col(kind)
    issue = lambda field, what, severity: F.struct(F.lit(field).alias("field"), F.lit(what).alias("issue_type"), F.lit(severity).alias("severity"))
    warning = F.length(T.text_or_empty(F.get_json_object(r, "$.insufficient_data_warning"))) > 10
    refs = F.get_json_object(r, "$.references")
    rules = [F.when(warning, issue("insufficient_data_warning", "incomplete", "major")), F.when(refs.isNull() | (refs == "[]"), issue("references", "missing_reference", "minor"))]
    rules += [F.when((k == task) & _absent(r, f), issue(f, "incomplete", "major" if f in MAJOR else "minor")) for task, fields in REQUIRED.items() for f in fields]
    broken = F.try_parse_json(r).isNull()
    return results.withColumn("issues", F.when(broken, F.array(issue("_root", "invalid_json", "critical"))).otherwise(F.array_compact(F.array(*rules))))


def ungrounded(result: Column, references: Column) -> Column:
    """The result is more than five times as long as its references, if there are any."""
    n = F.length(F.array_join(F.filter(references, lambda x: x.isNotNull() & (x != "")), "\n"))
    return (n > 0) & (F.length(result) > 5 * n)


def severity_counts(issues: Column) -> Column:
    """struct(critical, major, minor, fields): how many findings of each weight, and their distinct fields."""
    n = lambda s: F.size(F.filter(issues, lambda x: x["severity"] == s)).cast("long").alias(s)
    return F.struct(n("critical"), n("major"), n("minor"), F.array_distinct(F.transform(issues, lambda x: x["field"])).alias("fields"))


def all_issues(rules: Column, model: Column) -> Column:
    """Findings of the rules, then of a model."""
    return F.concat(F.coalesce(rules, F.array().cast("array<struct<field:string,issue_type:string,severity:string>>")), F.coalesce(model, F.array().cast("array<struct<field:string,issue_type:string,severity:string>>")))


def repeated_days(plans: DataFrame) -> DataFrame:
    """Adds ``repeated``: the indexes (from 0) of daily tasks whose day came before."""
    days = F.transform("daily_tasks", lambda t: t["day"])
    return plans.withColumn("_days", days).withColumn("repeated", F.filter(F.transform("_days", lambda d, i: F.when(F.array_position("_days", d) <= i, i)), lambda x: x.isNotNull())).drop("_days")


def study_plan_errors(doc: Column) -> Column:
    """Messages about a study plan in JSON."""
    v = F.try_parse_json(doc)
    title, total, tasks = (F.try_variant_get(v, f"$.{f}", t) for f, t in (("title", "string"), ("total_time_minutes", "int"), ("daily_tasks", "array<variant>")))
    has = lambda f: F.get_json_object(doc, f"$.{f}").isNotNull()
    missing = lambda t, i: F.array_compact(F.array(*[F.when(~F.coalesce(F.array_contains(F.json_object_keys(F.to_json(t)), f), F.lit(False)), F.concat(F.lit("daily_tasks["), i.cast("string"), F.lit(f"]缺少{f}字段"))) for f in PLAN_TASK]))
    per_task = F.coalesce(F.flatten(F.transform(tasks, missing)), F.array().cast("array<string>"))
    head = F.array_compact(F.array(F.when(~has("title"), "缺少title字段").when(title.isNull(), "title必须是字符串"), F.when(~has("total_time_minutes"), "缺少total_time_minutes字段").when(total.isNull(), "total_time_minutes必须是整数"), F.when(has("daily_tasks") & tasks.isNull(), "daily_tasks必须是列表")))
    return F.concat(head, per_task)


def exercise_errors(doc: Column) -> Column:
    """Messages about an exercise set in JSON."""
    v = F.try_parse_json(doc)
    qs = F.try_variant_get(v, "$.questions", "array<variant>")
    has = F.get_json_object(doc, "$.questions").isNotNull()
    at = lambda i, f: F.concat(F.lit("questions["), i.cast("string"), F.lit(f))
    level = lambda q: F.get_json_object(F.to_json(q), "$.difficulty")
    one = lambda q, i: F.array_compact(
        F.array(
            *[F.when(~F.coalesce(F.array_contains(F.json_object_keys(F.to_json(q)), f), F.lit(False)), at(i, f"]缺少{f}字段")) for f in QUESTION],
            F.when(level(q).isNotNull() & ~level(q).isin(*LEVELS), at(i, "].difficulty必须是easy/medium/hard")),
            F.when(F.get_json_object(F.to_json(q), "$.options").isNotNull() & ~F.get_json_object(F.to_json(q), "$.options").startswith("["), at(i, "].options必须是列表")),
        )
    )
    per = F.coalesce(F.flatten(F.transform(qs, one)), F.array().cast("array<string>"))
    return F.concat(F.array_compact(F.array(F.when(~has, "缺少questions字段").when(qs.isNull(), "questions必须是列表"))), per)


def exam_check(papers: DataFrame) -> DataFrame:
    """Adds ``total, is_valid``: scores add up to the paper's total within 0.1; a total of 0 or none counts as their sum."""
    total = F.aggregate("questions", F.lit(0.0), lambda a, q: a + F.coalesce(q["score"].cast("double"), F.lit(0.0)))
    expected = F.coalesce(F.nullif(F.col("total_score").cast("double"), F.lit(0.0)), F.col("total"))
    return papers.withColumn("total", total).withColumn("is_valid", (F.size("questions") == 0) | (F.abs(F.col("total") - expected) <= 0.1))
