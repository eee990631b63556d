"""Dashboards, reports, generated material, review rules, sinks, services and stateful streaming on small tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from scholium import services
from scholium.functions import batch
from scholium.operators import analytics as A
from scholium.operators import generators as G
from scholium.operators import lookups as L
from scholium.operators import structure as S
from scholium.sources import sinks
from scholium.streaming import activity

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(1, T0 + datetime.timedelta(minutes=i), i, f"a{i % 3}", i % 3 > 0, "", i % 2 == 0, 10) for i in range(12)] + [(2, T0, 100, "a", True, None, False, 5)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, action string, is_correct boolean, error_type string, mastered boolean, seconds long")


def test_learner_record(answers):
    got = {r["user_id"]: r for r in A.learner_record(answers, answers.where("NOT is_correct"), answers, answered=6, shown=2).collect()}
    assert (got[1]["total"], got[1]["correct"], got[1]["accuracy"], got[1]["mistake_count"], got[1]["mastered_count"]) == (6, 4, 66.7, 2, 2)
    assert got[1]["recent_actions"] == ["a2", "a1"] and got[2]["mistake_count"] == 0


def test_stale_profiles(spark, answers):
    rec = A.learner_record(answers, answers.where("NOT is_correct"), answers)
    assert [r["user_id"] for r in A.stale_profiles(rec, spark.createDataFrame([(1, 12)], "user_id long, total_answers long")).collect()] == [2]


def test_student_dashboard(spark, answers):
    plans = spark.createDataFrame([(1,)] * 7, "user_id long")
    got = {r["user_id"]: r for r in A.student_dashboard(answers, answers.where("NOT is_correct"), plans, answers).collect()}
    assert got[1]["plan_count"] == 5 and got[1]["error_types"] == {"未分类": 2} and got[1]["daily_seconds"] == {T0.date(): 120}
    assert (got[2]["total"], got[2]["unmastered"], got[2]["error_types"]) == (1, 0, None)


def test_course_list_and_teacher(spark):
    courses = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "course_id string, created_at int")
    ch = spark.createDataFrame([("a",), ("a",), ("c",)], "course_id string")
    fr = spark.createDataFrame([("a", "d1"), ("a", "d1"), ("a", "d2")], "course_id string, document_id string")
    got = {r["course_id"]: r for r in A.course_list(courses, ch, ch.limit(0), fr, newest=2).collect()}
    assert set(got) == {"b", "c"} and got["c"]["chapter_count"] == 1 and got["c"]["document_count"] == 0
    ex = spark.createDataFrame([("e1", "a"), ("e2", "a")], "exercise_id string, course_id string")
    an = spark.createDataFrame([("e1", True), ("e1", False), ("e2", True), ("zz", True)], "exercise_id string, is_correct boolean")
    mi = spark.createDataFrame([("a", None), ("a", "x"), ("a", "")], "course_id string, error_type string")
    t = {r["course_id"]: r for r in A.teacher_overview(fr.select("course_id"), ch, fr, ex, an, mi).collect()}
    assert (t["a"]["total_submissions"], t["a"]["correct_submissions"], t["a"]["average_accuracy"], t["a"]["mistake_count"]) == (3, 2, 66.7, 3)
    assert t["a"]["error_types"] == {"x": 1, "未分类": 2} and t["c"]["average_accuracy"] == 0


def test_generation_metadata(spark):
    df = spark.createDataFrame([(["ab", "c"], [str(i) for i in range(10)]), ([], [])], "fragments array<string>, knowledge_points array<string>")
    a, b = A.generation_metadata(df).collect()
    assert (a["source_char_count"], len(a["knowledge_points_preview"]), a["has_source_material"]) == (3, 8, True) and not b["has_source_material"]


def test_generators(spark):
    q = spark.createDataFrame([(["x", "y"], [], 3, "ch"), ([], ["fill_in"], 0, "ch")], "points array<string>, question_types array<string>, n int, chapter string")
    a, b = G.exercises(q).collect()
    assert [(x["knowledge_point"], x["question_type"]) for x in a["questions"]] == [("x", "multiple_choice"), ("y", "fill_in"), ("x", "short_answer")]
    assert len(b["questions"]) == 1 and "ch" in b["questions"][0]["stem"]
    s = G.slides(spark.createDataFrame([(8,)], "total_slides int")).first()["slides"]
    assert [x["slide_title"] for x in s][-2:] == ["总结", "学习目标"]
    c = G.course_structure(spark.createDataFrame([("m", "", "t" * 400, "f1"), ("m", "c", None, None)], "course_name string, chapter_name string, chapter_text string, fragment_id string")).collect()
    assert c[0]["chapter_name"] == "未命名章节" and len(c[0]["chapter_summary"]) == 300 and c[0]["references"] == ["f1"] and c[1]["insufficient_data_warning"]
    n = G.name_graph(spark.createDataFrame([(1, ["a", "b"])], "id int, points array<string>"), "id").collect()
    assert [r["node_id"] for r in n] == ["kp_1", "kp_2"]


def test_review_rules(spark):
    plan = {"title": "t", "total_time_minutes": "x", "daily_tasks": [{"day": 1, "task_name": "n"}]}
    quiz = {"questions": [{"question_id": 1, "question_type": "a", "difficulty": "odd", "stem": "s", "options": 3}]}
    df = spark.createDataFrame([(json.dumps(plan), json.dumps(quiz)), ("{}", "{}")], "p string, q string")
    a, b = df.select(G.study_plan_errors(F.col("p")).alias("p"), G.exercise_errors(F.col("q")).alias("q")).collect()
    assert a["p"] == ["total_time_minutes必须是整数", "daily_tasks[0]缺少task_description字段", "daily_tasks[0]缺少estimated_time_minutes字段"]
    assert a["q"] == ["questions[0]缺少correct_answer字段", "questions[0].difficulty必须是easy/medium/hard", "questions[0].options必须是列表"]
    assert b["p"] == ["缺少title字段", "缺少total_time_minutes字段"] and b["q"] == ["缺少questions字段"]
    t = spark.createDataFrame([("识别题目 then 整理条件", [], ""), ("识别题目", ["整理条件"], "x = 1"), ("识别题目", [], "")], "s string, steps array<string>, f string")
    assert [r[0] for r in t.select(G.is_template_answer(F.col("s"), F.col("steps"), F.col("f"))).collect()] == [True, False, False]
    g = spark.createDataFrame([("x" * 60, ["ab", None, "cdefghi"]), ("x" * 40, ["abcdefghi"]), ("x", [])], "r string, refs array<string>")
    assert [r[0] for r in g.select(G.ungrounded(F.col("r"), F.col("refs"))).collect()] == [True, False, False]
    d = spark.createDataFrame([([(1,), (2,), (1,), (1,)],)], "daily_tasks array<struct<day:int>>")
    assert G.repeated_days(d).first()["repeated"] == [2, 3]
    e = spark.createDataFrame([([(50.0,), (49.95,)], 100.0), ([(1.0,)], 0.0), ([(1.0,)], 2.0)], "questions array<struct<score:double>>, total_score double")
    assert [r["is_valid"] for r in G.exam_check(e).collect()] == [True, True, False]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("d1", 1, "x"), ("d1", 2, "y"), ("d2", 1, "z")], "document_id string, page_no int, text string")
    new = spark.createDataFrame([("d1", 1, "new")], "document_id string, page_no int, text string")
    failed = spark.createDataFrame([("d1", 2, "damaged")], "document_id string, page_no int, failure_reason string")
    got = {(r["document_id"], r["page_no"]): (r["text"], r["failure_reason"]) for r in sinks.replaced_pages(pages, new, failed).collect()}
    assert got == {("d1", 1): ("new", None), ("d1", 2): (None, "damaged"), ("d2", 1): ("z", None)}
    assert sinks.replaced(pages, new, ["document_id", "page_no"]).count() == 3
    path = str(tmp_path / "pages")
    sinks.overwrite_documents(pages, path)
    sinks.overwrite_documents(new, path)
    assert {(r["document_id"], r["text"]) for r in spark.read.parquet(path).collect()} == {("d1", "new"), ("d2", "z")}
    left = sinks.removed({"a": pages, "b": new}, spark.createDataFrame([("d1",)], "document_id string"))
    assert (left["a"].count(), left["b"].count()) == (1, 0)
    fr = spark.createDataFrame([("k1", "t", None, "x"), ("k2", "", [1.0], "y"), ("k3", "u", [2.0], None)], "chunk_id string, text string, embedding array<double>, embedding_id string")
    assert [r["embedding_id"] for r in sinks.with_embedding_ids(fr, fr.where("chunk_id = 'k1'")).orderBy("chunk_id").collect()] == ["emb_k1", "y", None]
    assert {r["chunk_id"]: r["metadata"] for r in sinks.vectors(fr).collect()} == {"k1": '{"embedding_id":"x"}', "k3": "{}"}
    rows = spark.createDataFrame([(T0,), (T0 + datetime.timedelta(hours=30),)], "ts timestamp")
    assert sinks.live(rows, F.lit(T0 + datetime.timedelta(hours=40))).count() == 1
    n = spark.createDataFrame([("c", "n1", "chapter", "x", 0.9), ("e", "n2", "chapter", "y", 0.9)], "course_id string, node_id string, node_type string, name string, confidence double")
    e = spark.createDataFrame([("c", "n1", "n1", "r", 1.0)], "course_id string, source string, target string, relation string, weight double")
    got = {r[0]: json.loads(r[1]) for r in sinks.graph_object(n, e).collect()}
    assert (got["c"]["node_count"], got["c"]["edge_count"], got["e"]["edges"]) == (1, 1, [])
    assert sinks.student_version(spark.createDataFrame([(1, "a", "b")], "id int, stem string, answer string")).columns == ["id", "stem"]


class Embed:
    def embed(self, texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]


class Rank:
    def scores(self, query, texts):
        return [float(t.count(query)) for t in texts]


class Answer:
    def complete(self, prompt):
        if prompt == "fail":
            raise TimeoutError("late")
        return prompt.upper()


class Read:
    def read(self, image):
        return (image.decode(), 0.9)


def test_services(spark):
    f = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None)], "id int, text string").coalesce(1)
    assert [r["embedding"] for r in services.embedded(f, Embed(), size=1).orderBy("id").collect()] == [[2.0, 1.0], None, [0.0, 1.0]]
    hits = spark.createDataFrame([("k1", "x", 0.5), ("k2", "x x", 0.1)], "chunk_id string, text string, score double")
    assert [r["chunk_id"] for r in services.reranked(hits, "x", Rank(), 2).collect()] == ["k2", "k1"]
    assert [r["chunk_id"] for r in services.reranked(hits, "x", None, 2).collect()] == ["k1", "k2"]
    got = services.completed(spark.createDataFrame([("hi",), ("fail",)], "prompt string"), Answer(), "fallback").collect()
    assert {(r["answer"], r["warning"]) for r in got} == {("HI", None), ("fallback", "TimeoutError: late")}
    pages = services.recognised(spark.createDataFrame([(bytearray(b"txt"),), (bytearray(b"\xff"),)], "image binary"), Read()).collect()
    assert pages[0]["ocr_text"] == "txt" and pages[1]["failure_reason"].startswith("UnicodeDecodeError")


def test_mastery_stream(spark, tmp_path):
    rows = [(1, T0, True), (1, T0, False), (2, T0, True)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, is_correct boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("user_id = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = activity.mastery(stream).writeStream.outputMode("update").format("memory").queryName("mastery").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["user_id"]: (r["total"], r["correct"]) for r in spark.sql("select user_id, max(total) total, max(correct) correct from mastery group by 1").collect()}
    assert got[1] == (4, 2) and got[2] == (1, 1)


def test_lookups(spark):
    rows = spark.createDataFrame([("k1", '["a"]', "broken", None, 1), ("k2", None, None, "[1.5]", 0)], "chunk_id string, knowledge_points string, source_refs string, embedding string, is_ocr int")
    a, b = L.decoded(rows).orderBy("chunk_id").collect()
    assert (a["knowledge_points"], a["source_refs"], a["embedding"], a["is_ocr"]) == (["a"], [], [], True) and b["embedding"] == [1.5] and b["knowledge_points"] == []
    pages = spark.createDataFrame([("d", 5, 2), ("d", 1, None), ("d", 3, 1), ("e", 9, 1)], "document_id string, id int, page_no int")
    assert [r["id"] for r in L.pages_of(pages, "d").collect()] == [1, 3, 5]
    points = spark.createDataFrame([("c", "h1", "t", 2, "b"), ("c", "h2", "t", 1, "a"), ("x", "h1", "t", 1, "z")], "course_id string, chapter_id string, kp_type string, created_at int, kp_id string")
    assert [r["kp_id"] for r in L.points_of(points, "c").collect()] == ["a", "b"] and L.points_of(points, "c", "h1").count() == 1
    scores = spark.createDataFrame([(-20.0,), (0.0,), (30.0,)], "s double")
    assert [r[0] for r in scores.select(L.rerank_share(F.col("s"))).collect()] == [0.0, 0.5, 1.0]
    docs = spark.createDataFrame([('{"a": "", "b": 2}',), ('{"c": 1}',)], "d string")
    assert [r[0] for r in docs.select(L.first_of(F.col("d"), "a", "b", "c")).collect()] == ["2", "1"]
    c = spark.createDataFrame([("s", "x", [1.0, 0.0]), ("s", "y", [0.0, 1.0]), ("t", "z", [1.0, 0.0])], "session_id string, concept string, embedding array<double>")
    assert [r["concept"] for r in L.concepts(c, "s", "", [0.2, 1.0], k=1).collect()] == ["y"]


def test_section_ladder(spark):
    f = spark.createDataFrame([("k1", "c", "1.1 函数：概念"), ("k2", "c", "1.2 函数性质"), ("k3", "c", "2.1 其它"), ("k4", "d", "1.1 函数：概念")], "chunk_id string, course_id string, section_name string")
    find = lambda name: {r["chunk_id"]: r["tier"] for r in L.laddered(f, L.section_tiers(f, name, F.col("course_id") == "c"), ["chunk_id"], ["chunk_id"]).collect()}
    assert find("1.1函数:概念") == {"k1": 0} and find("函数性质") == {"k2": 1} and set(find("zzz")) == {"k1", "k2", "k3"}


def test_best_match(spark):
    q = spark.createDataFrame([("第一章",), ("导数",), ("zzz",)], "query string")
    n = spark.createDataFrame([("第一章 函数",), ("第二章 导数",), ("第二章 导数",)], "name string")
    got = {r["query"]: r["name"] for r in S.best_match(q, n, batch.weighted_ratio_udf, 55.0).collect()}
    assert got == {"第一章": "第一章 函数", "导数": "第二章 导数"}
