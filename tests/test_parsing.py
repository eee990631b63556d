"""Page decisions, rewriting and generators on hand-made rows."""

from pyspark.sql import functions as F

from scholium.operators import parsing as P

SCHEMA = "document_id string, ord int, text string, image_count int, image_coverage double"


def test_profiles_and_budget(spark):
    rows = [("a", i, "", 1, 0.9) for i in range(4)] + [("a", 4, "long enough text " * 5, 0, 0.0), ("b", 0, "full page of text " * 9, 0, None), ("b", 1, None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert [r["is_scanned"] for r in P.page_profile(pages).orderBy("document_id", "ord").collect()] == [True] * 4 + [False] * 3
    assert {r["document_id"]: r["likely_scanned"] for r in P.scan_profile(pages).collect()} == {"a": True, "b": False}
    done = P.ocr_budget(pages, 2).where("do_ocr").select("document_id", "ord").collect()
    assert sorted(map(tuple, done)) == [("a", 0), ("a", 1), ("b", 1)]


def test_text_choice(spark):
    df = spark.createDataFrame([("abc", "abcd"), ("abcd", "ab"), ("", "x"), (None, None)], "d string, o string")
    got = [tuple(r[0]) for r in df.select(P.chosen_text(F.col("d"), F.col("o"))).collect()]
    assert got == [("abcd", "mixed"), ("abcd", "direct"), ("x", "ocr"), ("", "direct")]


def test_cache(spark):
    pages = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 1)], "md5 string, page int").withColumn("key", P.cache_key("md5", "page"))
    cache = pages.limit(2).select("key").withColumn("text", F.lit("t")).withColumn("success", F.lit(True))
    assert P.uncached(pages, cache).count() == 1


def test_rewriting(spark):
    df = spark.createDataFrame([("请问这个极限怎么求吗？", "极限", "第一章", ""), ("Please explain limits?", None, "limits", "calculus")], "q string, k string, c string, n string")
    got = [r[0] for r in df.select(P.rewritten(*[F.col(x) for x in "qkcn"])).collect()]
    assert got == ["极限怎么求吗 第一章", "Please explain limits calculus"]  # one closing mark goes; what is lacking follows


def test_generators(spark):
    p = spark.createDataFrame([(1, ["a", "b"], 3, 100.0), (2, [], 1, 10.0)], "paper_id int, points array<string>, n int, total_score double")
    q = {r["paper_id"]: [tuple(x) for x in r["questions"]] for r in P.exam_papers(p).collect()}
    assert q == {1: [("Q001", "a", 33.33), ("Q002", "b", 33.33), ("Q003", "a", 33.33)], 2: [("Q001", None, 10.0)]}
    lesson = spark.createDataFrame([(300,), (50,)], "duration int")
    assert [[x["seconds"] for x in r["sections"]] for r in P.micro_lessons(lesson).collect()] == [[30, 240, 30], [30, 30, 30]]
