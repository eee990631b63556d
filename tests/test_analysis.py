"""Chapters and knowledge points of pages, on a page with a table of contents and on odd pages."""

from scholium.operators import analysis as A

TOC = "目录\n第一章 随机事件……12\n1.1 样本空间 ...... 3\n\n"
ONE = "第一章  随机事件\n1.1 样本空间\n定义1：样本空间是全部结果\n说明\n贝叶斯公式 P(A|B) = x\n例 如下\nChapter II Sets\n因为 1.2 no"


def pages(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_no int, text string")


def test_contents_and_headings_are_one(spark):
    rows = A.lines(pages(spark, [("d", 1, TOC), ("d", 2, ONE), ("n", 1, None), ("e", 1, "")]))
    got = [(c.chapter_index, c.name, c.number, c.page_start, c.page_end) for c in A.chapters(rows).orderBy("chapter_index").collect()]
    assert got == [(0, "第一章 随机事件", "第一章", 1, 1), (1, "1.1 样本空间", "1.1", 1, 1), (2, "Chapter II Sets", "3", 2, 0)]


def test_points_in_order(spark):
    rows = A.lines(pages(spark, [("d", 1, TOC), ("d", 2, ONE)]))
    got = A.points(rows, A.chapters(rows)).orderBy("place").collect()
    assert [(p.name, p.kp_type, p.page_no, p.chapter_index) for p in got] == [
        ("1.1 样本空间", "concept", 1, 1), ("定义1 样本空间是全部结果", "concept", 2, 1), ("例 如下", "method", 2, 1),
        ("样本空间", "concept", 1, 1), ("随机事件", "concept", 1, 0), ("贝叶斯公式", "concept", 2, 1), ("贝叶斯公式 P(A|B) = x", "formula", 2, 1),
    ]
    by = {p.name: p for p in got}
    assert by["定义1 样本空间是全部结果"].definition == "定义1:样本空间是全部结果 说明 贝叶斯公式 P(A|B) = x"
    assert (by["样本空间"].difficulty, by["贝叶斯公式"].difficulty, by["例 如下"].difficulty) == ("easy", "hard", "medium")


def test_caps_and_empty(spark):
    rows = A.lines(pages(spark, [("d", 1, "\n".join(f"a{i} = {i}" for i in range(100)))]))
    assert A.points(rows, A.chapters(rows)).count() == 80
    assert A.points(rows, A.chapters(rows), terms=(), most=5).count() == 5
    none = A.lines(pages(spark, []))
    assert A.points(none, A.chapters(none)).count() == A.chapters(none).count() == 0
