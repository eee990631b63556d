"""Operators on small hand-made tables."""

import io
import math
import zipfile

from pyspark.sql import functions as F

from scholium.operators import analytics as A
from scholium.operators import knowledge as K
from scholium.operators import retrieval as R
from scholium.operators import structure as S
from scholium.sources import documents, sinks
from scholium.streaming import activity


def test_bm25_formula(spark):
    texts = ["a b", "a a c", "d", "e f g"]
    f = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = {r[0]: r[1] for r in R.bm25(f, "A d").collect()}
    avg = sum(len(t.split()) for t in texts) / 4

    def part(tf, df, dl):
        return max(math.log((4 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    want = {0: part(1, 2, 2), 1: part(2, 2, 3), 2: part(1, 1, 1)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 9.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(R.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 1 / math.sqrt(2)) < 1e-12 and got[1:] == [0.0, 0.0, 0.0]


def test_fusion_keeps_both_sides(spark):
    kw = spark.createDataFrame([(1, 2.0), (2, 1.0)], "chunk_id long, keyword_score double")
    vec = spark.createDataFrame([(2, 0.5), (3, 0.25)], "chunk_id long, vector_score double")
    got = {r["chunk_id"]: round(r["score"], 6) for r in R.fused(kw, vec).collect()}
    assert got == {1: 0.45, 2: 0.775, 3: 0.275}


def test_relaxation(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, lang string")
    ids = lambda s: sorted(r[0] for r in R.relaxed(f, F.col("lang") == s, F.lit(True)).collect())
    assert ids("a") == [1] and ids("zz") == [1, 2]


def test_context_stops_at_first_overflow(spark):
    h = spark.createDataFrame([("q", 1, "x" * 10, "c"), ("q", 2, "y" * 100, "c"), ("q", 3, "z", "c")], "q string, rank int, text string, citation string")
    assert [r["rank"] for r in R.context(h, "rank", 60, ["q"]).collect()] == [1]


def test_predicates(spark):
    f = spark.createDataFrame([(1, 5, "a"), (2, 9, "b")], "id long, n int, l string")
    assert [r[0] for r in f.where(R.compiled({"n": {"$gte": 6}, "$and": [{"l": ["b", "c"]}]})).collect()] == [2]
    assert R.filtered(f, {"l": "", "n": [5, 9]}).count() == 2


TEXTBOOK = "第一章 函数\n定义 函数是指一种对应。\n例 1 求值\n第二章 极限\n习题 1\nplain"


def test_spans_and_blocks(spark):
    rows = S.lines(spark.createDataFrame([(1, TEXTBOOK), (2, None)], "doc_id long, text string"))
    spans = S.spans(rows, F.col("line").startswith("第")).orderBy("line_start").collect()
    assert [(r["title"], r["line_start"], r["line_end"]) for r in spans] == [("第一章 函数", 0, 2), ("第二章 极限", 3, 5)]
    blocks = S.typed_blocks(rows).orderBy("block_no").collect()
    assert [(r["content_type"], r["n_lines"]) for r in blocks] == [("explanation", 1), ("definition", 1), ("example", 2), ("exercise", 2)]


def test_edge_lines_are_removed(spark):
    pages = spark.createDataFrame([(i, "b", f"Running head\nbody {i}\nmore {i}\nlast {i}") for i in range(4)], "doc_id long, book string, text string")
    rep = S.edge_lines(pages, "book")
    assert [(r["line"], r["n"]) for r in rep.collect()] == [("Running head", 4)]
    left = S.without_edge_lines(pages, rep, "book").orderBy("doc_id").first()["text"]
    assert left == "body 0\nmore 0\nlast 0"


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    parts = [r["chunk"] for r in S.fixed_windows(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_no").collect()]
    assert parts[0] == text[:900] and parts[1] == text[780:1680] and text.endswith(parts[-1])


def test_packed_sentences(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "text string").select(S.sentences(F.col("text"))).first()[0]
    parts = S.packed(cut("句子。" * 500), 800, 120)
    assert all(len(p) <= 923 for p in parts) and parts[1].startswith(parts[0][-120:])
    assert S.packed([]) == [] and cut(None) == []


def test_answers_round_half_up_and_unclassified(spark):
    a = spark.createDataFrame([("u", True)] + [("u", False)] * 7, "user_id string, is_correct boolean")
    assert A.answer_overview(a, "user_id").first()["accuracy"] == 12.5
    m = spark.createDataFrame([("u", ""), ("u", None), ("u", "x")], "user_id string, error_type string")
    assert {r["error_type"]: r["n"] for r in A.error_histogram(m, ["user_id"]).collect()} == {"未分类": 2, "x": 1}


def test_merge_keeps_old_columns(spark):
    old = spark.createDataFrame([(1, "a", "2020"), (2, "b", "2021")], "id long, name string, created string")
    new = spark.createDataFrame([(2, None, "2025"), (3, "c", "2025")], "id long, name string, created string")
    got = {r["id"]: (r["name"], r["created"]) for r in A.merged(old, new, "id", ["created"]).collect()}
    assert got == {1: ("a", "2020"), 2: ("b", "2021"), 3: ("c", "2025")}


def test_similar_names(spark):
    n = spark.createDataFrame([("c", 1, "limit of functions"), ("c", 2, "functions limit of"), ("c", 3, "matrix rank"), ("d", 4, "limit of functions")], "per string, id long, name string")
    assert [(r["a"], r["b"]) for r in K.similar_names(n).collect()] == [(1, 2)]


def _zip(**members) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/") + ".xml", v)
    return b.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 第一章\ntext")
    (tmp_path / "b.csv").write_text("x,y\n1,2")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "c.docx").write_bytes(_zip(word__document=doc))
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    (tmp_path / "d.pptx").write_bytes(_zip(ppt__slides__slide2=f"<s {a}><a:p><a:t>two</a:t></a:p></s>", ppt__slides__slide10=f"<s {a}><a:p><a:t>ten</a:t></a:p></s>", ppt__slides__slide3=f"<s {a}/>"))
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {(r["document_id"].rsplit("/", 1)[-1], r["page_no"]): (r["text"], r["failure_reason"] is not None) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got[("a.md", 1)] == ("# 第一章\ntext", False) and got[("b.csv", 1)][0] == "x,y\n1,2"
    assert got[("c.docx", None)] == ("Hello\n1 | 2", False)
    assert got[("d.pptx", 2)][0] == "two" and got[("d.pptx", 10)][0] == "ten" and ("d.pptx", 3) not in got
    assert got[("e.docx", None)] == ("", True)


def test_sinks(spark):
    old = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, n int")
    new = spark.createDataFrame([("d1", 7, "x")], "document_id string, n int, more string")
    assert sorted(tuple(r) for r in sinks.replaced(old, new).collect()) == [("d1", 7, "x"), ("d2", 2, None)]
    g = sinks.graph_json(old.select(F.col("document_id").alias("node_id")), new.select(F.col("document_id").alias("source"))).collect()
    assert len(g) == 4


def test_streaming_daily_study(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select * from values (1, timestamp'2024-01-01 10:00:00', 30), (1, timestamp'2024-01-01 11:00:00', 20), (2, timestamp'2024-01-03 10:00:00', 5) as t(user_id, ts, seconds)").write.parquet(str(src))
    stream = spark.readStream.schema("user_id int, ts timestamp, seconds int").parquet(str(src))
    q = activity.daily_study(stream).writeStream.outputMode("append").format("memory").queryName("study").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["user_id"], r["seconds"], r["events"]) for r in spark.table("study").collect()] == [(1, 50, 2)]
