"""Pages of an Arrow batch are taken apart in pieces; lines that stay empty keep their places."""

import tracemalloc

import pyarrow as pa

from scholium.llm import extract


def batch(n: int, size: int) -> pa.RecordBatch:
    html = "<p>" + "word " * (size // 5) + "</p>"
    return pa.RecordBatch.from_arrays([pa.array(["h.example"] * n), pa.array([html] * n)], names=["host", "html"])


def test_a_batch_is_not_made_python_strings_as_a_whole():
    b = batch(1000, 100_000)
    parts = list(extract.pieces(b))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) < 60
    assert [p.num_rows for p in extract.pieces(batch(3, 9_000_000))] == [1, 1, 1] and list(extract.pieces(b.slice(0, 0))) == []
    tracemalloc.start()
    seen = sum(len(lines) for part in extract.pieces(b) for _, lines, _, _ in extract.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 1000 and peak < 20 << 20  # the batch's pages are 100 MB


def test_pieces_do_not_change_texts(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i}", f"<nav>menu</nav><p>shared line</p><p>own {i} &amp; more</p><footer>end</footer><p></p><p>tail {i}</p>") for i in range(40)]
    rows += [(100, "http://a.example/x", None), (101, None, ""), (102, "http://b.example/", "<nav>only</nav>"), (103, "http://c.example/", "<p>alone</p>")]
    rows += [(104, "http://c.example/big", "<p>" + "long " * 2_000_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.main_text(df.coalesce(1)).collect()}
    assert len(got) == len(rows) and all(got[i] == f"own {i} & more\ntail {i}" for i in range(40))
    assert got[100] == got[101] == got[102] == "" and got[103] == "alone" and len(got[104]) == 5 * 2_000_000 - 1
