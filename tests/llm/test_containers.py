"""Furniture inside article containers goes by differencing, comments by their class."""

from scholium.llm import extract


def test_container_lines(spark):
    page = lambda i, extra="": (i, f"http://h.org/{i:03}", f"<article><p>Story {i} told here at some length</p>{extra}<p>Subscribe to us</p></article><p>by</p>")
    rows = [page(i, "<p>A passage of two</p>" if i in (4, 5) else "") for i in range(10)]
    same = "<p>" + "long text of one article " * 5 + "</p>"
    rows += [(20 + i, f"http://v.org/{i}", f"<article>{same}<p>version {i}</p></article>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.main_text(df).collect()}
    for i in range(10):
        assert got[i] == f"Story {i} told here at some length" + ("\nA passage of two" if i in (4, 5) else "")
    assert all("long text" in got[20 + i] and f"version {i}" in got[20 + i] for i in range(5))


def test_comment_classes():
    assert extract.marked("div", ' class="post-comments"') and extract.marked("div", ' class="article-comments"')
    assert not extract.marked("div", ' class="has-comments"') and not extract.marked("div", ' class="post-header"')


def test_attributes_are_read_one_by_one():
    keeps = ('style="overflow:hidden"', 'data-hidden="x"', 'data-id="comments"', "data-role=nav", 'title="id=nav hidden"', "hiddenish")
    assert not any(extract.marked("div", f" {a}") for a in keeps)
    assert extract.marked("div", " hidden") and extract.marked("div", ' HIDDEN=""') and extract.marked("p", ' aria-hidden="true"') and extract.marked("div", " id=sidebar")
    assert not extract.marked("h2", ' id="related-work"') and not extract.marked("section", ' id="related-work"', True) and extract.marked("section", ' class="related"', True)


def test_text_kept_in_articles():
    page = '<article><h2 id="related-work">Related work</h2><div style="overflow:hidden"><p>Kept text</p></div><section id="notice"><p>More</p></section><div class="ad">Buy</div></article>'
    assert [t for _, t in extract.lines_of(page)] == ["Related work", "Kept text", "More"]
