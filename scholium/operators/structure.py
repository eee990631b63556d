"""Lines, headings, blocks and chunks of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.functions import text as T
from scholium.session import written


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, line_no, line``: kept lines, numbered from 0 within the document, inside its own row."""
    return docs.select(key, F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


def adjacent_collapsed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that equal the line kept before them go."""
    before = F.lag("line").over(Window.partitionBy(key).orderBy("line_no"))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("line"))).drop("_before")


def edge_lines(pages: DataFrame, per: str, key: str = "doc_id", least: int = 3, edge: int = 2, most_chars: int = 80) -> DataFrame:
    """``per, line, n``: first and last lines of pages that recur as headers or footers."""
    rows = T.lines(F.col("text"))
    n = F.size("rows")
    ends = F.concat(F.slice("rows", 1, edge), F.when(n > 0, F.slice("rows", F.greatest(F.lit(1), n - edge + 1), F.lit(edge))).otherwise(F.array().cast("array<string>")))
    cand = pages.select(per, key, rows.alias("rows")).select(per, F.explode(ends).alias("line"))
    cand = cand.where((F.length("line").between(3, most_chars)) & ~T.is_page_number(F.col("line")))
    return cand.groupBy(per, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_edge_lines(pages: DataFrame, repeated: DataFrame, per: str, key: str = "doc_id") -> DataFrame:
    """Page texts without the recurring lines."""
    one = lines(pages.select(per, key, "text"), key)
    own = pages.select(key, per)
    kept = one.join(own, key).join(repeated.select(per, "line"), [per, "line"], "left_anti")
    body = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return pages.select(key).join(body, key, "left").select(key, F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("")).alias("text"))


def spans(rows: DataFrame, is_marker: Column, key: str = "doc_id") -> DataFrame:
    """``key, title, line_start, line_end`` of what each marker line opens, up to the next one."""
    w = Window.partitionBy(key).orderBy("line_no")
    last = rows.groupBy(key).agg(F.max("line_no").alias("last"))
    marks = rows.where(is_marker).withColumn("next", F.lead("line_no").over(w))
    return marks.join(last, key).select(key, F.col("line").alias("title"), F.col("line_no").alias("line_start"), F.coalesce(F.col("next") - 1, F.col("last")).alias("line_end"))


def typed_blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, block_no, content_type, line_start, n_lines``: runs that start at a line that opens a definition, example and so on."""
    w = Window.partitionBy(key).orderBy("line_no")
    typed = rows.withColumn("kind", T.block_type(F.col("line"))).withColumn("opens", F.col("kind").isin(*T.BLOCK_OPENERS))
    block = F.sum(F.when(F.col("opens") | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w)
    run = typed.withColumn("block_no", block).groupBy(key, "block_no").agg(
        F.min("line_no").alias("line_start"),
        F.count("*").alias("n_lines"),
        F.min_by("kind", "line_no").alias("first_kind"),
        F.bool_or("opens").alias("opened"),
        F.bool_or(F.col("kind") == "formula").alias("formula"),
    )
    kind = F.when(F.col("opened"), F.col("first_kind")).when(F.col("formula"), "formula").otherwise("explanation")
    return run.select(key, F.col("block_no").cast("long"), kind.alias("content_type"), F.col("line_start").cast("long"), "n_lines")


def fixed_windows(docs: DataFrame, size: int = 900, step: int = 780, least: int = 10, key: str = "doc_id") -> DataFrame:
    """``key, chunk_no, chunk``: overlapping windows; the one that reaches the end is the last."""
    n = F.length("text")
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(float(step))))
    starts = F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1)
    parts = docs.where(n > 0).select(key, F.posexplode(F.transform(starts, lambda i: F.substring(F.col("text"), i * step + 1, F.lit(size)))).alias("chunk_no", "chunk"))
    return parts.where(F.length(T.strip(F.col("chunk"))) >= least)


def plain_windows(docs: DataFrame, size: int = 800, key: str = "doc_id") -> DataFrame:
    return fixed_windows(docs, size, size, 1, key)


def as_of(rows: DataFrame, markers: DataFrame, at: str, marker_at: str, value: str) -> DataFrame:
    """Each row with the value of the last marker at or before it (of equal ones, the largest value).

    Distinct places and markers, one row each, are range-partitioned in order.
    Every partition carries its own markers forward; what precedes its first one
    is the last marker of the partitions before it, which a table of one row a
    partition gives. Rows then meet their place in a join, so neither rows nor
    markers are broadcast unseen and no task sees the whole order.
    """
    marks = markers.groupBy(F.col(marker_at).alias("_at")).agg(F.max(F.struct(F.col(value).alias("v"))).alias("_mark"))
    places = rows.select(F.col(at).alias("_at")).distinct()
    both = places.withColumn("_here", F.lit(True)).join(marks, "_at", "full_outer").where(F.col("_at").isNotNull())
    ranged = written(both.repartitionByRange("_at").withColumn("_part", F.spark_partition_id()))
    last = ranged.where("_mark IS NOT NULL").groupBy("_part").agg(F.max_by("_mark", "_at").alias("_last"))
    parts = ranged.select("_part").distinct().join(last, "_part", "left")
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    carried = F.last("_mark", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    filled = ranged.withColumn("_mark", carried).where("_here").join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")
    filled = filled.select("_at", F.coalesce("_mark", "_before")["v"].alias("_value"))
    return rows.join(filled, F.col(at) == F.col("_at"), "left").withColumn(value, F.col("_value")).drop("_at", "_value")


def carried_forward(df: DataFrame, value: str, by: list[str], order: list) -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


#: A sentence: up to an end mark or a line's end, or what is left at the end of the text.
SENTENCE = r"[^。！？；;!?\n]*[。！？；;!?\n]|[^。！？；;!?\n]+$"


def sentences(c: Column, most: int = 500) -> Column:
    """The sentences of a text, longer ones cut hard at ``most`` characters; blank ones are left out."""
    found = F.regexp_extract_all(T.strip(T.text_or_empty(c)), F.lit(SENTENCE), F.lit(0))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most)))
    return F.filter(F.transform(F.flatten(F.transform(found, cut)), T.strip), lambda x: x != "")


def packed(parts: list[str], size: int = 800, overlap: int = 120, least: int = 80) -> list[str]:
    """Sentences packed greedily up to a size; each chunk starts with the tail of the one before."""
    out, cur, fresh = [], "", False
    for p in parts:
        if cur and len(cur) + len(p) > size:
            if fresh:
                out.append(cur)
            cur, fresh = cur[-overlap:] if overlap else "", False
        cur, fresh = cur + p, True
    if fresh:
        out.append(cur)
    return [c for i, c in enumerate(out) if i == 0 or len(c) >= least]


def structured_chunks(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """``doc_id, chunk_index, chunk_id, text, char_count``: the sequential chunker, one document at a time inside its row."""

    def run(batches):
        for pdf in batches:
            rows = [(d, i, c) for d, parts in zip(pdf["doc_id"], pdf["parts"]) for i, c in enumerate(packed(list(parts), size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    out = docs.select("doc_id", sentences(F.col("text")).alias("parts")).mapInPandas(run, "doc_id long, chunk_index int, text string")
    return out.select("doc_id", "chunk_index", T.short_id(F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.substring("text", 1, 200)).alias("chunk_id"), "text", F.length("text").alias("char_count"))


# --- chapters and sections over the pages of documents ---
def page_lines(pages: DataFrame, key: str = "document_id", order: str = "page_no") -> DataFrame:
    """``key, page_no, line_no, line``: the lines of all pages, numbered from 0 through the document.

    The numbers of lines before a page come from one small row per page, so pages are not sorted line by line.
    """
    rows = pages.select(key, F.col(order).alias("page_no"), T.lines(F.col("text")).alias("rows"))
    before = F.sum(F.size("rows")).over(Window.partitionBy(key).orderBy("page_no")) - F.size("rows")
    return rows.withColumn("before", before).select(key, "page_no", F.posexplode("rows").alias("i", "line"), "before").select(key, "page_no", (F.col("before") + F.col("i")).cast("long").alias("line_no"), "line")


def outlined(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Lines with the chapter and section they belong to.

    Adds ``chapter_no, chapter_name, section_no, section_name``. Lines before
    the first chapter of a document, and before the first section of a chapter,
    belong to none and are left out; a document without chapters is one chapter,
    a chapter without sections one section, both named 正文.
    """
    doc = Window.partitionBy(key).orderBy("line_no")
    is_chapter = T.heading(F.col("line"), T.CHAPTER)
    r = rows.withColumn("_c", is_chapter).withColumn("chapter_no", F.sum(F.when(F.col("_c"), 1).otherwise(0)).over(doc))
    some = F.max("chapter_no").over(Window.partitionBy(key))
    r = r.withColumn("chapter_name", F.last(F.when(F.col("_c"), F.col("line")), ignorenulls=True).over(doc)).withColumn("_n", some)
    r = r.where("chapter_no > 0 OR _n = 0").withColumn("chapter_no", F.greatest("chapter_no", F.lit(1))).withColumn("chapter_name", F.coalesce("chapter_name", F.lit("正文")))
    part = Window.partitionBy(key, "chapter_no").orderBy("line_no")
    r = r.withColumn("_s", T.heading(F.col("line"), T.SECTION)).withColumn("section_no", F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(part))
    r = r.withColumn("section_name", F.last(F.when(F.col("_s"), F.col("line")), ignorenulls=True).over(part)).withColumn("_m", F.max("section_no").over(Window.partitionBy(key, "chapter_no")))
    keep = (F.col("section_no") > 0) | (F.col("_m") == 0)
    return r.withColumn("in_section", keep).withColumn("section_no", F.when(keep, F.greatest("section_no", F.lit(1)))).withColumn("section_name", F.when(keep, F.coalesce("section_name", F.lit("正文")))).drop("_c", "_n", "_s", "_m")


def _text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")


def _numbered(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), 3, "0"))


def chapters(outline_rows: DataFrame, key: str = "document_id") -> DataFrame:
    """``key, chapter_id, chapter_name, page_start, page_end, line_start, line_end, text, section_count, chapter_no``.

    An id holds three digits of its number, so from the thousandth chapter on ids repeat within a document; numbers don't.
    """
    g = outline_rows.groupBy(key, "chapter_no", "chapter_name").agg(
        F.min_by("page_no", "line_no").alias("page_start"), F.max_by("page_no", "line_no").alias("page_end"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), _text().alias("text"), F.coalesce(F.max("section_no"), F.lit(0)).cast("long").alias("section_count")
    )
    return g.select(key, _numbered("chapter_", F.col("chapter_no")).alias("chapter_id"), "chapter_name", "page_start", "page_end", "line_start", "line_end", "text", "section_count", "chapter_no")


def sections(outline_rows: DataFrame, key: str = "document_id") -> DataFrame:
    """``key, chapter_id, chapter_name, section_id, section_name, line_start, line_end, text``; line numbers count from the chapter's first line."""
    first = F.min("line_no").over(Window.partitionBy(key, "chapter_no"))
    r = outline_rows.withColumn("_first", first).where("in_section")
    g = r.groupBy(key, "chapter_no", "chapter_name", "section_no", "section_name").agg((F.min("line_no") - F.min("_first")).alias("line_start"), (F.max("line_no") - F.min("_first")).alias("line_end"), _text().alias("text"))
    return g.select(key, _numbered("chapter_", F.col("chapter_no")).alias("chapter_id"), "chapter_name", _numbered("section_", F.col("section_no")).alias("section_id"), "section_name", "line_start", "line_end", "text")


def course_outline(outline_rows: DataFrame, key: str = "document_id") -> DataFrame:
    """``key, chapter_count, section_count, chapters``: the table of contents as an array, by id; chapters of one id by number."""
    c = chapters(outline_rows, key)
    names = ("chapter_id", "chapter_name", "page_start", "page_end", "section_count")
    entry = F.struct("chapter_id", "chapter_no", *names[1:])
    shown = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return c.groupBy(key).agg(F.count("*").alias("chapter_count"), F.sum("section_count").alias("section_count"), shown.alias("chapters"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Adds id, flags, difficulty and counts to ``course_id, document_id, chunk_index, text, ...``."""
    text = F.col("text")
    count = F.size(T.formulas(text))
    return chunks.select(
        *chunks.columns,
        F.concat(F.lit("chunk_"), T.short_id(F.col("course_id"), F.col("document_id").cast("string"), F.col("chunk_index").cast("string"), F.substring("text", 1, 200))).alias("chunk_id"),
        count.cast("long").alias("formula_count"),
        (count > 0).alias("has_formula"),
        T.has_example(text).alias("has_example"),
        T.has_exercise(text).alias("has_exercise"),
        T.difficulty(text).alias("difficulty"),
        T.tags(text).alias("tags"),
        F.length(text).cast("long").alias("char_count"),
    )


def page_chunks(pages: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks that never leave their page: ``course_id, document_id, chunk_index, page_no, chapter_id, chapter_name, section_name, content_type, start_offset, end_offset, text`` and metadata.

    ``pages`` is ``(course_id, document_id, page_no, text)`` with cleaned texts.
    A page's chapter and section are those of its first line, if that is a
    heading, else its last headings, else those of the page before; the chapter
    number counts headings. Offsets count two characters between pages.
    """
    rows = T.lines(F.col("text"))
    p = pages.select("course_id", "document_id", "page_no", rows.alias("rows")).where(F.size("rows") > 0).withColumn("text", T.joined(F.col("rows")))
    head, first = F.filter("rows", T.chunk_heading), F.col("rows")[0]
    top = F.when(T.chunk_heading(first), first)
    own = F.filter(head, T.is_chunk_chapter)
    last = lambda a: F.get(a, F.size(a) - 1)
    top_chapter = F.when(T.is_chunk_chapter(top), top)
    p = p.withColumn("_chapter", F.coalesce(top_chapter, last(own))).withColumn("_section", F.coalesce(top, last(head)))
    p = p.withColumn("_n", F.size(own) + F.when(top_chapter.isNotNull() & (top_chapter != last(own)), 1).otherwise(0))
    w = Window.partitionBy("course_id", "document_id").orderBy("page_no")
    number = F.sum("_n").over(w)
    p = p.withColumn("chapter_name", F.coalesce(F.last("_chapter", ignorenulls=True).over(w), F.lit("正文"))).withColumn("section_name", F.coalesce(F.last("_section", ignorenulls=True).over(w), F.lit("正文")))
    p = p.withColumn("chapter_id", _numbered("chapter_", number)).withColumn("_base", F.sum(F.length("text") + 2).over(w) - F.length("text") - 2)
    b = p.select("course_id", "document_id", "page_no", "chapter_id", "chapter_name", "section_name", "_base", F.posexplode(T.block_rows(F.col("text"))).alias("_b", "_block"))
    c = b.select("*", F.posexplode(batch.pieces(size, overlap)(F.col("_block.text"))).alias("_p", "_piece"))
    index = F.row_number().over(Window.partitionBy("course_id", "document_id").orderBy("page_no", "_b", "_p")) - 1
    out = c.select(
        "course_id", "document_id", index.alias("chunk_index"), "page_no", "chapter_id", "chapter_name", "section_name", F.col("_block.content_type").alias("content_type"),
        (F.col("_base") + F.col("_piece.start")).cast("long").alias("start_offset"), (F.col("_base") + F.col("_piece.end")).cast("long").alias("end_offset"), F.col("_piece.text").alias("text"),
    )
    return chunk_metadata(out)


def section_chunks(outline_rows: DataFrame, course: Column, key: str = "document_id", size: int = 800, overlap: int = 100, least: int = 6) -> DataFrame:
    """Chunks along an outline: the typed blocks of every section, cut to size; pieces under ``least`` characters go unless they are the document's first."""
    s = sections(outline_rows, key).withColumn("course_id", course)
    b = s.select("course_id", key, "chapter_id", "chapter_name", "section_id", "section_name", F.posexplode(T.block_rows(F.col("text"))).alias("_b", "_block"))
    c = b.select("*", F.posexplode(batch.pieces(size, overlap)(F.col("_block.text"))).alias("_p", "_piece"))
    order = Window.partitionBy("course_id", key).orderBy("chapter_id", "section_id", "_b", "_p")
    kept = c.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) | (F.length("_piece.text") >= least))
    out = kept.select("course_id", F.col(key).alias("document_id"), (F.row_number().over(order) - 1).alias("chunk_index"), "chapter_id", "chapter_name", "section_name", F.col("_block.content_type").alias("content_type"), F.col("_piece.start").alias("start_offset"), F.col("_piece.end").alias("end_offset"), F.col("_piece.text").alias("text"))
    return chunk_metadata(out)


def first_occurrence(terms: DataFrame, docs: DataFrame, term: str = "term", key: str = "document_id") -> DataFrame:
    """Each ``(key, term)`` of ``terms`` with ``line_no, line``: the first line of its document that holds it; terms of no line give no row.

    ``docs`` is ``(key, lines)`` with a document's lines in order. A document's
    terms become one automaton that reads its lines once, however many there are.
    """
    own = terms.where(F.col(term) != "").groupBy(key).agg(F.collect_set(term).alias("_terms"))
    met = docs.select(key, "lines").join(own, key).select(key, "lines", F.explode(batch.first_lines("lines", "_terms")).alias("_hit"))
    return met.select(key, F.col("_hit.term").alias(term), F.col("_hit.line_no").alias("line_no"), F.element_at("lines", F.col("_hit.line_no") + 1).alias("line"))


def name_spans(pages: DataFrame, names: DataFrame, least: int = 40) -> DataFrame:
    """``document_id, page_no, span_no, chapter_index, text``: pages divided where the names of chapters that begin there first stand.

    ``pages (document_id, page_no, text)``; ``names (document_id, chapter_index,
    name, page_start)``. A span reaches to the next; what precedes the first is a
    span of the chapter before if it has ``least`` characters; blank spans are
    left out. A page on which no name stands is one span, of the last chapter
    that begins at or before it (0: none). Of names at one place the last
    chapter has the text. Null texts are empty.
    """
    chapter = F.array_sort(F.collect_list(F.struct("chapter_index", F.trim("name").alias("name"), "page_start")))
    p = pages.select("document_id", "page_no", T.text_or_empty(F.col("text")).alias("text")).join(names.groupBy("document_id").agg(chapter.alias("_all")), "document_id", "left")
    mine = F.filter("_all", lambda x: (x["page_start"] == F.col("page_no")) & (x["name"] != ""))
    found = F.transform(mine, lambda x: F.struct(F.position(x["name"], F.col("text")).alias("at"), x["chapter_index"].alias("chapter")))
    p = p.withColumn("_hits", F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda h: h["at"] > 0))), F.array().cast("array<struct<at:int,chapter:int>>")))
    size, first = F.size("_hits"), F.get("_hits", F.lit(0))
    end = lambda i: F.coalesce(F.get("_hits", i + 1)["at"], F.length("text") + 1)
    span = lambda text, chapter: F.struct(T.strip(text).alias("text"), chapter.cast("int").alias("chapter"))
    spans = F.transform("_hits", lambda h, i: span(F.substring(F.col("text"), h["at"], end(i) - h["at"]), h["chapter"]))
    before = span(F.substring(F.col("text"), F.lit(1), first["at"] - 1), F.greatest(F.lit(0), first["chapter"] - 1))
    spans = F.filter(spans, lambda x: x["text"] != "")
    spans = F.when((size > 0) & (F.length(before["text"]) >= least), F.concat(F.array(before), spans)).otherwise(spans)
    # chapters in order up to the first that begins behind the page
    start = F.struct(F.lit(0).alias("chosen"), F.lit(False).alias("over"))
    step = lambda acc, x: F.struct(F.when(~acc["over"] & (x["page_start"] > 0) & (x["page_start"] <= F.col("page_no")), x["chapter_index"].cast("int")).otherwise(acc["chosen"]).alias("chosen"), (acc["over"] | (x["page_start"] > F.col("page_no"))).alias("over"))
    last = F.coalesce(F.aggregate("_all", start, step, lambda acc: acc["chosen"]), F.lit(0))
    whole = F.array(F.struct(F.col("text"), last.cast("int").alias("chapter")))
    return p.select("document_id", "page_no", F.posexplode(F.when(F.size(spans) > 0, spans).otherwise(whole)).alias("span_no", "_s")).select("document_id", "page_no", "span_no", F.col("_s.chapter").alias("chapter_index"), F.col("_s.text").alias("text"))


def best_match(queries: DataFrame, names: DataFrame, scorer, least: float = 0.0) -> DataFrame:
    """``query, name, score``: for each query the best of the (few, distinct) names, the first by name on a tie."""
    pairs = queries.select("query").crossJoin(F.broadcast(names.select("name").distinct()))
    scored = pairs.withColumn("score", scorer("query", "name")).where(F.col("score") >= least)
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "name"))
    return scored.withColumn("_n", first).where("_n = 1").select("query", "name", "score")
