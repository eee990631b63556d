"""Decisions about parsed pages: scan profiles, the OCR budget and cache, text choice, query rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.functions import text as T

# --- fixed values: thresholds of scan detection ---
LOW_CHARS, SHORT_CHARS = 30, 20
LOW_RATIO, IMAGE_RATIO, GARBLED, FIRST_PAGES = 0.60, 0.50, 0.35, 5
#: Openings and references that a query loses, and its closing mark.
POLITE = "^(请问|告诉我|我想知道|帮我|能不能|可以|请问一下|问一下)\\s*"
PRONOUNS = ("这个", "那个", "它", "该公式", "该定理")
TAIL = "[吗？?]$"
LESSON_PARTS = ("导入", "核心讲解", "总结")
# --- end of fixed values ---


def page_profile(pages: DataFrame) -> DataFrame:
    """Adds ``chars, garbled, has_image, is_scanned, low_quality``; a short but clean page without an image is neither."""
    body = T.text_or_empty(F.col("text"))
    cover = F.coalesce("image_coverage", F.lit(0.0))
    image = (F.coalesce("image_count", F.lit(0)) > 0) | (cover >= IMAGE_RATIO)
    p = pages.withColumn("chars", F.length(T.strip(body))).withColumn("garbled", T.gibberish_ratio(body) >= GARBLED).withColumn("has_image", image)
    n, bad = F.col("chars"), F.col("garbled")
    scanned = ((n == 0) & image) | (bad & (image | (n >= SHORT_CHARS))) | ((cover >= IMAGE_RATIO) & (n < LOW_CHARS))
    return p.withColumn("is_scanned", scanned).withColumn("low_quality", (n == 0) | bad | (image & (n < SHORT_CHARS)))


def scan_profile(pages: DataFrame) -> DataFrame:
    """``document_id, avg_chars, low_ratio, image_ratio, likely_scanned`` from the first pages of each document."""
    first = page_profile(pages).where(F.col("ord") < FIRST_PAGES)
    low = F.count_if(F.col("chars") < LOW_CHARS) / F.count("*")
    image = F.count_if(F.coalesce("image_count", F.lit(0)) > 0) / F.count("*")
    d = first.groupBy("document_id").agg(F.avg("chars").alias("avg_chars"), low.alias("low_ratio"), image.alias("image_ratio"))
    short = F.col("avg_chars") < LOW_CHARS
    return d.withColumn("likely_scanned", short & ((F.col("low_ratio") >= LOW_RATIO) | (F.col("image_ratio") >= IMAGE_RATIO)))


def ocr_budget(pages: DataFrame, most: int | None) -> DataFrame:
    """Adds ``do_ocr``: the first ``most`` pages of a document that need it (all, if None).

    Only the places of the first ``most`` such pages of each document meet its pages again, so a long document is not sorted in one task.
    """
    p = page_profile(pages).withColumn("_need", F.col("is_scanned") | F.col("low_quality"))
    if most is None:
        return p.withColumn("do_ocr", F.col("_need")).drop("_need")
    # pages in need first: a filter on the need would move below the profile, which it would compute once for every use
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("_need").desc(), "ord"))  # pruned before the shuffle
    last = p.select("document_id", "ord", "_need").withColumn("_n", nth).where((F.col("_n") <= most) & F.col("_need")).groupBy("document_id").agg(F.max("ord").alias("_last"))
    return p.join(last, "document_id", "left").withColumn("do_ocr", F.when(F.col("ord") <= F.col("_last"), F.col("_need")).otherwise(F.lit(False))).drop("_need", "_last")


def chosen_text(direct: Column, ocr: Column) -> Column:
    """struct(text, method): OCR text counts only if it is at least as long as the direct text."""
    d, o = T.text_or_empty(direct), T.text_or_empty(ocr)
    take = (F.length(o) > 0) & (F.length(o) >= F.length(d))
    method = F.when(take & (F.length(d) > 0), "mixed").when(take, "ocr").otherwise("direct")
    return F.struct(F.when(take, o).otherwise(d).alias("text"), method.alias("method"))


def cache_key(*parts: str) -> Column:
    """The key of an OCR result: a SHA-256 over its inputs as JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(p) for p in sorted(parts)])), 256)


def uncached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages without a usable (non-empty, successful) result in the cache."""
    return pages.join(cache.where("success AND length(text) > 0").select("key"), "key", "left_anti")


def rewritten(query: Column, point: Column, chapter: Column, course: Column) -> Column:
    """A query without opening, references and question mark, followed by the point, chapter and course it lacks."""
    q = F.regexp_replace(T.strip(T.text_or_empty(query)), f"(?U){POLITE}", "")
    for word in PRONOUNS:
        q = F.replace(q, F.lit(word), F.lit(""))
    q = T.strip(F.regexp_replace(q, TAIL, ""))
    lacks = lambda c: F.when((T.text_or_empty(c) != "") & ~F.contains(q, c), c)
    return F.concat_ws(" ", q, lacks(point), lacks(chapter), lacks(course))


def exam_papers(papers: DataFrame) -> DataFrame:
    """Fallback papers: questions Q001 onward, points dealt in turn, equal rounded scores.

    ``papers`` is ``(paper_id, points array<string>, n int, total_score double)``.
    """
    each = F.round((F.col("total_score") / F.col("n")).cast("decimal(20,6)"), 2).cast("double")
    q = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.struct(F.concat(F.lit("Q"), F.lpad((i + 1).cast("string"), 3, "0")).alias("question_id"), F.when(F.size("points") > 0, F.get("points", F.pmod(i, F.size("points")))).alias("point"), each.alias("score")),
    )
    return papers.withColumn("questions", q)


def micro_lessons(lessons: DataFrame) -> DataFrame:
    """Fallback scripts: introduction, core and summary of 30, the rest (30 at least) and 30 seconds."""
    part = lambda name, seconds: F.struct(F.lit(name).alias("section"), seconds.cast("int").alias("seconds"))
    return lessons.withColumn("sections", F.array(part(LESSON_PARTS[0], F.lit(30)), part(LESSON_PARTS[1], F.greatest(F.col("duration") - 60, F.lit(30))), part(LESSON_PARTS[2], F.lit(30))))


# --- cleaning with statistics ---
def _stats(raw: Column, cleaned: Column, removed: Column) -> Column:
    return F.struct(F.length(raw).cast("long").alias("before_chars"), F.length(cleaned).cast("long").alias("after_chars"), removed.cast("long").alias("removed_lines"), T.gibberish_ratio(cleaned).alias("gibberish"), T.text_quality(cleaned)["quality"].alias("quality"))


def _all_lines(c: Column) -> Column:
    """All lines, white space normalised, blank ones too; an end of line at the end opens no further line."""
    whole = F.regexp_replace(c, f"(?:{T.LINE_END})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(whole, T.LINE_END), T.normalise_whitespace))


def cleaned_basic(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``cleaned`` and ``stats``: NFKC, no control characters, no blank lines."""
    raw = T.text_or_empty(F.col(column))
    d = docs.withColumn("_lines", _all_lines(T.remove_control(batch.nfkc(raw))))
    kept = F.filter("_lines", lambda x: x != "")
    d = d.withColumn("cleaned", T.normalise_whitespace(T.joined(kept))).withColumn("_removed", F.size("_lines") - F.size(kept))
    return d.withColumn("stats", _stats(raw, F.col("cleaned"), F.col("_removed"))).drop("_lines", "_removed")


def cleaned_textbook(docs: DataFrame, column: str = "text") -> DataFrame:
    """As ``cleaned_basic``, without contents headings and short watermark lines, and with mathematics normalised."""
    d = cleaned_basic(docs, column).withColumn("_lines", T.lines(F.col("cleaned")))
    noise = lambda x: x.rlike(T.CONTENTS_LINE) | (x.rlike(T.WATERMARK) & (F.length(x) < 80))
    kept = F.filter("_lines", lambda x: ~noise(x))
    d = d.withColumn("_removed", F.col("stats.removed_lines") + F.size("_lines") - F.size(kept)).withColumn("cleaned", batch.normalise_math(T.joined(kept)))
    return d.withColumn("stats", _stats(T.text_or_empty(F.col(column)), F.col("cleaned"), F.col("_removed"))).drop("_lines", "_removed")


def cleaned_ocr(docs: DataFrame, column: str = "text", mathematics: bool = True) -> DataFrame:
    """Adds ``cleaned`` and ``stats``: broken words joined, dotted leaders and noise lines out, adjacent repetitions once."""
    raw = T.text_or_empty(F.col(column))
    t = T.remove_control(batch.nfkc(raw))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "([A-Za-z])-\n([A-Za-z])", "$1$2"), "[.·•]{5,}", " "), "[_＿]{3,}", " ")
    d = docs.withColumn("_lines", _all_lines(t)).withColumn("_good", F.filter("_lines", lambda x: ~T.is_gibberish(x)))
    kept = F.filter("_good", lambda x, i: (i == 0) | (x != F.get("_good", i - 1)))
    d = d.withColumn("_removed", F.size("_lines") - F.size(kept)).withColumn("cleaned", T.normalise_whitespace(T.joined(kept)))
    if mathematics:
        d = d.withColumn("cleaned", batch.normalise_math("cleaned"))
    return d.withColumn("stats", _stats(raw, F.col("cleaned"), F.col("_removed"))).drop("_lines", "_good", "_removed")


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """Page texts cleaned by their method (OCR or not); pages left empty go."""
    is_ocr = F.coalesce("is_ocr", F.lit(False)) | F.contains(F.lower(T.text_or_empty(F.col("method"))), F.lit("ocr"))
    a, b = cleaned_ocr(pages.where(is_ocr), mathematics=False), cleaned_textbook(pages.where(~is_ocr))
    return a.unionByName(b).withColumn("text", F.col("cleaned")).drop("cleaned").where("text <> ''")
