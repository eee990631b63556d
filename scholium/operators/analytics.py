"""Learner, teacher and course aggregates over activity tables.

Activity rows are ``(user_id, action, duration, ts, event_id, error_type)``;
limits come before the aggregates where the dashboards show only recent rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCLASSIFIED = "未分类"


def rounded_share(part: Column, whole: Column, scale: int = 1) -> Column:
    """Percentage, half up; 0 for an empty whole."""
    return F.when(whole > 0, F.round((part * 100.0 / whole).cast("decimal(20,6)"), scale)).otherwise(F.lit(0)).cast("double")


def latest(df: DataFrame, per: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark prunes groups before the shuffle (window group limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def answer_overview(answers: DataFrame, per: str) -> DataFrame:
    right = F.count_if("is_correct")
    return answers.groupBy(per).agg(F.count("*").alias("total"), right.alias("correct"), rounded_share(right, F.count("*")).alias("accuracy"))


def error_histogram(mistakes: DataFrame, per: list[str]) -> DataFrame:
    """Counts by error type; null and empty types are one class."""
    kind = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.lit(UNCLASSIFIED))
    return mistakes.groupBy(*per, kind.alias("error_type")).agg(F.count("*").alias("n"))


def daily_seconds(logs: DataFrame, per: str, newest: int = 30) -> DataFrame:
    """Seconds per day over each learner's newest logs only."""
    recent = latest(logs, per, [F.col("ts").desc(), F.col("event_id").desc()], newest)
    return recent.groupBy(per, F.to_date("ts").alias("day")).agg(F.sum("seconds").alias("seconds"))


def radar(stats: DataFrame) -> DataFrame:
    """Five clamped scores of a learner from total, accuracy, unmastered, mastered and active days."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))
    return stats.select(
        "user_id",
        clamp(F.col("accuracy")).alias("accuracy_score"),
        clamp(100 - 8 * F.col("unmastered")).alias("mistake_score"),
        clamp(F.col("accuracy") - 3 * F.col("unmastered") + 15).alias("stability_score"),
        clamp(20 * F.col("mastered")).alias("review_score"),
        F.when(F.col("total") > 0, 65.0).otherwise(30.0).alias("activity_score"),
    )


def weak_points(histogram: DataFrame, per: str, most: int = 5) -> DataFrame:
    """The commonest error types of a learner with an estimated mastery of 15 to 75."""
    top = histogram.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(F.col("n").desc(), "error_type"))).where(F.col("rank") <= most)
    return top.withColumn("mastery", F.greatest(F.lit(15), F.least(F.lit(75), 70 - 12 * F.col("n"))).cast("long"))


def hardest(answers: DataFrame, exercises: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The exercises with most wrong answers; those without an exercise row shrink the list."""
    top = answers.where(~F.col("is_correct")).groupBy(key).agg(F.count("*").alias("wrong")).orderBy(F.col("wrong").desc(), key).limit(n)
    return top.join(exercises, key)


def upserted(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The latest row per key: an upsert as a window."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, key: str, keep_old: list[str]) -> DataFrame:
    """An upsert of a table: new values win, ``keep_old`` columns and missing values stay."""
    cols = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    pick = [F.coalesce(*(F.col(f"{s}.{c}") for s in (("o", "n") if c in keep_old else ("n", "o")))).alias(c) for c in cols]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *pick)


def learner_record(answers: DataFrame, mistakes: DataFrame, logs: DataFrame, answered: int = 200, logged: int = 100, shown: int = 10) -> DataFrame:
    """``user_id, total, correct, accuracy, mistake_count, mastered_count, recent_actions``: the latest answers and logs, all mistakes."""
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    a = answer_overview(latest(answers, "user_id", newest, answered), "user_id")
    m = mistakes.groupBy("user_id").agg(F.count_if(~F.col("mastered")).alias("mistake_count"), F.count_if("mastered").alias("mastered_count"))
    recent = latest(logs, "user_id", newest, min(shown, logged)).groupBy("user_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action")))).alias("r"))
    out = a.join(m, "user_id", "full_outer").join(recent, "user_id", "full_outer")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "correct", "accuracy", "mistake_count", "mastered_count")]
    return out.select("user_id", *zero, F.coalesce(F.col("r.action"), F.array().cast("array<string>")).alias("recent_actions"))


def stale_profiles(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """Learners without a profile, or with more answers than it was made from."""
    p = profiles.select("user_id", F.col("total_answers").alias("_known"))
    return records.join(p, "user_id", "left").where(F.col("_known").isNull() | (F.col("total") > F.col("_known"))).drop("_known")


def student_dashboard(answers: DataFrame, mistakes: DataFrame, plans: DataFrame, logs: DataFrame, newest: int = 30, most_plans: int = 5) -> DataFrame:
    """One row per learner: overview, open and mastered mistakes, error types of open ones, plans (five at most), seconds by day of the newest logs."""
    a = answer_overview(answers, "user_id")
    m = mistakes.groupBy("user_id").agg(F.count_if(~F.col("mastered")).alias("unmastered"), F.count_if("mastered").alias("mastered"))
    h = error_histogram(mistakes.where("NOT mastered"), ["user_id"]).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("error_types"))
    p = plans.groupBy("user_id").agg(F.least(F.count("*"), F.lit(most_plans)).alias("plan_count"))
    d = daily_seconds(logs, "user_id", newest).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "seconds")))).alias("daily_seconds"))
    out = a
    for other in (m, h, p, d):
        out = out.join(other, "user_id", "full_outer")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "correct", "accuracy", "unmastered", "mastered", "plan_count")]
    return out.select("user_id", *zero, "error_types", "daily_seconds")


def course_list(courses: DataFrame, chapters: DataFrame, points: DataFrame, fragments: DataFrame, newest: int = 100) -> DataFrame:
    """The newest courses with the number of their chapters, knowledge points and documents that have fragments."""
    n = lambda df, name: df.groupBy("course_id").agg(F.count("*").alias(name))
    docs = fragments.select("course_id", "document_id").distinct().groupBy("course_id").agg(F.count("*").alias("document_count"))
    out = courses.orderBy(F.col("created_at").desc(), "course_id").limit(newest)
    for other in (n(chapters, "chapter_count"), n(points, "kp_count"), docs):
        out = out.join(other, "course_id", "left")
    return out.fillna(0, ["chapter_count", "kp_count", "document_count"])


def teacher_overview(documents: DataFrame, chapters: DataFrame, fragments: DataFrame, exercises: DataFrame, answers: DataFrame, mistakes: DataFrame) -> DataFrame:
    """``course_id`` with resource counts, submissions, accuracy over all of them, and error types of all mistakes."""
    n = lambda df, name: df.groupBy("course_id").agg(F.count("*").alias(name))
    per = answers.groupBy("exercise_id").agg(F.count("*").alias("t"), F.count_if("is_correct").alias("c"))  # fewer rows reach the join
    a = per.join(exercises.select("exercise_id", "course_id"), "exercise_id").groupBy("course_id").agg(F.sum("t").alias("total_submissions"), F.sum("c").alias("correct_submissions"))
    h = error_histogram(mistakes, ["course_id"]).groupBy("course_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("error_types"), F.sum("n").alias("mistake_count"))
    out = n(documents, "document_count")
    for other in (n(chapters, "chapter_count"), n(fragments, "fragment_count"), n(exercises, "exercise_count"), a, h):
        out = out.join(other, "course_id", "full_outer")
    counts = [c for c in out.columns if c.endswith(("_count", "_submissions"))]
    return out.fillna(0, counts).withColumn("average_accuracy", rounded_share(F.col("correct_submissions"), F.col("total_submissions")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of every table, by partial counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")).select("table_name", "n")
        out = one if out is None else out.unionByName(one)
    return out


def generation_metadata(requests: DataFrame, preview: int = 8) -> DataFrame:
    """Adds counts of source fragments, their characters and knowledge points, and the first of these."""
    chars = F.aggregate("fragments", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return requests.select(
        "*", F.size("fragments").cast("long").alias("source_fragment_count"), chars.alias("source_char_count"), F.size("knowledge_points").cast("long").alias("knowledge_point_count"),
        F.slice("knowledge_points", 1, preview).alias("knowledge_points_preview"), (F.size("fragments") > 0).alias("has_source_material"),
    )


def parse_report(documents: DataFrame, pages: DataFrame, fragments: DataFrame, points: DataFrame, outlines: DataFrame, low: float = 0.55) -> DataFrame:
    """The parsing report of every document: pages by outcome, characters, structure, fragments, vectors.

    ``documents (document_id, course_id, file_name, file_type, page_count, status)``,
    ``pages (document_id, page_no, text, method, is_ocr, is_scanned, quality,
    error, failure_reason)``, ``fragments (document_id, has_vector)``, ``points
    (document_id)``, ``outlines`` as from ``course_outline``. Texts are joined
    by two line feeds for the character count.
    """
    from scholium.functions import text as T

    good = T.text_or_empty(F.col("text")) != ""
    ocr = good & (F.coalesce("is_ocr", F.lit(False)) | F.contains(F.lower(T.text_or_empty(F.col("method"))), F.lit("ocr")))
    reason = F.coalesce("failure_reason", "error")
    low_page = (F.coalesce("quality", F.lit(1.0)) < low) | F.col("failure_reason").isNotNull()
    size = lambda f: F.sum(F.when(good, F.size(f(T.text_or_empty(F.col("text"))))).otherwise(0)).cast("long")
    p = pages.groupBy("document_id").agg(
        F.count("*").alias("_pages"), F.count_if(good).alias("success_pages"), F.count_if(good & (F.col("method") == "direct")).alias("direct_pages"), F.count_if(ocr).alias("ocr_pages"), F.count_if(F.col("error").isNotNull()).alias("failed_pages"),
        F.count_if(F.coalesce("is_scanned", F.lit(False))).alias("scanned_pages"), F.count_if(low_page).alias("low_quality_pages"), (F.sum(F.when(good, F.length("text") + 2).otherwise(0)) - 2).alias("_chars"),
        size(T.formulas).alias("formula_count"), size(T.examples).alias("example_count"), size(T.exercises).alias("exercise_count"),
        F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("page_no", reason.alias("reason"))))).alias("failure_reasons"),
    )
    f = fragments.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count_if("has_vector").alias("vector_count"))
    k = points.groupBy("document_id").agg(F.count("*").alias("knowledge_point_count"))
    out = documents
    for other in (p, f, k, outlines.select("document_id", "chapter_count", "section_count")):
        out = out.join(other, "document_id", "left")
    counts = [c for c in out.columns if c.endswith(("_pages", "_count")) and c != "page_count"]
    out = out.fillna(0, counts).withColumn("total_chars", F.greatest(F.coalesce("_chars", F.lit(0)), F.lit(0)))
    out = out.withColumn("total_pages", F.coalesce(F.nullif("page_count", F.lit(0)), "_pages")).withColumn("average_chars_per_page", F.col("total_chars") / F.greatest("_pages", F.lit(1)))
    return out.withColumn("index_success", (F.col("chunk_count") > 0) & (F.col("chunk_count") == F.col("vector_count"))).drop("_pages", "_chars", "page_count")
