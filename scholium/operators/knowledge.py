"""Knowledge points, their graph, review rules and deterministic generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.functions import text as T
from scholium.session import written

# --- fixed values ---
#: Confidence of graph nodes and weight of edges by kind.
NODE_CONFIDENCE = {"chapter": 0.95, "formula": 0.80, "example": 0.75, "exercise": 0.75, "mistake": 0.65, "knowledge_point": 0.72}
EDGE_WEIGHT = {"belongs_to": 1.0, "prerequisite": 0.72, "confusable_with": 0.62, "of_fragment": 0.8, "chapter_order": 0.45}
FRAGMENT_RELATIONS = {"formula": "formula_for", "example": "example_of", "exercise": "used_in", "mistake": "confusable_with"}
INTENTS = {
    "learning_package": ("学习包", "学习计划", "章节学习", "生成学习", "学习方案"),
    "exam": ("试卷", "考试", "组卷", "测试卷", "模拟卷"),
    "exercise": ("练习题", "出几道题", "做题", "练习一下", "出点题", "习题", "做几道题", "练练手"),
    "micro_lesson": ("微课", "视频脚本", "教学视频", "微课脚本"),
    "ppt": ("ppt", "PPT", "课件", "幻灯片", "演示文稿"),
    "homework_tutor": ("作业", "辅导", "题目讲解", "解题", "答疑"),
    "knowledge_graph": ("知识图谱", "知识关系", "知识点关联", "知识网络"),
    "student_profile": ("学生画像", "学习分析", "学习报告", "学习情况"),
}
GENERIC_SECTIONS = ("正文", "小结", "习题")
MISTAKE_WORDS = "易错|注意"
# --- end of fixed values ---


def knowledge_points(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Knowledge points of chapter texts ``(key, text)``: ``key, place, kp_id, name, definition, source, difficulty, tags`` and what the text offers.

    Three passes inside the row: section headings, definitions, sentences of the
    form "X is". A name that a heading or an earlier match gave is not taken
    again by the later passes; headings are all kept.
    """
    text = T.text_or_empty(F.col("text"))
    is_section = lambda x: T.heading(x, T.SECTION)
    runs = T.split_at(T.lines(text), is_section)
    point = lambda name, source, definition, about, seed: F.struct(name.alias("name"), F.lit(source).alias("source"), definition.alias("definition"), about.alias("about"), seed.alias("seed"))
    bare = lambda x: T.canonical_name(T.strip(F.regexp_replace(x, T.SECTION_NUMBER, "")))
    headings = F.filter(F.transform(runs, lambda r: point(bare(r[0]), "section_heading", F.lit(""), T.joined(r), bare(r[0]))), lambda p: F.length(p["name"]).between(2, 40) & ~p["name"].isin(*GENERIC_SECTIONS))
    bodies = F.transform(F.regexp_extract_all(text, F.lit(T.DEFINITION), F.lit(1)), T.normalise_whitespace)
    defined = F.transform(bodies, lambda b: point(T.canonical_name(T.name_from_definition(b)), "definition", b, b, F.concat(T.canonical_name(T.name_from_definition(b)), b)))
    said = F.transform(F.regexp_extract_all(text, F.lit(T.NAME_BY_IS), F.lit(0)), lambda m: F.struct(T.normalise_whitespace(m).alias("s"), T.normalise_whitespace(F.regexp_extract(m, T.NAME_BY_IS, 1)).alias("n")))
    told = F.transform(said, lambda m: point(T.canonical_name(m["n"]), "sentence", m["s"], m["s"], m["s"]))
    later = F.filter(F.concat(defined, told), lambda p: F.length(p["name"]) >= 2)
    d = texts.select(key, text.alias("text"), headings.alias("_h"), later.alias("_l"))
    d = d.withColumn("_l", F.filter("_l", lambda p, i: ~F.array_contains(F.transform("_h", lambda h: h["name"]), p["name"]) & (F.array_position(F.transform("_l", lambda x: x["name"]), p["name"]) == i + 1)))
    d = d.withColumn("_e", F.slice(T.exercises(F.col("text")), 1, 5)).withColumn("_f", F.slice(T.formulas(F.col("text")), 1, 5)).withColumn("_x", F.slice(T.examples(F.col("text")), 1, 3))
    p = d.select("*", F.posexplode(F.concat("_h", "_l")).alias("place", "p"))
    name = F.col("p.name")
    return p.select(
        key, "place", F.concat(F.lit("kp_"), F.substring(F.md5(F.col("p.seed")), 1, 12)).alias("kp_id"), name.alias("name"), F.col("p.definition").alias("definition"), F.col("p.source").alias("source"),
        T.difficulty(F.col("p.about")).alias("difficulty"), T.tags(F.col("p.about")).alias("tags"), F.col("_f").alias("formulas"), F.col("_x").alias("examples"), F.slice("_e", 1, 3).alias("exercises"),
        F.array_sort(F.array_distinct(F.transform("_e", T.question_type))).alias("question_types"), T.confusable(name, F.col("text")).alias("confusable_with"), T.prerequisites(name, F.col("text")).alias("prerequisites"), T.applications(F.col("text")).alias("applications"),
    )


def tagged(chunks: DataFrame, points: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with ``knowledge_points`` (the first five names, else their tags) and ``tags`` (a sorted set of both)."""
    names = points.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), 1, 5).alias("_names"))
    c = chunks.join(names, key, "left").withColumn("knowledge_points", F.coalesce("_names", T.tags(F.col("text"))))
    return c.withColumn("tags", F.array_sort(F.array_union(T.tags(F.col("text")), F.col("knowledge_points")))).drop("_names")


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(F.concat_ws("|", *[T.text_or_empty(p.cast("string")) for p in parts])), 1, 12))


def graph_nodes(fragments: DataFrame, points: DataFrame) -> DataFrame:
    """``course_id, node_id, node_type, name, chapter, summary, confidence, place``; the first writer of an id in a course wins.

    ``fragments`` is ``(course_id, ord, chunk_id, chapter_id, chapter_name, text,
    has_example, has_exercise)``, ``points`` as from ``knowledge_points`` with
    ``course_id, ord, chapter_name``. A fragment writes its chapter, its first
    three formulas, itself as example, exercise or mistake; then come points.
    """
    f = fragments.withColumn("chapter", F.coalesce(F.nullif("chapter_name", F.lit("")), F.lit("正文")))
    text = T.text_or_empty(F.col("text"))
    node = lambda i, kind, ident, name, about: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("node_type"), ident.alias("node_id"), name.alias("name"), about.alias("summary"))
    found = F.transform(F.slice(T.formulas(text), 1, 3), lambda x: node(1, "formula", F.concat(F.lit("formula_"), F.substring(F.md5(x), 1, 12)), F.substring(x, 1, 60), x))
    itself = lambda i, kind, flag: F.when(flag, node(i, kind, _id(kind, F.col("chunk_id"), F.substring(text, 1, 80)), T.summary(text, 40), T.summary(text)))
    own = F.array_compact(F.array(itself(2, "example", F.col("has_example")), itself(3, "exercise", F.col("has_exercise")), itself(4, "mistake", text.rlike(MISTAKE_WORDS))))
    chapter = F.array(node(0, "chapter", F.coalesce("chapter_id", _id("chapter", F.col("course_id"), F.col("chapter"))), F.col("chapter"), F.lit("")))
    a = f.select("course_id", "ord", "chapter", F.posexplode(F.concat(chapter, found, own)).alias("k", "n")).select("course_id", F.lit(0).alias("round"), F.col("ord").cast("long").alias("ord"), "k", "chapter", "n.node_type", "n.node_id", "n.name", "n.summary")
    b = points.select("course_id", F.lit(1).alias("round"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("k"), F.col("chapter_name").alias("chapter"), F.lit("knowledge_point").alias("node_type"), F.col("kp_id").alias("node_id"), "name", F.coalesce(F.nullif("definition", F.lit("")), F.col("name")).alias("summary"))
    first = F.min(F.struct("round", "ord", "k", "node_type", "name", "chapter", "summary"))
    one = a.unionByName(b).groupBy("course_id", "node_id").agg(first.alias("n")).select("course_id", "node_id", "n.*")
    kinds = F.create_map(*[F.lit(x) for kv in NODE_CONFIDENCE.items() for x in kv])
    return one.select("course_id", "node_id", "node_type", "name", "chapter", "summary", kinds[F.col("node_type")].alias("confidence"), F.struct("round", "ord", "k").alias("place"))


def graph_edges(nodes: DataFrame, fragments: DataFrame, points: DataFrame, least: float = 72.0) -> DataFrame:
    """``course_id, source, target, relation, weight``; self-loops go, the last writer of (source, target, relation) wins.

    In the order of writing: points belong to their chapter; prerequisites and
    confusable points by name; a chapter's formulas, examples, exercises and
    mistakes; the chain of chapters; points with similar names. Every relation
    reads nodes and points anew, so they are written first.
    """
    nodes, points = written(nodes), written(points)
    top = lambda df, by: df.groupBy("course_id", by).agg(F.max_by("node_id", "place").alias("target"))
    chapter = top(nodes.where("node_type = 'chapter'"), "name").withColumnRenamed("name", "chapter_name").withColumnRenamed("target", "chapter_node")
    by_name = points.groupBy("course_id", "name").agg(F.max_by("kp_id", "ord").alias("named"))
    edge = lambda df, step, s, t, relation, weight: df.select("course_id", F.lit(step).alias("step"), F.col(s).alias("source"), F.col(t).alias("target"), relation.alias("relation"), weight.cast("double").alias("weight"))
    belongs = edge(points.join(chapter, ["course_id", "chapter_name"]), 0, "kp_id", "chapter_node", F.lit("belongs_to"), F.lit(EDGE_WEIGHT["belongs_to"]))
    before = points.select("course_id", "kp_id", F.explode("prerequisites").alias("name")).join(by_name, ["course_id", "name"])
    alike = points.select("course_id", "kp_id", F.explode("confusable_with").alias("name")).join(by_name, ["course_id", "name"])
    kinds = F.create_map(*[F.lit(x) for kv in FRAGMENT_RELATIONS.items() for x in kv])
    of_fragments = nodes.where(F.col("node_type").isin(*FRAGMENT_RELATIONS)).select("course_id", "node_id", "node_type", F.col("chapter").alias("chapter_name"), F.substring("summary", 1, 20).alias("head"))
    inside = of_fragments.join(chapter, ["course_id", "chapter_name"])
    # a formula needs a fragment of its chapter that holds its head; one fragment each, so pairs are not multiplied
    texts = fragments.select("course_id", "chapter_name", F.explode(F.transform(T.formulas(F.col("text")), lambda x: F.substring(x, 1, 20))).alias("head"), "text").where(F.contains("text", F.col("head"))).select("course_id", "chapter_name", "head").distinct()
    formula = inside.where("node_type = 'formula'").join(texts, ["course_id", "chapter_name", "head"], "left_semi")
    of_chapter = inside.where("node_type <> 'formula'").unionByName(formula.select(*inside.columns))
    chain = nodes.where("node_type = 'chapter'").withColumn("next", F.lead("node_id").over(Window.partitionBy("course_id").orderBy("place"))).where("next IS NOT NULL")
    same = similar_names(nodes.where("node_type = 'knowledge_point'").select(F.col("course_id").alias("per"), F.col("node_id").alias("id"), "name", "place"), least, order="place")
    every = (
        belongs.unionByName(edge(before, 1, "named", "kp_id", F.lit("prerequisite"), F.lit(EDGE_WEIGHT["prerequisite"])))
        .unionByName(edge(alike, 1, "kp_id", "named", F.lit("confusable_with"), F.lit(EDGE_WEIGHT["confusable_with"])))
        .unionByName(edge(of_chapter, 2, "chapter_node", "node_id", kinds[F.col("node_type")], F.lit(EDGE_WEIGHT["of_fragment"])))
        .unionByName(edge(chain, 3, "node_id", "next", F.lit("prerequisite"), F.lit(EDGE_WEIGHT["chapter_order"])))
        .unionByName(edge(same.withColumnRenamed("per", "course_id"), 4, "a", "b", F.lit("same_level"), F.col("score") / 100))
    )
    return every.where("source <> target").groupBy("course_id", "source", "target", "relation").agg(F.max_by("weight", "step").alias("weight"))


def similar_names(names: DataFrame, least: float = 72.0, order: str = "id") -> DataFrame:
    """``per, a, b, score``: pairs of ``(per, id, name)`` with a token-set ratio of ``least`` or more, a before b in ``order``; none is missed.

    A ratio so high needs a common word, or else a common subsequence of the
    names with w = least / 200 of their joint length: then the longer is at most
    (1 - w) / w times as long, and the names share one of the first characters
    (counted, in one order) of either. Pairs meet on words and on those characters.
    """
    w = least / 200
    share = w * (1 + w / (1 - w))  # of a name's characters that a partner must share
    chars = F.array_sort(F.split(F.array_join(F.array_sort(F.array_distinct(F.split("name", " "))), " "), ""))
    counted = F.transform(chars, lambda c, i: F.concat(c, F.lit("#"), (F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))).cast("string")))
    n = F.size(chars)
    some = F.slice(F.array_sort(counted), F.lit(1), n - F.ceil(n * share).cast("int") + 1)
    words = F.transform(F.filter(F.split("name", " "), lambda x: x != ""), lambda x: F.concat(F.lit("word "), x))
    k = names.where("name <> ''").select("per", "id", "name", F.col(order).alias("o"), F.explode(F.array_distinct(F.concat(words, some))).alias("k"))
    a, b = (k.select("per", "k", F.col("id").alias(i), F.col("name").alias(x), F.col("o").alias(f"o{i}")) for i, x in (("a", "x"), ("b", "y")))
    pairs = a.join(b, ["per", "k"]).where("oa < ob").select("per", "a", "b", "x", "y").distinct()
    return pairs.withColumn("score", batch.token_set_ratio_udf("x", "y")).where(F.col("score") >= least).select("per", "a", "b", "score")


def intent(text: Column) -> Column:
    """The task whose keywords in the text have most characters; the first on a tie, and where none occurs."""
    scores = [F.struct(sum((F.when(F.lower(text).contains(w.lower()), len(w)).otherwise(0) for w in words), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(INTENTS.items())]
    return F.array_max(F.array(*scores))["name"]


def credibility(llm: Column, references: Column, critical: Column, issues: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), llm + F.when(references > 0, 10).otherwise(-15) - 20 * critical - 5 * issues))


def difficulty_mix(questions: DataFrame, per: str) -> DataFrame:
    """Shares of easy and hard questions; an issue if one is above 0.8 of three or more."""
    n, easy, hard = F.count("*"), F.count_if(F.col("difficulty") == "easy"), F.count_if(F.col("difficulty") == "hard")
    return questions.groupBy(per).agg(n.alias("n"), easy.alias("easy"), hard.alias("hard"), ((n >= 3) & ((easy / n > 0.8) | (hard / n > 0.8))).alias("issue"))


def repeated_stems(questions: DataFrame, per: str, stem: str, order: str) -> DataFrame:
    """Every repetition of a stem after its first."""
    return questions.withColumn("nth", F.row_number().over(Window.partitionBy(per, stem).orderBy(order))).where("nth > 1")


def graded(answers: DataFrame) -> DataFrame:
    """Choice, fill and judge by equality of normalised answers; open answers by length and keywords."""
    s, a = T.normalise_answer(F.col("student_answer")), T.normalise_answer(F.col("answer"))
    keys = F.filter(F.slice(F.split(F.regexp_replace(a, "，", ","), ","), 1, 4), lambda k: F.length(k) >= 2)
    open_ok = (F.length(s) >= 8) & ((F.col("question_type") != "计算题") | s.rlike("[=0-9]")) & (F.exists(keys, lambda k: s.contains(k)) | (F.length(s) >= 18))
    ok = F.when(F.col("question_type").isin("选择题", "填空题", "判断题"), s == a).otherwise(open_ok)
    return answers.withColumn("is_correct", ok).withColumn("score", F.when(ok, 10.0).otherwise(0.0))


def study_plan(plans: DataFrame) -> DataFrame:
    """Fallback study plans: day i studies point i, else the first two; total is days times minutes."""
    day = F.sequence(F.lit(1), F.col("days"))
    task = F.transform(day, lambda d: F.struct(d.alias("day"), F.coalesce(F.get("points", d - 1), F.concat_ws("、", F.slice("points", 1, 2))).alias("topic"), F.col("daily_minutes").alias("minutes")))
    return plans.withColumn("daily_tasks", task).withColumn("total_minutes", F.col("days") * F.col("daily_minutes"))


def plan_errors(plans: DataFrame) -> DataFrame:
    """Rule violations of a plan as an array of messages."""
    total = F.aggregate("daily_tasks", F.lit(0).cast("long"), lambda a, t: a + t["minutes"])
    rules = F.array(
        F.when(F.size("daily_tasks") == 0, "no tasks"),
        F.when(F.abs(total - F.col("total_minutes")) > 10, "minutes do not add up"),
        F.when(F.exists("daily_tasks", lambda t: t["minutes"] <= 0), "a task without time"),
    )
    return plans.withColumn("errors", F.filter(rules, lambda e: e.isNotNull()))
