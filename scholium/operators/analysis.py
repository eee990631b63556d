"""Analysis of parsed pages: chapters by their headings, and knowledge points by explicit words, by a dictionary of the subject and by formulas.

Pages are ``(document_id, page_no, text)``; null texts are empty. Lines keep
their order as ``(page_no, i)``; what needs a line's neighbours takes them from
its own page, so no window runs over all lines of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import text as T

# --- fixed values: patterns, dictionary, words that decide kinds and difficulty ---
HEADINGS = (
    r"^第[一二三四五六七八九十百零〇0-9]+[章节篇]\s*.+",
    r"^[0-9]+(?:\.[0-9]+){1,3}\s+[一-龥A-Za-z].+",
    r"^§\s*[0-9]+(?:\.[0-9]+)*\s*.+",
    r"^Chapter\s+[0-9IVXLC]+.+",
)
NO_HEADING = ("如下", "因为", "所以", "于是", "可得", "证明", "解:", "例", "习题")
SECTION_TITLE = r"^([0-9]+(?:\.[0-9]+){1,3}\s+|第[一二三四五六七八九十百零〇0-9]+节)"
HEADING_NUMBER = r"^(第[一二三四五六七八九十百零〇0-9]+[章节篇]|[0-9]+(?:\.[0-9]+){0,3}|§\s*[0-9]+(?:\.[0-9]+)*)"
LEADERS, PAGE_NUMBER = r"[.·•…．]{2,}\s*\d+\s*$", r"\s+\d{1,4}\s*$"
EXPLICIT = r"^(定义|定理|性质|引理|推论|命题|公式|法则|例题|例)\s*([0-9一二三四五六七八九十.．-]*)\s*[：:]?\s*(.+)?$"
NAME_PREFIX = r"^(定义|定理|性质|引理|推论|命题|公式|方法|结论)\s*\d*[：:]\s*"
FORMULA_SIGNS = ("=", "∫", "∑", "∏", "lim", "sin", "cos", "tan", "log", "ln", "→", "∞", "P{", "P(", "E(", "D(", "Var", "Cov")
DOMAIN_TERMS = (
    "随机试验", "样本空间", "随机事件", "事件关系", "事件运算", "频率", "概率", "古典概型", "几何概型",
    "条件概率", "乘法公式", "全概率公式", "贝叶斯公式", "事件独立性", "伯努利试验",
    "随机变量", "分布函数", "离散型随机变量", "连续型随机变量", "概率密度", "分布律",
    "数学期望", "方差", "协方差", "相关系数", "矩母函数", "大数定律", "中心极限定理",
    "正态分布", "二项分布", "泊松分布", "指数分布", "均匀分布", "卡方分布", "t分布", "F分布",
    "参数估计", "最大似然估计", "矩估计", "置信区间", "假设检验", "显著性水平", "回归分析",
)
KINDS = {"theorem": ("定理", "引理", "推论", "法则", "律"), "formula": ("公式", "=", "∫", "∑", "P(", "P{", "E(", "D("), "method": ("例", "题", "解法", "方法", "估计", "检验")}
HARD = ("中心极限定理", "最大似然", "假设检验", "协方差", "条件概率", "贝叶斯", "矩母函数")
EASY = ("样本空间", "随机事件", "概率", "频率", "分布函数")
# --- end of fixed values ---


def _any(c: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def title(line: Column) -> Column:
    """A line as a heading: without marks of level, leaders of a table of contents and the page number behind them."""
    bare = T.strip(F.regexp_replace(T.strip(line), r"^#{1,6}\s*", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, LEADERS, ""), PAGE_NUMBER, "")
    return F.regexp_replace(bare, r"^[ \-—\t]+|[ \-—\t]+$", "")


def is_heading(c: Column) -> Column:
    hit = F.lit(False)
    for p in HEADINGS:
        hit = hit | F.rlike(c, F.lit(f"(?i){p}"))
    for w in NO_HEADING:
        hit = hit & ~F.startswith(c, F.lit(w))
    return hit & F.length(c).between(1, 90)


def kind(c: Column) -> Column:
    out = F.lit("concept")
    for name, words in reversed(KINDS.items()):
        out = F.when(_any(c, words), name).otherwise(out)
    return out


def difficulty(name: Column, definition: Column) -> Column:
    return F.when(_any(name, HARD) | _any(definition, HARD), "hard").when(name.isin(*EASY), "easy").otherwise("medium")


def point_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(T.strip(c), NAME_PREFIX, ""), 1, 120)


def lines(pages: DataFrame) -> DataFrame:
    """``document_id, page_no, i, line, two, three, around``: lines in one spelling, with the text from the line on (two or three lines) and from the line before to two after it, all of the same page."""
    rows = F.filter(F.transform(F.split(T.text_or_empty(F.col("text")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"), lambda x: F.replace(F.replace(T.strip(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit("．"), F.lit(".")), F.lit("："), F.lit(":"))), lambda x: x != "")
    p = pages.select("document_id", "page_no", rows.alias("_rows")).select("*", F.posexplode("_rows").alias("i", "line"))
    some = lambda first, n: F.substring(F.array_join(F.slice("_rows", first, n), " "), 1, 500)
    i = F.col("i")
    return p.select("document_id", "page_no", "i", "line", some(i + 1, F.lit(2)).alias("two"), some(i + 1, F.lit(3)).alias("three"), F.when(i > 0, some(F.greatest(i, F.lit(1)), F.lit(4))).otherwise(some(F.lit(1), F.lit(3))).alias("around"))


def chapters(rows: DataFrame, most: int = 80) -> DataFrame:
    """``document_id, chapter_index, name, number, page_start, page_end`` from ``lines``: each heading once, as it first stands; blanks make no difference. The last chapter's end is 0 (open)."""
    h = rows.select("document_id", "page_no", "i", title(F.col("line")).alias("title")).where(is_heading(F.col("title")))
    once = h.groupBy("document_id", F.regexp_replace("title", r"\s+", "").alias("_key")).agg(F.min(F.struct("page_no", "i", "title")).alias("x"))
    w = Window.partitionBy("document_id").orderBy("x.page_no", "x.i")
    n = once.withColumn("chapter_index", (F.row_number().over(w) - 1).cast("int")).where(F.col("chapter_index") < most)
    own = F.regexp_extract("x.title", HEADING_NUMBER, 1)
    later = F.lead("x.page_no").over(w)
    end = F.when(later.isNull(), 0).otherwise(F.greatest(F.col("x.page_no"), later - 1))
    number = F.when(own != "", F.trim(own)).otherwise((F.col("chapter_index") + 1).cast("string"))
    return n.select("document_id", "chapter_index", F.substring("x.title", 1, 120).alias("name"), F.substring(number, 1, 32).alias("number"), F.col("x.page_no").alias("page_start"), end.cast("int").alias("page_end"))


def points(rows: DataFrame, found: DataFrame, terms=DOMAIN_TERMS, most: int = 300, most_formulas: int = 80) -> DataFrame:
    """``document_id, place, name, definition, kp_type, difficulty, page_no, chapter_index`` from ``lines`` and their ``chapters``.

    In this order: lines that say what they are and section titles; the
    ``terms`` that occur, where they first do; the first formulas. A name counts
    once, blanks make no difference, and names of one character are left out.
    Every line is read once for all terms. A point belongs to the chapter whose
    name last stood as a line before it, or to the first.
    """
    line, at = F.col("line"), F.struct("page_no", "i")
    said = F.rlike(line, F.lit(EXPLICIT))
    part = lambda n: F.regexp_extract(line, EXPLICIT, n)
    name = point_name(T.strip(F.concat(part(1), part(2), F.lit(" "), T.strip(part(3)))))
    toc = title(line)
    section = is_heading(line) & F.rlike(line, F.lit(f"(?i){SECTION_TITLE}"))
    one = lambda order, n, definition, k: F.struct(F.lit(order).alias("order"), n.alias("name"), definition.alias("definition"), k.alias("kp_type"))
    explicit = rows.where(said | section).select("document_id", at.alias("at"), F.lit(0).alias("no"), F.when(said, one(0, F.when(name == "", part(1)).otherwise(name), F.col("three"), kind(part(1)))).otherwise(one(0, toc, F.col("two"), F.lit("concept"))).alias("p"))

    words = F.array(*[F.struct(F.lit(n).alias("no"), F.lit(t).alias("term")) for n, t in enumerate(terms)]) if terms else F.array().cast("array<struct<no:int,term:string>>")
    met = rows.select("document_id", at.alias("at"), "around", F.explode(F.filter(words, lambda t: F.contains(line, t["term"]))).alias("t"))
    first = met.groupBy("document_id", "t").agg(F.min(F.struct("at", "around")).alias("x"))
    known = first.select("document_id", F.col("x.at").alias("at"), F.col("t.no").alias("no"), one(1, F.col("t.term"), F.col("x.around"), F.lit("concept")).alias("p"))

    signs = rows.where(F.length("line").between(4, 220) & _any(line, FORMULA_SIGNS)).groupBy("document_id", "line").agg(F.min(at).alias("at"))
    early = Window.partitionBy("document_id").orderBy("at")
    formulas = signs.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= most_formulas).select("document_id", "at", F.lit(0).alias("no"), one(2, F.concat(F.lit("公式："), F.substring("line", 1, 80)), line, F.lit("formula")).alias("p"))

    # chapters' names where they stand as lines, and points, in order: no other line takes part
    marks = rows.select("document_id", at.alias("at"), title(line).alias("name")).join(found.select("document_id", "name", "chapter_index"), ["document_id", "name"]).select("document_id", "at", "chapter_index")
    every = explicit.unionByName(known).unionByName(formulas).unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy("document_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("chapter_index", F.coalesce(F.last("chapter_index", ignorenulls=True).over(before), F.lit(0))).where(F.col("p").isNotNull())
    clean = T.strip(point_name(F.col("p.name")))
    every = every.withColumn("name", clean).where(F.length("name") >= 2)
    order = [F.col("p.order"), F.col("no"), F.col("at")]
    once = every.groupBy("document_id", F.regexp_replace("name", r"\s+", "").alias("_key")).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "name", "p", "chapter_index")).alias("x"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("x"))
    out = once.withColumn("place", place).where(F.col("place") <= most)
    definition = F.coalesce(F.nullif("x.p.definition", F.lit("")), F.col("x.name"))
    return out.select("document_id", "place", F.col("x.name").alias("name"), definition.alias("definition"), F.col("x.p.kp_type").alias("kp_type"), difficulty(F.col("x.name"), F.coalesce(F.col("x.p.definition"), F.lit(""))).alias("difficulty"), F.col("x.o2.page_no").alias("page_no"), "x.chapter_index")
