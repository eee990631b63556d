"""Text functions as Catalyst expressions: cleaning, quality, typing, tagging, citation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns, word lists and labels that results depend on ---
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SPACES = "[ \\t\u3000]+"
#: All characters that end a line (CR LF counts once).
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
MEANINGFUL = r"[\u4e00-\u9fffA-Za-z0-9=+\-*/^<>≤≥≈≠∫∑∏√∞]"
WORDLIKE = r"[\u4e00-\u9fffA-Za-z0-9]"
PAGE_NUMBER = r"(?i)^\s*(?:第?\s*[0-9]+\s*页?|[-—–]?\s*[0-9]+\s*[-—–]?|[0-9]+\s*/\s*[0-9]+|page\s+[0-9]+(?:\s+of\s+[0-9]+)?)\s*$"
SYMBOLS_ONLY = r"(?U)^[\W_]{4,}$"
TOKEN = r"[A-Za-z0-9_]+"
TERM = r"[\u4e00-\u9fffA-Za-z0-9_]+"
CHAPTER = r"^\s*(第[一二三四五六七八九十百千万零〇两0-9]+[章节篇编]\s*[^。\n]{0,80}|(?:Chapter|CHAPTER)\s+[0-9IVXLC]+[^\n]{0,80}|[0-9]{1,2}\s+[^\n。]{2,60})\s*$"
SECTION = r"^\s*([0-9]+(?:\.[0-9]+){1,4}\s*[^。\n]{0,80}|[一二三四五六七八九十百千万零〇两0-9]+[、.．]\s*[^。\n]{1,80}|§\s*[0-9]+(?:\.[0-9]+)*\s*[^\n]{0,80}|Section\s+[0-9IVXLC]+[^\n]{0,80})\s*$"
HEADING_CHARS = 96
#: The words that open a typed block, in order of precedence.
BLOCK_OPENERS = {
    "definition": "定义|概念|记作|称为|所谓|Definition",
    "theorem": "定理|引理|推论|命题|性质|法则|公式|Theorem|Lemma",
    "example": "例题?|例\\s*[0-9一二三四五六七八九十]*|Example",
    "proof": "证明|证|Proof",
    "exercise": "习题|练习|作业|思考题|选择题|填空题|解答题|Exercises?",
    "summary": "小结|总结|本章小结|复习|Summary",
}
FORMULA_HINT = r"(\$.*?\$|\\frac|\\sum|\\int|[=<>≤≥≈≠]|∫|∑|√|lim)"
FORMULA = (
    r"(?iU)(\$\$.*?\$\$|\$[^$]{1,200}\$|\\\[[\s\S]{1,500}?\\\]|\\\([\s\S]{1,300}?\\\)"
    r"|(?:[A-Za-z0-9_{}一-鿿]+)\s*[=<>≤≥≈≠]\s*[^，。；;\n]{1,120}"
    r"|(?:∫|∑|∏|√|lim|\\frac|\\sum|\\int)[^，。；;\n]{0,160})"
)
DEFINITION = r"(?iU)(?:定义|概念|所谓|称为|叫做|记作)[:：]?\s*([^。；;\n]{4,160})"
NAME_BY_IS = r"(?U)([一-鿿A-Za-z0-9（）()·]{2,30})\s*(?:是指|是|称为|叫做)\s*[^。；;\n]{4,120}"
NAME_SEPARATORS = ("是指", "是", "称为", "叫做", "，", ",", "。")
EXAMPLE_START = r"(?iU)^\s*(例题?|例\s*[0-9一二三四五六七八九十]*|Example)\b"
EXERCISE_START = r"(?iU)^\s*(习题|练习|作业|思考题|选择题|填空题|解答题|Exercises?)\b"
EXERCISE_INSIDE = r"(?iU)(^|\n)\s*(习题|练习|作业|选择题|填空题|解答题|Exercises?)\b"
NUMBERED = r"(?U)^\s*(?:\d+[).、]|[（(]\d+[）)]|[A-D][.、])\s*[^。]{4,}"
SECTION_NUMBER = r"(?U)^[0-9.一二三四五六七八九十、.．§\s]+"
SYNONYMS = {
    "不定积分": ("原函数与不定积分", "原函数", "不定积分"),
    "定积分": ("定积分", "黎曼积分"),
    "极限": ("函数极限", "数列极限", "极限"),
    "导数": ("导数", "微分", "变化率"),
}
PREREQUISITES = {"定积分": ("函数", "极限"), "不定积分": ("导数", "微分"), "导数": ("函数", "极限"), "极限": ("函数",)}
BASICS = ("函数", "方程", "集合")
APPLICATIONS = ("面积", "体积", "最值", "变化率", "概率", "物理应用", "经济应用", "建模")
CHUNK_CHAPTER = r"(?U)^\s*(第[一二三四五六七八九十百零〇0-9]+[章篇编]|(?:Chapter|CHAPTER)\s+[0-9IVXLC]+)"
CHUNK_HEADINGS = (
    r"(?U)^第[一二三四五六七八九十百零〇0-9]+[章节篇编]\s*[^。；;]{0,80}$"
    r"|^[0-9]+(?:\.[0-9]+){1,4}\s*[^。；;]{0,80}$"
    r"|^§\s*[0-9]+(?:\.[0-9]+)*\s*[^。；;]{0,80}$"
    r"|^(?:Chapter|CHAPTER|Section)\s+[0-9IVXLC]+[^。；;]{0,80}$"
)
CONTENTS_LINE = r"(?iU)^(目录|CONTENTS?)\s*$"
WATERMARK = "仅供学习|扫码|水印|公众号|版权所有|未经许可"
HARD_WORDS = "证明|推导|综合|应用|最值|极限|积分|导数|矩阵|递推|概率密度|偏导"
EASY_WORDS = "选择|填空|判断|基础|概念"
QUESTION_TYPES = (
    ("选择题", r"选择题|^[A-D][.、]|A[.、].*B[.、]"),
    ("填空题", r"填空题|_{2,}|（\s*）|\(\s*\)"),
    ("证明题", "证明|说明理由"),
    ("计算题", "计算|求|解方程|积分|导数"),
)
KEYWORD_TAGS = (
    ("定义", "概念"), ("概念", "概念"), ("定理", "定理"), ("性质", "性质"), ("公式", "公式"), ("例", "例题"), ("习题", "习题"),
    ("证明", "证明"), ("极限", "极限"), ("函数", "函数"), ("导数", "导数"), ("积分", "积分"), ("矩阵", "线性代数"), ("概率", "概率统计"),
)
STATUS_LABELS = {"uploaded": "已上传", "parsing": "文本解析中", "ocr_processing": "OCR 识别中", "chunking": "分块处理中", "embedding": "向量化中", "indexed": "索引完成", "completed": "全部完成", "failed": "解析失败"}
# --- end of fixed values ---


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Removes white space (any, not just blanks) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_control(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), CONTROL, "")


def normalise_whitespace(c: Column) -> Column:
    """One blank for runs of blanks, at most one empty line between lines, no ends."""
    return strip(F.regexp_replace(F.regexp_replace(text_or_empty(c), SPACES, " "), r"\n{3,}", "\n\n"))


def gibberish_ratio(c: Column) -> Column:
    """Share of characters that are neither letters, digits nor mathematics; 0 for an empty text."""
    c = text_or_empty(c)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(1.0 - F.regexp_count(c, F.lit(MEANINGFUL)) / F.length(c))


def lines(c: Column) -> Column:
    """The non-blank lines, white space normalised."""
    return F.filter(F.transform(F.split(text_or_empty(c), LINE_END), normalise_whitespace), lambda x: x != "")


def text_quality(c: Column) -> Column:
    """struct(gibberish, meaningful_chars, line_count, quality)."""
    # the lines are made once: inside the lambda, x is the array they stand in
    counted = F.transform(F.array(lines(c)), lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, lambda y: F.length(y) <= 2)).alias("short"), gibberish_ratio(c).alias("g")))
    return F.transform(counted, lambda k: _quality(c, k["n"], k["short"] / F.greatest(k["n"], F.lit(1)), k["g"]))[0]


def _quality(c: Column, n: Column, short: Column, g: Column) -> Column:
    return F.struct(
        g.alias("gibberish"),
        F.regexp_count(text_or_empty(c), F.lit(WORDLIKE)).cast("long").alias("meaningful_chars"),
        n.cast("long").alias("line_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - g * 0.75 - short * 0.25)).alias("quality"),
    )


def is_page_number(c: Column) -> Column:
    return text_or_empty(c).rlike(PAGE_NUMBER)


def is_gibberish(c: Column) -> Column:
    """A blank, numbering or symbol line that OCR noise leaves behind."""
    s = strip(text_or_empty(c))
    n, m = F.length(s), F.regexp_count(s, F.lit(WORDLIKE))
    return (n == 0) | s.rlike(PAGE_NUMBER) | s.rlike(SYMBOLS_ONLY) | ((n <= 4) & (m == 0)) | ((n >= 8) & (m / n < 0.18))


def tokens(c: Column) -> Column:
    """Lower-case words, then CJK characters, then their pairs; repetitions stay."""
    low = F.lower(text_or_empty(c))
    chars = F.regexp_extract_all(low, F.lit(r"[\u4e00-\u9fff]"), F.lit(0))
    pairs = F.when(F.size(chars) > 1, F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), chars, pairs)


def query_terms(c: Column, most: int = 12) -> Column:
    """The first terms of a query, as they are written."""
    return F.slice(F.regexp_extract_all(text_or_empty(c), F.lit(TERM), F.lit(0)), 1, most)


def heading(c: Column, pattern: str) -> Column:
    """Whether a line is a heading: it matches, is short and holds at most one clause mark."""
    return c.rlike(pattern) & (F.length(c) <= HEADING_CHARS) & (F.regexp_count(c, F.lit("[。，,]")) < 2)


def block_type(c: Column) -> Column:
    """The first opener that starts the text, else formula or explanation; empty for a blank text."""
    t = normalise_whitespace(c)
    out = F.when(t == "", "empty")
    for name, words in BLOCK_OPENERS.items():
        out = out.when(t.rlike(rf"(?iU)^\s*({words})\b"), name)
    return out.when(t.rlike(FORMULA_HINT), "formula").otherwise("explanation")


def split_at(rows: Column, starts_line) -> Column:
    """The runs of an array of lines that begin at the lines of a predicate, each up to the next; lines before the first are left out."""
    at = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: starts_line(F.get(rows, i - 1)))
    at = F.when(F.size(rows) > 0, at).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(at), lambda a: F.transform(a, lambda i, k: F.slice(rows, i, F.coalesce(F.get(a, k + 1), F.size(rows) + 1) - i)))[0]


def joined(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def block_rows(c: Column) -> Column:
    """array<struct<content_type, text>>: the typed blocks of a text, in the row; a block without an opener is typed by its whole text."""
    rows = lines(c)
    opens = lambda x: block_type(x).isin(*BLOCK_OPENERS)
    blocks = F.transform(F.array(rows), lambda r: F.concat(_before_first(r, opens), split_at(r, opens)))[0]
    return F.transform(F.filter(blocks, lambda b: F.size(b) > 0), lambda b: F.struct(block_type(joined(b)).alias("content_type"), joined(b).alias("text")))


def _before_first(rows: Column, starts_line) -> Column:
    """One run of the lines before the first that starts one (none: no run)."""
    first = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: starts_line(F.get(rows, i - 1)))
    n = F.when(F.size(rows) > 0, F.coalesce(F.get(first, 0), F.size(rows) + 1) - 1).otherwise(0)
    return F.array(F.slice(rows, F.lit(1), n))


def prefixed(c: Column, pattern: str) -> Column:
    """The texts of the runs that start at lines of a pattern."""
    return F.transform(split_at(lines(c), lambda x: x.rlike(pattern)), joined)


def examples(c: Column) -> Column:
    return prefixed(c, EXAMPLE_START)


def exercises(c: Column) -> Column:
    """Runs that start like an exercise; where there are none, numbered lines."""
    runs = prefixed(c, EXERCISE_START)
    numbered = F.filter(lines(c), lambda x: x.rlike(NUMBERED))
    return F.when(F.size(runs) > 0, runs).otherwise(numbered)


def canonical_name(c: Column) -> Column:
    """The synonym group that holds the name, or a part of it, first group first; else the name itself."""
    name = normalise_whitespace(c)
    out = None
    for group, variants in SYNONYMS.items():
        hit = F.lit(False)
        for v in variants:
            hit = hit | F.contains(name, F.lit(v)) | F.contains(F.lit(v), name)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(name)


def name_from_definition(c: Column) -> Column:
    """What stands before the first separator (in order of precedence) that leaves 2 to 30 characters; else the first 30."""
    body = normalise_whitespace(c)
    tidy = lambda x: F.regexp_replace(x, "^[ ：:，,。]+|[ ：:，,。]+$", "")
    out = None
    for sep in NAME_SEPARATORS:
        left = F.substring_index(body, sep, 1)
        fits = F.contains(body, F.lit(sep)) & F.length(left).between(2, 30)
        out = F.when(fits, tidy(left)) if out is None else out.when(fits, tidy(left))
    return out.otherwise(tidy(F.substring(body, 1, 30)))


def confusable(name: Column, text: Column) -> Column:
    """Up to three other groups whose first variant the text holds."""
    found = [F.when((name != group) & F.contains(text, F.lit(variants[0])), group) for group, variants in SYNONYMS.items()]
    return F.slice(F.array_compact(F.array(*found)), 1, 3)


def prerequisites(name: Column, text: Column) -> Column:
    basics = F.slice(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(x)), x) for x in BASICS])), 1, 2)
    out = None
    for key, words in PREREQUISITES.items():
        value = F.array(*[F.lit(w) for w in words])
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out.otherwise(basics)


def applications(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(x)), x) for x in APPLICATIONS]))


def summary(c: Column, most: int = 120) -> Column:
    """White space collapsed, cut with dots."""
    t = strip(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))
    return F.concat(F.substring(t, 1, most), F.when(F.length(t) > most, "...").otherwise(""))


def chunk_heading(c: Column) -> Column:
    """Whether a line is a heading for the structure-driven chunker."""
    return (c != "") & (F.length(c) <= HEADING_CHARS) & c.rlike(CHUNK_HEADINGS)


def is_chunk_chapter(c: Column) -> Column:
    return c.rlike(CHUNK_CHAPTER)


def has_example(c: Column) -> Column:
    return c.rlike(r"(?iU)(^|\n)\s*(例题?|例\s*[0-9一二三四五六七八九十]*|Example)\b")


def has_exercise(c: Column) -> Column:
    return c.rlike(EXERCISE_INSIDE)


def formulas(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(FORMULA), F.lit(1)), normalise_whitespace)
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2))


def difficulty(c: Column) -> Column:
    c = text_or_empty(c)
    score = F.least(F.floor(F.length(c) / 350), F.lit(3)) + F.least(F.size(formulas(c)), F.lit(3))
    score = score + F.when(c.rlike(HARD_WORDS), 2).otherwise(0) - F.when(c.rlike(EASY_WORDS), 1).otherwise(0)
    return F.when(score <= 1, "基础").when(score <= 4, "中等").otherwise("困难")


def question_type(c: Column) -> Column:
    out = None
    for name, pattern in QUESTION_TYPES:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise("综合题")


def tags(c: Column) -> Column:
    """Tags of the keywords that occur, in their order; the block type if there is none."""
    c = text_or_empty(c)
    found = F.array(*[F.when(c.contains(word), tag) for word, tag in KEYWORD_TAGS], F.when(F.size(formulas(c)) > 0, "公式"))
    found = F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(block_type(c)))


def citation(course: Column, chapter: Column, page_start: Column, page_end: Column, file_name: Column) -> Column:
    some = lambda x: x.isNotNull() & (x != 0)
    page = (
        F.when(some(page_start) & some(page_end) & (page_start != page_end), F.concat(F.lit("第 "), page_start.cast("string"), F.lit("-"), page_end.cast("string"), F.lit(" 页")))
        .when(some(page_start), F.concat(F.lit("第 "), page_start.cast("string"), F.lit(" 页")))
        .otherwise("页码未知")
    )
    named = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    return F.concat_ws(" ", named(course, "课程资料"), named(chapter, "正文"), page, F.nullif(file_name, F.lit("")))


def short_id(*parts: Column, length: int = 16) -> Column:
    """The head of an MD5 over the parts joined by a colon."""
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, length)


def labelled(c: Column, labels: dict[str, str]) -> Column:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[c], c)


def normalise_answer(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)\s+", "")


def heading_name(c: Column) -> Column:
    """A section name for comparison: lower case, no white space, one kind of colon."""
    return F.replace(normalise_answer(c), F.lit("："), F.lit(":"))
