"""Main-text extraction by nearest-URL page differencing.

The different contents of a host (pages with the same lines are one) are
ordered by path over the whole table; each is compared with the nearest ones
before and after it. The text lines of two neighbours are aligned by their
longest common subsequence, and a shared line is page furniture and goes.
Inside an explicit article container it takes two neighbours and most of them,
as two articles may share a passage; neighbours that share nearly all are
versions of the page and don't count. All lines take part, those of navigation,
headers and footers included. For lines that no neighbour shares the markup
decides: elements that never hold main text (navigation, headers, footers,
asides, forms, comments, adverts) go by name, class or role, and where an
article container holds half of the text, lines outside it go.

Differencing works on line hashes, so the order, the exchange between tasks and
the decisions move a few bytes a line. Contents are numbered through the whole
order and dealt in blocks that overlap at their edges: which tasks or
partitions pages come from does not change a result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, checkpoint

#: Elements that end a line.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never main text.
DROPPED = frozenset("script style noscript template head nav footer aside form button select textarea iframe svg canvas object dialog menu".split())
#: Their text runs to the end tag, whatever it holds.
RAW = frozenset("script style textarea title noscript template iframe".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark furniture.
MARKED = frozenset(
    "ad ads alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu menubar nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: A comment, declaration or tag; a quote counts only behind an equals sign, so a stray one ends nothing.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
#: One attribute after the other, so that nothing inside a value counts as a name.
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[^a-z0-9]+")
#: Parts of a class that say the element is the content beside the furniture, or has none.
CONTENT = frozenset("no has with without main article content body post entry page story text".split())
#: Those of them that deny or qualify another word; only they exempt a class that names comments.
QUALIFIED = frozenset("no has with without".split())
COMMENTS = frozenset("comment comments disqus replies reply".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Of MARKED, what an article element itself can be.
CARDS = frozenset("ad ads advert comment comments promo related reply replies sponsored teaser".split())
#: Words that name a place or a thing for one of MARKED; inside an article a class must hold nothing else.
COMPANIONS = frozenset("area articles bar block bottom box button buttons container form icons inline inner item items left link links list panel posts right section slot top unit wrapper".split())
#: Of MARKED, what a part of an article may be called as well: there its neighbours decide.
PLAIN = frozenset("alert banner complementary header notice notices popup search skip social toolbar widget".split())
#: What an opening tag ends, up to the nearest of the elements that hold it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Blocks that don't end an open paragraph.
_WITHIN = frozenset("br caption body head html option tbody td tfoot th thead title tr".split())


def ended(stack: list, name: str) -> int:
    """How many open elements stay when an element of this name opens: end tags may be left out."""
    keep = len(stack)
    wanted = [ENDS[name]] if name in ENDS else []
    if name in BLOCKS and name not in _WITHIN:
        wanted.append(({"p"}, {"table", "td", "th", "caption", "button", "object"}))
    for ends, holds in wanted:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in holds:
                break
            if stack[i][0] in ends:
                keep = min(keep, i)
                if name not in ("tr", "tbody", "thead", "tfoot"):
                    break
    return keep


def marked(name: str, attrs: str, inside: bool = False) -> bool:
    """Whether an element's attributes call it furniture; one class word decides, unless it also names content.

    Headings are never marked. Inside an article only class and role count, as
    an id there is an anchor of the text, and a class only if nothing in it
    names anything else: ``share-buttons``, not ``share-price``.
    """
    words = CARDS if name == "article" else MARKED
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if name not in HEADINGS and (key in ("class", "role") or key == "id" and not inside):
            for word in value.split():
                parts = set(_PART.split(word)) - {""}
                if inside and name != "article":
                    if parts & words - PLAIN and parts <= words | COMPANIONS:
                        return True
                elif parts & words & COMMENTS and not parts & QUALIFIED or parts & words and not parts & CONTENT:
                    return True
    return False


def lines_of(page: str | None) -> list[tuple[bool, str]]:
    """The page's text lines in order as ``(protected, text)``, without those of dropped elements; protected: inside an article or main element."""
    return [(state == INSIDE, text) for state, text in all_lines(page) if state != LOST]


#: What a line is: outside any container, inside an article or main element, or in an element that never holds main text.
OUTSIDE, INSIDE, LOST = 0, 1, 2
_FORM_END = re.compile(r"</form\s*>", re.I)
_CONTAINER = re.compile(r"<(?:article|main)[\s>]", re.I)


def all_lines(page: str | None) -> list[tuple[int, str]]:
    """All text lines of a page in order as ``(state, text)``."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, protected
    buf: list[str] = []
    lost: list[str] = []
    at = 0
    dropped = protected = False
    containers: list[int] | None = None

    def flush():
        for parts, state in ((buf, INSIDE if protected else OUTSIDE), (lost, LOST)):
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    out.append((state, text))
                parts.clear()

    while at < len(page):
        m = _TOKEN.search(page, at)
        (lost if dropped else buf).append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in DROPPED:
            flush()
        if not m[1]:
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name == "body":  # ends a head that was left open
                stack = [x for x in stack if x[0] != "head"]
            else:
                del stack[ended(stack, name) :]
            dropped, protected = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if name in VOID or m[0].endswith("/>"):
                continue
            in_article = any(s[0] in ("article", "main") for s in stack)
            drop = dropped or name in DROPPED or (name == "header" and not in_article) or name not in ("html", "body", "main") and marked(name, m[3], in_article)
            if drop and name == "form" and not dropped and not marked(name, m[3], in_article):
                # a form around the page is no form: it holds a container, or half of the page
                end = _FORM_END.search(page, at)
                till = end.start() if end else len(page)
                containers = [c.start() for c in _CONTAINER.finditer(page)] if containers is None else containers
                k = bisect_left(containers, at)
                drop = not (k < len(containers) and containers[k] < till or 2 * (till - at) >= len(page))
            stack.append((name, drop, protected or name in ("article", "main")))
        else:
            at_open = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at_open is None or at_open < next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] and name not in ("html", "body")), -1) and name not in BLOCKS:
                continue
            del stack[at_open:]
        dropped = bool(stack) and stack[-1][1]
        protected = bool(stack) and stack[-1][2]
    flush()
    return out


def shared(a: list, b: list) -> set[int]:
    """Positions of a's lines in a longest common subsequence with b.

    Only lines that both have can take part, and equal ends are matched first,
    so the quadratic table is over what is left between them. Its rows are bit
    sets; one of about every square root of their number is kept, and those
    between two of these are made again when the way back comes to them.
    """
    common = set(a) & set(b)
    x, y = [i for i, s in enumerate(a) if s in common], [j for j, s in enumerate(b) if s in common]
    got: set[int] = set()
    n = 0
    while n < min(len(x), len(y)) and a[x[n]] == b[y[n]]:
        got.add(x[n])
        n += 1
    x, y = x[n:], y[n:]
    while x and y and a[x[-1]] == b[y[-1]]:
        got.add(x.pop())
        y.pop()
    if not x or not y:
        return got
    where: dict[str, int] = {}
    for j, p in enumerate(y):
        where[b[p]] = where.get(b[p], 0) | 1 << j
    full = (1 << len(y)) - 1
    step = isqrt(len(x)) + 1

    def following(v: int, lo: int, hi: int) -> list[int]:
        """The rows behind row ``v`` of the lines ``lo`` to ``hi``; a zero bit marks where the common length grows."""
        out = []
        for i in x[lo:hi]:
            u = v & where.get(a[i], 0)
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    starts = [full]
    for lo in range(0, len(x), step):
        starts.append(following(starts[-1], lo, lo + step)[-1])
    j = len(y) - 1
    length = lambda r, upto: (upto + 1) - (r & ((1 << upto + 1) - 1)).bit_count()
    for k in range(len(starts) - 2, -1, -1):
        rows = [starts[k], *following(starts[k], k * step, (k + 1) * step)]
        for n in range(len(rows) - 1, 0, -1):
            if j < 0:
                return got
            before = length(rows[n - 1], j)
            if length(rows[n], j) > before:
                got.add(x[k * step + n - 1])
                while j >= 0 and length(rows[n], j) > before:
                    j -= 1
                # j now ends before the matched line
    return got


def host_path(url):
    """Host and path of a URL column, lower-case host, without scheme, port, query or fragment."""
    rest = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#][\s\S]*$", "")
    return F.lower(F.regexp_replace(F.substring_index(rest, "/", 1), r":\d+$", "")), F.regexp_replace(rest, r"^[^/]*", "")


#: Of a line: its hash, its length, what it is.
_LINE = np.dtype([("hash", "<u8"), ("size", "<u4"), ("inside", "u1")])
#: Contents in a block of the order.
BLOCK = 1000
#: Neighbours that share so much of a page are versions of it.
VERSION = 0.9


def outline(lines: list[tuple[int, str]]) -> np.ndarray:
    """What differencing needs of a page: ``all_lines``, or ``lines_of`` where nothing was dropped."""
    out = np.zeros(len(lines), _LINE)
    for i, (inside, text) in enumerate(lines):
        out[i] = (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), len(text), inside)
    return out


def kept(own: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """Which lines stay after differencing with the neighbours."""
    plain, lost, inside = own["hash"].tolist(), own["inside"] == LOST, own["inside"] == INSIDE
    size = np.where(lost, 0, own["size"]).astype(np.int64)
    within, total = int(size[inside].sum()), int(size.sum())
    gone = ~inside if 2 * within >= total else np.zeros(len(own), bool)
    times, asked = np.zeros(len(own), np.int64), 0
    for w in near:
        common = np.zeros(len(own), bool)
        common[sorted(shared(plain, w["hash"].tolist()))] = True
        if size[common].sum() < VERSION * total:
            gone |= common & ~inside
        if 2 * size[common & inside].sum() < within:  # else a version of this article
            asked += 1
            times += common
    return ~(gone | lost | inside & (times >= 2) & (2 * times > asked))


#: Bytes of a batch that are taken apart at once.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch):
    """A record batch in slices of about ``PIECE`` bytes, a row at least: a batch of ten thousand pages as Python's
    strings, with their lines beside them, takes several times its own memory, which a worker then keeps."""
    rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def read(batch: pa.RecordBatch):
    """``host, lines, outline, signature`` of a batch's pages, one after the other."""
    hosts, pages = batch.column(batch.schema.get_field_index("host")), batch.column(batch.schema.get_field_index("html"))
    for h, page in zip(hosts, pages):
        lines = all_lines(page.as_py())
        own = outline(lines).tobytes()
        yield h.as_py(), lines, own, xxhash.xxh3_64_intdigest(own) - (1 << 63)


def main_text(pages: DataFrame, neighbours: int = 2) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages (page_id, url, html)``.

    Lines are the blocks of the page, white space inside one made a single
    space, joined by a line feed. Null or empty html gives an empty text; a null
    url counts as an empty one. Pages of a host with the same lines throughout
    (copies) are one content, which stands at its smallest path and has one
    result; contents at one path go by a hash of their lines. A content is
    compared with ``neighbours`` others on either side. Repeated rows give
    repeated rows, further columns are ignored, an empty table gives none.

    Contents are found by an aggregate with partial sums and numbered in range
    partitions, so neither a host nor a path of any size comes into one task.
    Decisions on contents with more than 1 / 4096 of all pages (4096 at most)
    are broadcast; the others meet their pages in a join.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    keyed = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    id_type = next(f.dataType.simpleString() for f in pages.schema if f.name == "page_id")

    def outlines(batches):
        for b in batches:
            for part in pieces(b):
                got = [(h, sig, own) for h, _, own, sig in read(part)]
                hosts, sigs, bodies = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), part.column(part.schema.get_field_index("path")).cast(pa.string()), pa.array(sigs, pa.int64()), pa.array(bodies, pa.binary())], names=["host", "path", "sig", "body"])

    each = keyed.select("host", "path", "html").mapInArrow(outlines, "host string, path string, sig long, body binary")
    contents = each.groupBy("host", "sig").agg(F.min("path").alias("path"), F.min("body").alias("body"), F.count("*").alias("n"))
    ordered = contents.repartitionByRange("host", "path", "sig").sortWithinPartitions("host", "path", "sig").withColumn("id", F.monotonically_increasing_id())
    ordered = checkpoint(ordered)
    part = F.shiftright("id", 33)
    sizes = sorted((r[0], r[1], r[2]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*"), F.sum("n")).collect())  # one row a partition
    starts, total = np.cumsum([0, *(n for _, n, _ in sizes)]).tolist(), sum(n for _, _, n in sizes)
    offsets = spark.createDataFrame([(p, at) for (p, _, _), at in zip(sizes, starts)], "p long, first long")
    ranked = ordered.withColumn("p", part).join(F.broadcast(offsets), "p").withColumn("rank", F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1))
    block, place = F.floor(F.col("rank") / BLOCK), F.col("rank") % BLOCK
    to = F.array(block, F.when((place < neighbours) & (block > 0), block - 1), F.when(place >= BLOCK - neighbours, block + 1))
    dealt = ranked.select("host", "sig", "n", "body", "rank", F.explode(F.array_compact(to)).alias("block")).repartition("block").sortWithinPartitions("block", "rank")
    decided_schema = pa.schema([("host", pa.string()), ("sig", pa.int64()), ("n", pa.int64()), ("stays", pa.binary())])

    def decide(batches):
        now, rows = None, []  # host, sig, n, outline, rank

        def out():
            got = []
            for i, (h, sig, n, own, rank) in enumerate(rows):
                if rank // BLOCK == now:
                    near = [r[3] for r in [*reversed(rows[max(0, i - neighbours) : i]), *rows[i + 1 : i + 1 + neighbours]] if r[0] == h]
                    got.append((h, sig, n, np.packbits(kept(own, near)).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got) if got else [[]] * 4, decided_schema)], schema=decided_schema)

        for b in batches:
            for h, sig, n, body, rank, at in zip(*(c.to_pylist() for c in b.columns)):
                if at != now:
                    yield out()
                    now, rows = at, []
                rows.append((h, sig, n, np.frombuffer(body, _LINE), rank))
        yield out()

    decided = checkpoint(dealt.mapInArrow(decide, "host string, sig long, n long, stays binary"))
    often = F.col("n") > max(1000, total // 4096)
    hot = Shared(spark, {(r[0], r[1]): r[2] for r in decided.where(often).select("host", "sig", "stays").collect()})  # 4096 at most

    def finished(lines: str, stays: bytes) -> str:
        return "\n".join(t for t, k in zip(lines.split("\n"), np.unpackbits(np.frombuffer(stays, np.uint8))) if k)

    told_schema = pa.schema([("host", pa.string()), ("sig", pa.int64()), ("lines", pa.string()), ("text", pa.string())])

    def tell(batches):
        for b in batches:
            for part in pieces(b):
                rows = []
                for h, lines, _, sig in read(part):
                    texts = "\n".join("" if state == LOST else t for state, t in lines)  # what never stays need not travel
                    stays = hot.value.get((h, sig))
                    # what is finished meets no decision: an own key keeps it where it falls
                    rows.append((h, sig, texts, None) if stays is None else (None, len(rows) * 0x9E3779B97F4A7C15 % (1 << 63), None, finished(texts, stays)))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, told_schema)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["page_id", "url", *told_schema.names])

    told = keyed.select("page_id", "url", "html", "host").mapInArrow(tell, f"page_id {id_type}, url string, host string, sig long, lines string, text string")
    both = told.join(decided.where(~often).select("host", "sig", "stays"), ["host", "sig"], "left").select("page_id", "url", "lines", "stays", "text")

    def finish(batches):
        for b in batches:
            for part in pieces(b):
                texts = [t if t is not None else finished(x, k) for x, k, t in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(finish, f"page_id {id_type}, url string, text string, n_chars long")
