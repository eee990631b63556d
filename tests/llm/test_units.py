"""Pure functions of the training-data operators, against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.llm import bitslice, decontaminate, extract, mixing, phrases, quality, repeats, simhash, suffix, toxicity

texts = st.text(alphabet="ab \n", max_size=60)


@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_equal_grams_have_equal_hashes(symbols, k):
    h = repeats.gram_hashes(np.array(symbols, np.uint64), k)
    assert len(h) == max(0, len(symbols) - k + 1)
    grams = [tuple(symbols[i : i + k]) for i in range(len(h))]
    assert all((grams[i] == grams[j]) == (h[i] == h[j]) for i in range(len(h)) for j in range(len(h)))


@given(st.lists(st.integers(0, 2), min_size=12, max_size=80))
@settings(max_examples=60, deadline=None)
def test_every_window_holds_an_anchor_and_equal_windows_the_same(symbols):
    sym = np.array(symbols, np.uint64)
    pos, _ = repeats.anchors(sym, 4, 12)
    seen: dict[tuple, frozenset] = {}
    for i in range(len(symbols) - 11):
        inside = frozenset(p - i for p in pos.tolist() if i <= p <= i + 8)
        assert inside
        h = repeats.gram_hashes(sym[i : i + 12], 4)
        least = frozenset(np.nonzero(h == h.min())[0].tolist())
        assert least <= inside
        assert seen.setdefault(tuple(symbols[i : i + 12]), least) == least


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_merged_ranges(pairs):
    s, e = np.array([a for a, _ in pairs], np.int64), np.array([a + n for a, n in pairs], np.int64)
    ms, me = repeats.merged(s, e)
    assert {x for a, b in zip(ms, me) for x in range(a, b)} == {x for a, b in zip(s, e) for x in range(a, b)}
    assert all(b < a for b, a in zip(me[:-1], ms[1:]))


def test_packing_round_trip():
    a, b, m = np.arange(5, dtype="<u8") << np.uint64(50), np.arange(5, dtype="<i4") - 2, np.arange(35, dtype=np.uint8).reshape(5, 7)
    x, y, z = repeats.unpacked(repeats.packed(a, b, m), "<u8", "<i4", 7)
    assert (x == a).all() and (y == b).all() and (z == m).all()


@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=3), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_multikey_order(rows):
    m = np.array(rows, np.uint64)
    got = [tuple(m[i]) for i in suffix.multikey_order(m)]
    assert got == sorted(map(tuple, rows))


@given(st.lists(st.binary(min_size=0, max_size=90).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=2, max_size=5))
@settings(max_examples=40, deadline=None)
def test_repeated_offsets(docs):
    window, left = 20, 20 - suffix.K
    ctx, doc, pos, lo, hi = [], [], [], [], []
    for d, raw in enumerate(docs):
        wide = np.concatenate([np.zeros(left, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(window, np.uint8)])
        for p in range(len(raw) - suffix.K + 1):
            if len(raw) >= window:
                ctx.append(wide[p : p + left + window])
                doc.append(d)
                pos.append(p)
                lo.append(max(0, p + window - len(raw)))
                hi.append(min(left, p))
    if not ctx:
        return
    mask = suffix.repeated_offsets(np.array(ctx), np.array(doc), np.array(lo), np.array(hi), window)
    for m, d, p, a, b in zip(mask.tolist(), doc, pos, lo, hi):
        for o in range(left + 1):
            s = docs[d][p - o : p - o + window] if a <= o <= b else None
            assert bool(m >> o & 1) == (s is not None and any(s in x for x in docs[:d]))


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_automata_locate_all_later_windows(passages):
    docs, none = np.arange(len(passages)), np.zeros(len(passages), np.int64)
    for window in (4, 10, 7):  # groups of four, five and one
        doc, at = phrases.locate(docs, none, none, [phrases.word_symbols(b" ".join(p))[0] for p in passages], window)
        seen, want = set(), set()
        for d, words in enumerate(passages):
            for i in range(len(words) - window + 1):
                k = tuple(words[i : i + window])
                if k in seen:
                    want.add((d, i))
                seen.add(k)
        assert set(zip(doc.tolist(), at.tolist())) == want


def test_fingerprint_edges():
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \t\n") == 0
    assert simhash.fingerprint(b"One two") == simhash.fingerprint(b"one  TWO") != simhash.fingerprint(b"two one")
    assert len(simhash.ball(1)) == 65 and len(set(simhash.ball(1))) == 65


@pytest.mark.parametrize("drop", [0, 2, 5])
@pytest.mark.parametrize("n", [1, 5, 200, 1000])
def test_bit_sliced_top(n, drop):
    rng = np.random.default_rng(n + drop)
    vals = rng.integers(-300, 300, (n, 8))
    vals[: n // 3] = vals[0]  # a third are copies
    ids = rng.permutation(n) * 3
    block = bitslice.SlicedBlock(ids, vals, drop)
    for i in (0, n // 2):
        q = vals[i]
        want = sorted((-int(v @ q), int(x)) for x, v in zip(ids, vals) if x != ids[i])[:10]
        assert block.top(q, int(ids[i]), 10) == [(-s, x) for s, x in want]


def test_gap_kernel_definition():
    from itertools import combinations

    def slow(s, t, p=3, d=0.6):
        pick = lambda x: [("".join(x[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(x)), p)]
        return sum(d ** (a + b) for u, a in pick(s) for v, b in pick(t) if u == v)

    pairs = [(s, t) for s in ("idiot", "i.d.i.o.t", "stuupid", "xyz", "ab", "stupid") for t in ("idiot", "stupid", "ab")]
    got = toxicity.gap_kernel(toxicity.coded([s for s, _ in pairs], 12, 0), toxicity.coded([t for _, t in pairs], 8, -1))
    assert got == pytest.approx([slow(s, t) for s, t in pairs])


def test_toxicity_tolerates_gaps():
    m = toxicity.Model(["idiot", "stupid"])
    value = lambda t: (0.0 if (v := m.values([t])[0]) is None else float(v[:2].max()))
    for t in ("you i.d.i.o.t", "a st-upid one", "i--d--i--o--t", "such an i d i o t"):
        assert value(t) == pytest.approx(1.0), t
    for t in ("idot", "stpid", "xidiot", "idxiot", "stuupid", "st_u_pi_d!", "idioot", "idiots", "x" * 3 + "stupid" + "x" * 4):
        assert value(t) > 1e-4, t
    assert value("x" * 20 + "stupid" + "x" * 90) == 0  # a span is at most twice a landmark
    assert value("nothing here at all") == value(None) == value("") == 0
    assert value("idiot") == pytest.approx(1.0)


def test_toxicity_filter_is_the_common_length():
    rng = random.Random(4)
    m = toxicity.Model(["idiot", "stupid", "worthless"])
    spans = ["".join(rng.choice("idotsup") for _ in range(rng.randrange(3, 15))) for _ in range(400)]

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_row(row, x, b)
        return row[-1]

    def _lcs_row(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        return new

    want = [any(10 * length(s, w) >= 7 * len(w) and len(s) <= 2 * len(w) + 2 for w in m.landmarks) for s in spans]
    got = set(m.alike(spans)[:, 0].tolist())
    assert [i in got for i in range(len(spans))] == want and 20 < sum(want) < 390


def test_decontamination_tolerates_substitutions():
    rng = random.Random(1)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    block = decontaminate.Block([(7, " ".join(item)), (8, "too short"), (9, "")])
    filler = [f"f{rng.randrange(10**6)}" for _ in range(60)]
    for every in (5, 6, 9):
        noisy = [f"s{i}" if i % every == 2 else w for i, w in enumerate(item)]
        got = block.overlaps(decontaminate.word_hashes(" ".join(filler + noisy + filler)), 13)
        assert [g[0] for g in got] == [7] and got[0][1] >= 13
    assert block.overlaps(decontaminate.word_hashes(" ".join(filler + item[:9] + filler)), 13) == []
    assert block.overlaps(decontaminate.word_hashes(None), 13) == [] and decontaminate.Block([]).overlaps(decontaminate.word_hashes("a b"), 13) == []


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
@settings(max_examples=150, deadline=None)
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = [a[i] for i in sorted(extract.shared(a, b))]
    assert len(got) == table[-1][-1]
    rest = iter(b)
    assert all(x in rest for x in got)


PAGE = """<html><head><title>T</title><script>if (a < b) x("</p>")</script></head><body>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="layout no-sidebar"><p>First &amp; <b>bold</b>
 text&nbsp;here.</p><p>Second<br>line</p></div><div id=comments><p>Nice!</p></div>
<form><p>Name</p></form><footer>&copy; me</footer></body></html>"""


def test_lines_of_a_page():
    assert [t for _, t in extract.lines_of(PAGE)] == ["First & bold text here.", "Second", "line"]
    assert extract.lines_of(None) == extract.lines_of("") == []
    assert extract.lines_of("<p>open <b>never closed") == [(False, "open never closed")]
    assert extract.lines_of("1 < 2 & 3") == [(False, "1 < 2 & 3")]
    assert [t for _, t in extract.lines_of("<head><title>x</title><body><p>y")] == ["y"]


def test_quality_em_separates():
    good, bad = quality.pattern([2] * 9), quality.pattern([2, 0, 0, 0, 2, 2, 2, 2, 2])
    post = quality.estimate({good: 900, bad: 100, quality.pattern([0, 2, 0, 0, 2, 2, 2, 2, 2]): 60})[2]
    assert post[good] > 0.9 and post[bad] < 0.2
    assert quality.votes("") == [0] * 9 and len(quality.features("")[0]) >= 1
    assert quality.fit([])[1] == 0.0


def test_rates_follow_steps(spark):
    df = spark.createDataFrame([([0.25, 0.75],), ([1.0, 0.0],)], "posterior array<double>")
    got = [r[0] for r in df.select(mixing.rate_after([[1.0, -1.0], [0.5, 0.5]])).collect()]
    assert got == pytest.approx([max(0, max(0, 1 - (0.25 - 0.75)) - 0.5), 0.0])


def test_extraction_keeps_article_text():
    text = lambda page: [t for _, t in extract.lines_of(page)]
    assert text('<p class="promo">Ad<p>Real one<p>Real two') == ["Real one", "Real two"]
    assert text('<ul><li class="ad">Ad<li>Real<ul><li>In it</ul></ul>') == ["Real", "In it"]
    assert text('<table><tr><td class="ad">Ad<td>Cell<tr><td>Next</table>') == ["Cell", "Next"]
    assert text('<dl><dt class="ad">Ad<dd>Real</dl>') == ["Real"]
    assert text('<form id="aspnetForm"><article>Text<p>more</p></article></form>') == ["Text", "more"]
    assert text("<article>Text of it all</article><form>Search <b>it</b></form>") == ["Text of it all"]
    assert text('<p title="it"s">Quote broken</p><p title=\'a>b\'>Whole') == ["Quote broken", "Whole"]
    names = ["share-price", "related-work", "search-term", "notice", "widget", "social-history", "header-image"]
    assert text("<article>" + "".join(f'<p class="{n}">{n} stays</p>' for n in names) + "</article>") == [f"{n} stays" for n in names]
    assert text('<article><p>Text</p><div class="share-buttons">Share</div><div class="ad">Buy</div><ul class="related-posts"><li>More</ul></article>') == ["Text"]
    assert text("Hello <span class=ad>Buy</span> world<nav>Menu</nav>") == ["Hello world"]
    assert extract.all_lines("<nav>Menu</nav><article>A</article>b") == [(extract.LOST, "Menu"), (extract.INSIDE, "A"), (extract.OUTSIDE, "b")]


def test_longest_common_subsequence_of_permuted_lines():
    import random

    rng = random.Random(3)
    for n in (0, 1, 7, 40, 200):
        a, b = [rng.randrange(n // 2 + 1) for _ in range(n)], [rng.randrange(n // 2 + 1) for _ in range(n + 3)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(extract.shared(a, b))
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in rest for i in got)


def test_differencing_deletes_lines_without_markup():
    pages = [f"<div>Home</div><div>About us</div><p>Story {k} begins</p><p>and ends {k}</p><div>Imprint</div>" for k in range(5)]
    outlines = [extract.outline(extract.all_lines(p)) for p in pages]
    for k, p in enumerate(pages):
        near = [o for i, o in enumerate(outlines) if i != k]
        assert [t for (_, t), stays in zip(extract.all_lines(p), extract.kept(outlines[k], near)) if stays] == [f"Story {k} begins", f"and ends {k}"]
