"""Every stretch of a diagonal counts, not the one of the highest gain alone."""

from scholium.llm import decontaminate

ITEM = [f"w{i}" for i in range(40)]


def found(differ, least=13, item=ITEM):
    words = [f"x{i}" if i in differ else w for i, w in enumerate(item)]
    block = decontaminate.Block([(7, " ".join(item))])
    return block.overlaps(decontaminate.word_hashes(" ".join(words)), least)


def test_second_stretch():
    # 12 equal (gain 12), 5 different, 15 with one substitution (gain 11), the rest different
    assert found({*range(12, 17), 24, *range(32, 40)}) != []
    assert found(set(), 13) == [(7, 40, 40, 0, 0)]


def test_brute_force():
    for differ in ({*range(12, 17), *range(29, 40)}, {*range(12, 15), *range(16, 40)}, {*range(12, 18), 26, *range(31, 40)}, {*range(0, 40, 3)}, {*range(10, 25), *range(34, 40)}):
        same = [i not in differ for i in range(40)]
        want = any(sum(same[a:b]) >= 13 and 4 * (b - a - sum(same[a:b])) <= b - a for a in range(40) for b in range(a + 1, 41))
        seeded = any(all(same[i + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for i in range(41 - len(m)))
        got = found(differ)
        assert bool(got) == (want and seeded)
        for _, matched, length, at, item_at in got:
            assert at == item_at and matched == sum(same[at : at + length]) >= 13 and 4 * (length - matched) <= length
