"""Windows with enough shingles of an item: counts and starts against brute force; nothing similar is ruled out."""

import random

import numpy as np

from meridex.llm import decontam as D


def test_least_common_is_the_least():
    for wide in range(1, 80):
        for bag in range(1, 80):
            enough = [c for c in range(1, wide + bag) if c / (wide + bag - c) >= D.SIMILARITY]
            assert D.least_common(wide, bag) == min(enough)


def test_crowded_windows_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        wide, last = rnd.randint(1, 8), rnd.randint(0, 30)
        need = rnd.randint(1, wide)
        spots = sorted({(rnd.randrange(4), rnd.randrange(last + wide)) for _ in range(rnd.randint(1, 40))})
        of, spot = (np.array(x) for x in zip(*spots, strict=True))
        want = [s for s in range(last + 1) if any(sum(o == i and s <= p < s + wide for o, p in spots) >= need for i in range(4))]
        assert D.crowded(spot, of, need, wide, last).tolist() == want


def test_all_similar_windows_are_found():
    """Items with repeated words, changed or shortened in long texts, against every window and every item."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [[rnd.choice(words) for _ in range(rnd.choice([4, 12, 30, 30, 45]))] for _ in range(12)] + [["x"] * 12, ["x", "y"] * 15]
    index = D.ItemIndex(list(range(len(items))), [" ".join(i) for i in items])
    seen = 0
    for _ in range(200):
        middle = list(rnd.choice(items))
        if rnd.random() < 0.5:
            middle[rnd.randrange(len(middle))] = "changed"
        text = [rnd.choice(words) for _ in range(rnd.choice([0, 3, 40]))] + middle + [rnd.choice(words) for _ in range(rnd.choice([0, 25]))]
        doc = D.ItemIndex([0], [" ".join(text)])
        values = doc.bag[0]
        got = {m[0]: (m[1], m[2]) for m in index.matches(values, index.shared(values), len(text))} if len(index.shared(values)) else {}
        want = {}
        for i, bag in enumerate(index.bag):
            wide = max(min(len(items[i]), len(text)) - D.SHINGLE + 1, 1)
            best = max((D.weighted_similarity(values[s : s + wide], bag), -s) for s in range(len(values) - wide + 1))
            if best[0] >= D.SIMILARITY:
                want[i] = (best[0], -best[1])
        assert got == want
        seen += len(want)
    assert seen > 50
