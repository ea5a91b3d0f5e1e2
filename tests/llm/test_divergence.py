"""The divergence audit against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from oracle import check

from meridex.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, k):
    """All parts of (text, lang, source) rows with plain loops."""
    rows = [(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), lang or "", s or "") for t, lang, s in rows]
    out = set()
    for lang in {x for _, x, _ in rows}:
        docs, total, own = Counter(), Counter(), {}
        for words, at, source in rows:
            if at == lang:
                docs.update(set(words))
                total.update(words)
                own.setdefault(source, Counter()).update(words)
        kept = sorted(w for w in docs if docs[w] >= least)
        p = {}
        for source, c in [*own.items(), (None, total)]:
            size = sum(c[w] for w in kept) + 2 * len(kept)
            p[source] = {w: 1 + 10**9 * (c[w] + 2) // size for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in own if t != s]
            terms = [(-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if own[s][w] and p[s][w] > p[None][w]]
            out |= {(lang, s, "pair", t, -v, r + 1) for r, (v, _, t) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(sorted(terms)[:k])}
    return out


def made(seed, n=160):
    """Few words with many ties, texts without words, nulls, and a language in which no word is frequent."""
    rnd = random.Random(seed)
    names = ["a", "B", "éa", "z\U0001f600", "ab", "ba", "c", "dd", "ee", "ﬀ", "￮", "\U00010000"]
    rows = [(" ".join(rnd.choice(names[: rnd.randint(2, 12)]) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", None, "de"]), rnd.choice(["s1", "s2", "s3", None, "é"])) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "en", "silent"), ("12 34 _", "de", "silent"), ("lonely", "xx", "one"), ("rare words here", "yy", "p"), ("others", "yy", "q")]


def test_against_brute_force(spark, monkeypatch):
    for seed, least, k, terms, sources in ((1, 10, 10, 4096, 128), (2, 3, 2, 2, 2), (3, 30, 1, 1, 1), (4, 1, 3, 3, 2)):
        monkeypatch.setattr(dv, "BLOCK_TERMS", terms)
        monkeypatch.setattr(dv, "BLOCK_SOURCES", sources)
        monkeypatch.setattr(dv, "MERGED_PARTS", 2)
        rows = made(seed)
        got = [tuple(r) for r in dv.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least, k).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least, k)


def test_sql_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK_TERMS", 64)
    monkeypatch.setattr(dv, "BLOCK_SOURCES", 4)
    check(spark, dv.op12_divergence, dv.OP12_SQL)


def test_tasks_hand_on_counts_early(spark):
    df = spark.createDataFrame([(r[0], r[1], r[2], 7) for r in made(9)], "text string, lang string, source string, n long").repartition(2)
    want = sorted(map(repr, dv.count_terms(df).collect()))
    assert sorted(map(repr, dv.count_terms(df, held_rows=4).collect())) == want


def test_skyband_keeps_what_fewer_than_k_dominate():
    rnd = np.random.default_rng(5)
    for size, high, k in ((0, 3, 2), (1, 3, 1), (60, 4, 1), (200, 12, 3), (300, 400, 10)):
        count, total = rnd.integers(0, high, size), rnd.integers(0, high, size)
        order = rnd.permutation(size)
        place = np.argsort(order)
        above = [sum(count[j] >= count[i] and total[j] <= total[i] and place[j] < place[i] for j in range(size)) for i in range(size)]
        assert sorted(dv.skyband(count, total, order, k).tolist()) == [i for i in range(size) if above[i] < k]


def test_shares_are_exact():
    for count, size in ((0, 2), (0, 3), (10**12, 10**13 + 7), (8 * 10**15, 9 * 10**15)):
        assert dv.shares(np.array([count]), np.array([size])).tolist() == [1 + 10**9 * (count + 2) // size]


def test_unit_without_marks_is_empty():
    unit = pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("side", pa.int32()), ("source", pa.string()), ("size", pa.int64()), ("terms", pa.int64()), ("term", pa.string()), ("n", pa.int64()))})
    assert dv.unit_sums(unit).num_rows == 0
