"""Scores by many blocks and shards: against brute force, and the same however documents are dealt."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meridex.llm import lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def brute(rows, d=lm.DISCOUNT):
    """Exact scores of (key, text, train): absolute discounting over all training rows."""
    c, pairs, begins = Counter(), Counter(), 0
    for _, text, train in rows:
        if train:
            w = tokens(text)
            begins += 1
            c.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    above, kinds, n, v = {**c, "<s>": begins}, Counter(x for x, _ in pairs), sum(c.values()), len(c)
    out = {}
    for key, text, _ in rows:
        w = tokens(text)
        score = 0
        for a, b in zip(["<s>", *w[:-1]], w, strict=True):
            p = (c[b] + 1) / (n + v + 1)
            score += math.log10((max(pairs[a, b] - d, 0) + d * kinds[a] * p) / above[a] if above.get(a) else p)
        out[key] = score
    return out


@pytest.fixture(scope="module")
def rows():
    """A few very frequent words that are followed by many, rare words, copies, and texts without words."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    text = lambda: " ".join(x for _ in range(rnd.randint(1, 120)) for x in (rnd.choice(("the", "of", "a")), rnd.choice(words[: rnd.choice((9, 900))])))
    out = [(k, text(), k % 7 != 2) for k in range(400)]
    out += [(1000 + k, out[5][1], k % 2 == 0) for k in range(30)] + [(2000, None, True), (2001, "", False), (2002, "never seen before", False), (2003, "one " * 3000, False)]
    return out


def scored(spark, rows, monkeypatch, block, shard):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "SHARD_WORDS", shard)
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    return {r.doc_id: r for r in lm.score(df, F.col("train")).collect()}


@pytest.mark.parametrize("block,shard", [(1 << 30, 10**9), (8_000, 2_000), (2_000, 500), (50_000, 300)])
def test_scores_by_blocks_and_shards(spark, rows, monkeypatch, block, shard):
    want, got = brute(rows), scored(spark, rows, monkeypatch, block, shard)
    assert set(got) == set(want)
    for key, r in got.items():
        assert math.isfinite(r.score)
        # a code is off by half a step at most: 10 ** -((k / 85) ** 2) for a share, less than 0.03 in log10 up to code 254
        assert abs(r.score - want[key]) <= 0.005 * r.n_tokens + 0.02, (key, r.score, want[key])


def test_blocks_and_copies_change_nothing(spark, rows, monkeypatch):
    one, many = scored(spark, rows, monkeypatch, 1 << 30, 500), scored(spark, rows, monkeypatch, 2_000, 500)
    for key in one:
        assert math.isclose(one[key].score, many[key].score, rel_tol=1e-12) and one[key].n_known == many[key].n_known
    assert len({many[key].score for key in (5, *range(1000, 1030))}) == 1


def test_shares_of_a_context_sum_to_one(spark, rows, monkeypatch):
    """p(w | v) over all known words and one unknown, for a spread context and others."""
    vocabulary = sorted({w for _, text, train in rows if train for w in tokens(text)} - {"</s>"})
    probes = [(10_000 + k, f"{v} {w}", False) for v in ("the", "w3", "w700") for k, w in enumerate([*vocabulary, "unknown"])]
    probes = [(10_000 + k, text, False) for k, (_, text, _) in enumerate(probes)]
    alone = [(90_000 + k, v, False) for k, v in enumerate(("the", "w3", "w700"))]
    got = scored(spark, [*rows, *probes, *alone], monkeypatch, 20_000, 500)
    want = brute([*rows, *probes, *alone])
    for v in ("the", "w3", "w700"):
        keys = [k for k, text, _ in probes if text.split()[0] == v]
        mass = sum(10 ** (got[k].score - want[k]) for k in keys) / len(keys)
        assert abs(mass - 1) < 0.03
