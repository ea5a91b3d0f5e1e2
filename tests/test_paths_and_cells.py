"""Nearest segments and shortest paths against brute force; chains in few rounds."""

import math
import random
from itertools import pairwise

from pyspark.sql import functions as F

from meridex.operators import joins as J
from meridex.operators import spatial as S


def distance(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


def test_nearest_of_near_and_far_points(spark):
    rnd = random.Random(1)
    segs = []
    for k in range(60):
        x, y = rnd.choice([(0, 0), (5e4, -3e4), (-9e5, 2e5)])
        ax, ay = x + rnd.uniform(-300, 300), y + rnd.uniform(-300, 300)
        segs.append((k, ax, ay, ax + rnd.uniform(-90, 90), ay + rnd.choice([0.0, rnd.uniform(-2000, 2000)])))
    points = [(k, rnd.uniform(-1, 1) * s, rnd.uniform(-1, 1) * s) for k, s in enumerate([100, 1e3, 1e4, 1e5, 1e6, 1e7] * 6)]
    odd = [(900, None, 1.0), (901, float("nan"), 0.0), (902, float("inf"), 0.0)]
    df = spark.createDataFrame(points + odd, "id long, x double, y double")
    seg = spark.createDataFrame([*segs, (99, None, 0.0, 1.0, 1.0), (98, float("nan"), 0.0, 0.0, 0.0)], "seg long, ax double, ay double, bx double, by double")
    got = {r.id: (r.seg, r.distance) for r in S.nearest_segment(df, seg, 50.0).collect()}
    assert len(got) == len(points) + 3 and all(got[k] == (None, None) for k in (900, 901, 902))
    for k, x, y in points:
        want = min((distance(x, y, *s[1:]), s[0]) for s in segs)
        assert got[k][0] == want[1] and math.isclose(got[k][1], want[0], rel_tol=1e-9), (k, got[k], want)


def brute_paths(edges, source, target):
    """All simple paths of least cost, fewest nodes, first nodes, by search over everything."""
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    best, stack = None, [(0.0, [source])]
    while stack:
        cost, path = stack.pop()
        if path[-1] == target:
            best = min(best or (math.inf,), (round(cost, 9), len(path), path))
            continue
        stack += [(cost + c, [*path, n]) for n, c in near.get(path[-1], []) if n not in path]
    return best


def test_paths_against_brute_force(spark):
    rnd = random.Random(3)
    edges, requests = [], []
    for g in range(12):  # twelve graphs of eight hubs and chains between them, with ties, parallel edges, loops and circles
        base = 1000 * g
        for k in range(7):
            a, b = base + rnd.randint(0, 4), base + rnd.randint(0, 4)
            inner = [base + 10 * k + 100 + i for i in range(rnd.choice([0, 0, 1, 2, 5]))]
            edges += [(x, y, float(rnd.randint(0, 2))) for x, y in pairwise([a, *inner, b])]
        edges += [(base + 900, base + 901, 1.0), (base + 901, base + 902, 1.0), (base + 902, base + 900, 1.0)]
        requests += [(f"{g}-{i}", base + rnd.randint(0, 4), base + rnd.randint(0, 4)) for i in range(3)]
        requests += [(f"{g}-in", base + 100, base + 2), (f"{g}-off", base, base + 900)]
    df, asked = spark.createDataFrame(edges, "a long, b long, cost double"), spark.createDataFrame(requests, "request string, source long, target long")
    got = {r.request: (r.cost, r.path) for r in J.shortest_paths(df, asked).collect()}
    assert set(got) == {r[0] for r in requests}
    for name, source, target in requests:
        want = brute_paths(edges, source, target)
        assert got[name] == ((want[0], want[2]) if want else (None, None)), name


def test_long_chains_take_few_rounds(spark, monkeypatch):
    calls, plain = [], J.cut
    monkeypatch.setattr(J, "cut", lambda df: calls.append(1) or plain(df))
    n = 3000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("cost"))
    asked = spark.createDataFrame([("x", 0, n)], "request string, source long, target long")
    got = J.shortest_paths(chain, asked).first()
    assert got.cost == n and got.path == list(range(n + 1)) and len(calls) < 25
