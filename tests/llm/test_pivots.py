"""Exact top-k search (3) against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelab.llm import pivots


def brute(rows, k=20):
    q = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q.setdefault(i, set()).add(tuple(math.floor(64 * float(np.float32(x))) for x in v))
    flat = [(i, v) for i, vs in q.items() for v in vs]
    out = []
    for i, vs in q.items():
        if i % 20:
            continue
        v = min(vs, key=lambda x: np.array(np.trim_zeros(x, "b"), "<i4").tobytes())
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in flat if j != i)[:k]
        out += [(i, r + 1, j, -score) for r, (score, j) in enumerate(s)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(700):
        c = rng.randint(0, 4)
        out.append((i, [rng.gauss(c == k % 5, 0.4) for k in range(12)]))
    hot = out[3][1]
    out += [(1000 + k, hot) for k in range(300)]  # one vector in a third of the rows
    out += [(2000, None), (2020, [None] * 12), (2040, [float("nan")] + [0.0] * 11), (2060, [float("inf")] * 12), (2080, []), (2100, [0.0] * 12), (2120, [1.0, 2.0]), (None, hot), (40, out[40][1]), (60, hot)]
    return out


@pytest.mark.parametrize("block, queries", [(64, 7), (4096, 512)])
def test_top_k(spark, rows, monkeypatch, block, queries):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "QUERIES", queries)
    monkeypatch.setattr(pivots, "SAMPLE", 100)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = pivots.top_k(df, F.pmod("vec_id", F.lit(20)) == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(20, [1.0]), (3, [0.5])], "vec_id long, embedding array<double>")
    assert list(map(tuple, pivots.top_k(df, F.col("vec_id") == 20).collect())) == [(20, 1, 3, 2048)]
    assert pivots.top_k(df.limit(0), F.col("vec_id") == 20).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 20, (400, 8)) + rng.integers(0, 4, (400, 1)) * 60)
    p = pivots.choose_pivots(x[:100], 12)
    d = pivots.distances(x, p).astype(np.float32)
    n = (x * x).sum(1)
    bound = pivots.upper_bounds(d, n, d, n)
    s = pivots.scores(x, x)
    assert (bound >= s).all()
    best = np.sort(s, axis=1)[:, -5]
    assert (bound < best[:, None]).mean() > 0.3


def test_nothing_is_broadcast_and_cells_agree(spark, rows, monkeypatch):
    """Small files of queries, exploded to all blocks, were broadcast through the driver."""
    monkeypatch.setattr(pivots, "SAMPLE", 50)
    monkeypatch.setattr(pivots, "LEAST", 2**10, raising=False)
    monkeypatch.setattr(pivots, "HELD", 2**14, raising=False)
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    found = pivots.top_k(df, F.pmod("vec_id", F.lit(20)) == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_grid_sends_no_more_than_its_cells_need():
    for n in (2_000, 50_000, 600_000, 24_000_000):
        down, across = pivots.grid(n // 20, n, 350, 20, 200)
        assert n * 350 / across <= pivots.HELD
        assert n * n / 20 / (down * across) <= 2 * pivots.MOST
    one, six = (pivots.grid(n // 20, n, 350, 20, 200) for n in (100_000, 600_000))
    assert max(six) <= 2 * max(one)  # copies of a row: 25 blocks and 147 before
    assert pivots.grid(0, 5, 64, 20, 8) == (1, 1)
