"""Vector codes against plain squared distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gatelab.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code int, cell string"


def brute(rows, parts, entries, rounds, scale=256):
    """(id, code, error, sum over the label) of every kept row, and the digest of the codebooks."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in rows) // parts)
    x = np.array([[math.floor(scale * c) for c in r[1]] + [0] * (parts * width - len(r[1])) for r in rows], np.int64).reshape(len(rows), parts, width)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = x[order[:entries]].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        codes, error = far.argmin(2), far.min(2).sum(1)
        for p in range(parts):
            for e in range(books.shape[1]) if k < rounds else ():
                own = x[codes[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], bytes(c.tolist()).hex(), int(e), total[r[2]]) for r, c, e in zip(rows, codes, error)], digest


def compare(spark, rows, parts, entries, rounds):
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    got, books = V.compress(docs, parts, entries, rounds)
    assert got.columns == ["vec_id", "label", "cell", "code", "error", "label_error"]
    want, digest = brute([(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows], parts, entries, rounds)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error").collect()), key=key) == sorted(want, key=key)
    assert V.digest_of(books) == digest


@given(st.integers(1, 9), st.integers(0, 2**32 - 1), st.sampled_from([2, 300, V.LIMIT]))
@settings(max_examples=60, deadline=None)
def test_nearest_is_exact(width, seed, most):
    """Any width, small values with many ties, values at the limit."""
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-most, most + 1, (50, width)), rng.integers(-most, most + 1, (rng.integers(1, 20), width))
    far = ((x[:, None] - e[None]) ** 2).sum(2)
    entry, scaled = V.nearest(V.walsh(x), V.walsh(e))
    n = V.walsh(e).shape[1]
    assert (entry == far.argmin(1)).all() and (scaled == n * far.min(1)).all()


def test_coefficients_come_by_sequency():
    for n in (1, 2, 4, 8, 16):
        rows = V.walsh(np.eye(n, dtype=np.int64)).T  # coefficient k of all unit vectors is row k of the transform
        assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(n))


@pytest.mark.parametrize("parts,entries,rounds", [(16, 64, 2), (4, 8, 3), (3, 200, 1)])
def test_equals_plain_distances(spark, parts, entries, rounds):
    """Nulls in every place, values that aren't finite, repeated rows and ids, null ids and labels, short and empty vectors, -0.0."""
    rng = random.Random(parts)
    vec = lambda: [round(rng.gauss(0, 1), 2) for _ in range(32)]
    rows = [(i % 150, vec(), rng.choice([None, 0, 1, 2])) for i in range(200)]
    rows += rows[:20] + [(None, vec(), 1), (None, [0.5] * 32, None), (1, [-0.0] * 32, 3), (2, [0.25] * 5, 3), (-5, [], 3)]
    rows += [(3, None, 1), (4, [1.0, None] * 16, 1), (5, [float("nan")] * 32, 1), (6, [float("inf")] + [0.0] * 31, 1)]
    compare(spark, rows, parts, entries, rounds)


def test_copies_share_code_and_error(spark):
    """A third of the rows is one vector: two entries are equal at the start, and ties go to the lower."""
    rng = random.Random(5)
    rows = [(i, [1.5] * 16 if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(16)], i % 2) for i in range(240)]
    compare(spark, rows, 4, 16, 2)


def test_no_rows_and_large_values(spark):
    empty, books = V.compress(spark.createDataFrame([(1, None, 1, 1, "c")], SCHEMA))
    assert empty.collect() == [] and books is None and V.digest_of(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="beyond"):
        V.compress(spark.createDataFrame([(1, [1e9] * 16, 1, 1, "c")], SCHEMA))
