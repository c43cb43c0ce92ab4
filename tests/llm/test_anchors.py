"""Substring dedup (6) against brute force."""

import hashlib
import random

import pytest

from gatelab.llm import anchors


def words(text):
    return (text or "").encode().split()


def brute(docs, window):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i, key=lambda x: -1 if x is None else x)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            f = first[tuple(w[k : k + window])]
            if (-1 if f is None else f) < (-1 if i is None else i):
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [13, 4])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    vocab = [f"w{k}" for k in range(300)] + ["é", "日本"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [line(rng.randint(window - 1, 60)) for _ in range(15)]
    docs = []
    for i in range(120):
        parts = [line(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), line(rng.randint(0, 9))]
        docs.append((i * 3, "\n".join(parts)))
    rng.shuffle(docs)
    copy = docs[0][1]
    docs += [(1000 + k, copy) for k in range(10)] + [(0, copy), (0, copy)]
    docs += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "a " * 30000), (2004, "a " * 40), (2005, "a b " * 50), (2006, "b a " * 50), (None, docs[5][1]), (2007, line(window - 1))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept string, chunk int").repartition(5)
    found = anchors.remove_repeats(df, window)
    assert sorted((tuple(r) for r in anchors.digest(found).collect()), key=str) == brute(docs, window)
    for r in found.collect():
        spans = [(s.start, s.end) for s in r.removed]
        assert spans == sorted(spans) and all(0 <= a < b <= r.n_words for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert anchors.digest(anchors.remove_repeats(df)).count() == 0
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in anchors.digest(anchors.remove_repeats(df)).collect()] == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]
