"""Benchmark decontamination (7) against brute force."""

import hashlib
import random
import re

import pytest

from gatelab.llm import phrase_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    out = []
    for i, text in docs:
        w, hit, got = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(width, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    got.add(str(item) if item is not None else "")
        sha = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(got), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    vocab = ["Alpha", "beta", "ça", "delta-x", "e5", "the", "of", "日本"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, line(rng.randint(14, 30))) for k in range(12)] + [(12, "short item"), (13, ""), (14, None), (None, "lone"), (10, line(20)), (15, "!!")]
    docs = [(k, line(rng.randint(0, 120))) for k in range(30)]
    for k in range(30, 60):
        t = items[k % 12][1].split()
        a = rng.randint(0, 3)
        docs.append((k, f"{line(rng.randint(0, 300))}, {' | '.join(t[a : a + rng.randint(11, 20)]).upper()}! {line(5)}"))
    docs += [(60, None), (61, ""), (62, "Short ITEM"), (63, "alone lone"), (64, "the " * 30000), (62, "Short ITEM")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n_words int")
    b = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    return docs, items, d, b


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_contamination(tables, block):
    docs, items, d, b = tables
    rows = phrase_index.report(phrase_index.contamination(d, b, block_bytes=block)).collect()
    assert sorted(tuple(r) for r in rows) == brute(docs, items)


def test_drop_and_empty(tables):
    docs, items, d, b = tables
    bad = {r[0] for r in brute(docs, items) if r[5]}
    kept = phrase_index.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)
    assert phrase_index.report(phrase_index.contamination(d.limit(0), b)).count() == 0
    assert {r.n_hit for r in phrase_index.report(phrase_index.contamination(d, b.limit(0))).collect()} == {0}


def test_proximity(tables):
    docs, items, d, b = tables
    block = next(phrase_index.item_blocks(b.where("item_id = 12 or item_id is null"), "item_id", "text", 13, 1 << 20))
    found = phrase_index.search_near(phrase_index.build_index(d, block.terms), block, 4).collect()
    want = set()
    for i, text in docs:
        w = words(text)
        for item, t in (("12", "short item"), ("", "lone")):
            need = set(words(t))
            for e in range(len(w)):
                s = next((s for s in range(e, max(-1, e - 4), -1) if need <= set(w[s : e + 1])), None)
                if s is not None and w[e] in need:
                    want.add((i, item, s, e))
    assert {tuple(r) for r in found} == want


def test_drop_judges_rows_not_ids(spark, tables):
    _, items, _, b = tables
    bad, clean = items[2][1], "nothing of the kind"
    rows = [(None, bad), (None, clean), (1, bad), (1, clean), (1, clean), (2, None)]
    kept = phrase_index.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(None, clean), (1, clean), (1, clean), (2, None)], key=str)


def test_null_ids_stay_null(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text), (1, "w1"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", text)], "item_id string, text string")
    rows = phrase_index.report(phrase_index.contamination(docs, items)).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in rows) == [("1", 0), ("None", 0), ("None", 30)]
    assert sorted(str(r.doc_id) for r in phrase_index.drop_contaminated(docs, items).collect()) == ["1", "None"]
