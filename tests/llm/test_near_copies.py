"""The near-copies stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from gatelab.llm import bktree

SCHEMA = "doc_id long, text string, n_chars long"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(docs, threshold=0.8):
    """Groups (row numbers) that pairs of the threshold connect."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= threshold:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k), []).append(k)
    return list(groups.values())


def run(spark, docs):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], SCHEMA).repartition(4)
    out = corpus_pipeline.near_copies(spark, df, "")
    assert out.columns == df.columns
    return [(r.doc_id, r.text) for r in out.collect()]


def test_word_edits_are_found(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    docs = []
    for n in (60, 200, 600, 1500):
        for _ in range(12):
            base = rng.choices(words, k=n)
            docs.append((len(docs), " ".join(base)))
            for share in (0.01, 0.02, 0.03):
                w = list(base)
                for k in rng.sample(range(n), max(1, round(n * share))):
                    w[k] = rng.choice(words)
                docs.append((len(docs), " ".join(w).upper() if rng.random() < 0.3 else "\n".join(w)))
    # a chain whose ends are unlike, and a pair just below the threshold
    chain = [str(k) for k in range(1000)]
    docs += [(5000 + k, " ".join(chain[60 * k : 60 * k + 600])) for k in range(6)]
    docs += [(6000, " ".join(f"x{k}" for k in range(104))), (6001, " ".join(f"x{k}" for k in range(30, 134)))]
    docs += [(7000, "one two"), (7001, "One  two"), (7002, "two one")]
    want = sorted(min(docs[k][0] for k in g) for g in brute(docs))
    assert sorted(i for i, _ in run(spark, docs)) == want and 5001 not in want and 6001 in want


def test_null_and_repeated_ids(spark):
    line = lambda s: " ".join(f"{s}{k}" for k in range(40))
    docs = [(None, line("a")), (None, line("b")), (None, line("b")), (1, line("c")), (1, line("d")), (2, line("c")), (None, line("d")), (0, line("e")), (3, line("e")), (3, line("f"))]
    got = sorted(t.split()[0] + str(i) for i, t in run(spark, docs))
    assert got == ["a0None", "b0None", "c01", "d01", "e00", "f03"]


def test_documents_of_one_frame_are_not_compared_pair_by_pair(spark, monkeypatch):
    """600 documents that share a frame, alike at some 0.6, and two copies: only what may be alike is verified."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    frame, docs = words(300), []
    for k in range(600):
        d = list(frame)
        for at in rng.sample(range(0, 300, 10), 5):
            d[at : at + 10] = words(10)
        docs.append((k, " ".join(d)))
    docs.append((600, docs[7][1] + " end"))
    verified, whole = [], bktree._alike
    monkeypatch.setattr(bktree, "_alike", lambda pairs, *a: (verified.append(pairs.count()), whole(pairs, *a))[1])
    assert sorted(i for i, _ in run(spark, docs)) == list(range(600))
    assert sum(verified) < 10 * len(docs)


def test_fingerprints_link_first(spark, monkeypatch):
    """fingerprints and BK-trees link what they reach; without them bands alone would, so bands are taken away here."""
    base = [f"w{k}" for k in range(4000)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["end"])), (3, " ".join(f"x{k}" for k in range(300))), (4, ""), (5, None)]
    asked, trees = [], bktree.hamming_links
    monkeypatch.setattr(bktree, "hamming_links", lambda nodes, *a: (asked.append(nodes.count()), trees(nodes, *a))[1])
    assert sorted(i for i, _ in run(spark, docs)) == [1, 3, 4]
    assert asked in ([3], [4])
    signed = bktree._signed
    monkeypatch.setattr(bktree, "_signed", lambda *a: signed(*a).withColumn("bands", F.array(F.xxhash64("row"))))
    assert sorted(i for i, _ in run(spark, docs)) == [1, 3, 4]


def test_shards_are_dealt_by_all_bits():
    """blocks of the fingerprint's 64 bits; of the low 16 alone shards hold a thirtieth of all fingerprints."""
    assert bktree.BITS == 64 and [len(b) for b in bktree.blocks(3, list(range(bktree.BITS)))] == [21, 21, 22]
