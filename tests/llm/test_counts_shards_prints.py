"""Token counts (4), sharding (8) and SimHash components (10) against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatelab.llm import bktree, minimax, prefix_counts

DOCS = "doc_id long, text string, lang string, size int, component long"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "e", "'", "l", "'ll", "'re", "v", " ", "  ", "\n", "\t", ".", "!", "é", "ñ", "1", "23", "<|endoftext|>", "<|end", "日本", "🙂", "the", " and", "\x1c", "-", "'s", " "]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["loud", "Soft", "gate", "x", "the", "über", "don't", "mm"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one two"), (105, "y " * 40000), (106, rows[3][1]), (107, rows[3][1]), (3, rows[3][1])]
    rows += [(200 + k, rows[5][1] + " " + words[k]) for k in range(8)]
    return spark.createDataFrame([(i, t, None, 1, 7) for i, t in rows], DOCS)


def test_prefix_counts_at_every_prefix():
    t, c = Tokenizer.from_file(PATH), prefix_counts.PrefixCounter(PATH, keep=50)
    rng = random.Random(1)
    for _ in range(400):
        s = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        want = [len(t.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert prefix_counts.prefix_counts(c.deltas(s)).tolist() == want, s


def test_prefix_table_and_budget(docs):
    t = Tokenizer.from_file(PATH)
    table = prefix_counts.prefix_table(docs, PATH)
    rows = {(r.doc_id, r.n_bytes, r.n_tokens) for r in table.collect()}
    assert rows == {(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in prefix_counts.answer_budget(table, 20).collect():
        x = texts[r.doc_id]
        n = lambda k: len(t.encode(x[:k], add_special_tokens=False).ids)
        assert n(r.longest_prefix) <= 20 and (r.longest_prefix == len(x) or n(r.longest_prefix + 1) > 20)
        assert r.fits == (n(len(x)) <= 20)
    assert prefix_counts.prefix_table(docs.limit(0), PATH).count() == 0


def brute_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        for s in sizes:
            if s > mid:
                used = shards + 1
                break
            if room + s > mid:
                used, room = used + 1, 0
            room += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def test_minimax_in_memory():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([1, 5, 16, 300]) + rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
        k = rng.randint(1, 9)
        capacity, cuts = minimax.minimax(sizes, k)
        assert capacity == brute_capacity(sizes, k)
        bounds = [0, *cuts, len(sizes)]
        assert len(bounds) - 1 <= k and all(sum(sizes[a:b]) <= capacity for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("fan_out", [8, 1 << 16])
def test_shards(docs, fan_out):
    rows = minimax.shard_by_bytes(docs, 7, fan_out=fan_out).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).groupBy("k").agg(F.sum(F.col("n") + 16).alias("s"))
    sizes = [r.s for r in keyed.orderBy("k").collect()]
    total = {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) <= brute_capacity(sizes, 7)
    crc = {}
    for r in rows:
        assert crc.setdefault((r.text_crc32, r.size), r.shard) == r.shard  # equal texts stay together
    assert minimax.shard_by_bytes(docs.limit(0), 7).count() == 0


def brute_print(text, seed=42):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=2):
    root = {i: i for i in prints}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("most", [2, 50_000])
def test_simhash(docs, most):
    rows = bktree.simhash_components(docs, most=most).select("doc_id", bktree.hex_fingerprint().alias("f"), "component_id").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    label = components(prints)
    assert sorted(tuple(r) for r in rows) == sorted((r.doc_id, f"{prints[r.doc_id]:016x}", label[r.doc_id]) for r in docs.collect())
    assert bktree.simhash_components(docs.limit(0)).count() == 0
    kept = [r.doc_id for r in bktree.keep_one(docs).collect()]
    assert sorted(set(kept)) == sorted(set(label.values())) and bktree.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("most", [3, 50_000])
def test_links_lose_nothing(spark, most):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    values = set(base)
    for b in base:  # chains of steps of one to three bits
        for _ in range(30):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                b ^= 1 << int(bit)
            values.add(b)
    prints = dict(enumerate(sorted(values)))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in prints.items()]
    links = bktree.hamming_links(spark.createDataFrame(rows, "fp long, node long"), 2, most)
    found = {r.node: r.component for r in bktree.connected_components(links).collect()}
    assert {i: found.get(i, i) for i in prints} == components(prints)


def test_bk_tree():
    rng = random.Random(4)
    values = [rng.getrandbits(10) for _ in range(200)]
    tree = bktree.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for q in range(0, 1024, 37):
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


@pytest.mark.parametrize("sizes, shards", [([5] * 300 + [1500] + [5] * 300, 40), ([1] * 1000, 7), ([9, 1, 1, 1, 9], 3), ([4], 5), ([], 3)])
def test_shards_are_near_equal_below_the_capacity(sizes, shards):
    capacity, cuts = minimax.minimax(sizes, shards)
    edges = [0, *cuts, len(sizes)]
    parts = [sum(sizes[a:b]) for a, b in zip(edges, edges[1:])]
    assert max(parts, default=0) <= capacity and len(parts) <= shards
    if len(sizes) > 500:
        rest = sorted(parts)[2:-1]  # without a dominating group, and the shards that it and the end cut short
        assert len(parts) >= shards - 1 and max(rest) <= 1.3 * min(rest)


@pytest.mark.parametrize("sizes,largest", [([100] * 41, [200] + [100] * 39), ([1000] + [10] * 300, None), ([10] * 150 + [1000] + [10] * 150, None), ([10] * 300 + [1000], None), ([5] * 12, None)])
def test_all_shards_are_used(sizes, largest):
    """Groups coarser than shards, a group that dominates at any place, fewer groups than shards."""
    capacity, cuts = minimax.minimax(sizes, 40)
    bounds = [0, *cuts, len(sizes)]
    got = [sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])]
    assert capacity == brute_capacity(sizes, 40) and max(got) <= capacity and min(got) > 0
    assert len(got) == min(40, len(sizes))
    assert largest is None or sorted(got, reverse=True) == largest
    assert largest or max(x for x in got if x < 1000) <= 80


def test_coarse_groups_use_all_shards(spark):
    rows = [(i, f"group {i % 41:03d} " * 10) for i in range(410)]
    got = minimax.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    assert {r.shard for r in got} == set(range(40))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(40)]
    assert sorted(sizes)[-1] == 2 * sorted(sizes)[-2] == 2 * min(sizes)
