"""The manifest against trees built in memory, with nulls, ties, repeated rows, clashing names and several depths."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gatelab.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, idx long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, i, own, width):
    """The last node, the siblings of node i on the way, and the last node if node i were `own`."""
    beside = ""
    while len(nodes) > 1:
        a = i - i % width
        run = nodes[a : a + width]
        beside += "".join(run[: i - a] + run[i - a + 1 :])
        own = h("".join(run[: i - a] + [own] + run[i - a + 1 :]))
        nodes = [h("".join(nodes[k : k + width])) for k in range(0, len(nodes), width)]
        i //= width
    return nodes[0], beside, own


def brute(rows, width=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    leaves = [[leaf(r) for r in groups[k]] for k in keys]
    subs = [climb(x, 0, "", width)[0] for x in leaves]
    out = []
    for t, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            new = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                new = (*r[:4], r[4].translate(str.maketrans(UPPER, LOWER)))
            sub, near, own = climb(leaves[t], i, leaf(new), width)
            root, far, own = climb(subs, t, own, width)
            out.append((r[0], leaves[t][i], sub, root, h(near + far), own, own == root))
    return out


def found(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(docs, COLUMNS, {"text": F.translate("text", UPPER, LOWER)}, tampered, **settings)


def compare(spark, rows, **settings):
    got = found(spark, rows, **settings).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, settings.get("width", 16)), key=key)
    return got


def made(n, seed=1):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Ab c", "ÉZ straße", "Long Words " * rng.randint(1, 2000)])
    rows = [(i or None, rng.choice(["b", "é", "a", None, f"alone{i}"]) if i % 3 else "hot", rng.choice([None, "en"]), rng.choice([None, i]), text()) for i in range(n)]
    return rows + [(7, "hot", "en", 1, "x")] * 2 + [(7, "hot", "en", 2, "X"), (None, "hot", None, None, None)]


def test_equals_trees_in_memory(spark):
    got = compare(spark, made(1200))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("width,depth", [(2, 1), (3, 2), (16, 3)])
def test_blocks_of_any_depth(spark, width, depth):
    compare(spark, made(150, 2), width=width, depth=depth)


def test_edges_of_runs(spark):
    """Groups of 1, 16, 17, 256 and 257 rows: full runs, a last run of one, a group that just fits a block."""
    rows = [(i, f"s{n}", "en", 1, f"T{i}") for n in (1, 16, 17, 256, 257) for i in range(n)]
    compare(spark, rows)


def test_lone_row_and_no_rows(spark):
    got = compare(spark, [(5, None, None, None, "A")])
    assert got[0].leaf == got[0].subroot == got[0].root and got[0].proof == h("")
    assert found(spark, []).collect() == []


def test_versions_own_their_path_alone(spark):
    """A version owns one digest a level, from the changed leaf to its root, and shares the rest."""
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(300)]
    got = {r.doc_id: r for r in found(spark, rows).collect()}
    assert all(len(r.copied) == 4 and r.copied[-1] == r.folded_root for r in got.values())  # 300, 19, 2 and 1 nodes
    changed = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    own = [d for i in changed for d in got[i].copied]
    assert len(set(own)) == len(own) == 4 * len(changed)
    same = {tuple(got[i].copied[2:]) for i in range(256) if i not in changed}
    assert len(same) == 1 and got[1].copied[0] == got[1].leaf


def test_without_tampering_all_is_verified(spark):
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in made(60, 3)], SCHEMA)
    assert {r.verified for r in merkle.manifest(docs, COLUMNS).collect()} == {True}
