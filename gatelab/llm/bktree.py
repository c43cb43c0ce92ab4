"""SimHash near-dedup with BK-trees.

A document's fingerprint has the majority of each bit over the XXH64 hashes of its
shingles.  Equal fingerprints are one node.  Fingerprints within `radius` bits agree
in at least one of radius + 1 disjoint blocks of bits, so each is filed under
radius + 1 shards (block number, block value), and links are looked for inside
shards only: no link is lost.  Every shard has a BK-tree, whose children are keyed
by their integer Hamming distance to the parent; a search with distance d to a node
follows only edges from d - radius to d + radius.  The tree is built and probed
where its shard's rows are: sent to every executor, all trees would grow with the
corpus.  A shard with more than `most` fingerprints is divided by blocks of its
remaining bits in the same way.  Each tree yields a spanning forest of its links,
not all pairs, and union-find over these gives components.

Documents without words (null, empty, white space) have fingerprint zero and are
linked like any other; with fewer words than a shingle, the whole sequence is
the one shingle.  Texts of any length are taken whole.  Rows with equal ids are one
document of that id each; a null id is no smaller than any id, so a component of null
ids alone has a null component_id.  An empty table gives an empty one.  Other
columns are not read.

`keep_one` (the stage of the pipeline) takes the same steps over five-word shingles:
fingerprints, BK-trees in shards, union-find; links are verified exactly, as near copies
are documents whose sets of these shingles have a Jaccard similarity of 0.8 or more.  At
0.8 fingerprints are some ten of 64 bits apart, where pigeonhole blocks tell nothing apart,
so what is still unconnected meets in 16 bands of five MinHash values too (998 of 1000
pairs at 0.8 do, more above) and is verified alike.  Documents without words are copies of
each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelab.llm.components import connected_components, may_be_alike
from gatelab.llm.runtime import LOWER, SPACED, arrow_map, drop_scratch, mix, slices, utf8, word_bounds, word_hashes, write_scratch

BITS = 64
BANDS, BAND_ROWS = 16, 5
LONGS = 16  # of a bitmap of shingles
_BITMAP = [f"b{k}" for k in range(LONGS)]
_PERMUTED = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_WORD = np.cumprod(np.full(64, 0xA0761D6478BD642F, np.uint64))


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text (UTF-8, not yet lower case)."""
    return int(_simhashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width, seed)[0])


def _simhashes(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, SPACED)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # the words again, each after one space: shingle k is then one slice
    size = ends - starts
    to = np.cumsum(size + 1) - size
    line = np.full(int(to[-1] + size[-1]), 0x20, np.uint8)
    inside = np.repeat(to - starts, size) + (src := np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size))
    line[inside] = data[src]
    line = line.tobytes()
    n = np.diff(first)
    shingles = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    rows = np.repeat(np.arange(len(n)), shingles)
    head = np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(first[:-1], shingles)
    tail = np.minimum(head + width, first[1:][rows]) - 1
    a, b = to[head].tolist(), (to + size)[tail].tolist()
    h = np.fromiter((xxh64_intdigest(line[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a))
    filled = np.flatnonzero(shingles)
    out[filled] = _majority(h, (np.cumsum(shingles) - shingles)[filled], shingles[filled])
    return out


def _majority(h: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The fingerprints of rows whose shingles hash to h; at: where the rows begin, many: how many each has, none 0."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = [_simhashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, 42) for a, b in slices(offsets, 1 << 20)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, int, dict] | None = None

    def add(self, value: int, label: int) -> None:
        if self.root is None:
            self.root = (value, label, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, label, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Labels of the entries at most radius away."""
        stack = [self.root] if self.root else []
        while stack:
            v, label, children = stack.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                yield label
            if len(children) < 2 * radius + 1:
                stack.extend(c for k, c in children.items() if d - radius <= k <= d + radius)
            else:
                stack.extend(c for k in range(d - radius, d + radius + 1) if (c := children.get(k)))


def blocks(n: int, bits: list[int]) -> list[list[int]]:
    """bits dealt into n runs of nearly equal length."""
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _shard_rows(nodes: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint under radius + 1 shards: part (which block) and value (its bits)."""
    parts = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("value")) for k, b in enumerate(blocks(radius + 1, list(range(BITS))))]
    return nodes.select("fp", "node", F.explode(F.array(*parts)).alias("s")).select("s.part", "s.value", "fp", "node")


def _divided(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of large shards under blocks of the bits that their shard doesn't fix."""
    arms = []
    for k, fixed in enumerate(blocks(radius + 1, list(range(BITS)))):
        rest = [b for b in range(BITS) if b not in set(fixed)]
        subs = [
            F.struct(F.lit((k + 1) * 100 + j).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(fixed + sub))).alias("value"))
            for j, sub in enumerate(blocks(radius + 1, rest))
        ]
        arms.append(F.when(F.col("part") == k, F.array(*subs)))
    return rows.select("fp", "node", F.explode(F.coalesce(*arms)).alias("s")).select("s.part", "s.value", "fp", "node")


def _forest(radius: int):
    """Links of a spanning forest of each shard, from rows sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, parent = None, BKTree(), {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            a, b = [], []
            for part, value, fp, node in zip(*cols):
                if (part, value) != now:
                    now, tree, parent = (part, value), BKTree(), {}
                fp &= (1 << 64) - 1
                parent.setdefault(node, node)
                for other in tree.within(fp, radius):
                    x, y = find(node), find(other)
                    if x != y:
                        parent[x] = y
                        a.append(node)
                        b.append(other)
                tree.add(fp, node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def hamming_links(nodes: DataFrame, radius: int = 2, most: int = 50_000) -> DataFrame:
    """nodes: fp (distinct), node.  Returns links a, b that connect whatever is connected by distances up to radius."""
    rows = _shard_rows(nodes, radius)
    large = rows.groupBy("part", "value").count().where(F.col("count") > most).select("part", "value")
    large = write_scratch(large, "large-shards")
    if large.limit(1).count():
        rows = rows.join(large, ["part", "value"], "left_anti").unionByName(_divided(rows.join(large, ["part", "value"], "left_semi"), radius))
    return arrow_map(rows.repartition("part", "value").sortWithinPartitions("part", "value", "node"), _forest(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, most: int = 50_000) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest id reachable over links, itself included)."""
    prints = write_scratch(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = write_scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # rows of one id with different texts are nodes of the same label: joined as they are one document
    found = write_scratch(connected_components(hamming_links(nodes, radius, most)), "simhash-components")
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row and their offsets; a row of fewer words is one shingle, one without words has none."""
    starts, ends, first = word_bounds(data := LOWER[data], offsets, SPACED)
    h, n = word_hashes(data, starts, ends), np.diff(first)
    many = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    to = np.concatenate([[0], np.cumsum(many)])
    rows = np.repeat(np.arange(len(n)), many)
    head = np.arange(to[-1]) - np.repeat(to[:-1], many) + np.repeat(first[:-1], many)
    out = np.zeros(len(head), np.uint64)
    for k in range(width):
        # words past the end of a short row count as none
        out += np.where(head + k < first[1:][rows], h[np.minimum(head + k, max(len(h) - 1, 0))], np.uint64(0)) * _WORD[k] if len(h) else 0
    return mix(out), to


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """rows: row, text.  Returns row, k1, k2 (equal for equal bags of shingles), fp (the fingerprint over these shingles), bands, many
    (shingles, repeats included) and the longs of a bitmap of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = batch.num_rows
            keys, bands = np.zeros((2, n), np.uint64), np.zeros((n, BANDS), np.uint64)
            filled, prints = np.zeros(n, bool), np.zeros(n, np.uint64)
            many, bits = np.zeros(n, np.int64), np.zeros((n, LONGS), np.uint64)
            for a, b in slices(offsets, 1 << 20):
                h, to = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                many[a:b] = np.diff(to)
                held = np.zeros((b - a) * LONGS * 64, bool)
                held[np.repeat(np.arange(b - a), np.diff(to)) * (LONGS * 64) + (h % np.uint64(LONGS * 64)).astype(np.int64)] = True
                bits[a:b] = np.packbits(held.reshape(b - a, -1), axis=1, bitorder="little").view(np.uint64)
                full = np.flatnonzero(np.diff(to))
                if not len(full):
                    continue
                at = to[full]
                filled[a + full] = True
                prints[a + full] = _majority(h, at, np.diff(to)[full])
                for k in range(2):
                    keys[k, a + full] = np.add.reduceat(mix(h + np.uint64(k + 1)), at)
                for k in range(BANDS):
                    band = np.full(len(full), k, np.uint64)
                    for j in range(BAND_ROWS):
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * _PERMUTED[k * BAND_ROWS + j], at))
                    bands[a + full, k] = band
            to = np.concatenate([[0], np.cumsum(np.where(filled, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(to), pa.array(bands[filled].reshape(-1).view(np.int64)))
            sketch = [pa.array(many), *[pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(LONGS)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(prints.view(np.int64)), lists, *sketch], names=["row", "k1", "k2", "fp", "bands", "many", *_BITMAP]
            )

    return arrow_map(rows, run, "row long, k1 long, k2 long, fp long, bands array<long>, many long, " + ", ".join(f"{b} long" for b in _BITMAP))


def _alike(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least that Jaccard similarity, compared exactly (by 64 bits of hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xo), (y, yo) = utf8(batch.column(2)), utf8(batch.column(3))
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                s, t = (np.unique(_sets(d[o[k] : o[k + 1]], np.array([0, o[k + 1] - o[k]]), width)[0]) for d, o in ((x, xo), (y, yo)))
                if min(len(s), len(t)) >= threshold * max(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good[k] = both >= threshold * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in range(2)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    return arrow_map(both.select("a", "b", "x", "y"), run, "a long, b long")


def _print_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect whatever fingerprints connect: each with the least of its fingerprint, and those by the BK-trees."""
    first = write_scratch(nodes.groupBy("fp").agg(F.min("node").alias("node")), "simhash-nodes")
    same = nodes.select("node", "fp").join(first.withColumnRenamed("node", "least"), "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return same.union(hamming_links(first, radius))


def copy_groups(rows: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 2) -> DataFrame:
    """rows: row (distinct longs), text.  Returns row, group: groups are connected by pairs of that Jaccard similarity or more.

    Rows of equal bags of shingles are one node.  Fingerprints of the nodes are linked by BK-trees in shards, as in
    simhash_components, and these links are verified exactly; union-find over them gives the first components.  What is further
    apart than fingerprints reach, or hung together by a link that verification drops, is looked for among nodes of different
    components: they meet in bands of a MinHash signature.  In every band each node is
    compared with one of its nodes, drawn by hash for each band, then those of other components than that one's with the
    nodes of all components but their own: a pair of a band is compared or already connected.  Pairs that bitmaps of the
    shingles show to be less alike are left out where bands are joined; only of the others do texts meet."""
    signed = write_scratch(_signed(rows, width), "signed")
    same = [F.first(c).alias(c) for c in ("fp", "bands", "many", *_BITMAP)]
    nodes = write_scratch(signed.groupBy("k1", "k2").agg(F.min("row").alias("node"), *same), "nodes")
    sketches = nodes.select("node", "many", *_BITMAP)
    alike = may_be_alike("x", "y", _BITMAP, threshold)
    texts = rows.select("row", "text")
    each = nodes.select("node", F.explode("bands").alias("band"))
    hubs = each.groupBy("band").agg(F.max(F.struct(F.xxhash64("node", "band").alias("h"), "node")).alias("top"), F.count("*").alias("m")).where("m > 1")
    members = write_scratch(each.join(hubs.select("band", F.col("top.node").alias("hub")), "band"), "members")

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Those pairs that bitmaps don't rule out, and of these the links."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.node")).join(sketches.alias("y"), F.col("b") == F.col("y.node"))
        pairs = write_scratch(pairs.where(alike).select("a", "b"), "pairs")
        return pairs, write_scratch(_alike(pairs, texts, width, threshold), "copy-links")

    def placed(found: DataFrame) -> DataFrame:
        """The members of bands with their components, and those of their hubs."""
        of = found.select("node", F.col("component").alias("c"))
        hub_of = found.select(F.col("node").alias("hub"), F.col("component").alias("hc"))
        return members.join(of, "node", "left").join(hub_of, "hub", "left").select("band", "node", "hub", F.coalesce("c", "node").alias("c"), F.coalesce("hc", "hub").alias("hc"))

    near, near_links = verified(_print_pairs(nodes, radius))
    first = write_scratch(connected_components(near_links), "copy-components")
    met, met_links = verified(placed(first).where("c <> hc").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    pairs, links = near.union(met), near_links.union(met_links)
    found = write_scratch(connected_components(links), "copy-components")

    at = placed(found).drop("hub")
    apart = write_scratch(at.where("c <> hc"), "apart")
    others = at.join(apart.select("band").distinct(), "band", "left_semi").join(sketches, "node").alias("y")
    cross = apart.join(sketches, "node").alias("x").join(others, (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & alike)
    cross = cross.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    more = write_scratch(_alike(cross.join(pairs, ["a", "b"], "left_anti"), texts, width, threshold), "copy-links")
    if more.limit(1).count():
        before, found = found, write_scratch(connected_components(links.union(more)), "copy-components")
        drop_scratch(before)
    drop_scratch(members, near, met, apart, more)
    groups = nodes.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("group"))
    out = write_scratch(signed.join(groups, ["k1", "k2"]).select("row", "group"), "copy-groups")
    drop_scratch(signed, nodes, first, near_links, met_links, found)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without near copies: of each group of `copy_groups` one row stays, the one of smallest id (null last; rows of
    equal ids by hashes of their texts).  Rows are judged one by one, whatever their ids; other columns are carried along,
    whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # the number stands beside the row, not among its columns
    rows = write_scratch(docs.select(whole, F.monotonically_increasing_id().alias("row")), "rows")
    text = F.col("doc").getField(text_col).cast("string")
    groups = copy_groups(rows.select("row", text.alias("text")), width, threshold)
    i = F.col("doc").getField(id_col).cast("long")
    order = F.struct(i.isNull().alias("n"), i.alias("i"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g"), F.col("row").alias("row"))
    keep = rows.select("row", order.alias("o")).join(groups, "row").groupBy("group").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    return rows.join(keep, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
