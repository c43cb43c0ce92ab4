"""Benchmark decontamination over a distributed positional inverted index.

Training documents are indexed in segments of bounded size.  A segment stores, for
each term of the test items, the sorted positions at which it stands (terms that no
item has are never looked up and are not stored).  A phrase is found by taking its
rarest term in the segment, shifting that term's positions by the term's offset in
the phrase, and intersecting with the offset-adjusted positions of the next rarer
terms in turn.  Proximity matches are windows of limited width that hold all terms
of an item.

Segments are built and searched where the documents are; nothing is shuffled.  The
test items are broadcast in blocks of at most `block_bytes` of text; with more than
one block, each is searched in a pass of its own and the spans are merged by row.

Terms are compared by 64-bit hashes of their lower-case words, position by position.

The index lives as long as the pass over its segment: what it holds depends on the items'
terms, and building it costs less than reading it back, so it isn't stored.

Null text has no words: such documents are reported with zeros, such items never
match.  A null document id stays null.  Texts of any length are searched whole; a very
long one is a segment of its own.  Empty tables give empty results.  Null item ids are the empty string.  Repeated rows get equal results.
Columns other than the ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import ALNUM, LOWER, arrow_map, long_column, packed, slices, utf8, word_bounds, word_hashes, write_scratch

SEGMENT = 2 << 20


@dataclass
class Phrases:
    """A bounded block of test items: the terms of all windows, as numbers of sorted distinct hashes."""

    items: list[str]
    terms: np.ndarray  # sorted hashes
    windows: np.ndarray  # windows x width term numbers, -1 beyond the end
    lengths: np.ndarray
    owner: np.ndarray  # item of each window
    words: list[np.ndarray]  # term numbers of each item


def phrases(items: list[tuple[str, str | None]], width: int) -> Phrases:
    texts = pa.array([(t or "").encode() for _, t in items], pa.binary())
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    hashes = word_hashes(data, starts, ends)
    terms, number = np.unique(hashes, return_inverse=True)
    rows, lengths, owner, words = [], [], [], []
    for i in range(len(items)):
        w = number[first[i] : first[i + 1]]
        words.append(w)
        n = min(len(w), width)
        for k in range(max(len(w) - width, 0) + 1 if n else 0):
            rows.append(np.pad(w[k : k + n], (0, width - n), constant_values=-1))
            lengths.append(n)
            owner.append(i)
    return Phrases([a for a, _ in items], terms, np.array(rows, np.int64).reshape(-1, width), np.array(lengths, np.int64), np.array(owner, np.int64), words)


class Segment:
    """The positional index of one run of documents: for each term its sorted positions, as one sorted array of
    term * 2**40 + position; a position counts words from the segment's start."""

    def __init__(self, first: np.ndarray, postings: np.ndarray):
        self.first, self.postings = first, postings

    @classmethod
    def build(cls, data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> Segment:
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, ALNUM)
        h = word_hashes(data, starts, ends)
        if not len(terms) or not len(h):
            return cls(first, np.zeros(0, np.int64))
        # a small table by low bits tells nearly all other words apart at once
        seen = np.zeros(1 << 16, bool)
        seen[terms & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(seen[h & np.uint64(0xFFFF)])
        k = np.minimum(np.searchsorted(terms, h[at]), len(terms) - 1)
        ok = terms[k] == h[at]
        return cls(first, np.sort((k[ok].astype(np.int64) << 40) + at[ok]))

    def counts(self, n_terms: int) -> np.ndarray:
        return np.diff(np.searchsorted(self.postings, np.arange(n_terms + 1, dtype=np.int64) << 40))

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        if not len(self.postings):
            return np.zeros(len(terms), bool)
        k = np.searchsorted(self.postings, key := (terms << 40) + positions)
        return self.postings[np.minimum(k, len(self.postings) - 1)] == key

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def exact(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of windows: window numbers and start positions."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(p.windows) or not len(self.postings):
            return none
        n = self.counts(len(p.terms))
        rarity = np.where(p.windows >= 0, n[p.windows], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")  # offsets of a window, rarest term first
        live = np.flatnonzero(rarity.min(axis=1) > 0)
        rare = order[live, 0]
        term = p.windows[live, rare]
        head = np.searchsorted(self.postings, term << 40)
        size = n[term]
        w = np.repeat(live, size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(head, size)
        start = (self.postings[at] & ((1 << 40) - 1)) - np.repeat(rare, size)
        ok = start >= 0
        w, start = w[ok], start[ok]
        for k in range(1, p.windows.shape[1]):
            offset = order[w, k]
            term = p.windows[w, offset]
            ok = (term < 0) | self.has(np.maximum(term, 0), start + offset)
            w, start = w[ok], start[ok]
            if not len(w):
                return none
        same = self.doc_of(start) == self.doc_of(start + p.lengths[w] - 1)
        return w[same], start[same]

    def near(self, words: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
        """Windows of at most `span` words of one document that hold all given terms: (start, end) positions, one for
        each last word at which such a window ends."""
        terms = np.unique(words)
        if not len(terms):
            return
        lists = sorted((self.postings[slice(*np.searchsorted(self.postings, [t << 40, (t + 1) << 40]))] & ((1 << 40) - 1) for t in terms.tolist()), key=len)
        if not len(lists[0]):
            return
        ends = np.unique(np.concatenate(lists))
        # the rarest term must stand close before each end
        k = np.searchsorted(lists[0], ends, "right") - 1
        ends = ends[(k >= 0) & (lists[0][np.maximum(k, 0)] > ends - span)]
        least = ends.copy()
        for x in lists:
            k = np.searchsorted(x, ends, "right") - 1
            last = np.where(k >= 0, x[np.maximum(k, 0)], -(span + 1))
            least = np.minimum(least, last)
        ok = (least > ends - span) & (self.doc_of(np.maximum(least, 0)) == self.doc_of(ends))
        yield from zip(least[ok].tolist(), ends[ok].tolist())


def build_index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table, for a caller to write: a row per segment with doc_ids, first (first position of each document, and the end) and
    postings, all packed int64.  terms: sorted hashes of the terms to store."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.asarray(terms, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = long_column(batch, "id")
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SEGMENT):
                s = Segment.build(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], wanted.value)
                yield pa.RecordBatch.from_arrays([packed([ids[a:b]]), packed([s.first]), packed([s.postings])], names=["doc_ids", "first", "postings"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "doc_ids binary, first binary, postings binary")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Segment]]:
    for batch in batches:
        for ids, first, postings in zip(*(batch.column(k).to_pylist() for k in range(3))):
            yield np.frombuffer(ids, np.int64), Segment(np.frombuffer(first, np.int64), np.frombuffer(postings, np.int64))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint half-open spans that cover the given ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


MATCH = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def search_exact(index: DataFrame, block: Phrases) -> DataFrame:
    """Per document of the index: n_words, the merged spans of words inside occurrences, the items that occur."""
    wanted = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = wanted.value
        for ids, s in _segments(batches):
            w, start = s.exact(p)
            doc = s.doc_of(start)
            spans: list[list] = [[]] * len(ids)
            items: list[list] = [[]] * len(ids)
            order = np.argsort(doc, kind="stable")
            for d, rows in zip(u := np.unique(doc), np.split(order, np.searchsorted(doc[order], u[1:]))) if len(doc) else ():
                a = start[rows] - s.first[d]
                spans[d] = [{"start": x, "end": y} for x, y in merged(a, a + p.lengths[w[rows]])]
                items[d] = sorted({p.items[i] for i in p.owner[w[rows]]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == -(2**63)), pa.array(np.diff(s.first)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return arrow_map(index, run, MATCH)


def search_near(index: DataFrame, block: Phrases, span: int) -> DataFrame:
    """Proximity matches: doc_id, item_id, start, end (words of the document, inclusive)."""
    wanted = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = wanted.value
        for ids, s in _segments(batches):
            rows = [(i, a, b) for i, w in enumerate(p.words) for a, b in s.near(w, span)]
            at = np.array([r[1] for r in rows], np.int64)
            d = s.doc_of(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[d], mask=ids[d] == -(2**63)), pa.array([p.items[r[0]] for r in rows], pa.string()), pa.array(at - s.first[d]), pa.array(np.array([r[2] for r in rows], np.int64) - s.first[d])],
                names=["doc_id", "item_id", "start", "end"],
            )

    return arrow_map(index, run, "doc_id long, item_id string, start long, end long")


def item_blocks(items: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int) -> Iterator[Phrases]:
    """The test items in blocks that are small enough to broadcast."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield phrases([(r.i, r.t) for r in part.collect()], width)


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (words inside an occurrence of a window of an item), items."""
    blocks = item_blocks(items, item_id, item_text, width, block_bytes)
    block = next(blocks)
    second = next(blocks, None)
    if second is None:
        return search_exact(build_index(docs, block.terms, id_col, text_col), block)
    rows = write_scratch(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "rows")
    parts = None
    for b in chain([block, second], blocks):  # no more than two are held at once
        found = write_scratch(search_exact(build_index(rows, b.terms, "row"), b), "matches")
        parts = found if parts is None else parts.union(found)
    whole = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"start": a, "end": b} for a, b in merged(np.array([x["start"] for x in s], np.int64), np.array([x["end"] for x in s], np.int64))]
                for s in batch.column("spans").to_pylist()
            ]
            yield batch.set_column(2, "spans", pa.array(spans, batch.schema.field("spans").type))

    whole = arrow_map(whole, merge, MATCH).withColumnRenamed("doc_id", "row")
    return rows.select("row", "doc_id").join(whole, "row").drop("row").select("doc_id", "n_words", "spans", "items")


def report(found: DataFrame, share: int = 20) -> DataFrame:
    """The figures of each document; contaminated when hit words are at least one in `share`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is contaminated.  Rows are judged one by one, whatever their ids (null or repeated);
    other columns are carried along, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = write_scratch(docs.select(whole, F.monotonically_increasing_id().alias("row")), "rows")
    texts = rows.select("row", F.col("doc").getField(text_col).alias("text"))
    bad = report(contamination(texts, items, id_col="row")).where("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(bad, "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
