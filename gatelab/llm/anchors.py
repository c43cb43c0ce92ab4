"""Substring dedup with fixed-block anchors.

A passage of `window` words that stands in two documents holds, in the first of
them, a whole block of a grid of non-overlapping blocks of (window + 1) // 2 words.
So the blocks are the index, and every rolling window of that many words probes it.
Hits are extended to the full windows around them, which are matched exactly by
longer hashes; runs of matched windows are the maximal exact repeats.  A word is
removed when it lies in a window that also starts in a document of smaller id.

1. Documents are packed into chunks of bounded size, written once.
2. Blocks and probes travel as 32-bit remainders, grouped by hash bucket; each
   bucket answers with bits in the order it was asked.  For every block value only
   the smallest indexed id and the largest probing id matter, so a group of any
   number of copies costs its rows, never its pairs.
3. Windows around hits travel the same way with 80-bit hashes and answer likewise.
4. Chunks are cut by the answers.

Buckets follow the number of shuffle partitions, so their size doesn't grow with
the input; hot values add rows to one bucket only for each document that has them.

Null text has no words.  Texts of any length are cut whole, a long one over several
chunks.  Documents of equal id don't remove from one another.  A null id counts as the
smallest.  Repeated rows get equal results; no rows give none.  Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import SPACED, arrow_map, drop_scratch, long_column, mix, packed, shuffle_partitions, slices, utf8, window_hashes, word_bounds, word_hashes, write_scratch

CHUNK = 4 << 20
_NULL = -(2**63)


def pack_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chunk, ids, offsets, text: runs of documents as rows of about CHUNK bytes of text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = long_column(batch, "id")
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, CHUNK):
                text = pa.compress(data[offsets[a] : offsets[b]].tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), packed([ids[a:b]]), packed([offsets[a : b + 1] - offsets[a]]), pa.array([text], pa.binary())], names=["chunk", "ids", "offsets", "text"]
                )
                number += 1

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(docs, run, "chunk long, ids binary, offsets binary, text binary")


@dataclass
class Chunk:
    """The words of one chunk, by their hashes."""

    number: int
    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    words: np.ndarray
    window: int

    @classmethod
    def read(cls, number: int, ids: bytes, offsets: bytes, text: bytes, window: int) -> Chunk:
        off = np.frombuffer(offsets, np.int64)
        data = np.frombuffer(pa.decompress(text, int(off[-1]), "zstd", asbytes=True), np.uint8)
        starts, ends, first = word_bounds(data, off, SPACED)
        return cls(number, np.frombuffer(ids, np.int64), data, starts, ends, first, word_hashes(data, starts, ends), window)

    def places(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a run of `width` words of one document starts, in documents of `window` words at least; and their documents."""
        n = np.diff(self.first)
        runs = np.where(n >= self.window, n - width + 1, 0)
        doc = np.repeat(np.arange(len(n)), runs)
        at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + self.first[:-1][doc]
        return at, doc

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, documents, hashes of rolling blocks, and whether the block is one of the grid.  A run of equal
        neighbours off the grid is probed once."""
        width = (self.window + 1) // 2
        at, doc = self.places(width)
        h = window_hashes(self.words, width)[at]
        grid = (at - self.first[doc]) % width == 0
        keep = grid.copy()
        if len(h):
            keep[0] = True
            keep[1:] |= (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return at[keep], doc[keep], h[keep], grid[keep]

    def around(self, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For the window starting at each of `at`: whether a block inside it is flagged."""
        width = (self.window + 1) // 2
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[np.minimum(at + self.window - width + 1, len(flags))] > total[at]

    def candidates(self, asks: np.ndarray, shows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From answers to the probes: positions of full windows that ask or show, their documents, and the two roles."""
        at, doc, h, _ = self.probes()
        n = len(self.words)
        ask, show, known = np.zeros(n, bool), np.zeros(n, bool), np.full(n, -1)
        ask[at], show[at], known[at] = asks, shows, at
        places, _ = self.places((self.window + 1) // 2)
        ask[places] = ask[np.maximum.accumulate(known)[places]]  # what was probed once holds for its run
        at, doc = self.places(self.window)
        a, s = self.around(ask, at), self.around(show, at)
        some = a | s
        return at[some], doc[some], a[some], s[some]


def _buckets(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that groups entries by bucket, and bounds of the n buckets in it."""
    bucket = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length form of an array."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[heads], np.diff(np.append(heads, len(values))).astype(np.int32)


def _bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) if b else np.zeros(n, bool)


QUESTION = "chunk long, bucket int, keys binary, checks binary, doc_ids binary, doc_runs binary, asks binary, shows binary"
ANSWER = "chunk long, bucket int, asks binary, shows binary"


def _questions(c: Chunk, doc: np.ndarray, split: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, asks: np.ndarray | None, shows: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of QUESTION: the entries of one chunk by bucket."""
    order, bounds = _buckets(split, n)
    rows = {k: [] for k in ("bucket", "keys", "checks", "doc_ids", "doc_runs", "asks", "shows")}
    ids = c.ids[doc]
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        e = order[bounds[b] : bounds[b + 1]]
        d, runs = _runs(ids[e])
        rows["bucket"].append(b)
        rows["keys"].append(keys[e].tobytes())
        rows["checks"].append(checks[e].tobytes() if checks is not None else b"")
        rows["doc_ids"].append(d.tobytes())
        rows["doc_runs"].append(runs.tobytes())
        rows["asks"].append(np.packbits(asks[e]).tobytes() if asks is not None else b"")
        rows["shows"].append(np.packbits(shows[e]).tobytes())
    cols = [pa.array([c.number] * len(rows["bucket"]), pa.int64()), pa.array(rows["bucket"], pa.int32())]
    return pa.RecordBatch.from_arrays(cols + [pa.array(rows[k], pa.binary()) for k in list(rows)[1:]], names=["chunk", *rows])


def _answer(key_type: type) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: which asking entries have a smaller showing document of the same key, and which showing entries
    have a larger asking one."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        key = np.concatenate([np.frombuffer(r["keys"], key_type) for r in rows])
        size = [len(r["keys"]) // np.dtype(key_type).itemsize for r in rows]
        doc = np.concatenate([np.repeat(np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["doc_runs"], np.int32)) for r in rows])
        show = np.concatenate([_bits(r["shows"], n) for r, n in zip(rows, size)])
        ask = np.concatenate([_bits(r["asks"], n) if r["asks"] else np.ones(n, bool) for r, n in zip(rows, size)])
        if rows[0]["checks"]:
            check = np.concatenate([np.frombuffer(r["checks"], np.uint16) for r in rows])
            order = np.lexsort((check, key))
            new = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        else:
            order = np.argsort(key, kind="stable")
            new = key[order][1:] != key[order][:-1]
        heads = np.flatnonzero(np.concatenate([[True], new]))
        group = np.cumsum(np.concatenate([[0], new.astype(np.int64)]))
        big, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        d = doc[order]
        least = np.minimum.reduceat(np.where(show[order], d, big), heads)
        most = np.maximum.reduceat(np.where(ask[order], d, small), heads)
        hit, useful = np.empty(len(key), bool), np.empty(len(key), bool)
        hit[order] = ask[order] & (least[group] < d)
        useful[order] = show[order] & (most[group] > d)
        out, at = {"chunk": [], "bucket": [], "asks": [], "shows": []}, 0
        for r, n in zip(rows, size):
            a, s = hit[at : at + n], useful[at : at + n]
            at += n
            if a.any() or s.any():
                out["chunk"].append(r["chunk"])
                out["bucket"].append(r["bucket"])
                out["asks"].append(np.packbits(a).tobytes())
                out["shows"].append(np.packbits(s).tobytes())
        return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["bucket"], pa.int32()), pa.array(out["asks"], pa.binary()), pa.array(out["shows"], pa.binary())], names=list(out))

    return run


def _spread(found: list[dict] | None, order: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Answers of all buckets, put back in the order of the entries."""
    asks, shows = np.zeros(len(order), bool), np.zeros(len(order), bool)
    for r in found or ():
        a, b = bounds[r["bucket"]], bounds[r["bucket"] + 1]
        asks[order[a:b]] = _bits(r["asks"], b - a)
        shows[order[a:b]] = _bits(r["shows"], b - a)
    return asks, shows


def _full_keys(c: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, check and bucket hash of full windows."""
    h = window_hashes(c.words, c.window)[at]
    g = window_hashes(mix(c.words ^ np.uint64(0x5851F42D4C957F2D)), c.window)[at]
    return h, (g >> np.uint64(48)).astype(np.uint16), g


def _per_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "asks", "shows")).alias(name))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, removed (maximal runs of removed words, half open), kept (the other
    words, joined by one space)."""
    spark = docs.sparkSession
    n = 2 * shuffle_partitions(spark)
    chunks = write_scratch(pack_chunks(docs, id_col, text_col), "chunks")

    def read(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, dict]]:
        for k in range(batch.num_rows):
            r = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            yield Chunk.read(r["chunk"], r["ids"], r["offsets"], r["text"], window), r

    def ask_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, _ in read(batch):
                _, doc, h, grid = c.probes()
                yield _questions(c, doc, h, (h >> np.uint64(32)).astype(np.uint32), None, None, grid, n)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, r in read(batch):
                at, doc, asks, shows = c.candidates(*_spread(r["blocks"], *_buckets(c.probes()[2], n)))
                key, check, split = _full_keys(c, at)
                yield _questions(c, doc, split, key, check, asks, shows, n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, r in read(batch):
                gone = np.zeros(len(c.words) + 1, np.int64)
                if r["windows"]:
                    at, _, _, _ = c.candidates(*_spread(r["blocks"], *_buckets(c.probes()[2], n)))
                    hit, _ = _spread(r["windows"], *_buckets(_full_keys(c, at)[2], n))
                    np.add.at(gone, at[hit], 1)
                    np.add.at(gone, at[hit] + window, -1)
                yield _cut(c, np.cumsum(gone)[:-1] > 0)

    asked = arrow_map(chunks.select("chunk", "ids", "offsets", "text"), ask_blocks, QUESTION)
    blocks = write_scratch(asked.groupBy("bucket").applyInArrow(_answer(np.uint32), ANSWER), "block-hits")
    hit = chunks.join(_per_chunk(blocks, "blocks"), "chunk")
    asked = arrow_map(hit, ask_windows, QUESTION)
    windows = write_scratch(asked.groupBy("bucket").applyInArrow(_answer(np.uint64), ANSWER), "window-hits")
    both = _per_chunk(blocks, "blocks").join(_per_chunk(windows, "windows"), "chunk")
    return arrow_map(chunks.join(both, "chunk", "left"), cut, "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept string")


def _cut(c: Chunk, gone: np.ndarray) -> pa.RecordBatch:
    """The documents of a chunk without the words marked gone."""
    n_docs = len(c.ids)
    stay = np.flatnonzero(~gone)
    size = (c.ends - c.starts)[stay]
    per_doc = np.searchsorted(stay, c.first)
    # every kept word is followed by one space, the last of a document by none
    last = np.zeros(len(stay), bool)
    last[per_doc[1:][np.diff(per_doc) > 0] - 1] = True
    room = size + ~last
    to = np.cumsum(room) - room
    line = np.full(int(room.sum()), 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[within + np.repeat(to, size)] = c.data[within + np.repeat(c.starts[stay], size)]
    offsets = np.append(to, len(line))[per_doc].astype(np.int32)
    kept = pa.Array.from_buffers(pa.string(), n_docs, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(line.tobytes())])
    edge = np.concatenate([[0], gone.astype(np.int8), [0]])
    removed: list[list] = [[] for _ in range(n_docs)]
    if gone.any():
        a, b = np.flatnonzero(np.diff(edge) == 1), np.flatnonzero(np.diff(edge) == -1)
        # a run that crosses into the next document is two runs
        inner = c.first[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(gone))])
        inner = inner[gone[inner] & gone[inner - 1]]
        a, b = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner]))
        doc = np.searchsorted(c.first, a, "right") - 1
        for d, x, y in zip(doc.tolist(), (a - c.first[doc]).tolist(), (b - c.first[doc]).tolist()):
            removed[d].append({"start": x, "end": y})
    return pa.RecordBatch.from_arrays(
        [pa.array(c.ids, mask=c.ids == _NULL), pa.array(np.diff(c.first)), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), kept],
        names=["doc_id", "n_words", "removed", "kept"],
    )


def digest(found: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
