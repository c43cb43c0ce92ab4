"""SentencePiece encoding by sampling, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for every
piece that spells the text between two nodes; a character that is no piece has its
bytes as a chain of byte pieces.  Forward filtering sums the weights of all paths to
each node, exp(inverse_temperature * score) per piece; backward sampling walks from
the end and takes each edge with its share of its node's sum, which draws a
segmentation in proportion to its weight.  The random numbers are hashes of the row
key, the place in the row and the step, so a row's pieces are the same on any
cluster and after any retry.

No piece holds a space after another character, and none has certain marks right
after a word character (found when the model is read), so a text falls apart there
into units whose lattices are independent.  Forward sums of a unit are computed once and kept
while it is in use; all units of a batch of texts are sampled together, one numpy
step per piece.

Decoding joins the pieces' bytes and drops the one space that encoding puts in
front.  A text's own U+2581 is written in bytes, so that it is not taken for a
space: decoding always gives back the text.

Null text is encoded as null; empty text as no pieces.  Repeated rows get equal
pieces; no rows give none.  A null key is a key like any other.  Texts of any length are encoded whole.
Other columns are carried along; one named like an output column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import arrow_map, long_column, mix

_MARKS = ".,;:!?|#$%*&"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 30


def _roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h + code.astype(np.uint64) + np.uint64(1)) * _GOLD


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


class Lattice:
    def __init__(self, model: str, inverse_temperature: float, keep_nodes: int = 1_600_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte_id, self.score, self.bytes_of = {}, {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.score[piece] = (i, inverse_temperature * sp.get_score(i))
                self.bytes_of.append(piece.replace("▁", " ").encode())
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces: decoding wouldn't be lossless")
        if "\0" in "".join(self.score) or any("▁" in p[1:] and p.strip("▁") for p in self.score):
            raise ValueError("a piece holds NUL, or a space after another character")
        # marks that no piece has right after a word character: a text may be cut before them there
        word = re.compile(r"\w")
        cut = {m for m in _MARKS if not any(y == m and word.match(x) for p in self.score for x, y in zip(p, p[1:]))}
        marks = re.escape("".join(sorted(cut)))
        self.unit = re.compile(rf" *[^ \n](?:[^ \n{marks}]+|(?<!\w)[{marks}])*|\n| +" if marks else r" *[^ \n]+|\n| +")
        self.keep_nodes = keep_nodes
        # by length: pieces as sorted hashes with their codes, ids and weights, and which hashes begin a longer piece
        by_size: dict[int, list[str]] = {}
        for p in self.score:
            by_size.setdefault(len(p), []).append(p)
        self.longest = max(by_size)
        begins = [np.zeros(1 << 16, bool) for _ in range(self.longest + 2)]
        self.table = {}
        for n, pieces in by_size.items():
            codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = np.zeros(len(pieces), np.uint64)
            for k in range(n):
                h = _roll(h, codes[:, k])
                if k + 1 < n:
                    begins[k + 1][_low(h)] = True
            order = np.argsort(h)
            ids, weights = zip(*(self.score[p] for p in pieces))
            seen = np.zeros(1 << 16, bool)
            seen[_low(h)] = True
            self.table[n] = (h[order], codes[order], np.array(ids, np.int32)[order], np.array(weights)[order], seen)
        self.begins = begins
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.first = np.zeros(0, np.int64)  # start node of each unit
        self.last = np.zeros(0, np.int64)  # end node
        self.share = np.zeros(0, np.int64)  # per edge: node << 30 | cumulated share of its node's sum
        self.source = np.zeros(0, np.int64)
        self.piece = np.zeros(0, np.int32)
        self.nodes = 0

    def matches(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in a run of characters: start, length, id and weight.  room: characters left in each one's unit."""
        found = []
        live, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, self.longest + 1):
            ok = room[live] >= n
            live, h = live[ok], h[ok]
            h = _roll(h, codes[live + n - 1])
            low = _low(h)
            if n in self.table:
                hashes, spelled, ids, weights, seen = self.table[n]
                k = np.flatnonzero(seen[low])
                at = np.minimum(np.searchsorted(hashes, h[k]), len(hashes) - 1)
                ok = (spelled[at] == codes[live[k][:, None] + np.arange(n)]).all(1)
                at, start = at[ok], live[k[ok]]
                found.append((start, np.full(len(start), n), ids[at], weights[at]))
            ok = self.begins[n][low]
            live, h = live[ok], h[ok]
            if not len(live):
                break
        return tuple(np.concatenate(x) for x in zip(*found))

    def add(self, units: list[str]) -> None:
        """Forward filtering of new units, all together.  Node numbers: one for each place between characters of a unit,
        and one for each between the bytes of a character that is no piece."""
        text = "".join(units)
        codes = np.frombuffer(text.replace("▁", "\0").replace(" ", "▁").encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(size)
        unit = np.repeat(np.arange(len(units)), size)
        start, length, piece, weight = self.matches(codes, end[unit] - np.arange(len(codes)))
        known = np.zeros(len(codes), bool)
        known[start[length == 1]] = True
        chains = [(i, text[i].encode()) for i in np.flatnonzero(~known).tolist()]
        extra = np.zeros(len(codes) + 1, np.int64)
        for i, c in chains:
            extra[i + 1] = len(c) - 1
        place = np.arange(len(codes) + 1) + np.cumsum(extra) + self.nodes  # but for one more per unit before
        first = place[end - size] + np.arange(len(units))
        last = place[end] + np.arange(len(units))
        source = [place[start] + unit[start]] + [place[i] + unit[i] + np.arange(len(c)) for i, c in chains]
        to = np.concatenate([place[start + length] + unit[start]] + [x + 1 for x in source[1:]])
        source = np.concatenate(source)
        piece = np.concatenate([piece] + [np.array([self.byte_id[x] for x in c], np.int32) for _, c in chains])
        weight = np.concatenate([weight, np.zeros(len(to) - len(weight))])
        base = int(last[-1]) + 1
        n = base - self.nodes
        depth = to - np.concatenate([first[unit[start]]] + [np.full(len(c), first[unit[i]]) for i, c in chains])
        # the pieces of one length are in order already, so this merges a few runs
        order = np.argsort(to, kind="stable")
        to, source, weight, depth = to[order], source[order], weight[order], depth[order]
        alpha = np.zeros(n)
        value = np.zeros(len(to))
        # nodes at equal distance from their unit's start are summed at once
        by_depth = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
        bounds = np.flatnonzero(np.diff(depth[by_depth], prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(by_depth)]):
            e = by_depth[a:b]
            v = alpha[source[e] - self.nodes] + weight[e]
            heads = np.flatnonzero(np.diff(to[e], prepend=-1))
            total = np.logaddexp.reduceat(v, heads)
            alpha[to[e][heads] - self.nodes] = total
            value[e] = np.exp(v - np.repeat(total, np.diff(np.append(heads, len(e)))))
        heads = np.flatnonzero(np.diff(to, prepend=-1))
        # whole numbers, so that a node's shares don't depend on what else is summed here
        value = np.rint(value * (1 << _BITS)).astype(np.int64)
        sums = np.cumsum(value)
        size = np.diff(np.append(heads, len(to)))
        share = np.minimum(sums - np.repeat(sums[heads] - value[heads], size), 1 << _BITS)
        share[np.append(heads[1:], len(to))[: len(heads)] - 1] = 1 << _BITS
        self.number.update(zip(units, range(len(self.first), len(self.first) + len(units))))
        self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, last])
        self.share = np.concatenate([self.share, (to << _BITS) + share])
        self.source, self.piece = np.concatenate([self.source, source]), np.concatenate([self.piece, piece[order]])
        self.nodes = base

    def encode(self, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts, and the offsets of each text's ids."""
        found = [self.unit.findall(" " + t) if t else [] for t in texts]
        per_text = np.array([len(f) for f in found], np.int64)
        units = [u for f in found for u in f]
        if self.nodes > self.keep_nodes:
            self.clear()
        if new := list(dict.fromkeys(u for u in units if u not in self.number)):
            self.add(new)
        u = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        row = np.repeat(np.arange(len(texts)), per_text)
        place = np.arange(len(units)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        rng = mix(mix(keys.view(np.uint64) + np.uint64(seed * int(_GOLD) % 2**64))[row] + place.astype(np.uint64) * _GOLD)
        count = np.zeros(len(units), np.int64)
        live, at, first, steps = np.arange(len(units)), self.last[u], self.first[u], []
        while len(live):
            draw = (mix(rng[live] + np.uint64((len(steps) + 1) * int(_GOLD) % 2**64)) >> np.uint64(64 - _BITS)).astype(np.int64)
            edge = np.searchsorted(self.share, (at << _BITS) + draw, "right")
            steps.append((live, self.piece[edge]))
            count[live] += 1
            at = self.source[edge]
            on = at != first[live]
            live, at = live[on], at[on]
        ends = np.cumsum(count)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (who, piece) in enumerate(steps):
            ids[ends[who] - 1 - k] = piece
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


def _path(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def fresh(name: str, df: DataFrame) -> str:
    """The name, or the first longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(
    df: DataFrame, key_col: str = "doc_id", text_col: str = "text", out_col: str = "pieces", model: str = "piece_bpe_32k.model", inverse_temperature: float = 0.001, seed: int = 1, check_col: str | None = None
) -> DataFrame:
    """df with a column of sampled piece ids; with check_col also one that tells whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(_path(model), inverse_temperature)
        for batch in batches:
            n = batch.num_columns - 2  # key and text stand last, whatever the names
            keys, rest = long_column(batch, n), batch.select(list(range(n)))
            for a in range(0, batch.num_rows, 256):
                texts = batch.column(n + 1).slice(a, 256).to_pylist()
                for x, y in _slices(texts):
                    part = texts[x:y]
                    ids, offsets = lattice.encode([t or "" for t in part], keys[a + x : a + y], seed)
                    gone = pa.array([t is None for t in part])
                    out = rest.slice(a + x, y - x).append_column(out_col, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=gone))
                    if check_col:
                        same = [lattice.decode(ids[i:j].tolist()) == (t or "") for t, i, j in zip(part, offsets, offsets[1:])]
                        out = out.append_column(check_col, pa.array(same))
                    yield out

    kept = df.drop(out_col, *[check_col] * bool(check_col))  # what the new columns replace
    base = df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{key_col}`").cast("long").alias(fresh("key", df)), F.col(f"`{text_col}`").alias(fresh("text", df)))
    df = kept
    return arrow_map(base, run, f"{_fields(df)}`{out_col}` array<int>" + f", `{check_col}` boolean" * bool(check_col))


def decode(df: DataFrame, pieces_col: str = "pieces", out_col: str = "decoded", model: str = "piece_bpe_32k.model") -> DataFrame:
    """df with the text that piece ids spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(_path(model), 1.0)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = [None if p is None else lattice.decode(p) for p in part.column(pieces_col).to_pylist()]
                yield part.append_column(out_col, pa.array(text, pa.string()))

    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out_col])
    return arrow_map(df, run, f"{_fields(df)}`{out_col}` string")
