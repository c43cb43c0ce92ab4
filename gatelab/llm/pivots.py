"""Exact top-k inner-product search with a pivot table.

Vectors are made integers, floor(scale * component), so scores are exact.  Every
vector's distances to a set of pivots are computed once and stored.  By the triangle
inequality the largest difference between a query's and a candidate's distances to
one pivot bounds their distance from below, and with the norms it bounds their
inner product from above.  Candidates of a block are scored in the order of that
bound until no remaining bound reaches the query's k-th best score; ties at that
score are still scored, so the result is exact.

Queries and candidates are each dealt into groups by hash, and each cell of that grid
is one task: it holds its candidates in blocks around their nearest pivot and lets its
queries pass.  A row travels once for each group of the other side, to the cells only;
nothing is broadcast but the sample.  The number of cells follows the shuffle
partitions and what a task may hold, not the number of blocks.  A query
starts with the k-th best score over the bounded sample from which the pivots come,
goes on with the k-th best found in its cell, and a block whose range of pivot
distances can't reach that score is left out without scoring.

Vectors that are null, or hold a null or a value that isn't finite, take no part.
Shorter vectors count as padded with zeros.  Fully repeated rows count once; rows of
one id with different vectors are all candidates, and the one of them that is least
as bytes is the query.  No candidate has the query's own id.  A null id takes no
part.  An empty table gives no rows.  Components beyond 2**31 or scores beyond 2**44 raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelab.llm.runtime import arrow_map, packed, shuffle_partitions, write_scratch

SAMPLE = 2048
BLOCK = 4096
QUERIES = 512
HELD = 2**25  # bytes of candidates that a cell may hold
LEAST, MOST = 2**22, 2**29  # pairs of a cell
_NONE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, vec: valid rows as packed int32 components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64))
                if not np.isfinite(x).all():
                    continue
                if len(x) and np.abs(x).max() >= 2**31:
                    raise ValueError(f"a component of vector {i} is beyond 2**31 when scaled")
                ids.append(i)
                out.append(np.trim_zeros(x.astype("<i4"), "b").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return arrow_map(rows, run, "vec_id long, vec binary").dropDuplicates(["vec_id", "vec"])


def matrix(rows: list[bytes], dim: int | None = None) -> np.ndarray:
    """Packed vectors as rows of a float64 matrix (integers below 2**53 are exact there)."""
    parts = [np.frombuffer(r, "<i4") for r in rows]
    out = np.zeros((len(parts), max([dim or 0, *map(len, parts)])))
    for row, p in zip(out, parts):
        row[: len(p)] = p
    return out


def fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices padded to one width."""
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    q, x = fit(q, x)
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2**44:
        return (q @ x.T).astype(np.int64)
    s = q.astype(np.int64) @ x.astype(np.int64).T
    if np.abs(q @ x.T).max(initial=0) >= 2**44:
        raise ValueError("a score is beyond 2**44")
    return s


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = fit(x, pivots)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from one another: each next one is the sample vector farthest from those chosen."""
    if not len(sample):
        return np.zeros((1, 1))
    chosen = [int(np.argmax((sample * sample).sum(1)))]
    near = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def upper_bounds(dq: np.ndarray, nq: np.ndarray, dx: np.ndarray, nx: np.ndarray) -> np.ndarray:
    """Largest possible inner products, from distances to pivots and squared norms; a little above, for rounding."""
    low = np.zeros((len(dq), len(dx)), np.float32)
    dx = np.ascontiguousarray(dx.T)
    for a in range(0, len(dq), 16):  # a few queries at a time stay in the processor's cache
        part, gap = low[a : a + 16], np.empty_like(low[a : a + 16])
        for p in range(dq.shape[1]):
            np.subtract(dq[a : a + 16, p, None], dx[p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(part, gap, out=part)
    n = nq[:, None] + nx[None, :]
    return (n - low.astype(np.float64) ** 2) / 2 + 1 + 1e-5 * n


def search_block(q: np.ndarray, q_ids: np.ndarray, dq: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, dx: np.ndarray, k: int, wave: int = 512):
    """Best k candidates of one block for each query, as rows (position of the query, candidate, score), none below the
    query's floor.  ids ascend."""
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    # the block as a whole: by the range of its distances to each pivot
    gap = np.maximum(np.maximum(dq - dx.max(0), dx.min(0) - dq), 0).max(1)
    whole = (nq + nx.max() - gap.astype(np.float64) ** 2) / 2 + 1 + 1e-5 * (nq + nx.max())
    live = np.flatnonzero(whole >= floor)
    best = np.full((len(live), k), _NONE)
    if len(live):
        q, q_ids, floor = q[live], q_ids[live], floor[live].astype(np.float64)
        bound = upper_bounds(dq[live], nq[live], dx, nx)
        bound -= floor[:, None]
        order = np.argsort(-bound.max(0), kind="stable")
        bound, first = bound[:, order], floor
        for a in range(0, len(order), wave):
            cols = order[a : a + wave][(bound[:, a : a + wave] >= (floor - first)[:, None]).any(0)]
            if not len(cols):
                continue
            s = scores(q, x[cols])
            # a larger key is a better candidate: by score, then by smaller position, which is smaller id
            key = (s << 18) - cols[None, :]
            key[q_ids[:, None] == ids[cols][None, :]] = _NONE
            both = np.concatenate([best, key], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            worst = best.min(1)
            floor = np.maximum(floor, np.where(worst > _NONE, (worst + (1 << 18) - 1) >> 18, floor))
    row, col = np.nonzero(best > _NONE)
    key = best[row, col]
    score = (key + (1 << 18) - 1) >> 18
    place = (score << 18) - key
    ok = score >= floor[row] if len(live) else np.zeros(0, bool)
    return live[row][ok], ids[place][ok], score[ok]


def keep_best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, by score, then by smaller id; rows ascend."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    ok = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[ok], ids[ok], score[ok]


class Cell:
    """A group of candidates in blocks; queries pass in blocks of their own."""

    def __init__(self, near: np.ndarray, ids: np.ndarray, d: np.ndarray, vecs: list[bytes], k: int):
        """near ascends, ids do for each near."""
        self.k, self.blocks = k, []
        edges = np.flatnonzero(np.diff(near, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(near)]):
            for i in range(a, b, BLOCK):
                j = min(i + BLOCK, b)
                self.blocks.append((matrix(vecs[i:j], 1), ids[i:j], d[i:j]))

    def search(self, ids: np.ndarray, d: np.ndarray, floor: np.ndarray, vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (query id, candidate, score): the best k of this cell for each query, none below the query's floor."""
        q, floor = matrix(vecs, 1), floor.copy()
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for x, x_ids, dx in self.blocks:
            found = search_block(q, ids, d, floor, x, x_ids, dx, self.k)
            row, _, score = best = keep_best(*map(np.concatenate, zip(best, found)), self.k)
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
            floor[row[last]] = score[last]
        return ids[best[0]], best[1], best[2]


def grid(queries: int, candidates: int, width: float, k: int, wanted: int) -> tuple[int, int]:
    """Groups of queries and of candidates: some `wanted` cells, more where one would hold or do too much, fewer where
    little is to do; such that least is sent, rows found for queries included.  width: bytes of a row."""
    pairs = queries * candidates
    cells = max(1, min(max(wanted, pairs / MOST), pairs / LEAST))
    ratio = max(candidates * width, 1) / max(queries * (width + 24 * k), 1)
    across = max(min(round(math.sqrt(cells * ratio)), math.ceil(cells)), math.ceil(candidates * width / HELD), 1)
    return max(1, round(cells / across)), across


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors, ties to the smaller vec_id.
    is_query: a condition on vec_id."""
    rows = write_scratch(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    spark = rows.sparkSession
    count, width = rows.agg(F.count("*"), F.avg(F.length("vec"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a bounded sample: pivots, and a first k-th best score for every query; each partition sends its first SAMPLE rows to
    # the driver, so rows far down the order are left out before, if enough remain
    order = F.xxhash64("vec_id")
    reach = -(2**63) + 2**64 * 4 * SAMPLE // count
    sample = rows.where(order < reach).orderBy(order, "vec_id", "vec").limit(SAMPLE).collect() if reach < 2**63 else []
    if len(sample) < SAMPLE:
        sample = rows.orderBy(order, "vec_id", "vec").limit(SAMPLE).collect()
    s_ids, s = np.array([r.vec_id for r in sample], np.int64), matrix([r.vec for r in sample], 1)
    shared = spark.sparkContext.broadcast((s_ids, s, choose_pivots(s, pivots)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("vec").to_pylist(), 1), shared.value[2]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), packed(list(d)), pa.array(d.argmin(1) if len(d) else np.zeros(0, np.int64), pa.int32())], names=["vec_id", "vec", "d", "near"]
            )

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_ids, s, _ = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                seed = scores(matrix(part.column("vec").to_pylist(), 1), s)
                seed[part.column("vec_id").to_numpy()[:, None] == s_ids[None, :]] = _NONE
                floor = np.partition(seed, -k, axis=1)[:, -k] if seed.shape[1] >= k else np.full(len(seed), _NONE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor, pa.int64())], names=["vec_id", "vec", "d", "floor"])

    table = write_scratch(arrow_map(rows, measure, "vec_id long, vec binary, d binary, near int"), "pivot-table")
    queries = table.where(is_query).groupBy("vec_id").agg(F.min(F.struct("vec", "d")).alias("m")).select("vec_id", "m.vec", "m.d")
    queries = write_scratch(arrow_map(queries, start, "vec_id long, vec binary, d binary, floor long"), "queries")
    down, across = grid(queries.count(), count, width + 4 * len(shared.value[2]) + 28, k, shuffle_partitions(spark))

    def dealt(groups: int, copies: int, *key: str) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64(*key), F.lit(groups)), F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))

    mine, each = dealt(across, down, "vec_id", "vec")
    held = table.select("*", mine.alias("mine"), each.alias("each"))
    held = held.select((F.col("each") * across + F.col("mine")).cast("int").alias("cell"), F.lit(0).alias("asks"), "near", "vec_id", "vec", "d", F.lit(0).cast("long").alias("floor"))
    mine, each = dealt(down, across, "vec_id")
    asked = queries.select("*", mine.alias("mine"), each.alias("each"))
    asked = asked.select((F.col("mine") * across + F.col("each")).cast("int").alias("cell"), F.lit(1).alias("asks"), F.lit(0).alias("near"), "vec_id", "vec", "d", "floor")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell come together, candidates before queries."""
        at, cell, waiting = None, None, []

        def gathered():
            near, ids, floor = (np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in ("near", "vec_id", "floor"))
            vecs, d = ([x for b in waiting for x in b.column(c).to_pylist()] for c in ("vec", "d"))
            waiting.clear()
            return near, ids, np.frombuffer(b"".join(d), np.float32).reshape(len(ids), -1), floor, vecs

        def answers():
            if not waiting or not at[1]:
                return
            _, ids, d, floor, vecs = gathered()
            if cell:
                for a in range(0, len(ids), QUERIES):
                    part = slice(a, a + QUERIES)
                    found = cell.search(ids[part], d[part], floor[part], vecs[part])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy()
            edges = np.flatnonzero(np.diff(cells * 2 + asks, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(cells)]):
                here = (int(cells[a]), int(asks[a]))
                if here != at:
                    yield from answers()
                    if here[1] and at == (here[0], 0):
                        near, ids, d, _, vecs = gathered()
                        cell = Cell(near, ids, d, vecs, k)
                        del vecs
                    else:
                        cell = None
                        waiting.clear()
                    at = here
                waiting.append(batch.slice(a, b - a))
                if at[1] and sum(w.num_rows for w in waiting) >= 8 * QUERIES:
                    yield from answers()
        yield from answers()

    together = held.unionByName(asked).repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "asks", "near", "vec_id")
    found = arrow_map(together, meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
