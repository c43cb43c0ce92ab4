"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by several functions floor((a . x + b) / w) with normal a; vectors
of equal numbers share a bucket.  A query doesn't only look into its own bucket.  For a
neighbour at distance r the projections differ by a normal step of deviation r, so the
chance that it is in a bucket is the product of the chances that each step ends in that
slot.  The query visits buckets of slots up to one aside in the order of that chance until
the chances add up to what each table must give, so that all tables together find a
neighbour with the chance `target`.  r is estimated for each query from its distances to a
bounded sample: queries in dense places visit few buckets, those in empty ones many.
Candidates of all tables are merged and ranked by exact distances in double precision.

What is fitted: the width w (twice a high quantile of r in the sample), the number of
functions (by the number of vectors) and the regions, all on a sample of at most `sample`
vectors.  All vectors are indexed and all are searched; a table of at most `sample` vectors
is searched exactly, as each query is compared with the whole sample.

Equal vectors are one class, indexed once with its k + 1 smallest ids, which are all that
can be among k nearest; equal queries are searched once.  Buckets are kept in regions (the
buckets of equal first slots), and a query goes to a region once with the list of its
buckets there.  Regions are cut into chunks and their queries into blocks, so that a task
meets bounded numbers of both, however many vectors a bucket holds, and looks at all of them.

Vectors that are null, zero or empty, or hold a null or a value that isn't finite, take no
part, and neither do rows of null id.  Shorter vectors count as padded with zeros.  A query
is a row: another row of its id, and a repetition of the row, is a candidate like any
other, and repeated queries are answered each.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelab.llm.runtime import arrow_map, mix, ship, write_scratch
from gatelab.llm.vector_codes import kept_rows

CHUNK = 4096
QUERIES = 512
SALTS = 16
#: Relative error allowed to distances taken from norms and products, before they are computed exactly.
SLACK = 1e-10


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The distribution function of the normal law, within 1e-7: an expansion for the upper half."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x < 0, tail, 1 - tail)


def matrix(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for row, r in zip(out, rows):
        x = np.frombuffer(r)
        row[: len(x)] = x
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of q to rows of x, pair by pair."""
    out = np.empty(len(q))
    for a in range(0, len(q), 8192):
        out[a : a + 8192] = np.sqrt(np.square(q[a : a + 8192] - x[a : a + 8192]).sum(1))
    return out


def hashed(numbers: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of integers."""
    h = np.full(numbers.shape[:-1], seed + 1, np.uint64)
    for k in range(numbers.shape[-1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + numbers[..., k].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


@dataclass
class Tables:
    """Hash functions, and the sample that they and the queries' distances are fitted on."""

    sample: np.ndarray  # vectors, in the order of cids
    cids: np.ndarray
    ids: list[list[int]]  # the smallest ids of each vector
    turns: np.ndarray  # (tables, dim, functions)
    shifts: np.ndarray  # (tables, functions), in widths
    width: float
    lead: int  # functions that make a region
    chance: float  # what each table must give
    order: int  # the sample's neighbour that stands for the k-th of all

    def slots(self, x: np.ndarray, table: int) -> np.ndarray:
        """Projections in widths; their floors are the slots."""
        return x @ self.turns[table] / self.width + self.shifts[table]

    def regions(self, slots: np.ndarray, table: int) -> np.ndarray:
        return hashed(slots[..., : self.lead], 2 * table)

    def buckets(self, slots: np.ndarray, table: int) -> np.ndarray:
        return hashed(slots, 2 * table + 1)

    def seeds(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each query the places of its k + 1 nearest sample vectors and their distances, the distance within which its
        k + 1 nearest rows are for sure, and the estimate of its k-th neighbour's distance."""
        n = len(self.sample)
        take = min(k + 1, n)
        gap = near(q, self.sample)
        reach = np.partition(gap, take - 1, axis=1)[:, take - 1] + SLACK * gap.max(1, initial=0)
        row, col = np.nonzero(gap <= reach[:, None])
        far = exact(q[row], self.sample[col])
        order = np.lexsort((np.array([i[0] for i in self.ids])[col], far, row))
        row, col, far = row[order], col[order], far[order]
        start = np.searchsorted(row, np.arange(len(q)))
        at = start[:, None] + np.arange(take)
        places, distances = col[at], far[at]
        held = np.cumsum(np.array([len(i) for i in self.ids])[places], axis=1)
        full = (held <= k).sum(1)  # the first place at which k + 1 rows are held
        bound = np.where(full < take, np.take_along_axis(distances, np.minimum(full, take - 1)[:, None], 1)[:, 0], np.inf)
        # the query itself may be in the sample
        positive = np.where(distances[:, 0] == 0, 1, 0)
        m = np.minimum(self.order - 1 + positive, take - 1)
        return places, distances, bound, np.take_along_axis(distances, m[:, None], 1)[:, 0]

    def visits(self, x: np.ndarray, r: float, table: int, steps: np.ndarray) -> np.ndarray:
        """The slots (buckets, functions) that one query visits in a table, most likely first."""
        at = self.slots(x[None, :], table)[0]
        own = np.floor(at)
        inside = (at - own) * self.width
        edges = normal_cdf((np.arange(-1, 3)[None, :] * self.width - inside[:, None]) / max(r, 1e-9 * self.width))
        step = np.diff(edges, axis=1)
        step[:, 1] += 1e-12  # of equal chances the own slot comes first
        chance = step[0]
        for s in step[1:]:
            chance = (chance[:, None] * s[None, :]).ravel()
        order = np.argsort(-chance, kind="stable")
        many = int(np.searchsorted(np.cumsum(chance[order]), self.chance)) + 1
        return own[None, :] + steps[order[:many]]


def all_steps(functions: int) -> np.ndarray:
    """All choices of -1, 0 or 1 for each function, the last changing fastest."""
    return np.stack(np.meshgrid(*[np.arange(-1, 2)] * functions, indexing="ij"), -1).reshape(-1, functions)


def near(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, but for rounding."""
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0)


def fit(sample: list, n: int, dim: int, k: int, tables: int, target: float, seed: int) -> Tables:
    """sample: rows of cid, vec, ids; n: vectors in all."""
    rng = np.random.default_rng(seed)
    x = matrix([r.vec for r in sample], dim)
    functions = int(np.clip(round(np.log2(max(n, 2)) / 2), 4, 10))
    order = max(1, round(k * len(sample) / n))
    out = Tables(
        x, np.array([r.cid for r in sample], np.int64), [list(r.ids) for r in sample], rng.standard_normal((tables, dim, functions)), rng.random((tables, functions)), 1.0, functions,
        1 - (1 - target) ** (1 / tables), order,
    )
    r = np.concatenate([out.seeds(x[a : a + QUERIES], max(k, order))[3] for a in range(0, len(x), QUERIES)])
    r = r[r > 0]
    out.width = 2 * float(np.quantile(r, 0.9)) if len(r) else 1.0
    # regions: as few leading functions as keep the region of half of the vectors within a chunk
    slots = [np.floor(out.slots(x, t)) for t in range(tables)]
    for out.lead in range(functions + 1):
        own = [np.unique(out.regions(s, t), return_inverse=True, return_counts=True)[1:] for t, s in enumerate(slots)]
        if n * np.median(np.concatenate([c[i] for i, c in own])) / len(x) <= CHUNK:
            break
    return out


# --- on Spark ---------------------------------------------------------------------------


def valid_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec: rows that take part, vectors as packed doubles without zeros at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, values = kept_rows(batch.column(1))
            ends = np.cumsum(sizes)
            packs = [np.trim_zeros(values[b - s : b] + 0.0, "b").tobytes() for b, s in zip(ends, sizes)]  # + 0.0: no negative zeros
            ids = batch.column(0).filter(pa.array(keep))
            use = [i for i, (v, there) in enumerate(zip(packs, ids.is_valid().to_pylist())) if v and there]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(use, pa.int64())), pa.array([packs[i] for i in use], pa.binary())], names=["id", "vec"])

    return arrow_map(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), run, "id long, vec binary")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 4, target: float = 0.97, sample: int = 2048, seed: int = 13, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k nearest other rows that were found, ties to the smaller vec_id.
    is_query: a condition on the columns of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    least = Window.partitionBy("vec").orderBy("id")
    few = valid_rows(vectors, id_col, vector_col).withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    classes = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = write_scratch(classes.withColumn("cid", F.monotonically_increasing_id()), "ann-classes")
    n, size = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = size // 8
    model = fit(classes.orderBy(F.xxhash64("vec"), "vec").limit(sample).collect(), n, dim, k, tables, target, seed)
    shared = spark.sparkContext.broadcast(model)
    rows = valid_rows(vectors.where(is_query), id_col, vector_col).groupBy("id", "vec").agg(F.count("*").alias("times"))
    queries = write_scratch(rows.select("vec").distinct().withColumn("qid", F.monotonically_increasing_id()), "ann-queries")
    found = from_sample(queries, shared, k, dim)
    if n > sample:
        found = found.union(from_tables(classes, queries, shared, k, dim, tables))

    # merged: a class counts once for a query, however many tables found it
    single = found.dropDuplicates(["qid", "cid"]).select("qid", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("qid").orderBy("score", "vec_id")
    single = single.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = single.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best")).join(queries, "qid")
    # rows of one vector may be any share of the queries: its answer is dealt to SALTS keys
    answers = answers.select("vec", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(answers, ["vec", "salt"])
    own = F.array_position("best", F.struct(F.lit(0.0).alias("score"), F.col("id").alias("vec_id"))).cast("int")
    others = F.when(own > 0, F.concat(F.slice("best", F.lit(1), F.greatest(own - 1, F.lit(0))), F.slice("best", own + 1, F.lit(k + 1)))).otherwise(F.col("best"))
    rows = rows.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "times")), F.slice(others, 1, k).alias("best"))
    rows = rows.select("id", F.posexplode("best").alias("pos", "b"))
    return rows.select(F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


_FOUND = "qid long, cid long, score double, ids array<long>"
_FOUND_TYPES = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def from_sample(queries: DataFrame, shared, k: int, dim: int) -> DataFrame:
    """The nearest vectors of the sample, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tables = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                places, distances, _, _ = model.seeds(matrix(part.column("vec").to_pylist(), dim), k)
                qid = np.repeat(part.column("qid").to_numpy(), places.shape[1])
                flat = places.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(model.cids[flat]), pa.array(distances.ravel()), pa.array([model.ids[i] for i in flat], pa.list_(pa.int64()))], schema=_FOUND_TYPES)

    return arrow_map(queries.select("qid", "vec"), run, _FOUND)


def from_tables(classes: DataFrame, queries: DataFrame, shared, k: int, dim: int, tables: int) -> DataFrame:
    """The k + 1 nearest vectors in the visited buckets of each region."""

    def index(with_vectors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: Tables = shared.value
            for batch in batches:
                x = matrix(batch.column("vec").to_pylist(), dim)
                for t in range(tables):
                    slots = np.floor(model.slots(x, t))
                    columns = [pa.array(model.regions(slots, t))]
                    if with_vectors:
                        columns += [pa.array(model.buckets(slots, t)), batch.column("cid"), batch.column("ids"), batch.column("vec")]
                    yield pa.RecordBatch.from_arrays(columns, names=["region", "bucket", "cid", "ids", "vec"][: len(columns)])

        return run

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tables = shared.value
        steps = all_steps(model.turns.shape[2])
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                packs, qids = part.column("vec").to_pylist(), part.column("qid").to_pylist()
                q = matrix(packs, dim)
                _, _, bound, r = model.seeds(q, k)
                out: list[list] = [[], [], [], [], []]
                for i in range(len(q)):
                    for t in range(tables):
                        slots = model.visits(q[i], r[i], t, steps)
                        region, buckets = model.regions(slots, t), model.buckets(slots, t)
                        order = np.argsort(region, kind="stable")
                        names, start = np.unique(region[order], return_index=True)
                        for name, own in zip(names.tolist(), np.split(buckets[order], start[1:])):
                            for column, value in zip(out, (name, qids[i], packs[i], bound[i], own.tobytes())):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.binary())],
                    names=["region", "qid", "q", "bound", "buckets"],
                )

    def search(key: tuple[pa.Scalar, ...], held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return _FOUND_TYPES.empty_table()
        held = held.sort_by("bucket")
        x, q = matrix(held.column("vec").to_pylist(), dim), matrix(asked.column("q").to_pylist(), dim)
        bound = asked.column("bound").to_numpy() ** 2
        names, start = np.unique(held.column("bucket").to_numpy(), return_index=True)
        ends = np.append(start[1:], len(x))
        lists = [np.frombuffer(b, np.int64) for b in asked.column("buckets").to_pylist()]
        who, wanted = np.repeat(np.arange(len(q)), [len(b) for b in lists]), np.concatenate(lists)
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        there = names[place] == wanted
        who, place = who[there], place[there]
        order = np.argsort(place, kind="stable")
        who, place = who[order], place[order]
        met, first = np.unique(place, return_index=True)
        pairs = []
        for b, visitors in zip(met, np.split(who, first[1:])):
            lo, hi = start[b], ends[b]
            gap = near(q[visitors], x[lo:hi])
            reach = bound[visitors]
            if hi - lo > k + 1:
                reach = np.minimum(reach, np.partition(gap, k, axis=1)[:, k])
            i, j = np.nonzero(gap <= (reach + SLACK * (reach + gap.max(1)))[:, None])
            pairs.append((visitors[i], j + lo))
        if not pairs:
            return _FOUND_TYPES.empty_table()
        i, j = (np.concatenate(p) for p in zip(*pairs))
        score = exact(q[i], x[j])
        ids = held.column("ids").combine_chunks()
        smallest = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        order = np.lexsort((smallest[j], score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
        i, j, score = i[keep], j[keep], score[keep]
        columns = [asked.column("qid").combine_chunks().take(pa.array(i)), held.column("cid").combine_chunks().take(pa.array(j)), pa.array(score), ids.take(pa.array(j))]
        return pa.Table.from_arrays(columns, schema=_FOUND_TYPES)

    some = classes.select("cid", "ids", "vec")
    held = arrow_map(some, index(True), "region long, bucket long, cid long, ids array<long>, vec binary")
    asked = write_scratch(arrow_map(queries.select("qid", "vec"), probe, "region long, qid long, q binary, bound double, buckets binary"), "ann-probes")
    n_held = arrow_map(some, index(False), "region long").groupBy("region").agg(F.count("*").alias("n"))
    n_asked = asked.groupBy("region").agg(F.count("*").alias("m"))
    cut = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    plan = write_scratch(n_held.join(n_asked, "region").select("region", cut("n", CHUNK).alias("chunks"), cut("m", QUERIES).alias("blocks")), "ann-regions")
    deal = lambda c, most: F.pmod(F.xxhash64(c), F.col(most)).cast("int")
    held = held.join(plan, "region").withColumn("chunk", deal("cid", "chunks")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked = asked.join(plan, "region").withColumn("block", deal("qid", "blocks")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    keys = ["region", "chunk", "block"]
    held = held.select(*keys, "bucket", "cid", "ids", "vec").groupBy(*keys)
    asked = asked.select(*keys, "qid", "q", "bound", "buckets").groupBy(*keys)
    return held.cogroup(asked).applyInArrow(search, _FOUND)
