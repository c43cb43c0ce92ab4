"""Vector codes: the parts of a vector become the numbers of their nearest codebook entries.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive
parts with a codebook each.  A codebook starts as that part of the vectors of the smallest
ids; each round assigns all parts and moves every entry to the floored mean of its parts.

Nearest entries are found by the Walsh-Hadamard transform, in integers alone.  A part and
the entries, padded with zeros to a power of two N, are transformed once; by Parseval the
squared distance is the sum of the squared differences of their coefficients over N.  The
sums are kept scaled by N, so nothing is divided.  Coefficients come in the order of their
sequency (sign changes), and an entry is dropped as soon as its sum so far is above the
full distance of the entry that was nearest in the first coefficient.  An entry whose sum
equals that distance stays, so ties go to the lower index.  What is left is exact.

Every round reads all vectors; a task adds up the parts of its batches by entry, so that a
round sends at most parts * entries * (width + 1) numbers a batch and the driver gets that
many in all, whatever the number of vectors.  Codebooks are as small and are broadcast.

Vectors that are null, or hold a null or a value that isn't finite, are dropped.  Shorter
vectors count as padded with zeros to the longest one, and the length is rounded up to a
multiple of the number of parts.  Null ids come after all others when the first vectors are
chosen, rows of equal id by their components; repeated rows are coded each.  With fewer
vectors than entries, codebooks are that small.  No vectors give no rows.  Other columns
are kept, but for those named like outputs, which are replaced.  Integers above 2**26 raise
an error, as sums could leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import arrow_map, write_scratch

LIMIT = 2**26
SALTS = 16
#: Parts that are compared with a codebook at once.
SLICE = 8192


# --- the transform -------------------------------------------------------------------


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural-order transform of size n (a power of two) by their number of sign changes: bit-reversed Gray codes."""
    bits = n.bit_length() - 1
    gray = [k ^ (k >> 1) for k in range(n)]
    return np.array([int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray], np.int64)


def walsh(x: np.ndarray) -> np.ndarray:
    """The integer transform of rows padded with zeros to a power of two, coefficients by sequency."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n), np.int64)
    y[:, : x.shape[1]] = x
    h = 1
    while h < n:
        pairs = y.reshape(len(y), -1, 2, h)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), n)
        h *= 2
    return y[:, sequency_order(n)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed part the index of its nearest entry (ties to the lower) and N times the squared distance."""
    n = parts.shape[1]
    first = (parts[:, :1] - entries[None, :, 0]) ** 2
    seed = first.argmin(1)
    bound = ((parts - entries[seed]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for k in range(1, n):
        total = total + (parts[row, k] - entries[entry, k]) ** 2
        stays = total <= bound[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    # rows ascend, entries ascend within a row, and the seed of each row is still there
    start = np.searchsorted(row, np.arange(len(parts)))
    least = np.minimum.reduceat(total, start) if len(parts) else np.zeros(0, np.int64)
    best = np.flatnonzero(total == least[row])
    place = best[np.searchsorted(row[best], np.arange(len(parts)))] if len(parts) else best
    return entry[place], least


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: vectors as (rows, parts, width), books: (parts, entries, width).  Index and squared distance of every part's nearest entry."""
    codes, error = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        entries = walsh(books[p])
        for a in range(0, len(x), SLICE):
            codes[a : a + SLICE, p], scaled = nearest(walsh(x[a : a + SLICE, p]), entries)
            error[a : a + SLICE, p] = scaled // entries.shape[1]
    return codes, error


# --- vectors in Arrow columns ----------------------------------------------------------


def kept_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array column: which rows hold a vector without nulls and infinite values, and those rows' sizes and values end to end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten()  # without what null rows hold
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    keep = there & (bad[ends] == bad[ends - sizes])
    return keep, sizes[keep], values[np.repeat(keep, sizes)]


def padded(sizes: np.ndarray, values: np.ndarray, dim: int) -> np.ndarray:
    """Vectors as rows of a matrix, with zeros behind shorter ones."""
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = values
    return out


def integers(sizes: np.ndarray, values: np.ndarray, dim: int, scale: int) -> np.ndarray:
    x = np.floor(padded(sizes, values, dim) * scale)
    if np.abs(x).max(initial=0) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} when scaled by {scale}")
    return x.astype(np.int64)


def finite(vector_col: str):
    """The condition of kept rows, for the few that are looked at on the way to the first codebooks."""
    v = F.col(vector_col)
    inf = F.lit(float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


# --- the operator ---------------------------------------------------------------------


def first_books(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of the vectors of the smallest ids; None without any vector."""
    kept = vectors.where(finite(vector_col))
    longest = kept.agg(F.max(F.size(vector_col))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    rows = kept.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()
    sizes = np.array([len(r.v) for r in rows], np.int64)
    x = integers(sizes, np.array([c for r in rows for c in r.v], np.float64), parts * width, scale)
    return x.reshape(len(rows), parts, width).transpose(1, 0, 2)


def moved(vectors: DataFrame, vector_col: str, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: each entry becomes the floored mean of its parts; entries without parts stay."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            _, sizes, values = kept_rows(batch.column(0))
            x = integers(sizes, values, parts * width, scale).reshape(-1, parts, width)
            cell = assign(x, books)[0] + np.arange(parts) * entries
            sums = np.zeros((parts * entries, width + 1), np.int64)
            np.add.at(sums, cell.ravel(), np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], axis=2).reshape(-1, width + 1))
            used = np.flatnonzero(sums[:, -1])
            at = np.repeat(used, width + 1) * (width + 1) + np.tile(np.arange(width + 1), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[used].ravel())], names=["at", "total"])

    found = arrow_map(vectors.select(vector_col), add_up, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()  # parts * entries * (width + 1) rows
    sums = np.zeros((parts, entries, width + 1), np.int64)
    for r in found:
        sums.reshape(-1)[r.at] = r.total
    counts = sums[:, :, -1:]
    return np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), books)


def digest_of(books: np.ndarray | None) -> str:
    """sha256 of all components by part, entry and position, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, (books if books is not None else np.zeros(0, np.int64)).ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray | None]:
    """The kept rows of vectors with code (two hex digits a part), error (squared distance to the coded vector, in scaled
    integers) and label_error (its sum over rows of the same label, null being one), without the vector; and the codebooks."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    books = first_books(vectors, id_col, vector_col, parts, entries, scale)
    kept = [c for c in vectors.columns if c not in (vector_col, "code", "error", "label_error")]
    schema = [vectors.schema[c] for c in kept]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    spark = vectors.sparkSession
    if books is None:
        return spark.createDataFrame([], f"{types}code string, error long, label_error long"), None
    for _ in range(rounds):
        books = moved(vectors, vector_col, books, scale)
    shared, n, width = spark.sparkContext.broadcast(books), parts, books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, values = kept_rows(batch.column(batch.num_columns - 1))
            x = integers(sizes, values, n * width, scale).reshape(-1, n, width)
            codes, error = assign(x, shared.value)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * n
            rest = batch.filter(pa.array(keep))
            columns = [rest.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error.sum(1), pa.int64())], names=[*kept, "code", "error"]
            )

    coded = write_scratch(arrow_map(vectors.select(*[F.col(c) for c in kept], vector_col), code, f"{types}code string, error long"), "vector-codes")
    # a label may have any share of the rows: its total is dealt to SALTS keys
    label = F.col(label_col)
    totals = coded.groupBy(label.alias("l")).agg(F.sum("error").alias("label_error")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(id_col, "code"), F.lit(SALTS))
    rows = coded.join(totals, label.eqNullSafe(F.col("l")) & (salt == F.col("s")))
    return rows.select(*kept, "code", "error", "label_error"), books
