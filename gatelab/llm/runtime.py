"""How the operators of this subpackage run on a cluster: scratch tables in the
shared folder, code shipped to the executors, Arrow passes, hashing of words."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_gatelab_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-gatelab-"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    sc._gatelab_shipped = True


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark.sparkContext, "_gatelab_scratch", None) or tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext._gatelab_scratch = root
    return root.rstrip("/")


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation of what came before.  Shuffle files of
    the finished job are released at once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # its buffers are on the heap, snappy's pile up beside it
    out = spark.read.schema(df.schema).parquet(path)
    out._gatelab_path = path
    release(spark)
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._gatelab_path)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask both collectors to run, so that the cleaner removes shuffle files nobody refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words of UTF-8 text held in Arrow buffers --------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most `most` bytes each; a longer row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_mask(separators: bytes) -> np.ndarray:
    """A table over the 256 byte values: True where a byte belongs to a word."""
    mask = np.ones(256, bool)
    mask[np.frombuffer(separators, np.uint8)] = False
    return mask


#: Words of any script: what stands between ASCII white space.
SPACED = word_mask(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of letters and digits: ASCII letters and digits, and all that is not ASCII.
ALNUM = word_mask(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of its first word (n + 1 entries)."""
    inside = mask[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[offsets < len(data)]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LONG = 48
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.cumprod(np.full(_LONG, 0xD6E8FEB86659FD93, np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over its bytes, or XXH3 where a word is long."""
    import xxhash

    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    short = np.minimum(sizes, _LONG)
    at = np.cumsum(short) - short
    within = np.arange(int(short.sum())) - np.repeat(at, short)
    h = np.add.reduceat(_BYTE[data[within + np.repeat(starts, short)]] * _POWER[within], at)
    h = mix(h + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


_FACTOR = np.cumprod(np.full(64, 0xA0761D6478BD642F, np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive entries (row boundaries are the caller's to mind)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += words[k : k + n] * _FACTOR[k]
    return mix(h)


def long_column(batch: pa.RecordBatch, name: str | int) -> np.ndarray:
    """An integer column as int64; null is the smallest value."""
    return batch.column(name).cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def read_parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


