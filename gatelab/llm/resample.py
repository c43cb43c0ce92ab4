"""Quality classifier by importance resampling of hashed n-grams.

Two generative models over hashed word n-grams (orders 1 and 2, a table of buckets
for each; an n-gram counts once per document): the target model counts labelled good
documents, the raw model counts the whole corpus.  A bucket's log ratio shrinks smoothly
with the evidence for it: by 1 - `significance`**2 / deviance, where the deviance is that
of a Poisson count from the expected one, and to zero below; several n-grams of some
evidence add up.  The shrunk ratios are drawn towards zero by `margin` more, so that shares
of languages, subjects and copies that differ a little between labelled and raw text
don't add up over long texts.  `prior` pseudo-counts draw the ratios towards no difference.  A document's log
weight is the sum of the log ratios of its n-grams, so text like the target is near
zero, and text with several n-grams that the target lacks is far below.

Documents are sampled without replacement in proportion to their weights by Gumbel
top-k: log weight plus a Gumbel variate drawn from a hash of the id; the k largest
stay.  By default k is the number of documents whose log weight is above
-`tolerance`: a Gumbel variate has nearly no lower tail, so the sample then keeps
text that fits the target and rejects what is well below it.

The target model is fitted on at most `max_labelled` good documents, the ones of
smallest hash of their id (about 8 MB of ids); the raw model, the weights and the
sample cover all documents.  The models are 2**20 buckets for words and for pairs as
many as the texts may hold pairs, 2**18 at least and 2**21 at most (what a worker and
the driver can hold).

A document is good when its least quality label is 1 and its largest toxic label
is 0; null labels count as bad.  Null or empty text has log weight 0.  Rows of equal id draw
equal variates.  Rows tied with the k-th key all stay.  With no labelled good
document nothing differs from the target and every log weight is 0.  Very long texts
are weighed whole.  An empty table gives an empty one.  Other columns
are carried along unread; those named `__log_weight` or `__gumbel_key` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import LOWER, SPACED, arrow_map, drop_scratch, long_column, mix, ship, slices, utf8, word_bounds, word_hashes, write_scratch

BITS = (20, 18)
MOST_BITS = 21
SLICE = 1 << 20


def table_bits(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Bits of the two tables: one bucket for every six bytes of text (a word and a space) within the limits."""
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return BITS[0], min(max((n_bytes // 6).bit_length(), BITS[1]), MOST_BITS)


def n_buckets(bits: tuple[int, int]) -> int:
    return sum(1 << b for b in bits)


def buckets(data: np.ndarray, offsets: np.ndarray, bits: tuple[int, int] = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every distinct n-gram of a document."""
    starts, ends, first = word_bounds(data, offsets, SPACED)
    h = word_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same = doc[1:] == doc[:-1]
    one = (h >> np.uint64(64 - bits[0])).astype(np.int64)
    pair = (two[same] >> np.uint64(64 - bits[1])).astype(np.int64) + (1 << bits[0])
    found = np.unique(np.concatenate([doc, doc[1:][same]]) * n_buckets(bits) + np.concatenate([one, pair]))
    return found % n_buckets(bits), found // n_buckets(bits)


def good_ids(labels: DataFrame, max_labelled: int) -> np.ndarray:
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("i")).agg(
        F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(1))).alias("t")
    )
    rows = labels.where("q = 1 and t = 0 and i is not null").select("i").orderBy(F.xxhash64("i"), "i").limit(max_labelled).toArrow()
    return np.sort(rows.column("i").to_numpy())


def count_ngrams(docs: DataFrame, good: np.ndarray, bits: tuple[int, int] = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all buckets over all documents, and over the good ones."""
    wanted = docs.sparkSession.sparkContext.broadcast(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n_buckets(bits), np.int32), np.zeros(n_buckets(bits), np.int32)
        for batch in batches:
            is_good = np.isin(long_column(batch, "id"), wanted.value)
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE):
                k, doc = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                np.add.at(raw, k, 1)
                np.add.at(target, k[is_good[a:b][doc]], 1)
        k = np.flatnonzero(raw)
        for a in range(0, len(k), 1 << 16):
            p = k[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(raw[p].astype(np.int64)), pa.array(target[p].astype(np.int64))], names=["bucket", "raw", "target"])

    parts = arrow_map(docs.select(F.col("__id").alias("id"), F.col("__text").alias("text")), run, "bucket int, raw long, target long")
    t = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(n_buckets(bits)), np.zeros(n_buckets(bits))
    k = t.column("bucket").to_numpy()
    raw[k], target[k] = t.column("raw").to_numpy(), t.column("target").to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float, significance: float, bits: tuple[int, int] = BITS, margin: float = 0.0) -> np.ndarray:
    out, at = np.zeros(n_buckets(bits), np.float32), 0
    for b in bits:
        part = slice(at, at := at + (1 << b))
        n_raw, n_target = raw[part].sum(), target[part].sum()
        if n_raw and n_target:
            expected = raw[part] * (n_target / n_raw)
            seen = np.where(target[part] > 0, target[part] * np.log(np.maximum(target[part], 1) / np.maximum(expected, 1e-9)), 0)
            deviance = np.maximum(2 * (seen - target[part] + expected), 1e-9)
            ratio = np.log((target[part] + prior) / (expected + prior))
            ratio *= np.maximum(0, 1 - significance**2 / deviance)
            out[part] = np.sign(ratio) * np.maximum(np.abs(ratio) - margin, 0)
    return out


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value, by counting in ever narrower bins."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    above, at = 0, rows
    while low < high:
        width = (high - low) / bins
        b = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = at.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
        else:
            return low
        at = at.where(F.col(column).between(low, high))
    return low


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 1.0, significance: float = 2.5, margin: float = 1.0, max_labelled: int = 1_000_000, seed: int = 7) -> DataFrame:
    """docs with __log_weight and __gumbel_key."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    bits = table_bits(base, "__text")
    raw, target = count_ngrams(base, good_ids(labels, max_labelled), bits)
    model = spark.sparkContext.broadcast(log_ratios(raw, target, prior, significance, bits, margin))

    @F.arrow_udf("double")
    def log_weight(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = utf8(column)
            weight = np.zeros(len(column))
            for a, b in slices(offsets, SLICE):
                k, doc = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                weight[a:b] = np.bincount(doc, model.value[k], minlength=b - a)
            yield pa.array(weight)

    # only texts go to Python and only weights come back
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("long")), 12) + F.lit(0.5)) / F.lit(2.0**52)
    weighed = docs.withColumn("__log_weight", log_weight(F.col(text_col)))
    return weighed.withColumn("__gumbel_key", F.col("__log_weight") - F.log(-F.log(u)))


def least_key(weights: DataFrame, k: int | None = None, tolerance: float = 4.0) -> float | None:
    """The smallest Gumbel key of the sample of k rows."""
    if k is None:
        k = weights.where(F.col("__log_weight") > -tolerance).count()
    return kth_largest(weights, "__gumbel_key", k)


def _in_sample(least: float | None):
    return F.lit(False) if least is None else F.col("__gumbel_key") >= F.lit(least)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, tolerance: float = 4.0, **how) -> DataFrame:
    """doc_id, log_weight, gumbel_key, keep for every row of docs."""
    rows = weigh(docs.select(id_col, text_col), labels, id_col, text_col, **how)
    rows = write_scratch(rows.select(F.col(id_col).alias("doc_id"), "__log_weight", "__gumbel_key"), "weights")
    keep = _in_sample(least_key(rows, k, tolerance))
    return rows.select("doc_id", F.col("__log_weight").alias("log_weight"), F.col("__gumbel_key").alias("gumbel_key"), keep.alias("keep"))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, tolerance: float = 4.0, **how) -> DataFrame:
    """docs without the rows that the sample rejects.  Weights are written once without the texts to find the last key
    of the sample, and computed again where the texts are."""
    weighed = weigh(docs, labels, id_col, text_col, **how)
    weights = write_scratch(weighed.select("__log_weight", "__gumbel_key"), "weights")
    least = least_key(weights, k, tolerance)
    drop_scratch(weights)
    return weighed.where(_in_sample(least)).select(*docs.columns)
