"""Sharding: contiguous shards of the smallest possible largest size.

Rows with equal texts form an atomic group.  Groups are ordered by a 64-bit hash
of their text, and shards are runs of that order.  The smallest feasible shard
capacity is found by binary search; a capacity is checked greedily (fill a shard
until the next group would not fit).  Below the capacity shards are filled to the lowest
level at which all shards are enough, so a large group doesn't make the others uneven; if
that leaves shards over, the first ones are filled a little less, and where groups are too
coarse for that the largest shards are parted, until all are used.  With fewer groups than
shards each group is a shard and the rest stay empty.

The driver never holds the groups.  It holds at most `fan_out` sums for ranges of
hash values.  A search over such ranges brackets the best capacity and each cut;
only ranges in which a cut may lie are split further, until every range that
matters is a single group.  Groups are sized by a partial aggregation, so one
group may hold any share of the rows.

Slots are numbered from 0 without gaps inside a shard: rows are dealt to blocks by
a hash of the id, blocks have offsets from their counts, and a row's slot is the
offset plus its rank in its block, by id (null first) and a hash of the text; equal rows
are in any order.

Null text counts as empty: its size is the per-row overhead, its checksum 0, and it
is in one group with empty texts.  A text of any length is one row of its size; rows of
null id are dealt like others.  Repeated rows keep one slot each.  An empty
table gives an empty result.  Other columns of docs are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelab.llm.runtime import shuffle_partitions, write_scratch

BITS = 64


class Ranges:
    """Ranges of hash values in order: (first hash, width in bits, size, largest group); width 0 is a single group."""

    def __init__(self, ranges: list[tuple[int, int, int, int]]):
        self.ranges, self.sums = ranges, [0]
        for r in ranges:
            self.sums.append(self.sums[-1] + r[2])
        self.total = self.sums[-1]

    def fill(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Greedy check: for each shard the least and the most size that the shards up to it can hold.  The two
        differ only where a shard ends in a range whose groups aren't known."""
        least, most = [0], [0]
        for _ in range(shards):
            least.append(self.sums[bisect_right(self.sums, least[-1] + capacity) - 1])
            k = bisect_right(self.sums, most[-1] + capacity) - 1
            inside = k < len(self.ranges) and self.ranges[k][1]
            most.append(most[-1] + capacity if inside else self.sums[k])
        return least, most

    def smallest(self, shards: int, surely: bool) -> int:
        """Binary search of the smallest capacity that surely does (or may do, for all that is known)."""
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards)[not surely][-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def level_ends(self, level: int, less: int = 0) -> list[int]:
        """Ends of shards filled up to a level, the first `less` of them to a level lower by one; what is larger than the level is
        a shard of its own."""
        ends, at = [], 0
        while at < self.total:
            k = bisect_right(self.sums, at + level - (len(ends) < less)) - 1
            at = self.sums[k] if self.sums[k] > at else self.sums[bisect_right(self.sums, at)]
            ends.append(at)
        return ends

    def even_ends(self, capacity: int, shards: int) -> list[int] | None:
        """Ends of shards filled to the lowest level at which they are enough: where one group is larger than that, the
        other shards don't grow with it.  None where known edges don't allow it within the capacity."""
        low, high = max(1, -(-self.total // shards) // 2), capacity
        while low < high:
            mid = (low + high) // 2
            if len(self.level_ends(mid)) <= shards:
                high = mid
            else:
                low = mid + 1
        ends = self.level_ends(low) if self.total else []
        if len(ends) < shards:  # as many of the first shards take a little less as makes up for those left over
            less = bisect_right(range(shards), shards - 1, key=lambda m: len(self.level_ends(low, m)))
            mixed = self.level_ends(low, less) if self.total else []
            ends = mixed if len(mixed) == shards else ends
        return ends if len(ends) <= shards and all(b - a <= capacity for a, b in zip([0, *ends], ends)) else None

    def filled_up(self, ends: list[int], shards: int) -> list[int]:
        """The ends with more between them until all shards are used: the largest shard that can be is parted at the edge nearest
        to its middle, again and again."""
        bounds = [0, *ends]
        while len(bounds) <= shards:
            inner = [(b - a, a, b) for a, b in zip(bounds, bounds[1:]) if bisect_right(self.sums, b) - bisect_right(self.sums, a) > 1]
            if not inner:
                break
            size, a, b = max(inner)
            edges = self.sums[bisect_right(self.sums, a) : bisect_right(self.sums, b) - 1]
            bounds = sorted([*bounds, min(edges, key=lambda x: abs(2 * (x - a) - size))])
        return bounds[1:]

    def open_ranges(self, shards: int) -> tuple[int, list[int], list[tuple[int, int]]]:
        """The capacity, the cuts (first hash of shards 1, 2, ...) and the ranges that must be split before both are exact."""
        high = self.smallest(shards, True)
        low = max(self.smallest(shards, False), max((r[3] for r in self.ranges), default=0))
        least, most = self.fill(min(low, high), shards)[0], self.fill(high, shards)[1]
        wanted = {}
        for a, b in zip(least[1:], most[1:]):
            i = max(0, bisect_right(self.sums, a) - 1)
            while i < len(self.ranges) and self.sums[i] < b:
                if self.ranges[i][1]:
                    wanted[self.ranges[i][0]] = self.ranges[i][1]
                i += 1
        ends = None if wanted else self.even_ends(high, shards)
        ends = list(dict.fromkeys(x for x in ends or self.fill(high, shards)[0][1:] if x <= self.total))
        if not wanted:
            ends = self.filled_up(ends, shards)
        ends = [x for x in ends if x < self.total]
        cuts = [self.ranges[bisect_right(self.sums, x) - 1][0] for x in ends]
        return high, cuts, sorted(wanted.items())


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The same search for sizes in memory: smallest capacity, and the index at which shards 1, 2, ... begin."""
    capacity, cuts, _ = Ranges([(i, 0, s, s) for i, s in enumerate(sizes)]).open_ranges(shards)
    return capacity, cuts


def _sums(groups: DataFrame, wanted: list[tuple[int, int]] | None, step: int) -> list[tuple[int, int, int, int]]:
    """Sizes by sub-range of 2**(width - step) hash values, for wanted ranges (start, width) or the whole space."""
    spark = groups.sparkSession
    if wanted is None:
        rest = BITS - step
        rows = groups.select(F.shiftright("key", rest).alias("p"), "size")
        width = F.lit(rest)
    else:
        w = wanted[0][1]
        rest = max(w - step, 0)
        heads = spark.createDataFrame([(s >> w,) for s, _ in wanted], "head long")
        rows = (
            groups.withColumn("head", F.shiftright("key", w))
            .join(F.broadcast(heads), "head", "left_semi")
            .select(F.shiftright("key", rest).alias("p"), "size")
        )
        width = F.lit(rest)
    out = rows.groupBy("p").agg(F.sum("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("n")).select("p", "size", "most", "n", width.alias("w"))
    # a range that holds one group is final, however wide
    return [(r.p << rest, 0 if r.n == 1 or rest == 0 else rest, r.size, r.most) for r in out.collect()]


def plan_cuts(groups: DataFrame, shards: int, fan_out: int = 1 << 16) -> tuple[int, list[int]]:
    """groups: key (signed 64-bit hash, the order), size.  Returns the smallest capacity and the keys at which
    shards 1, 2, ... begin.  Each round collects about fan_out sums at most."""
    ranges = sorted(_sums(groups, None, fan_out.bit_length() - 1))
    while True:
        capacity, cuts, wanted = Ranges(ranges).open_ranges(shards)
        if not wanted:
            return capacity, cuts
        width = max(w for _, w in wanted)
        batch = [(s, w) for s, w in wanted if w == width][: fan_out // 2]
        finer = _sums(groups, batch, (fan_out // len(batch)).bit_length() - 1)
        gone = {s for s, _ in batch}
        ranges = sorted([r for r in ranges if r[0] not in gone] + finer)


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, fan_out: int = 1 << 16) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard (from 0), slot (from 0, gapless in the shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = write_scratch(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    groups = write_scratch(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    _, cuts = plan_cuts(groups.select("key", "size"), shards, fan_out)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + F.when(F.col("key") >= F.lit(c), 1).otherwise(0)
    rows = rows.withColumn("shard", shard.cast("int"))

    # slots: blocks by hash of the id, so that neither a large shard nor a large group is one task
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    blocks = max(64, 4 * shuffle_partitions(spark) // shards, n_rows // (shards * 200_000))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "block").orderBy("id", "key")
    return (
        rows.withColumn("rank", F.row_number().over(inner))
        .join(offsets, ["shard", "block"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
    )


