"""Fuzzy line dedup by MinHash in DataFrame functions.

Lines are compared in lower case and trimmed.  Lines that are then equal are one
distinct line, known by 128 bits of hashes and by its first place (smallest document
id, then a hash of the text, then line number).

A line is signed by its windows of WINDOW characters.  Their hashes lie on a circle; the
first hash at or after a fixed point is one MinHash value, and BANDS bands of ROWS values
each use points far from one another.  Of long lines, windows far from any point are left out of the
minimum that they could hardly be (FIRST, PLENTY).  tests/llm measures how many pairs of Jaccard similarity 0.8 meet in a band.

Lines that share a band with another also get a bitmap of their shingles of 5 characters, a bit for each by its hash.  A bit that two
lines don't share stands for a shingle at least that they don't share, so from the bits
that differ and the number of shingles follows, for sure, that many pairs of a band can't be
similar enough; those are left out where bands are joined, and no similar pair is.

What is left is verified: Jaccard similarity of the sets of all 5-character
shingles (of very long lines, by 64-bit hashes).  In a band each line is first verified against the band's
most frequent line.  After union-find over the links, lines of one band and different
components are compared in rounds: in each, a few more lines of every band meet the lines
of other components, and links found spare the rounds that follow.  Where the bands that are left are small (CROWDED), the last
round, of all lines, comes at once.  So every pair of a
band is either compared or already connected.  Rounds compare inside the join, by sets of 32-bit hashes with room for
collisions, and a pair in the first band alone that it shares, so only pairs that are alike become rows, once each; the comparisons
themselves still grow with the square of the lines of a band that stay unconnected.

One line of each component stays, the first; the others are removed from their
documents.  Blank lines stay.  Documents without a text keep their null, empty texts stay
empty, and texts of any length are whole; documents of null id stay as they are.  Rows of
equal id and equal text are changed alike; rows of equal id and different texts are
different documents.  An empty table gives an empty one.  Other columns are carried along,
whatever their names; those named `__n_lines` or `__n_removed` are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelab.llm.components import connected_components, may_be_alike
from gatelab.llm.runtime import drop_scratch, write_scratch

SHINGLE = 5
WINDOW = 12  # characters of what is signed
BANDS, ROWS = 11, 2
POINTS = BANDS * ROWS
NEXT = 8  # points of which the first with a hash counts
FIRST, PLENTY = 64, 4  # of a line's windows all the first are signed, of the others those among the PLENTY nearest to a point, as expected
BITS = 16  # longs of a bitmap

#: Lines of a band that meet the others in each round after the first, as expected; the last round takes all that are left.
ROUNDS = (16,)

#: Rounds before the last are left out while a line's band has no more lines of several components than this, on average.
CROWDED = 32

#: Sets of longer lines are compared in rows of shingles instead of arrays.
LONG = 200_000

#: The lines of candidate pairs are looked up by a broadcast up to this many lines, else by a shuffle.
BROADCAST_LINES = 500_000


_WHITE = " \t\r\f\x0b"


def _lines(docs: DataFrame) -> DataFrame:
    """doc, th (hash of the text), pos, norm, k1, k2 for every line that isn't blank; docs has __doc and __text."""
    # what is the document's is computed before lines are, or it would be computed for each of them
    rows = docs.where("__doc is not null").select(F.col("__doc").alias("doc"), F.xxhash64("__text").alias("th"), F.split("__text", "\n").alias("lines"))
    rows = rows.select("doc", "th", F.posexplode("lines").alias("pos", "line"))
    starts = reduce(or_, [F.startswith("line", F.lit(c)) for c in _WHITE])
    ends = reduce(or_, [F.endswith("line", F.lit(c)) for c in _WHITE])
    trimmed = F.btrim("line", F.lit(_WHITE))
    rows = rows.where((F.col("line") != "") & (~starts | (trimmed != "")))
    rows = rows.select("doc", "th", "pos", F.lower(F.when(starts | ends, trimmed).otherwise(F.col("line"))).alias("norm"))
    return rows.withColumns({"k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit(7), "norm")})


_BITMAP = [f"b{k}" for k in range(BITS)]


def _windows(width: int) -> Column:
    """How many windows of that many characters a line has, repeats included; u has four bytes for each character.  A line of fewer
    characters is its own only window."""
    return F.greatest(F.length("u") / 4 - (width - 1), F.lit(1)).cast("long")


def _window(i: str, width: int) -> str:
    return f"xxhash64(substring(u, cast(4 * ({i}) + 1 as int), {4 * width}))"


def _signed(lines: DataFrame, banded: bool = True, sketched: bool = True) -> DataFrame:
    """The columns of lines but norm, which tell lines apart, with bands (banded), and with many (shingles, repeats included) and the
    longs of the bitmap (sketched)."""
    keys = [c for c in lines.columns if c != "norm"]
    rows = lines.select(*keys, F.encode("norm", "UTF-32").alias("u"))
    rows = rows.withColumns({"many": _windows(SHINGLE), "wide": _windows(WINDOW)})
    rows = rows.select(*keys, "u", "many", "wide", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many" if sketched else "wide") - 1)).alias("i"))
    sums, out = [], list(keys)
    if banded:
        # the i-th window, or once more the last
        rows = rows.withColumn("h", F.expr(_window("least(i, wide - 1)", WINDOW)))
        rows = rows.withColumn("q", F.shiftrightunsigned("h", 33) * POINTS)
        rows = rows.withColumns({"at": F.shiftright("q", 31), "v": F.shiftrightunsigned("h", 1)})
        if not sketched:
            rows = rows.where((F.col("i") < FIRST) | (F.col("q").bitwiseAND((1 << 31) - 1) * F.col("wide") <= PLENTY * POINTS * (1 << 31)))
        sums += [F.min(F.when(F.col("at") == k, F.col("v"))).alias(f"p{k}") for k in range(POINTS)]
    if sketched:
        rows = rows.withColumn("g", F.expr(_window("i", SHINGLE)))
        rows = rows.withColumns({"word": F.shiftrightunsigned("g", 6).bitwiseAND(BITS - 1), "bit": F.expr("shiftleft(1L, cast(g & 63 as int))")})
        sums += [F.max("many").alias("many"), *[F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(b) for k, b in enumerate(_BITMAP)]]
    signed = rows.groupBy(*keys).agg(*sums)
    if banded:
        points = [f"p{k}" for k in range(POINTS)]
        signed = signed.withColumn("least", F.least(*points))
        # a point without a hash up to the next takes that of the next, around the circle
        value = [F.coalesce(*[points[(k + j) % POINTS] for j in range(NEXT)], "least") for k in range(POINTS)]
        signed = signed.withColumn("bands", F.array(*[F.xxhash64(F.lit(j), *[value[j + r * BANDS] for r in range(ROWS)]) for j in range(BANDS)]))
        out.append("bands")
    return signed.select(*out, *(["many", *_BITMAP] if sketched else []))


def _distinct(lines: DataFrame) -> DataFrame:
    """One row per distinct line: id, k1, k2, first (doc, th, pos), n, norm."""
    out = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count("*").alias("n"), F.first("norm").alias("norm"))
    return write_scratch(out.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "first", "n", "norm"), "distinct-lines")


def _members(distinct: DataFrame) -> DataFrame:
    """band, id, hub, m: the lines of all bands that hold two or more, the most frequent line of each, and how many it has."""
    signed = write_scratch(_signed(distinct.select("id", "n", "norm"), sketched=False).select("id", "n", "bands"), "bands")
    rows = signed.select("id", "n", F.explode("bands").alias("band"))
    # count and id in one number, for a grouped maximum of fixed width
    order = F.shiftleft(F.least("n", F.lit(255)), 55) - F.col("id")
    hubs = write_scratch(rows.groupBy("band").agg(F.max(order).alias("top"), F.count("*").alias("m")).where("m > 1"), "hubs")
    members = rows.join(hubs.hint("shuffle_hash"), "band").select("band", "id", F.pmod(-F.col("top"), F.lit(1 << 55)).alias("hub"), "m")
    members = write_scratch(members, "band-members")
    drop_scratch(signed, hubs)
    return members


def _candidates(distinct: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the lines that share a band with another, as nothing else is looked at again: id, many, the bitmap and shared (their bands of
    two or more lines); id and norm."""
    shared = members.groupBy("id").agg(F.collect_list("band").alias("shared"))
    lines = write_scratch(distinct.select("id", "norm").join(shared.hint("shuffle_hash"), "id"), "candidate-lines")
    signed = _signed(lines.select("id", "norm"), banded=False)
    return write_scratch(signed.join(lines.select("id", "shared").hint("shuffle_hash"), "id"), "candidates"), lines


def _shingles(lines: DataFrame) -> DataFrame:
    """The columns of lines but norm, with g, the hash of a shingle: a row for each, repeats included."""
    keys = [c for c in lines.columns if c != "norm"]
    rows = lines.select(*keys, F.encode("norm", "UTF-32").alias("u")).withColumn("many", _windows(SHINGLE))
    rows = rows.select(*keys, "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("i"))
    return rows.select(*keys, F.expr(_window("i", SHINGLE)).alias("g"))


def _set(line: str) -> Column:
    """A line's shingles, repeats included, as an array; a line of fewer characters is its own only shingle.  No match begins inside a
    character of two UTF-16 units."""
    every = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))(?![\x{{DC00}}-\x{{DFFF}}])"), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(every)


def _of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """texts (id, norm) of the ids alone."""
    few = ids.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    return texts.join(ids.hint("broadcast" if few else "shuffle_hash"), "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least that Jaccard similarity; texts: id, norm."""
    side = lambda name: texts.select(F.col("id").alias(name), F.col("norm").alias(f"l{name}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    both = both.withColumn("big", F.greatest(F.length("la"), F.length("lb")) > LONG)
    # sets are columns before they are compared, and the comparison is a generator, or each use would make them anew
    none = F.array().cast("array<string>")
    rows = both.select("a", "b", "big", *[F.when(F.col("big"), none).otherwise(_set(f"l{x}")).alias(f"s{x}") for x in "ab"])
    counts = F.struct(F.size(F.array_union("sa", "sb")).alias("all"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    rows = rows.select("a", "b", "big", F.inline(F.array(counts)))
    links = write_scratch(rows.where(F.col("big") | (F.col("shared") >= threshold * F.col("all"))).select("a", "b", "big"), "line-links")
    if not links.where("big").limit(1).count():
        return links
    pairs = links.where("big").select("a", "b")
    side = lambda name, bit: pairs.join(texts, F.col(name) == F.col("id")).select("a", "b", F.lit(bit).alias("side"), "norm")
    rows = _shingles(side("a", 1).union(side("b", 2)).repartition("a", "b"))
    sets = rows.groupBy("a", "b", "g").agg(F.bit_or("side").alias("sides")).groupBy("a", "b").agg(F.count("*").alias("all"), F.count_if(F.col("sides") == 3).alias("shared"))
    sets = sets.where(F.col("shared") >= threshold * F.col("all"))
    out = write_scratch(links.where("not big").select("a", "b").union(sets.select("a", "b")), "line-links")
    drop_scratch(links)
    return out


def _apart(members: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """band, id, c, left, u, shared, sketch: the lines of bands that hold several components, with how many of them the band has; u orders
    them, evenly from 0 to the size of the band."""
    rows = members.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    rows = rows.select("band", "id", "m", F.coalesce("component", "id").alias("c"))
    several = rows.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("left")).where("low < high").select("band", "left")
    rows = rows.join(several.hint("shuffle_hash"), "band").join(sketches, "id")
    return rows.select("band", "id", "c", "left", F.pmod(F.xxhash64("id", "band"), F.col("m")).alias("u"), "shared", "many", *_BITMAP)


def _cross(apart: DataFrame, texts: DataFrame, low: int, high: int | None, threshold: float) -> DataFrame:
    """a, b: of the pairs of a round those that are alike, but for collisions of 32-bit hashes.  Of each line it is first asked
    whether bitmaps leave it any other of its band; only such lines get their sets, and they are compared inside the join."""

    def meet(x: str, y: str) -> Column:
        # of the bands that a pair shares, the least has it
        here = F.col(f"{x}.band") == F.array_min(F.array_intersect(f"{x}.shared", f"{y}.shared"))
        return (F.col(f"{x}.band") == F.col(f"{y}.band")) & (F.col(f"{x}.c") != F.col(f"{y}.c")) & may_be_alike(x, y, _BITMAP, threshold) & here

    # a pair belongs to the round of the lesser of its two in the order of the band
    first = F.col("u").between(low, high - 1) if high else F.col("u") >= low
    rows = apart.where(F.col("u") >= low)
    ends = write_scratch(rows.alias("x").join(rows.where(first).alias("y"), meet("x", "y"), "left_semi"), "ends")
    starts = ends  # in the last round all are
    if high:
        starts = write_scratch(rows.where(first).alias("x").join(ends.alias("y"), meet("x", "y"), "left_semi"), "starts")
    sets = _of(starts.select("id").union(ends.select("id")).distinct(), texts).select(F.col("id").alias("line"), F.transform(F.array_distinct(_set("norm")), lambda g: F.hash(g)).alias("s"))
    full = lambda rows: rows.join(sets.hint("shuffle_hash"), F.col("id") == F.col("line")).drop("line")
    later = (F.col("y.u") > F.col("x.u")) | ((F.col("y.u") == F.col("x.u")) & (F.col("y.id") > F.col("x.id")))
    # two shingles may share a hash, in long lines more may
    slack = 2 + F.least(F.col("x.many"), F.col("y.many")) / 1000
    both, shared = F.size("x.s") + F.size("y.s"), F.size(F.array_intersect("x.s", "y.s"))
    alike = shared + slack >= threshold * (both - shared)
    cross = full(starts).alias("x").join(full(ends).alias("y"), later & meet("x", "y") & alike)
    cross = write_scratch(cross.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")), "pairs")
    drop_scratch(*{id(t): t for t in (starts, ends)}.values())
    return cross


def line_components(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """docs: __doc, __text.  The distinct lines, and node, component for those that have links."""
    distinct = _distinct(_lines(docs))
    members = _members(distinct)
    sketches, texts = _candidates(distinct, members)
    pairs = members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    x, y = sketches.alias("x"), sketches.alias("y")
    pairs = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    pairs = write_scratch(pairs.where(may_be_alike("x", "y", _BITMAP, threshold)).select("a", "b"), "pairs")
    links = _verified(pairs, texts, threshold)
    found = write_scratch(connected_components(links), "line-components")
    drop_scratch(links, pairs)

    rounds = [*ROUNDS, None]
    low = 0
    while rounds:
        apart = write_scratch(_apart(members, found, sketches), "lines-apart")
        size = apart.agg(F.avg("left")).first()[0]
        if size is None:
            break
        if size <= CROWDED:
            rounds = [None]
        high = rounds.pop(0)
        cross = _cross(apart, texts, low, high, threshold)
        low = high
        drop_scratch(apart)
        if cross.limit(1).count():
            more = _verified(cross, texts, threshold)
            if more.limit(1).count():
                now = write_scratch(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b"))), "line-components")
                drop_scratch(found)
                found = now
            drop_scratch(more)
        drop_scratch(cross)
    drop_scratch(members, sketches, texts)
    return distinct, found


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __n_lines, __n_removed and the text without the lines removed."""
    base = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text"))
    distinct, found = line_components(base, threshold)
    rows = distinct.select("id", "k1", "k2", "first", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    rows = rows.where("n > 1 or component is not null").withColumn("c", F.coalesce("component", "id"))
    keeper = rows.groupBy("c").agg(F.min("first").alias("keep"))
    affected = rows.join(keeper, "c").select("k1", "k2", "keep")
    places = _lines(base).select("doc", "th", "pos", "k1", "k2")
    gone = places.join(affected, ["k1", "k2"]).where("doc <> keep.doc or th <> keep.th or pos <> keep.pos")
    gone = write_scratch(gone.groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "removed-lines")
    drop_scratch(distinct, found)

    names = [c for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    out = docs.select(row, F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th")).join(gone.hint("shuffle_hash"), ["doc", "th"], "left")
    out = out.select("row", "gone", F.split(F.col("row")[text_col], "\n").alias("lines"))
    # what stands between removed lines, in one pass over them
    out = out.withColumn("edges", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines"))))
    between = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice("lines", F.element_at("edges", i) + 2, F.element_at("edges", i + 1) - F.element_at("edges", i) - 1))
    kept = F.col("row")[text_col]
    text = F.when(F.col("gone").isNull(), kept).otherwise(F.array_join(F.flatten(between), "\n"))
    n_lines = F.when(kept.isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    keep = [(F.col("row")[c] if c != text_col else text).alias(c) for c in names]
    return out.select(*keep, n_lines.alias("__n_lines"), n_gone.alias("__n_removed"))
