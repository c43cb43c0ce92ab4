"""A Merkle manifest of a table: one digest for the whole, and versions that share what they don't change.

A row's leaf hashes its fields, each by its length and value.  Rows of a group are leaves of
one tree in the order of their ids; every `width` consecutive nodes become one node, also a
last run of fewer, until one node is left, the group's subroot.  Subroots in the order of
their groups are the leaves of the tree above, whose last node is the root.

The tree is persistent.  A changed leaf doesn't build a new tree: it makes a version that
copies the leaf's ancestors and shares every other node with the tree it comes from.  Trees
are cut into aligned blocks of width**depth nodes.  A task builds the levels of its block,
and each version copies its path inside the block there; the block's own path to the root,
some runs of digests, is made once by the tree above, and the version goes on along it.  So
no task sees more than a block, whatever the size of a group, and versions of one block
never meet.

The order is global: rows are dealt by ranges of (group, id, leaf), numbered in their
partition, and the offsets are one number for each partition.

Null fields are hashed as '-'.  Null groups are one group, before all others; null ids come
first.  Rows of equal id are ordered by their leaves; repeated rows are leaves of their own.
A change that leaves the fields as they are makes a version equal to the tree.  An empty
table has no root and gives no rows.  Texts of any length are hashed whole.  Columns that
aren't named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import drop_scratch, ship, shuffle_partitions, write_scratch

HEX = 64
_PATH = "path array<struct<at:int,run:string>>"
_ABOVE = f"tree long, idx long, {_PATH}, subroot string, root string"


# --- digests ------------------------------------------------------------------


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields, each as '<bytes>:<value>', or '-' for null."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- one block: plain lists of digests --------------------------------------------


def levels_of(nodes: list[str], whole: bool, width: int, depth: int) -> list[list[str]]:
    """The levels of a block from its nodes up.  A block that is a whole tree ends with its one last node; others have `depth`
    levels above the nodes, even where runs of one node remain."""
    levels = [nodes]
    for _ in range(depth):
        last = levels[-1]
        if whole and len(last) == 1:
            break
        levels.append([digest(last[i : i + width]) for i in range(0, len(last), width)])
    return levels


def runs_of(levels: list[list[str]], i: int, width: int) -> list[tuple[int, str]]:
    """The path of node i through its block: for each level the run it stands in, and where in it."""
    out = []
    for level in levels[:-1]:
        at = i % width
        out.append((at, "".join(level[i - at : i - at + width])))
        i //= width
    return out


def copied_path(leaf: str, path: Iterable[tuple[int, str]]) -> list[str]:
    """What a version with another leaf doesn't share: that leaf and its ancestors along the path, the root last."""
    own = [leaf]
    for at, run in path:
        own.append(digest((run[: at * HEX], own[-1], run[(at + 1) * HEX :])))
    return own


def siblings(path: Iterable[tuple[int, str]]) -> str:
    return "".join(run[: at * HEX] + run[(at + 1) * HEX :] for at, run in path)


# --- order and blocks on Spark -------------------------------------------------------


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with `at`, their place in the order from 0, and `part`, the range they were dealt to; and the scratch table below."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = write_scratch(dealt.withColumn("pos", F.monotonically_increasing_id()), name)
    part = F.shiftright("pos", 33)
    base, bases = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        bases.append((r.part, base))
        base += r.n
    offsets = spark.createDataFrame(bases, "part long, base long")
    at = F.col("base") + F.col("pos") - F.shiftleft("part", 33)
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("at", at).drop("pos", "base"), placed


def _block(span: int) -> Column:
    return F.expr(f"idx div {span}").alias("block")


def build(nodes: DataFrame, width: int, depth: int, name: str) -> list[DataFrame]:
    """nodes: tree, idx, digest, n (nodes in the tree).  The rounds of the trees: nodes, the roots of their blocks, the roots of
    blocks of those, and so on until each tree is one node."""
    span = width**depth
    ship(nodes.sparkSession)

    def top(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        n = block.column("n")[0].as_py()
        found = block.sort_by("idx").column("digest").to_pylist()
        root = levels_of(found, n <= span, width, depth)[-1][0]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [root], [-(-n // span)]], schema=pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]))

    rounds = [nodes]
    while True:
        up = rounds[-1].select("tree", "idx", "digest", "n").groupBy("tree", _block(span)).applyInArrow(top, "tree long, idx long, digest string, n long")
        rounds.append(write_scratch(up, name))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds


def _path(rows: pa.Table) -> list[tuple[int, str]]:
    return [(x["at"], x["run"]) for x in rows.column("path")[0].as_py()]


def descend(rounds: list[DataFrame], above: DataFrame, width: int, depth: int, name: str) -> DataFrame:
    """From the paths of the last round's nodes, the paths of the first round's blocks: tree, idx (of the block), path, subroot, root."""
    span = width**depth
    schema = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("run", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())])

    def extend(key: tuple[pa.Scalar, ...], block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        levels = levels_of(block.column("digest").to_pylist(), block.column("n")[0].as_py() <= span, width, depth)
        rest = _path(over)
        paths = [[{"at": a, "run": r} for a, r in runs_of(levels, i, width) + rest] for i in range(len(block))]
        same = [[over.column(c)[0].as_py()] * len(block) for c in ("subroot", "root")]
        return pa.table([block.column("tree"), block.column("idx"), pa.array(paths, schema.field("path").type), *same], schema=schema)

    for nodes in reversed(rounds[1:-1]):
        blocks = nodes.select("tree", "idx", "digest", "n").groupBy("tree", _block(span))
        above = write_scratch(blocks.cogroup(above.groupBy("tree", "idx")).applyInArrow(extend, _ABOVE), name)
    return above


def manifest(
    docs: DataFrame, columns: list[str], tamper: dict[str, Column] | None = None, where: Column | None = None, group_col: str = "source", id_col: str = "doc_id", width: int = 16, depth: int = 2
) -> DataFrame:
    """One row per row of docs: its id and group, leaf, subroot, root, `proof` (the digest of its path's siblings, from the leaf
    to the root), `copied` (the digests that its version owns, from the leaf to the version's root), folded_root (that root)
    and verified (it equals the root).  Where `where` holds, the version has the row's columns as `tamper` says; elsewhere
    its leaf is the row's own."""
    spark = docs.sparkSession
    span = width**depth
    ship(spark)
    fields = [F.col(c) for c in columns]
    leaf, changed = leaf_of(fields), F.lit(None).cast("string")
    if tamper:
        changed = F.when(F.lit(True) if where is None else where, leaf_of([tamper.get(c, F.col(c)) for c in columns]))
    rows = write_scratch(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("digest"), changed.alias("changed")), "merkle-leaves")

    leaves, dealt = numbered(rows, ["group", "id", "digest"], "merkle-order")
    stretches = leaves.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a group in a partition
    groups, dealt_groups = numbered(stretches.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("n")), ["first"], "merkle-groups")
    groups = groups.select("group", F.col("at").alias("tree"), "first", "n")
    g, s = groups.alias("g"), stretches.alias("s")
    stretches = s.join(g, F.col("s.group").eqNullSafe(F.col("g.group"))).select("s.group", "s.part", "g.tree", "g.first", "g.n")
    a, s = leaves.alias("a"), stretches.alias("s")
    leaves = a.join(s, (F.col("a.part") == F.col("s.part")) & F.col("a.group").eqNullSafe(F.col("s.group")))
    leaves = write_scratch(leaves.select("s.tree", (F.col("a.at") - F.col("s.first")).alias("idx"), "s.n", "a.id", "a.group", "a.digest", "a.changed"), "merkle-nodes")
    drop_scratch(rows, dealt)

    rounds = build(leaves, width, depth, "merkle-blocks")
    n_trees = rounds[-1].count()
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(n_trees).cast("long").alias("n"))
    upper = build(subroots, width, depth, "merkle-upper")
    no_path = F.array().cast("array<struct<at:int,run:string>>").alias("path")
    start = upper[-1].select("tree", "idx", no_path, F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    top = descend([subroots, *upper], start, width, depth, "merkle-paths")
    start = rounds[-1].select("tree", F.col("idx").alias("i"), F.col("digest").alias("sub")).join(top.select(F.col("idx").alias("tree"), "path", "root"), "tree")
    above = descend(rounds, start.select("tree", F.col("i").alias("idx"), "path", F.col("sub").alias("subroot"), "root"), width, depth, "merkle-paths")

    id_type, group_type = rows.schema["id"].dataType.simpleString(), rows.schema["group"].dataType.simpleString()
    out = f"`{id_col}` {id_type}, `{group_col}` {group_type}, leaf string, subroot string, root string, proof string, copied array<string>, folded_root string, verified boolean"

    def versions(key: tuple[pa.Scalar, ...], block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        leaf = block.column("digest").to_pylist()
        levels = levels_of(leaf, block.column("n")[0].as_py() <= span, width, depth)
        rest, subroot, root = _path(over), over.column("subroot")[0].as_py(), over.column("root")[0].as_py()
        beside = siblings(rest)
        goes_on: dict[str, list[str]] = {}  # versions with the same node at the top of the block share all above it
        proofs, copied = [], []
        for i, new in enumerate(block.column("changed").to_pylist()):
            path = runs_of(levels, i, width)
            own = copied_path(new or leaf[i], path)
            if own[-1] not in goes_on:
                goes_on[own[-1]] = copied_path(own[-1], rest)[1:]
            copied.append(own + goes_on[own[-1]])
            proofs.append(digest((siblings(path), beside)))
        n = len(leaf)
        folded = [c[-1] for c in copied]
        columns = [pa.array(leaf, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(copied, pa.list_(pa.string())), pa.array(folded, pa.string())]
        columns = [block.column("id"), block.column("group"), *columns, pa.array([f == root for f in folded], pa.bool_())]
        return pa.table(columns, names=[id_col, group_col, "leaf", "subroot", "root", "proof", "copied", "folded_root", "verified"])

    blocks = leaves.groupBy("tree", _block(span))
    return blocks.cogroup(above.groupBy("tree", "idx")).applyInArrow(versions, out)
