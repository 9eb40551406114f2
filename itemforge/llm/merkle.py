"""A Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups' roots.

Rows get their place in a group from ranges that are sorted apart. A block of fixed size, a power of the
tree's arity, is one array, whose levels `sequence`, `transform`, `slice` and `aggregate` collapse
natively. The roots of blocks are the next height's nodes, until each group has one node; the groups'
roots are the nodes of a last tree. Paths go the other way: a block's nodes take theirs inside the block
and add that of the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.llm import workspace


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*values: Column) -> Column:
    """The hash of a row's values: `-` for a null, else the UTF-8 byte count, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: hashed(s["left"], node, s["right"]))


def path_hash(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _levels(nodes: Column, go_on: Column, arity: int, height: int) -> Column:
    """A block's levels from its nodes upwards: to a single node, or, with `go_on`, by `height` levels
    even from a single node, since other blocks stand beside it."""

    def up(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), F.ceil(F.size(last) / arity).cast("int") - 1)
        above = F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(last, k * arity + 1, F.lit(arity)), ""), 256))
        return F.when(go_on | (F.size(last) > 1), F.concat(levels, F.array(above))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(nodes), up)


def _siblings(levels: Column, at: Column, arity: int) -> Column:
    """An array of (left, right), for each level but the last: the joined hashes of the others in the run
    of the node above place `at`."""

    def beside(level: Column, k: Column) -> Column:
        here = F.floor(at / F.pow(F.lit(arity), k)).cast("int")
        first = here - here % arity
        return F.struct(F.array_join(F.slice(level, first + 1, here - first), "").alias("left"), F.array_join(F.slice(level, here + 2, first + arity - 1 - here), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(g, ...) with `pos` from 0 in the order of each g and `n`, how many its g has. Ranges are
    sorted apart; only their counts, one for each range and g in it, are summed along."""
    by = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(workspace.partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    dealt = workspace.saved(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("here"), F.min("at").alias("start"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("g", "part", "start", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("g")).alias("n"))
    return dealt.join(counts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("start")).drop("at", "part", "start", "before")


def _climb(rows: DataFrame, arity: int, height: int) -> DataFrame:
    """rows(g, n, pos, node, ...) with `top`, the root of their g, and `path`, their siblings up to it."""
    size, heights, tasks = arity**height, [], workspace.partitions(rows.sparkSession)
    levels = _levels(F.transform("items", lambda x: x["node"]), F.col("n") > size, arity, height)
    while True:
        held = F.struct("pos", *[c for c in rows.columns if c not in ("g", "n", "pos")])
        blocks = rows.withColumn("block", F.floor(F.col("pos") / size)).groupBy("g", "n", "block").agg(F.array_sort(F.collect_list(held)).alias("items"))
        blocks = workspace.saved(blocks.coalesce(tasks), "merkle-blocks")
        heights.append(blocks)
        tasks = min(tasks, 1 + blocks.count() // (16 * size))  # each height has the size-th part of the nodes below
        if blocks.where(F.col("n") > size).isEmpty():
            break
        roots = blocks.withColumn("node", F.element_at(F.element_at(levels, -1), 1))
        rows = workspace.saved(roots.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), "node").coalesce(tasks), "merkle-roots")
    above = None
    for blocks in reversed(heights):
        met = blocks.withColumn("levels", levels)
        if above is None:  # each g has one block
            met = met.withColumns({"top": F.element_at(F.element_at("levels", -1), 1), "on": F.array().cast("array<struct<left:string,right:string>>")})
        else:
            met = met.join(above, ["g", "block"])
        each = met.select("g", "n", "levels", "top", "on", F.explode("items").alias("x"))
        each = each.select("g", "n", "x.*", "top", F.concat(_siblings(F.col("levels"), F.col("x.pos") % size, arity), "on").alias("path"))
        above = each.select("g", F.col("pos").alias("block"), "top", F.col("path").alias("on"))
    return each


def manifest(rows: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column] | None = None, arity: int = 2, block_levels: int = 8) -> DataFrame:
    """(id, leaf, subroot, root, path, carried columns) for every row.

    A leaf is the hash of the row's columns. In a group leaves ascend by the order column, nulls first,
    equal ones by their hash; rows that repeat stand beside each other, each for itself. Every `arity`
    consecutive nodes become the hash of their joined hashes, a shorter last run too, until one node
    is left, the group's subroot; the subroots, by group, null first, in order of bytes, give the root.
    path is an array of (left, right), the siblings on the way. A null group is a group. An empty table
    has no rows and no root. Other columns are not read, whatever their names.

    Blocks have arity ** block_levels leaves, so no array grows with the data. A group of any size, or
    an order value that many rows share, is cut by ranges and blocks.
    """
    g = F.col(f"`{group}`").cast("string")
    kept = {f"c{k}": c for k, c in enumerate((carry or {}).values())}
    slim = rows.select(
        F.coalesce(F.concat(F.lit("="), g), F.lit("")).alias("g"),  # sorts like the group, null first
        F.col(f"`{order}`").alias("id"),
        leaf_hash(*[F.col(f"`{c}`") for c in columns]).alias("node"),
        F.monotonically_increasing_id().alias("tie"),
        *[c.alias(k) for k, c in kept.items()],
    )
    leaves = _climb(_placed(workspace.saved(slim, "merkle-leaves"), ["id", "node", "tie"]).drop("tie"), arity, block_levels)
    leaves = workspace.saved(leaves.drop("n", "pos"), "merkle-paths")
    tops = leaves.groupBy("g").agg(F.first("top").alias("node")).select(F.col("g").alias("name"), "node", F.lit("").alias("g"))
    upper = _climb(_placed(tops, ["name"]), arity, block_levels).select(F.col("name").alias("g"), F.col("top").alias("root"), F.col("path").alias("on"))
    path = F.concat("path", "on").alias("path")
    return leaves.join(upper, "g").select("id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", path, *[F.col(k).alias(name) for k, name in zip(kept, carry or {}, strict=True)])


def verify(rows: DataFrame, kept: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(id, verified) of rows against a kept manifest of theirs: whether a row's columns still give the
    root. Rows whose id the manifest lacks are not verified; an id must stand for one row."""
    now = rows.select(F.col(f"`{order}`").alias("id"), leaf_hash(*[F.col(f"`{c}`") for c in columns]).alias("now"))
    met = now.join(kept.select(F.col("id").alias("known"), "path", "root"), F.col("id").eqNullSafe(F.col("known")), "left")
    return met.select("id", F.coalesce(fold(F.col("now"), F.col("path")) == F.col("root"), F.lit(False)).alias("verified"))
