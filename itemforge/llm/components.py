"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import workspace


#: Links a written file holds where all are few: a round's few links are not dealt over as many files as there are partitions.
FILE_ROWS = 50_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links u > v. A large star hangs each node's greater neighbours on its least one, a small star
    the node and its lesser neighbours."""
    if large:
        links = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    near = links.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); the root is the component's least node and has a
    row too. Each round is written to the shared folder, and the number of rounds grows with the
    logarithm of the longest path. No links give no rows."""
    now = workspace.saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _state(now)
    while before[0]:
        # A round never has more links than the one before.
        now = workspace.saved(_star(_star(now, True), False).coalesce(-(-before[0] // FILE_ROWS)), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
