"""Snapshot writes: last writer, replacement by origin, cascades, and violated constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writer(existing: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row for each key: the one of greatest sequence, an incoming row before an existing one of
    the same sequence. Both have the same columns; a map-side maximum picks the rows."""
    columns = existing.columns
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(sequence, "__new", F.struct(*columns).alias("row"))).alias("b"))
    return best.select("b.row.*")


def replace_by_origin(existing: DataFrame, incoming: DataFrame, origin: str, item: str = "item", topic: str = "topic") -> DataFrame:
    """Links (item, topic, score, origin, principal) of items that incoming classifies again.

    Links of that origin go, others stay; a clash with a manual link keeps the manual one, with its
    score. If no manual link is principal, the best incoming one becomes the only principal one.
    """
    again = incoming.select(F.col(item).alias("__i")).distinct()
    touched = F.col("__i").isNotNull()
    kept = existing.join(again, F.col(item) == F.col("__i"), "left").where(~touched | (F.col("origin") != origin))
    held = kept.groupBy(item).agg(F.max((F.col("principal") == 1) & (F.col("origin") == "manual")).alias("manual_principal"))
    fresh = incoming.select(item, topic, "score").join(kept.select(item, topic), [item, topic], "left_anti")
    best = incoming.groupBy(item).agg(F.max(F.struct("score", (-F.col(topic)).alias("t"))).alias("b")).select(F.col(item).alias("__b"), (-F.col("b.t")).alias("best"))
    new = fresh.withColumn("origin", F.lit(origin)).withColumn("principal", F.lit(0))
    both = kept.select(item, topic, "score", "origin", "principal").unionByName(new)
    met = both.join(held, item, "left").join(best, F.col(item) == F.col("__b"), "left")
    decided = F.col("__b").isNull() | F.coalesce("manual_principal", F.lit(False))
    principal = F.when(decided, F.col("principal")).otherwise((F.col(topic) == F.col("best")).cast("int"))
    return met.select(item, topic, "score", "origin", principal.alias("principal"))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def patch(existing: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """existing with the columns' values of changes where they are not null."""
    given = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    met = existing.join(given, keys, "left")
    return met.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns])


def cascade_delete(children: DataFrame, gone: DataFrame, child_key: str, key: str) -> DataFrame:
    return children.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(child_key) == F.col("__gone"), "left_anti")


def restricted(gone: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Rows that may not be deleted since children refer to them."""
    return gone.join(children.select(F.col(child_key).alias("__used")).distinct(), F.col(key) == F.col("__used"), "left_semi")


def set_null(children: DataFrame, gone: DataFrame, child_key: str, key: str) -> DataFrame:
    """children whose reference to a row that goes is null instead."""
    met = children.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(child_key) == F.col("__gone"), "left")
    return met.withColumn(child_key, F.when(F.col("__gone").isNull(), F.col(child_key))).select(*children.columns)


def unique_violations(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """(keys, n) that stand more than once among the rows that the condition takes in."""
    rows = rows.where(where) if where is not None else rows
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    known = parents.select(F.col(key).alias("__known")).distinct()
    return children.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("__known"), "left_anti")


def same_parent_violations(rows: DataFrame, mine: Column, theirs: Column) -> DataFrame:
    return rows.where(~mine.eqNullSafe(theirs))


def next_ordinal(children: DataFrame, key: str, ordinal: str) -> DataFrame:
    return children.groupBy(key).agg((F.coalesce(F.max(ordinal), F.lit(-1)) + 1).alias("next"))
