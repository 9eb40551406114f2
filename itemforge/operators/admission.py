"""Which rows of a batch a table takes, row by row, and the rule that each refused row breaks.

Rows come in an order, and a row is taken if it passes the checks, refers to rows that exist, and shares
no unique key with a row that is stored or with an earlier row that is taken. A refused row holds no
key, so a later one may have it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.operators import relational


@dataclass(frozen=True)
class Rules:
    """checks: an SQL condition by name, null counts as passed. references: (column, parent table, its
    key), null refers to nothing. unique: (columns, condition or None) by name; a row that has a null in
    the columns, or does not meet the condition, has no such key. The first rule broken is named, in
    this order."""

    checks: dict[str, str]
    references: list[tuple[str, DataFrame, str]]
    unique: dict[str, tuple[list[str], str | None]]


def _keys(unique: dict[str, tuple[list[str], str | None]]) -> Column:
    """An array of a row's (rule, key), rules by their place."""
    each = []
    for k, (columns, where) in enumerate(unique.values()):
        there = F.lit(True)
        for c in columns:
            there = there & F.col(c).isNotNull()
        if where:
            there = there & F.coalesce(F.expr(where), F.lit(False))
        each.append(F.when(there, F.struct(F.lit(k).alias("rule"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("key"))))
    return F.array_compact(F.array(*each))


def _contest(pairs: DataFrame) -> DataFrame:
    """The rows(o) that are taken of pairs(o, rule, key), by rounds. In a round a row that comes first in
    all its keys is taken, and the others of these keys are out; those whose keys' first rows are not
    decided yet wait. A key's first row is a map-side minimum, so rows that share one are not gathered.
    The number of rounds is that of the longest chain of rows in which each waits for the one before it."""
    taken, left = [pairs.where("false").select("o")], pairs
    while not left.isEmpty():
        first = left.groupBy("rule", "key").agg(F.min("o").alias("first"))
        met = relational.cut(left.join(first, ["rule", "key"]))
        won = relational.cut(met.groupBy("o").agg(F.bool_and(F.col("o") == F.col("first")).alias("all")).where("all").select("o"))
        taken.append(won)
        beaten = met.join(won.select(F.col("o").alias("first")), "first", "left_semi").select("o").distinct()  # the winners too
        left = relational.cut(met.join(beaten, "o", "left_anti").select("o", "rule", "key"))
    return relational.unioned(taken)


def admit(batch: DataFrame, order: list[str], rules: Rules, stored: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """batch with `broken`, the first rule that refuses a row, null for those taken, and `blocker`, the
    column `name` of the row of the batch whose key it wanted, null if it is a stored one or no key's.

    Rows of equal order stand as they are read. `stored` has the columns of the unique rules.
    """
    names = list(rules.unique)
    met, faults = batch, [F.when(~F.coalesce(F.expr(c), F.lit(True)), f"check {k}") for k, c in rules.checks.items()]
    for k, (column, parent, key) in enumerate(rules.references):
        met = met.join(parent.select(F.col(key).alias(f"__parent{k}")).distinct(), F.col(column) == F.col(f"__parent{k}"), "left")
        faults.append(F.when(F.col(column).isNotNull() & F.col(f"__parent{k}").isNull(), f"reference {column}"))
    named = F.col(name) if name else F.lit(None).cast("string")
    met = met.withColumns({"__fault": F.coalesce(*faults, F.lit(None).cast("string")), "__keys": _keys(rules.unique), "__o": F.struct(*order, F.monotonically_increasing_id().alias("__row"), named.alias("named"))})
    rows = relational.cut(met.select(*batch.columns, "__fault", "__keys", "__o"))
    pairs = relational.cut(rows.where("__fault IS NULL").select(F.col("__o").alias("o"), F.explode("__keys").alias("k")).select("o", "k.rule", "k.key"))
    known = pairs.where("false").select("rule", "key")
    if stored is not None:
        held = stored.select(F.explode(_keys(rules.unique)).alias("k")).select("k.rule", "k.key")
        known = relational.cut(held.join(pairs.select("rule", "key").distinct(), ["rule", "key"], "left_semi").distinct())
    refused = pairs.join(known, ["rule", "key"], "left_semi").select("o").distinct()
    taken = _contest(pairs.join(refused, "o", "left_anti")).withColumn("taken", F.lit(True))
    marked = relational.cut(pairs.join(taken, "o", "left"))
    # A refused row's rule is the first of those whose key a stored row has, or an earlier one that is taken.
    holders = marked.where("taken").select("rule", "key", F.col("o").alias("by")).unionByName(known, allowMissingColumns=True)
    met = marked.where("taken IS NULL").join(holders, ["rule", "key"]).where(F.col("by").isNull() | (F.col("by") < F.col("o")))
    lost = met.groupBy("o").agg(F.min(F.struct("rule", "by")).alias("s"))
    rule = F.element_at(F.array(*[F.lit(f"unique {n}") for n in names]), F.col("s.rule") + 1) if names else F.lit(None).cast("string")
    out = lost.select(F.col("o.__row").alias("__row"), rule.alias("__broken"), F.col("s.by.named").alias("__by"))
    rows = rows.withColumn("__row", F.col("__o.__row"))
    return rows.join(out, "__row", "left").select(*batch.columns, F.coalesce("__fault", "__broken").alias("broken"), F.col("__by").alias("blocker"))
