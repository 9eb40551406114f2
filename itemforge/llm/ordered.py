"""Documents dealt over partitions by ranges of their id."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(docs: DataFrame, id_column: str, n: int) -> list[int]:
    """At most n-1 ids that cut the table into n ranges of about as many rows. Reads ids only."""
    if n < 2:
        return []
    at = [k / n for k in range(1, n)]
    got = docs.select(F.percentile_approx(F.col(id_column), at, max(10_000, 10 * n)).alias("p")).first()
    return sorted(set(got.p or []))


def bucket(column: Column, cuts: list[int]) -> Column:
    """How many cuts are not over the id, found in two steps of the root of their number each; a
    null id is below all."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda x: x <= column))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.greatest(block, F.lit(1)))
    found = (F.greatest(block, F.lit(1)) - 1) * step + F.size(F.filter(inner, lambda x: x <= column))
    return F.coalesce(F.when(column.isNotNull(), found), F.lit(0)).cast("int")
