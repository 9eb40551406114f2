"""Joins on intervals of a line by cells of a grid: an equality of cells, and the exact condition on what
meets there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(at: Column, cell: float) -> Column:
    return F.floor(at / cell).cast("long")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], mine: tuple[str, str], theirs: tuple[str, str], cell: float) -> DataFrame:
    """left and right rows of equal keys whose closed intervals share a point, each pair once; the
    columns of both, which have different names but for the keys.

    A row stands in every cell that its interval touches, and a pair is taken in the first cell that
    both touch. A cell should be about as long as most intervals: shorter ones multiply rows, longer
    ones let more pairs meet that the condition refuses. Intervals with a null or a negative length meet none.
    """

    def spread(rows: DataFrame, ends: tuple[str, str], mark: str) -> DataFrame:
        lo, hi = (F.col(c) for c in ends)
        rows = rows.where(lo <= hi).withColumn(mark, _cell(lo, cell))
        return rows.withColumn("__cell", F.explode(F.sequence(F.col(mark), _cell(hi, cell))))

    met = spread(left, mine, "__first").join(spread(right, theirs, "__other"), [*keys, "__cell"])
    share = (F.col(mine[0]) <= F.col(theirs[1])) & (F.col(theirs[0]) <= F.col(mine[1]))
    return met.where((F.col("__cell") == F.greatest("__first", "__other")) & share).drop("__cell", "__first", "__other")


def containing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, span: tuple[str, str], cell: float) -> DataFrame:
    """points and the spans of equal keys, closed below and open above, that hold them."""
    spread = spans.where(F.col(span[0]) < F.col(span[1])).withColumn("__cell", F.explode(F.sequence(_cell(F.col(span[0]), cell), _cell(F.col(span[1]), cell))))
    met = points.withColumn("__cell", _cell(F.col(at), cell)).join(spread, [*keys, "__cell"])
    return met.where((F.col(at) >= F.col(span[0])) & (F.col(at) < F.col(span[1]))).drop("__cell")
