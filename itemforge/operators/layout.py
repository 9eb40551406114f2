"""Page layout: lines from fragments, columns, recurring headers and footers, question chains.

fragments(doc_id, page, x0, y0, x1, y1, text, size, bold, italic) are what a file decoder gives;
lines(doc_id, page, col, seq, x0, y0, x1, y1, text, first_fragment, others) what comes of them. A
document's lines are the unit of the sequential steps; they are bounded by its pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.operators import intervals, relational
from itemforge.sources import shared

#: The thresholds of the layout rules.
VOTING, COVERAGE, BODY = 25, 0.25, (0.08, 0.92)
PAGE_SHARE, LEAST_PAGES, GAP_LINES, MOST_SD, BAND_GAP, LONGEST_KEY, BUDGET = 0.40, 3, 1.3, 15.0, 20.0, 200, 0.25
GUTTER, STEP, STRONG = 4.0, 5, 5


def upper_median(column: Column | str) -> Column:
    """The element at half the length, rounded down, of the sorted values."""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def positional(column: Column | str, share: float) -> Column:
    """The element at that share of the length of the sorted values, the last at most."""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.least(F.floor(F.size(values) * share), F.size(values) - 1).cast("int"))


def has_text_layer(pages: DataFrame, least: int = 120) -> DataFrame:
    """(doc_id, has_text): characters a page, from pages(doc_id, page, text)."""
    share = F.sum(F.length(F.coalesce("text", F.lit("")))) / F.countDistinct("page")
    return pages.groupBy("doc_id").agg((share >= least).alias("has_text"))


def layout_votes(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, two_columns): each page's vote, null with too few fragments in the body.
    pages(doc_id, page, width, height)."""
    rows = pages.join(fragments, ["doc_id", "page"], "left")
    middle, slack = F.col("width") / 2, F.col("width") * 0.02
    at = (F.col("y0") + F.col("y1")) / 2
    body = (at > F.col("height") * BODY[0]) & (at < F.col("height") * BODY[1])
    n = F.count_if(body)
    cross = F.count_if(body & (F.col("x0") < middle - slack) & (F.col("x1") > middle + slack))
    left, right = F.count_if(body & (F.col("x1") <= middle + slack)), F.count_if(body & (F.col("x0") >= middle - slack))
    vote = (cross <= n * 0.05) & (left >= n * 0.2) & (right >= n * 0.2)
    return rows.groupBy("doc_id", "page").agg(F.when(n >= VOTING, vote).alias("two_columns"))


def document_layout(votes: DataFrame) -> DataFrame:
    """(doc_id, two_columns): more than half of the pages that vote."""
    yes = F.count_if(F.coalesce("two_columns", F.lit(False)))
    return votes.groupBy("doc_id").agg((yes > F.count("two_columns") / 2).alias("two_columns"))


def assign_columns(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """fragments with col: 0 on one-column pages; else by the centre, or by the left edge when a
    fragment covers a quarter of both halves. Pages that abstain stay in one column."""
    votes = layout_votes(fragments, pages)
    whole = document_layout(votes).withColumnRenamed("two_columns", "doc_two")
    rows = fragments.join(votes, ["doc_id", "page"], "left").join(whole, "doc_id", "left").join(pages, ["doc_id", "page"])
    middle = F.col("width") / 2
    covers_left = F.greatest(F.lit(0.0), F.least("x1", middle) - F.greatest("x0", F.lit(0.0))) >= COVERAGE * middle
    covers_right = F.greatest(F.lit(0.0), F.least("x1", F.col("width")) - F.greatest("x0", middle)) >= COVERAGE * middle
    edge = F.when(covers_left & covers_right, F.col("x0")).otherwise((F.col("x0") + F.col("x1")) / 2)
    two = F.col("doc_two") & F.col("two_columns").isNotNull()
    return rows.withColumn("col", F.when(two & (edge >= middle), 1).otherwise(0)).select(*fragments.columns, "col")


def assign_to_columns(fragments: DataFrame, columns: DataFrame, cell: float = 100.0) -> DataFrame:
    """fragments with col, of any number of columns(doc_id, page, col, left, right) a page.

    A fragment lies in the column that has its centre, or its left edge where it covers a quarter of two
    columns or more; one that no column has lies in the last. Pages without columns are one column.
    """
    rows = relational.cut(fragments.withColumn("__id", F.monotonically_increasing_id()))
    boxes = rows.select("__id", "doc_id", "page", "x0", "x1")
    met = intervals.overlapping(boxes, columns.select("doc_id", "page", F.col("col").alias("__col"), "left", "right"), ["doc_id", "page"], ("x0", "x1"), ("left", "right"), cell)
    covers = (F.least("x1", "right") - F.greatest("x0", "left")) / (F.col("right") - F.col("left")) >= COVERAGE
    holds = lambda at: F.min(F.when((at >= F.col("left")) & (at < F.col("right")), F.col("__col")))
    found = met.groupBy("__id").agg(F.count_if((F.col("right") > F.col("left")) & covers).alias("__covered"), holds((F.col("x0") + F.col("x1")) / 2).alias("__centre"), holds(F.col("x0")).alias("__edge"))
    last = columns.groupBy("doc_id", "page").agg(F.max("col").alias("__last"))
    out = rows.join(found, "__id", "left").join(last, ["doc_id", "page"], "left")
    col = F.coalesce(F.when(F.col("__covered") > 1, F.col("__edge")).otherwise(F.col("__centre")), "__last", F.lit(0))
    return out.select(*fragments.columns, col.cast("int").alias("col"))


_LINES = "doc_id long, page int, col int, seq long, x0 double, y0 double, x1 double, y1 double, text string, first_fragment string, others string, size double, bold boolean"


def fuse_lines(fragments: DataFrame) -> DataFrame:
    """Lines of fragments(…, col). On a page, fragments of a column join while their centre is within
    half the upper median height of the running mean of the line's centres.

    Pages are dealt over tasks and sorted there; a task takes many at once and holds no more than a batch
    and one page.
    """
    spark = fragments.sparkSession
    shared.ship(spark)
    kinds = dict(x.split() for x in _LINES.split(", "))
    names = ["doc_id", "page", "col", "x0", "y0", "x1", "y1", "text", "size", "bold"]
    rows = fragments.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names]).withColumn("c", (F.col("y0") + F.col("y1")) / 2)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ("doc_id", "page", F.col("col").asc_nulls_last(), F.col("c").asc_nulls_last(), F.col("x0").asc_nulls_last(), "text")
    return rows.repartition(n, "doc_id", "page").sortWithinPartitions(*order).mapInArrow(_fused, _LINES)


def _fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the sorted fragments of whole pages."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, 20_000
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(_begins(table, "doc_id", "page"))[-1])  # the last page may go on
        if cut:
            yield _lines_of(table.slice(0, cut).combine_chunks())
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        enough = max(20_000, rows * 5 // 4)
    if rows:
        yield _lines_of(pa.Table.from_batches(held).combine_chunks())


def _begins(table: pa.Table, *names: str) -> np.ndarray:
    """Where a row differs from the one before in one of these columns of whole numbers."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in names:
        column = table[name]
        for values in (column.fill_null(0).to_numpy(), column.is_null().to_numpy()):
            new[1:] |= values[1:] != values[:-1]
    return new


def _breaks(c: np.ndarray, fresh: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Where lines begin among sorted centres. A gap beyond the slack parts lines, since no mean lies
    beyond the centre before; centres that lie within the slack altogether are one line; only the
    others are told one by one against the running mean."""
    eps = 1e-9 * (1 + np.abs(c))
    with np.errstate(invalid="ignore"):
        new = fresh | ~(np.diff(c, prepend=c[:1]) <= slack + eps)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(c)) - 1
        doubtful = (last > first) & ~(c[last] - c[first] <= (slack - eps)[first])
    for a, b in zip(first[doubtful].tolist(), last[doubtful].tolist(), strict=True):
        high = low = 0.0  # of a sum whose rounding is made up for, as Python's sum() does
        start, most = a, float(slack[a])
        for k, x in enumerate(c[a : b + 1].tolist(), a):
            if k > start and not abs(x - (high + low) / (k - start)) <= most:
                new[k], start, high, low = True, k, 0.0, 0.0
            total = high + x
            low += (high - total) + x if abs(high) >= abs(x) else (x - total) + high
            high = total
    return new


def _lines_of(table: pa.Table) -> pa.RecordBatch:
    page = np.cumsum(_begins(table, "doc_id", "page")) - 1
    number = lambda name: table[name].cast("double").to_numpy()
    height = number("y1") - number("y0")
    tall = np.flatnonzero(height > 0)
    tall = tall[np.lexsort((height[tall], page[tall]))]
    count = np.bincount(page[tall], minlength=page[-1] + 1)
    middle = np.full(len(count), 10.0)
    middle[count > 0] = height[tall[(np.cumsum(count) - count + count // 2)[count > 0]]]
    slack = np.maximum(0.5 * middle, 1.0)
    inside = table["col"].is_valid().to_numpy()
    table, page = table.filter(pa.array(inside)), page[inside]
    if not len(page):
        return pa.RecordBatch.from_pylist([], schema=_LINES_ARROW)
    line = np.cumsum(_breaks(number("c"), _begins(table, "col") | (np.diff(page, prepend=-1) > 0), slack[page])) - 1
    by_x = np.lexsort((number("x0"), line))
    table = table.take(pa.array(by_x))
    first = np.flatnonzero(np.diff(line, prepend=-1))
    low = {k: np.fmin.reduceat(number(k), first) for k in ("x0", "y0")}
    high = {k: np.fmax.reduceat(number(k), first) for k in ("x1", "y1", "size")}
    words = table["text"].fill_null("").to_pylist()
    edges = [*first.tolist(), len(words)]
    spans = list(zip(edges, edges[1:], strict=False))
    heads = table.select(["doc_id", "page", "col"]).take(pa.array(first))
    order = np.lexsort((low["y0"], heads["col"].to_numpy(), page[first]))
    at = page[first][order]
    places = np.arange(len(at)) - np.flatnonzero(np.diff(at, prepend=-1))[np.cumsum(np.diff(at, prepend=-1) > 0) - 1]
    told = {k: heads[k] for k in ("doc_id", "page", "col")}
    told |= {k: pa.array(v, from_pandas=True) for k, v in (low | high).items()}
    told |= {"text": pa.array([" ".join(words[a:b]) for a, b in spans]), "first_fragment": pa.array([words[a] for a, _ in spans]), "others": pa.array([" ".join(words[a + 1 : b]) for a, b in spans])}
    told["bold"] = pa.array(np.logical_and.reduceat(table["bold"].fill_null(False).to_numpy(), first))
    out = pa.table(told).take(pa.array(order)).append_column("seq", pa.array(places))
    return out.select(_LINES_ARROW.names).cast(_LINES_ARROW).combine_chunks().to_batches()[0]


_LINES_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]]) for x in _LINES.split(", ")])


def _banded(heights: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """heights(keys, y0, ...), each height of a key once, with band: a new one where y0 is more than the gap below
    the one before. A page bounds the heights of a key, however common the line is."""
    order = Window.partitionBy(*keys).orderBy("y0")
    fresh = F.when(F.col("y0") - F.lag("y0").over(order) > gap, 1).otherwise(0)
    return heights.withColumn("__new", fresh).withColumn("band", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def band_facts(counted: DataFrame, keys: list[str], gap: float = BAND_GAP) -> DataFrame:
    """(keys, band, n, y_min, y_max, y_mean, y_sd) from counted(keys, y0, n): each height of a key once,
    and how many lines stand there. The lines themselves are not needed again."""
    rows = _banded(counted, keys, gap)
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("y0"))
    spread = F.sum(F.col("n") * F.col("y0") * F.col("y0")) / n - (s / n) * (s / n)
    return rows.groupBy(*keys, "band").agg(n.alias("n"), F.min("y0").alias("y_min"), F.max("y0").alias("y_max"), F.round(s / n, 2).alias("y_mean"), F.round(F.sqrt(F.greatest(spread, F.lit(0.0))), 2).alias("y_sd"))


def _keyed(lines: DataFrame) -> DataFrame:
    """(doc_id, page, col, y0, height, key) of lines, written once for the steps that count them. Keys that
    may not recur are null: strong question markers, empty and long keys take no part."""
    key = T.line_key(F.col("text"))
    rows = lines.select("doc_id", "page", "col", "y0", (F.col("y1") - F.col("y0")).alias("height"), F.when(~T.strong_number(F.col("first_fragment")), key).alias("key"))
    fits = F.length("key").between(1, LONGEST_KEY)
    return shared.saved(rows.withColumn("key", F.when(fits, F.col("key"))), "lines")


def recurrences(keyed: DataFrame) -> DataFrame:
    """(doc_id, key, band, n, pages, y_mean, y_sd): each key's bands with its first line a page. First lines are
    minima of plain numbers by column, so the lines are counted and not sorted, and heights are what bands
    are told from."""
    spark = keyed.sparkSession
    least = F.lit(float("-inf"))  # a missing height comes first, and has no band
    by_col = keyed.where("key IS NOT NULL").groupBy("doc_id", "page", "key", F.coalesce("col", F.lit(-(2**31))).alias("col")).agg(F.min(F.coalesce("y0", least)).alias("y0"))
    # What follows stays with a document's key, and is shuffled once.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    first = by_col.repartition(n, "doc_id", "key").groupBy("doc_id", "page", "key").agg(F.min_by("y0", "col").alias("y0"))
    there = first.where(F.col("y0") > least).groupBy("doc_id", "key", "y0").agg(F.count("*").alias("c"), F.collect_list("page").alias("pages"))
    total, mean = F.sum("c"), F.sum(F.col("c") * F.col("y0")) / F.sum("c")
    bands = _banded(there, ["doc_id", "key"], BAND_GAP).groupBy("doc_id", "key", "band")
    facts = bands.agg(total.alias("n"), F.array_sort(F.flatten(F.collect_list("pages"))).alias("pages"), mean.alias("mean"), F.collect_list(F.struct("c", "y0")).alias("at"))
    squares = F.aggregate("at", F.lit(0.0), lambda s, x: s + x["c"] * (x["y0"] - F.col("mean")) * (x["y0"] - F.col("mean")))
    return facts.select("doc_id", "key", "band", "n", "pages", F.round("mean", 2).alias("y_mean"), F.round(F.sqrt(squares / F.col("n")), 2).alias("y_sd"))


def _at_ranks(counts: DataFrame, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(doc_id, one column for each rank): the values that stand at given places, from 0, of a document's
    sorted values, of counts(doc_id, value, c); a rank may use their number `n`."""
    counts = counts.where(F.col(value).isNotNull()).groupBy("doc_id", value).agg(F.sum("c").alias("__c"))
    of_doc = Window.partitionBy("doc_id")
    up = F.sum("__c").over(of_doc.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("__up")
    placed = counts.select("doc_id", value, "__c", up, F.sum("__c").over(of_doc).alias("n"))
    here = lambda rank: (F.col("__up") - F.col("__c") <= rank) & (rank < F.col("__up"))
    return placed.groupBy("doc_id").agg(*[F.min(F.when(here(rank), F.col(value))).alias(name) for name, rank in ranks.items()])


def within_budget(candidates: Column, budget: Column) -> Column:
    """Of an array of structs with an int `n`, in order, those that fit what is left of a budget; one that
    does not fit is passed over."""
    start = F.struct(budget.cast("int").alias("left"), F.slice(candidates, 1, 0).alias("took"))

    def step(state: Column, x: Column) -> Column:
        taken = F.struct((state["left"] - x["n"]).alias("left"), F.concat(state["took"], F.array(x)).alias("took"))
        return F.when(x["n"] <= state["left"], taken).otherwise(state)

    return F.aggregate(candidates, start, step, lambda state: state["took"])


def _recurring(keyed: DataFrame, pages: DataFrame) -> DataFrame:
    """Recurring keys' bands on enough pages, with `kind`: `header` or `footer` for those that may be
    noise, null for the body's. Documents of fewer than three pages have none."""
    at_share = lambda share: F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    counts = keyed.groupBy("doc_id", "y0", "height").agg(F.count("*").alias("c"))
    # Tables of documents and pages grow with the input, so none of them is broadcast.
    facts = counts.groupBy("doc_id").agg(F.sum("c").alias("n_lines")).hint("merge")
    facts = facts.join(_at_ranks(counts, "y0", {"top": at_share(0.05), "bottom": at_share(0.95)}).hint("merge"), "doc_id", "left")
    facts = facts.join(_at_ranks(counts.where("height > 0"), "height", {"line_height": F.floor(F.col("n") / 2)}).hint("merge"), "doc_id", "left")
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.min_by("height", "page").alias("page_height"))
    facts = facts.join(sizes.hint("merge"), "doc_id")
    rec = recurrences(keyed).join(facts.hint("merge"), "doc_id").where((F.col("n_pages") >= LEAST_PAGES) & (F.size("pages") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n_pages") * PAGE_SHARE))))
    kind = F.when(F.col("y_sd") > MOST_SD, None).when(F.col("y_mean") <= F.col("top"), "header").when(F.col("y_mean") >= F.col("bottom"), "footer")
    rec = shared.saved(rec.withColumn("kind", kind).withColumn("band_width", F.greatest(F.col("y_sd") * 1.5, F.lit(2.0))), "bands")
    # Each page of a band: lines outside it, and the gap to the nearest body line. A page's heights are one row.
    heights = keyed.groupBy("doc_id", "page").agg(F.collect_list("y0").alias("ys"))
    at = rec.where("kind IS NOT NULL").select("doc_id", "key", "band", "kind", "y_mean", "band_width", "line_height", F.explode("pages").alias("page")).join(heights.hint("merge"), ["doc_id", "page"])
    above = F.filter("ys", lambda y: y < F.col("y_mean") - F.col("band_width"))
    below = F.filter("ys", lambda y: y > F.col("y_mean") + F.col("band_width"))
    header = F.col("kind") == "header"
    at = at.select("doc_id", "key", "band", "line_height", "y_mean", header.alias("header"), F.when(header, above).otherwise(below).alias("out"), F.when(header, below).otherwise(above).alias("in"))
    gap = F.when(F.col("header"), F.array_min("in") - F.col("y_mean")).otherwise(F.col("y_mean") - F.array_max("in"))
    page_facts = at.select("doc_id", "key", "band", "line_height", F.size("out").alias("outside"), F.coalesce(gap, F.lit(float("inf"))).alias("gap"))
    good = page_facts.groupBy("doc_id", "key", "band", "line_height").agg((F.avg((F.col("outside") <= 1).cast("double")) >= 0.8).alias("conform"), upper_median("gap").alias("gap")).where(F.col("conform") & (F.col("gap") >= F.coalesce("line_height", F.lit(0.0)) * GAP_LINES))
    met = rec.join(good.select("doc_id", "key", "band", F.lit(True).alias("__good")).hint("merge"), ["doc_id", "key", "band"], "left")
    return met.withColumn("kind", F.when(F.col("__good"), F.col("kind"))).drop("__good")


def _within(rec: DataFrame) -> DataFrame:
    """(doc_id, key, band, kind, y_mean, y_sd) of the bands that a document's budget takes: a fold that skips
    what does not fit, over a document's few candidates, those farthest from the middle first."""
    order = F.struct((-F.abs(F.col("y_mean") - F.col("page_height") / 2)).alias("far"), "key", "band", F.col("n").cast("int").alias("n"), "kind", "y_mean", "y_sd")
    folded = rec.where("kind IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("c"), F.first("n_lines").alias("n_lines"))
    taken = folded.select("doc_id", F.explode(within_budget(F.col("c"), F.floor(F.col("n_lines") * BUDGET).cast("int"))).alias("t"))
    return taken.select("doc_id", *[F.col(f"t.{c}").alias(c) for c in ("key", "band", "kind", "y_mean", "y_sd")])


def detect_noise(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with noise: `header`, `footer` or null.

    A band of a recurring key on enough pages is one when it does not wander, lies beyond the 5th or
    95th percentile of y, and has a gap to the body and at most one line outside on most pages. Bands
    farthest from the middle are taken while their lines fit the budget; one that does not fit is
    passed over. Documents of fewer than three pages have none.
    """
    height = F.col("y1") - F.col("y0")
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    facts = [F.max(of("header", "y_mean")).alias("__high"), F.min(of("footer", "y_mean")).alias("__low"), (F.max("y_sd") * 3).alias("__sd")]
    chosen = _within(_recurring(_keyed(lines), pages)).groupBy("doc_id").agg(F.collect_list(F.struct("key", "kind", "y_mean", "y_sd")).alias("__bands"), *facts)
    slack = F.when(height > 0, height).otherwise(12.0)
    near = lambda b: F.abs(F.col("y0") - b["y_mean"]) <= F.greatest(b["y_sd"] * 3, slack)
    # Most lines lie between a page's headers and footers, and no key is made of them.
    far = F.greatest("__sd", slack)
    edge = (F.col("y0") <= F.col("__high") + far) | (F.col("y0") >= F.col("__low") - far)
    met = lines.join(chosen.hint("shuffle_hash"), "doc_id", "left").withColumn("__key", F.when(edge, T.line_key(F.col("text"))))
    hits = F.filter("__bands", lambda b: (b["key"] == F.col("__key")) & near(b))
    return met.select(*lines.columns, F.when(F.col("__key").isNotNull(), F.array_min(F.transform(hits, lambda b: b["kind"]))).alias("noise"))


def recurrence_report(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, place, key, n, pages, y_mean, y_sd, kind, verdict) of all recurring bands, numbered by place
    in each document: the most frequent first, equal ones by key. verdict is `noise`, `body`, or `over
    budget` for a band that would have been noise, of which a reader should be warned."""
    rec = shared.saved(_recurring(_keyed(lines), pages), "recurring")
    taken = _within(rec).select("doc_id", "key", "band", F.lit("noise").alias("__taken")).hint("merge")
    verdict = F.when(F.col("kind").isNull(), "body").otherwise(F.coalesce("__taken", F.lit("over budget")))
    order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "key", "band")
    met = rec.join(taken, ["doc_id", "key", "band"], "left").withColumns({"verdict": verdict, "place": F.row_number().over(order)})
    return met.select("doc_id", "place", "key", "n", "pages", "y_mean", "y_sd", "kind", "verdict")


def longest_chain(numbers: list[int], step: int = STEP) -> list[int]:
    """Positions of the longest rising chain whose steps are 1 to `step`; the earliest end and the
    earliest predecessors win. For each number only its best end so far is kept, so a position looks
    at `step` numbers whatever came before it."""
    best: dict[int, tuple[int, int]] = {}  # number: (length, -position) of the best chain that ends with it
    back: list[int] = []
    last = (0, 0)
    for i, n in enumerate(numbers):
        length, before = max((best[m] for m in range(n - step, n) if m in best), default=(0, 1))
        back.append(-before)
        end = (length + 1, -i)
        best[n] = max(best.get(n, end), end)
        last = max(last, end)
    out, at = [], -last[1] if last[0] else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def split_options(texts: list[str], letters: list[str | None], rests: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """(statement, options) of a question's lines after its anchor: only the next expected letter opens
    an option, every other line goes on with what is open."""
    statement: list[str] = []
    options: list[tuple[str, list[str]]] = []
    for text, mark, rest in zip(texts, letters, rests, strict=True):
        if mark == chr(65 + len(options)):
            options.append((mark, [rest]))
        else:
            (options[-1][1] if options else statement).append(text)
    join = lambda parts: " ".join(p for p in parts if p).strip()
    return join(statement), [(mark, join(parts)) for mark, parts in options]


QUESTIONS = "doc_id long, number int, statement string, options array<struct<letter:string,text:string>>, first_page int, last_page int, confidence double, remarks array<string>"


def _gutters(col: np.ndarray, x0: np.ndarray) -> dict[int, float]:
    """The most frequent left edge of markers in each column, edges within the tolerance counted
    together under the first of them."""
    out = {}
    for c in np.unique(col):
        xs, first, counts = np.unique(x0[col == c], return_index=True, return_counts=True)
        edges: dict[float, int] = {}
        for k in np.argsort(first):
            x = round(float(xs[k]), 1)
            edge = next((e for e in edges if abs(e - x) <= GUTTER), x)
            edges[edge] = edges.get(edge, 0) + int(counts[k])
        out[int(c)] = max(edges, key=edges.get)
    return out


def _at_gutters(col: np.ndarray, x0: np.ndarray, marked: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The markers that count: where enough are strong, weak ones do not, and each stands at its column's gutter.
    A column without markers keeps the others' indent. Numbers and letters each have a census of their own."""
    counts = marked & strong if (marked & strong).sum() >= STRONG else marked
    gutters = _gutters(col[counts], x0[counts])
    if gutters:
        start = {int(c): float(np.fmin.reduce(x0[col == c])) for c in np.unique(col)}
        c0 = min(gutters)
        for c in start:
            gutters.setdefault(c, start[c] + gutters[c0] - start[c0])
    place = x0.copy()
    for c, x in gutters.items():
        place[col == c] = x
    return counts & (np.abs(x0 - place) <= GUTTER)


def segment(lines: DataFrame) -> DataFrame:
    """QUESTIONS from lines without noise; one group is one document.

    Numbers at their column's gutter that make the longest chain open questions; with five strong
    numbers or more, weak ones do not count, and so with letters. Confidence falls for missing or odd
    options, letters out of order, a short statement, many pages and empty options, each with a remark;
    then for a number of options that differs from what most questions of the document have.
    """
    return _segmented(lines, False)


def segment_warnings(lines: DataFrame) -> DataFrame:
    """(doc_id, warning, before, after) of whole documents: `no questions` where no chain of numbers
    was found, `jump` between two numbers that are not neighbours, and `late start` where the first
    number is not 1. Documents without lines are not seen."""
    return _segmented(lines, True)


WARNINGS = "doc_id long, warning string, before int, after int"


def _segmented(lines: DataFrame, warnings: bool) -> DataFrame:
    shared.ship(lines.sparkSession)
    first, others = F.col("first_fragment"), F.col("others")
    told = lines.withColumn("plain", T.plain_line(first, others))
    marked = told.withColumns({"num": F.when(~F.col("plain"), T.number_marker(first, others)), "let": F.when(~F.col("plain"), T.letter_marker(first, others))})
    # Markers of plain lines are told with the document, since few of their first fragments are distinct.
    sent = [F.when(F.col("plain"), F.coalesce(first, F.lit(""))).alias("first"), F.when(F.col("plain"), others).alias("others"), F.col("text")]
    odd = [F.col("num.value").alias("number"), F.col("num.rest").alias("number_rest"), F.col("num.strong").alias("number_strong"), F.upper("let.value").alias("letter"), F.col("let.rest").alias("letter_rest"), F.col("let.strong").alias("letter_strong")]
    if warnings:  # they follow from the numbers alone: texts and letters are neither made nor sent
        none = F.lit(None).cast("string")
        sent[1:] = [none.alias("others"), none.alias("text")]
        odd[1], odd[3:] = none.alias("number_rest"), [none.alias("letter"), none.alias("letter_rest"), F.lit(None).cast("boolean").alias("letter_strong")]
    rows = marked.select("doc_id", "page", "col", "seq", "x0", *sent, *odd)
    return rows.groupBy("doc_id").applyInArrow(_warned if warnings else _questions, WARNINGS if warnings else QUESTIONS)


_INT, _STRING = pa.int32(), pa.string()


def _sorted(doc: pa.Table) -> pa.Table:
    """A document's lines from the top of its first page."""
    last = 2**62
    keys = [doc[c].cast("int64").fill_null(last).to_numpy() for c in ("seq", "col", "page")]
    order = np.lexsort(keys)
    return doc if (np.diff(order) == 1).all() else doc.take(pa.array(order))


def _markers(doc: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(value, strong, rest of the first fragment) of each line's marker, those of plain lines told once for each
    distinct first fragment. A number is 0 or more and a letter from 1, -1 is none."""
    firsts = doc["first"].combine_chunks().dictionary_encode()
    found = [T.plain_marker(kind, x) for x in firsts.dictionary.to_pylist()]
    of = (lambda v: int(v)) if kind == "number" else (lambda v: ord(v.upper()) - 64)
    at = firsts.indices.fill_null(len(found)).to_numpy()
    value = np.array([-1 if m is None else of(m[0]) for m in found] + [-1], dtype=np.int64)[at]
    strong = np.array([m is not None and m[2] for m in found] + [False])[at]
    rest = pa.array(["" if m is None else m[1] for m in found] + [None], _STRING).take(pa.array(at))
    odd = doc[kind].combine_chunks()
    if odd.null_count < len(odd):
        here = odd.is_valid().to_numpy(zero_copy_only=False)
        value[here] = [of(v) if kind == "letter" or len(v) <= 9 else -1 for v in odd.drop_null().to_pylist()]
        strong = np.where(here, doc[f"{kind}_strong"].fill_null(False).to_numpy(), strong)
    return value, strong, rest


def _anchors(doc: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(line of each question's number, the numbers of all lines, rests of their first fragments)."""
    number, strong, rest = _markers(doc, "number")
    x0 = doc["x0"].cast("double").to_numpy()
    at = np.flatnonzero(_at_gutters(_columns(doc), x0, number >= 0, strong))
    steps = np.diff(number[at])
    whole = ((steps >= 1) & (steps <= STEP)).all()  # a rising chain as it stands
    return (at if whole else at[longest_chain(number[at].tolist())].astype(np.int64)), number, rest


def _columns(doc: pa.Table) -> np.ndarray:
    return doc["col"].cast("int64").fill_null(-1).to_numpy()


def _warned(doc: pa.Table) -> pa.Table:
    doc = _sorted(doc)
    anchors, numbers, _ = _anchors(doc)
    told = numbers[anchors].tolist()
    found = [] if told else [("no questions", None, None)]
    if told and told[0] != 1:
        found.append(("late start", None, told[0]))
    found += [("jump", a, b) for a, b in zip(told, told[1:], strict=False) if b != a + 1]
    names, before, after = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"doc_id": _repeated(doc, len(found)), "warning": pa.array(names, _STRING), "before": pa.array(before, _INT), "after": pa.array(after, _INT)})


def _repeated(doc: pa.Table, n: int) -> pa.Array:
    return pa.array([doc["doc_id"][0].as_py()] * n, pa.int64())


def _joined(parts: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Of each range of parts, those that are not empty with a space between, trimmed."""
    sizes = pc.binary_length(parts).fill_null(0).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(sizes)
    offsets = np.searchsorted(kept, np.append(first, len(parts)))
    ends = np.searchsorted(kept, last)
    # The ranges do not overlap; what lies between two of them gets a list of its own.
    bounds = np.stack([offsets[:-1], ends], axis=1).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.append(bounds, len(kept)), pa.int32()), parts.take(pa.array(kept)))
    return pc.utf8_trim_whitespace(pc.binary_join(lists, " ")).take(pa.array(np.arange(len(first)) * 2))


def _rests(doc: pa.Table, kind: str, rest: pa.Array, at: np.ndarray) -> pa.Array:
    """What follows the markers of some lines."""
    lines = pa.array(at)
    plain = pc.ascii_trim(pc.binary_join_element_wise(rest.take(lines).fill_null(""), doc["others"].combine_chunks().take(lines).fill_null(""), " "), " ")
    odd = doc[f"{kind}_rest"].combine_chunks().take(lines)
    return pc.if_else(doc["first"].combine_chunks().take(lines).is_valid(), plain, odd.fill_null(""))


def _questions(doc: pa.Table) -> pa.Table:
    """QUESTIONS of one document. Options are told letter by letter for all questions at once: each opens at the
    first line of its letter after the one before, every other line goes on with what is open."""
    doc = _sorted(doc)
    anchors, numbers, number_rest = _anchors(doc)
    letters, strong, letter_rest = _markers(doc, "letter")
    fits = _at_gutters(_columns(doc), doc["x0"].cast("double").to_numpy(), letters > 0, strong)
    fits[anchors] = False
    n, rows = len(anchors), doc.num_rows
    end = np.append(anchors[1:], rows)[:n]
    count, at, opened = np.zeros(n, dtype=np.int64), anchors, []
    for k in range(1, 6):
        these = np.append(np.flatnonzero(fits & (letters == k)), rows)
        after = these[np.searchsorted(these, at, side="right")]
        go = (count == k - 1) & (after < end)
        at = np.where(go, after, at)
        count += go
        opened.append(np.where(go, after, -1))
    options = np.sort(np.concatenate([x[x >= 0] for x in opened])) if n else np.zeros(0, dtype=np.int64)
    starts = np.sort(np.append(anchors, options))
    stop = np.append(starts[1:], rows)[: len(starts)]
    # An option's own line stands as its rest, a number's line is no part of what follows it.
    texts = doc["text"].combine_chunks()
    if len(options):
        mine = np.zeros(rows, dtype=bool)
        mine[options] = True
        texts = pc.replace_with_mask(texts, pa.array(mine), _rests(doc, "letter", letter_rest, options))
    is_option = np.isin(starts, options)
    more = _joined(texts, starts + ~is_option, stop)
    of_options = more.filter(pa.array(is_option))
    begun, more = _rests(doc, "number", number_rest, anchors), more.filter(pa.array(~is_option))
    between = pc.if_else(pc.and_(pc.greater(pc.binary_length(begun), 0), pc.greater(pc.binary_length(more), 0)), " ", "")
    statement = pc.binary_join_element_wise(begun, between, more, "")
    page = doc["page"].cast("int64").to_numpy()
    first_page, last_page = page[anchors], page[end - 1]
    offsets = np.append(0, np.cumsum(count))
    short = np.append(0, np.cumsum(pc.utf8_length(of_options).to_numpy(zero_copy_only=False) < 2))
    flags = [count == 0, (count > 0) & ~np.isin(count, (4, 5)), np.zeros(n, dtype=bool), pc.utf8_length(statement).to_numpy(zero_copy_only=False) < 30, last_page - first_page + 1 > 3, short[offsets[1:]] > short[offsets[:-1]]]
    counts = count.tolist()
    mode = max(dict.fromkeys(counts), key=counts.count) if counts else 0
    common = n >= 3 and mode > 0 and counts.count(mode) >= 0.6 * n
    code = sum(f.astype(np.int64) << k for k, f in enumerate([*flags, common & (count != mode)]))
    kinds, which = np.unique(code, return_inverse=True)
    judged = [_judged([bool(c >> k & 1) for k in range(7)]) for c in kinds.tolist()]
    letter = (np.arange(len(options)) - offsets[:-1].repeat(count)).tolist()
    pairs = pa.StructArray.from_arrays([pa.array(["ABCDE"[k] for k in letter], _STRING), of_options], names=["letter", "text"])
    return pa.table(
        {
            "doc_id": _repeated(doc, n),
            "number": pa.array(numbers[anchors], _INT),
            "statement": statement,
            "options": pa.ListArray.from_arrays(pa.array(offsets, _INT), pairs),
            "first_page": pa.array(first_page, _INT),
            "last_page": pa.array(last_page, _INT),
            "confidence": pa.array([c for c, _ in judged], pa.float64()).take(pa.array(which)),
            "remarks": pa.array([w for _, w in judged], pa.list_(_STRING)).take(pa.array(which)),
        }
    )


def _judged(flags: list[bool]) -> tuple[float, list[str]]:
    """(confidence, remarks) of a question with these faults; the last is a number of options that most questions of
    the document do not have, which counts where no other remark is on options."""
    loss, remarks = _loss(flags[:6])
    confidence = max(0.0, min(1.0, round(1.0 - loss, 3)))
    if flags[6] and not any("option" in w for w in remarks):
        return max(0.0, round(confidence - 0.35, 3)), [*remarks, "options differ from the document's"]
    return confidence, remarks


_FAULTS = ((0.6, "no options"), (0.3, "unusual number of options"), (0.2, "option letters out of order"), (0.25, "short statement"), (0.1, "spans many pages"), (0.2, "empty option"))


def _loss(flags: list[bool]) -> tuple[float, list[str]]:
    found = [x for x, bad in zip(_FAULTS, flags, strict=True) if bad]
    return sum(f for f, _ in found), [w for _, w in found]


def losses(statement: str, options: list[tuple[str, str]], pages: int) -> tuple[float, list[str]]:
    """(loss of confidence, remarks) of one question."""
    in_order = all(mark == chr(65 + k) for k, (mark, _) in enumerate(options))
    return _loss([not options, bool(options) and len(options) not in (4, 5), not in_order, len(statement) < 30, pages > 3, any(len(t) < 2 for _, t in options)])
