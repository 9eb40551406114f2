"""Read models of a question bank: topic trees, eligibility, queues, paging, counts."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topic_reach(topics: DataFrame, links: DataFrame) -> DataFrame:
    """(topic, item) by direct links and by those of direct children; one level, each pair once.
    topics(id, parent), links(item, topic)."""
    direct = links.select("topic", "item")
    child = topics.where(F.col("parent").isNotNull()).select(F.col("id").alias("child"), "parent")
    inherited = links.join(child, F.col("topic") == F.col("child")).select(F.col("parent").alias("topic"), "item")
    return direct.union(inherited).distinct()


def topic_counts(topics: DataFrame, links: DataFrame, eligible: DataFrame) -> DataFrame:
    """(id, total, available) of every topic with items, its own and its children's.
    eligible(item)."""
    reach = topic_reach(topics, links).join(eligible.select(F.col("item").alias("usable")).distinct(), F.col("item") == F.col("usable"), "left")
    counts = reach.groupBy("topic").agg(F.countDistinct("item").alias("total"), F.countDistinct(F.when(F.col("usable").isNotNull(), F.col("item"))).alias("available"))
    return topics.join(counts, F.col("id") == F.col("topic"), "left").select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("available", F.lit(0)).alias("available"))


def under_topic(items: DataFrame, topics: DataFrame, links: DataFrame, topic: int) -> DataFrame:
    """Items of a topic or of its direct children."""
    reach = topic_reach(topics, links).where(F.col("topic") == topic).select(F.col("item").alias("__item")).distinct()
    return items.join(reach, F.col("item") == F.col("__item"), "left_semi")


def untagged(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items that no topic reaches."""
    return items.join(links.select(F.col("item").alias("__item")).distinct(), F.col("item") == F.col("__item"), "left_anti")


def tree_order(topics: DataFrame) -> DataFrame:
    """Topics with each parent before its children, children by name."""
    return topics.orderBy(F.coalesce("parent", "id"), F.col("parent").isNotNull(), "name", "id")


def joined_letters(answers: DataFrame, key: str, letter: str) -> DataFrame:
    """(key, letters): distinct letters in order, joined by commas."""
    return answers.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(letter)), ",").alias("letters"))


def eligible(model: DataFrame) -> DataFrame:
    """Active items with a settled key of at least two options that no model only inferred. A null
    source is not eligible."""
    return model.where(F.col("active") & F.col("status").isin("valida", "multipla") & (F.col("options") >= 2) & (F.col("source") != "inferido_ml"))


def suggestion_queue(model: DataFrame) -> DataFrame:
    """Inferred keys that wait for a reader, the surest first."""
    rows = model.where(F.col("active") & (F.col("source") == "inferido_ml") & F.col("status").isin("valida", "multipla"))
    return rows.orderBy(F.col("confidence").desc_nulls_last(), "id")


def review_queue(model: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Items not reviewed whose confidence is missing or low, the worst first."""
    low = F.col("confidence").isNull() | (F.col("confidence") < threshold)
    return model.where(~F.col("reviewed") & F.col("active") & low).orderBy(F.col("confidence").asc_nulls_first(), "id")


def needs_review(remarks: Column, confidence: Column, threshold: float = 0.70) -> Column:
    """The importer's own rule: any remark, or low confidence with a missing one as zero."""
    return remarks.isNotNull() | (F.coalesce(confidence, F.lit(0.0)) < threshold)


def page(rows: DataFrame, order: list, number: int, size: int = 100) -> DataFrame:
    """The page of that number, from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def ineligible_reason(known: Column, active: Column, status: Column, options: Column, source: Column) -> Column:
    """Why a requested item cannot be used, null if it can."""
    return (
        F.when(known.isNull(), "unknown")
        .when(~active, "inactive")
        .when(~F.coalesce(status.isin("valida", "multipla"), F.lit(False)), "no key")
        .when(options < 2, "too few options")
        .when(source.eqNullSafe("inferido_ml"), "inferred key")
    )


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that stand more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_seen(rows: DataFrame, key: Column, order: list[Column], known: DataFrame | None = None) -> DataFrame:
    """The first row of each key by order, without keys that are known(key) already. Rows with a null
    key are kept. Each key's first row comes from a map-side minimum, so copies are not gathered, and
    the key is computed once."""
    names = rows.columns
    # Compare by order first; the row itself only rides along. Rows without a key get one of their own.
    packed = rows.select(key.alias("__key"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*names).alias("row")).alias("__row"))
    if known is not None:
        packed = packed.join(known.select(F.col("key").alias("__known")).distinct(), F.col("__key") == F.col("__known"), "left_anti")
    packed = packed.withColumn("__own", F.when(F.col("__key").isNull(), F.monotonically_increasing_id()))
    return packed.groupBy("__key", "__own").agg(F.min("__row").alias("__row")).select("__row.row.*")


def value_at(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, one column for each rank): the values that stand at given places, from 0, of a group's sorted
    values; a rank may use the group's size `n`. Equal values are counted before anything is shuffled.
    Ranges of values are counted apart, and a running sum inside one range, begun with the sum of those
    before it, finds the place: a group is neither gathered into one row nor sorted by one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    dealt = cut(counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()))
    of_key = Window.partitionBy(*keys)
    before = F.sum("__here").over(of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy(*keys, "__part").agg(F.sum("__c").alias("__here"))
    sizes = sizes.select(*keys, "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__here").over(of_key).alias("n"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = dealt.join(sizes.withColumnsRenamed({k: f"__{k}" for k in keys} | {"__part": "__at"}), [F.col("__part") == F.col("__at"), *on])
    up = F.col("__before") + F.sum("__c").over(Window.partitionBy("__part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    spread = met.select(*keys, value, "__c", up.alias("__up"), "n")
    here = lambda rank: (F.col("__up") - F.col("__c") <= rank) & (rank < F.col("__up"))
    return spread.groupBy(*keys).agg(*[F.min(F.when(here(rank), F.col(value))).alias(name) for name, rank in ranks.items()])


def unioned(parts: list[DataFrame]) -> DataFrame:
    """All rows of one or more tables of the same columns."""
    return reduce(DataFrame.unionByName, parts)


def cut(rows: DataFrame) -> DataFrame:
    """The rows in the shared folder that spark.checkpoint.dir names, without the plan that led to them.
    Where it is unset, a local master uses a folder of its own."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='itemforge-')}")
    return rows.checkpoint()
