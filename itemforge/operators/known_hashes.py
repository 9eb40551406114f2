"""A Bloom filter of the bank's hashes, kept as a table and tested while a batch is scanned.

The filter is cut into blocks of 4096 bits; a hash names one block and some bits in it, so one equality
join with the blocks tests it. Only rows that pass are compared with the hashes themselves: a small batch
does not shuffle the bank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.sources import shared

WORDS, WORD = 64, 64


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")


def _bits(key: Column, bits: int) -> list[Column]:
    """Places of a hash's bits in its block."""
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(WORDS * WORD)).cast("int") for k in range(bits)]


def build(hashes: DataFrame, column: str = "hash", blocks: int = 1024, bits: int = 6) -> DataFrame:
    """(block, words) of the filter of a column's values. Bits are set by map-side aggregates, so a hash
    that stands often costs no more. About 400 hashes a block give one false hit in a hundred."""
    key = F.col(column)
    each = hashes.where(key.isNotNull()).select(_block(key, blocks).alias("block"), F.explode(F.array(*_bits(key, bits))).alias("bit"))
    words = each.groupBy("block", F.floor(F.col("bit") / WORD).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % WORD)).alias("set"))
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "set")))
    full = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.try_element_at(F.col("__map"), k), F.lit(0).cast("long")))
    return words.groupBy("block").agg(by_word.alias("__map")).select("block", full.alias("words"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One filter of two of the same number of blocks: appends do not read the bank again."""
    both = old.withColumnRenamed("words", "a").join(new.withColumnRenamed("words", "b"), "block", "full_outer")
    none = F.array_repeat(F.lit(0).cast("long"), WORDS)
    return both.select("block", F.zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda x, y: x.bitwiseOR(y)).alias("words"))


def blocks_for(n: int, most: int = 1 << 14) -> int:
    """Blocks for n hashes: some 400 each, and no more than `most`, which bounds the filter to 8 MB; beyond
    that false hits grow more, and nothing else."""
    return max(1, min(most, -(-n // 400)))


def maybe_known(rows: DataFrame, filter_rows: DataFrame, column: str = "hash", blocks: int = 1024, bits: int = 6, name: str = "maybe") -> DataFrame:
    """rows with a column `name`: false means that the value is not among the filter's. The filter has at
    most `blocks` rows of half a kilobyte, which bounds what is sent to every task. Columns of rows may
    have any names that do not begin with `name`."""
    key, block, words = F.col(f"`{column}`"), f"{name}_block", f"{name}_words"
    sent = F.broadcast(filter_rows.select(F.col("block").alias(f"{name}_of"), F.col("words").alias(words)))
    met = rows.withColumn(block, _block(key, blocks)).join(sent, F.col(f"`{block}`") == F.col(f"`{name}_of`"), "left")
    hit = F.lit(True)
    for bit in _bits(key, bits):
        hit = hit & (F.getbit(F.element_at(F.col(f"`{words}`"), (bit / WORD).cast("int") + 1), bit % WORD) == 1)
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).drop(block, f"{name}_of", words)


def unknown(rows: DataFrame, filter_rows: DataFrame, known: DataFrame, column: str = "hash", blocks: int = 1024, bits: int = 6) -> DataFrame:
    """rows whose value known(hash) has not, nulls too. Rows that the filter refuses go on as they are; the
    values of the others, few if the batch is, are written once and met with the bank where Spark sees
    how small they are."""
    tested = shared.saved(maybe_known(rows, filter_rows, column, blocks, bits), "tested")
    hits = shared.saved(tested.where("maybe").select(F.col(column).alias("hash")).distinct(), "hits")
    there = known.select("hash").join(hits, "hash", "left_semi").distinct()
    return tested.join(there.withColumnRenamed("hash", "__known"), F.col(column) == F.col("__known"), "left_anti").drop("maybe")
