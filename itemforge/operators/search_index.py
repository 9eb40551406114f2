"""An inverted index of folded words, kept as files by the words' beginnings and kept up by appends.

A posting is (head, token, ids): head, the first two letters of a token, is a folder; inside, files are
sorted by token, so that a range of tokens reads few row groups. A common word has many postings of
bounded size, never one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import text as T

HEAD, BLOCK = 2, 1 << 16
_POSTINGS = "token string, ids array<long>, head string"


def _head(token: Column) -> Column:
    """The folder of a token: its first letters where these are plain, else one folder for all others."""
    start = F.substring(token, 1, HEAD)
    return F.when(start.rlike(f"^[a-z0-9]{{1,{HEAD}}}$"), start).otherwise("~")


def append(docs: DataFrame, path: str, id_column: str = "id", text_column: str = "text") -> None:
    """Adds documents with new ids to the index at a path; a first call makes it. Null texts have no words,
    null ids are not indexed. Other columns are not read."""
    folded = F.trim(T.tokens(F.coalesce(F.col(text_column).cast("string"), F.lit(""))))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.explode(F.array_distinct(F.split(folded, " "))).alias("token")).where("token <> ''")
    # Ids of one range of BLOCK share a posting, so a task's ids meet before the shuffle.
    lists = rows.groupBy("token", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    placed = lists.select("token", "block", "ids", _head(F.col("token")).alias("head"))
    dealt = placed.repartitionByRange("head", "token", "block").sortWithinPartitions("head", "token", "block")
    dealt.select("token", "ids", "head").write.mode("append").partitionBy("head").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POSTINGS).parquet(path)


def words(spark: SparkSession, query: str) -> list[list[str]]:
    """The folded words of each part of a query; a part with marks inside has several."""
    parts = query.replace('"', " ").split()
    if not parts:
        return []
    folded = spark.sql("SELECT 1").select(F.array(*[F.trim(T.tokens(F.lit(p))) for p in parts]).alias("w")).first().w
    return [w.split() for w in folded]


def _begins(head: Column, token: Column, word: str) -> Column:
    """Postings of tokens that begin with a word: conditions on the folder first, then a range of tokens."""
    plain = word[:HEAD].isascii() and word[:HEAD].isalnum()
    if not plain:
        folder = head == "~"
    elif len(word) >= HEAD:
        folder = head == word[:HEAD]
    else:  # a single letter begins all folders of it, and tokens whose second letter is not plain
        folder = head.startswith(word) | (head == "~")
    return folder & (token >= word) & token.startswith(word)


def candidates(index: DataFrame, query: list[list[str]]) -> DataFrame:
    """(id) of documents in which every word of a query begins some word."""
    flat = list(dict.fromkeys(w for part in query for w in part))
    if not flat:
        return index.select(F.lit(0).cast("long").alias("id")).limit(0)
    some = index.where(_any([_begins(F.col("head"), F.col("token"), w) for w in flat]))
    hit = F.filter(F.array(*[F.when(F.col("token").startswith(w), F.lit(k)) for k, w in enumerate(flat)]), lambda k: k.isNotNull())
    pairs = some.select(hit.alias("hits"), F.explode("ids").alias("id")).select("id", F.explode("hits").alias("hit"))
    return pairs.groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hit"))).alias("all")).where(F.col("all") == (1 << len(flat)) - 1).select("id")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def find(index: DataFrame, docs: DataFrame, query: str, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """docs that text.matches_all() finds, by the index: only documents in which all words begin some word
    are read on, and compared where a part of the query is a phrase. A query without words, or with more
    than 62, is refused: the first finds nothing, the second raises. Rows without an id are never found."""
    parts = words(docs.sparkSession, query)
    if sum(map(len, parts)) > 62:
        raise ValueError("a query has 62 words at most")
    if not parts or not all(parts):  # a part of nothing but marks: every text with a word has it
        parts = [p for p in parts if p]
        if not parts:
            return docs.where(F.col(id_column).isNotNull() & T.matches_all(F.col(text_column), query))
    met = docs.join(candidates(index, parts).select(F.col("id").alias("__found")), F.col(id_column) == F.col("__found"), "left_semi")
    phrase = any(len(p) > 1 for p in parts)
    return met.where(T.matches_all(F.col(text_column), query)) if phrase else met


def absent(docs: DataFrame, spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    """docs whose ids the index at a path does not have, to append them."""
    try:
        known = open_index(spark, path).select(F.explode("ids").alias("__id")).distinct()
        known.schema  # noqa: B018 - a missing path raises here
    except AnalysisException:
        return docs
    return docs.join(known, F.col(id_column) == F.col("__id"), "left_anti")
