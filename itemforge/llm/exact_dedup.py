"""Exact duplicates by a stateful stream over digests, built of Spark's own operators.

A streaming aggregation in RocksDB state, without watermark and so without expiry, holds for each
digest the greatest (id, locator) and the number of rows. Its changes go to a table, one folder for
each micro-batch. Texts whose digest is shared are then compared byte for byte, and no others are read
into a shuffle. A digest that stands for several texts is split by the texts themselves.

A caller's own folder keeps the state: a later call with the same folder reads only the files that
came since, and holds them against all that came before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import workspace
from itemforge.operators import known_hashes

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store would else reserve megabytes of the executor's disk for its first file, however few its rows.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_KINDS = "digest string, keep_id long, keep_locator string, group_size long"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(table: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return table.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), digest(text).alias("digest"), workspace.locator(table).alias("locator"))


def keep_state(seen: DataFrame, home: str, one_batch: bool = False) -> DataFrame:
    """(digest, keep_id, keep_locator, group_size) after a stream of seen(id, digest, locator) and all
    that the folder `home` holds from earlier calls. Memory holds no more than RocksDB's bounded
    cache; the state itself is on disk. `one_batch` says that the folder is new and the stream one
    micro-batch, so each digest has one row and need not be looked for again."""
    spark, out = seen.sparkSession, f"{home}/state"
    held = seen.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("stays"), F.count("*").alias("group_size"))

    def put(batch: DataFrame, number: int) -> None:
        batch.select("digest", F.col("stays.id").alias("keep_id"), F.col("stays.locator").alias("keep_locator"), "group_size").write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = held.writeStream.outputMode("update").option("checkpointLocation", f"{home}/stream").foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if one_batch and not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], _KINDS)
    table = spark.read.schema(f"{_KINDS}, batch int").option("basePath", out).parquet(out)
    if one_batch:
        return table.drop("batch")
    last = F.max(F.struct("batch", "keep_id", "keep_locator", "group_size")).alias("s")
    return table.groupBy("digest").agg(last).select("digest", "s.keep_id", "s.keep_locator", "s.group_size")


def _marks(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, locator) of rows(id, text, digest, locator). Full bytes are
    compared on hits: a filter of the digests that several rows share, of bounded size, is tested while
    the texts are scanned, and of those that it may know each task's different ones are shuffled once."""
    shared = workspace.saved(state.where("group_size > 1"), "dedup-shared")
    slim = rows.select("id", "digest", "locator").join(shared, "digest", "left")
    kept = F.col("keep_locator").isNull() | (F.col("locator") == F.col("keep_locator"))
    plain = slim.select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "digest", "locator")
    blocks = known_hashes.blocks_for(shared.count())
    hits = workspace.saved(known_hashes.build(shared, "digest", blocks), "dedup-filter")
    hit = known_hashes.maybe_known(rows.select("digest", "text"), hits, "digest", blocks).where("maybe")
    clash = hit.select("digest", "text").distinct().groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    clash = workspace.saved(clash, "dedup-clash")
    if not clash.isEmpty():
        # Different texts of one digest: the texts themselves are the groups. The stream's state
        # bounds none of this, yet only digests that clash come here.
        apart = rows.join(clash, "digest", "left_semi")
        best = apart.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("s"), F.count("*").alias("group_size"))
        again = apart.join(best, ["digest", "text"]).withColumn("keep_id", F.col("s.id")).withColumn("kept", F.col("locator") == F.col("s.locator"))
        plain = plain.join(clash, "digest", "left_anti").select("id", "keep_id", "group_size", "kept", "digest", "locator").union(again.select("id", "keep_id", "group_size", "kept", "digest", "locator"))
    return plain.withColumnRenamed("id", "doc_id")


def dedup_files(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, id_column: str = "doc_id", text_column: str = "text", home: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, locator) for every row of the Parquet files of a
    path, a folder or one file.

    Of equal texts the row with the greatest id stays; null and empty texts are equal, null ids are
    least. Of rows that repeat id and text, the one whose locator is last stays. Other columns are
    not read, an empty table gives no rows. Texts are equal when their bytes are: a digest only
    brings them together. With `home`, a folder that the executors share, the state lasts: a later
    call streams only the files that came to the path since, on top of the state of all others.
    """
    path = path.rstrip("/")
    table = spark.read.parquet(path).select(id_column, text_column)
    plain = spark.read.schema(table.schema).parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern the path may be a folder or a single file; a plain one must be a folder.
    seen = _rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_column, text_column, digest).drop("text")
    new = home or workspace.folder(spark, "dedup")
    return _marks(_rows(plain, id_column, text_column, digest), keep_state(seen, new, home is None and files_per_batch is None))


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one row of each text, all columns kept; which one stays, and what null and
    empty texts, null ids, repeated rows and empty tables give, is as in dedup_files().

    The stream reads a slim table of ids, digests and locators. A table that is no scan of Parquet
    files is landed first, so that its rows have locators.
    """
    spark, docs = docs.sparkSession, workspace.located(docs)
    rows = _rows(docs, id_column, text_column, digest)
    path = workspace.folder(spark, "dedup-rows")
    rows.drop("text").write.parquet(path)
    seen = spark.readStream.schema(rows.drop("text").schema).parquet(path)
    state = keep_state(seen, workspace.folder(spark, "dedup"), True)
    gone = workspace.saved(_marks(rows, state).where("not kept").select("locator"), "dropped")
    return workspace.without(docs, gone)
