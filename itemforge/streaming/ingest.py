"""Incremental ingest of question files, an extension: each content is taken in once, also after a restart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from itemforge.functions import text as T
from itemforge.operators import relational
from itemforge.plans import assembly
from itemforge.sources import shared

#: Fragments with the size of their page.
PAGED = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, italic boolean, width double, height double"
_KEPT = {"questions": "doc_id long, number int, statement string, options array<struct<letter:string,text:string>>, confidence double, hash string, batch long", "statuses": "doc_id long, status string, error string, digest string, batch long"}


def ingest(spark: SparkSession, path: str, schema: StructType | str, text_column: str, out: str, checkpoint: str, delay: str | None = None, time_column: str | None = None):
    """Streams Parquet files of a folder to another, without rows whose normalised text was taken in
    before; state expires only with a delay on a time column. Ends when all files are read."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("content_hash", T.content_hash(F.col(text_column)))
    if delay and time_column:
        rows = rows.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["content_hash"])
    else:
        rows = rows.dropDuplicates(["content_hash"])
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def stored(spark: SparkSession, out: str, table: str, before: int | None = None) -> DataFrame:
    """What import_stream() has put under a path, or what its batches before one have."""
    try:
        rows = spark.read.schema(_KEPT[table]).option("basePath", f"{out}/{table}").parquet(f"{out}/{table}")
    except AnalysisException:
        rows = spark.createDataFrame([], _KEPT[table])
    return rows if before is None else rows.where(F.col("batch") < before)


def import_stream(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 100):
    """Imports the documents of PAGED Parquet files as they come to a folder, and ends when all are read.

    Each batch goes through assembly.Import. Its new questions and the status of each document, `known`
    for one whose fragments an earlier batch had, are a folder of the batch's number. A batch that is
    run again after a failure writes its folder anew and looks at earlier batches only, so a restart
    stores each question once. Of equal questions the first batch's is kept, in it the one of the
    least document and number. A document must be whole in one file.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = shared.saved(batch, "stream-batch")
        each = F.xxhash64("page", "x0", "y0", "x1", "y1", "text").cast("decimal(38,0)")
        digests = batch.groupBy("doc_id").agg(F.concat_ws("-", F.count("*"), F.sum(each).cast("string")).alias("digest"))
        known = stored(spark, out, "statuses", number).select(F.col("digest").alias("__seen")).distinct()
        met = relational.cut(digests.join(known, F.col("digest") == F.col("__seen"), "left"))
        fresh = batch.join(met.where("__seen IS NULL").select("doc_id"), "doc_id", "left_semi")
        job, found = assembly.Import(), None
        try:
            found = job.run(fresh.drop("width", "height"), fresh.select("doc_id", "page", "width", "height").distinct(), stored(spark, out, "questions", number).select("hash"))
        except assembly.ImportFailure:
            pass  # every document of the batch is refused, which its statuses say
        if found is not None:
            kept = found.where("outcome = 'recorded'").select("doc_id", "number", "statement", "options", "confidence", "hash")
            kept.write.mode("overwrite").parquet(f"{out}/questions/batch={number}")
        old = F.when(F.col("__seen").isNotNull(), F.lit("known"))
        rows = met.join(job.statuses, "doc_id", "left").select("doc_id", F.coalesce(old, "status").alias("status"), "error", "digest")
        rows.write.mode("overwrite").parquet(f"{out}/statuses/batch={number}")

    source = spark.readStream.schema(PAGED).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, batch or stream, with late rows up to a delay."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
