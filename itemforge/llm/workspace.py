"""The shared folder of a job, its written tables, and the library's code for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators import known_hashes

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_FOLDERS: dict[str, SparkSession] = {}
_HERE = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one is made for a local
    master; any other master needs the setting, since executors can't see the driver's folders."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _ROOTS:
        _ROOTS[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='itemforge-')}"
        sc.setCheckpointDir(_ROOTS[sc.applicationId])
    return _ROOTS[sc.applicationId]


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder. It goes when the driver's session ends in good order, or
    with the stage that it was made in."""
    path = f"{shared_root(spark)}/itemforge/{name}-{uuid.uuid4().hex[:12]}"
    _FOLDERS[path] = spark
    if (stage := getattr(_HERE, "stage", None)) is not None:
        stage.append(path)
    return path


class Folders:
    """The folders of one pipeline, by stage; other pipelines' folders are not touched."""

    def __init__(self) -> None:
        self.of: dict[str, list[str]] = {}

    @contextmanager
    def stage(self, name: str):
        """Within it, new folders of this thread's job belong to the stage."""
        outer = getattr(_HERE, "stage", None)
        _HERE.stage = self.of.setdefault(name, [])
        try:
            yield
        finally:
            _HERE.stage = outer

    def drop(self, *names: str) -> None:
        """Removes the folders of stages whose rows nobody reads any more."""
        for name in names:
            for path in self.of.pop(name, ()):
                _remove(_FOLDERS.pop(path), path)


@atexit.register
def _clear() -> None:
    for path, spark in _FOLDERS.items():
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM is gone already; the folder belongs to the cluster's clean-up
        return


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: a cut of the lineage that outlives
    executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def locator(docs: DataFrame) -> Column:
    """Where a row of a table of files lies: its file and its place in it."""
    at = docs.metadataColumn("_metadata")
    return F.concat_ws("#", at.getField("file_path"), at.getField("row_index").cast("string"))


def located(docs: DataFrame) -> DataFrame:
    """The table itself if its rows lie in Parquet files, which give each row a locator, else a
    written copy of it."""
    try:
        docs.select(locator(docs))
    except AnalysisException:
        return saved(docs, "landed")
    return docs


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """A located table's rows but those whose locators are gone(locator, written before); all columns kept.
    A filter of the locators, of bounded size, is tested while the table is scanned: rows that it does
    not know go on from there, and only those that it may know are shuffled to be told exactly."""
    key = max(docs.columns, key=len) + "_at"  # longer than any column's name
    blocks = known_hashes.blocks_for(gone.count())
    known = saved(known_hashes.build(gone, "locator", blocks), "gone-filter")
    name = f"{key}_maybe"
    tested = known_hashes.maybe_known(docs.withColumn(key, locator(docs)), known, key, blocks, name=name)
    some = tested.where(F.col(f"`{name}`")).join(gone.select(F.col("locator").alias(f"{key}_gone")), F.col(f"`{key}`") == F.col(f"`{key}_gone`"), "left_anti")
    return tested.where(~F.col(f"`{name}`")).union(some).drop(key, name)


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers once for each application. Unless the session says how
    many rows an Arrow batch has, it is a thousand from now on, since texts can be long."""
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, None) is None:
        spark.conf.set(rows, "1000")
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        there = tempfile.mkdtemp(prefix="itemforge-code-")  # on the driver, which serves it to the executors
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        out = os.path.join(there, f"{package.name}.zip")
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, str(f.relative_to(package.parent)))
        sc.addPyFile(out)
        _SHIPPED.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def some(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, chosen by a hash of their key. A threshold for the hash cuts the table down to
    little more than n first, so that no task sorts more than its share of them."""
    total = rows.count()
    if total <= n:
        return rows
    share = F.pmod(F.xxhash64(F.lit("some"), key), F.lit(1 << 32)) / float(1 << 32)
    return rows.where(share < (n + 5 * n**0.5 + 20) / total).orderBy(F.xxhash64(F.lit("some"), key), key).limit(n)
