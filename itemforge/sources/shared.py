"""The folder that all executors share, tables written to it, and the package's code for Python workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master has one made; any
    other master needs the setting."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _ROOTS:
        made = tempfile.mkdtemp(prefix="itemforge-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _ROOTS[sc.applicationId] = f"file://{made}"
    return _ROOTS[sc.applicationId]


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{root(spark)}/itemforge/{name}-{uuid.uuid4().hex[:12]}"


def saved(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """saved() rows and how many there are, counted while they are written."""
    seen = Observation(name)
    out = saved(rows.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    there = tempfile.mkdtemp(prefix="itemforge-code-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, there, ignore_errors=True)
    out = os.path.join(there, f"{package.name}-core.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
