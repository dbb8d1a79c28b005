"""Reliable intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset on one machine, a
    temporary folder of this process.  On a cluster it must be set, as executors do not
    see each other's folders."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="stratagrade-")
        folder = _own
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/stratagrade/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation
    of what came before, and later plans see the table's true size.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    """In how many tasks a table is read, which follows its size."""
    return max(1, df.rdd.getNumPartitions())


def ship(spark: SparkSession) -> None:
    """Put this package at hand in the Python workers."""
    context = spark.sparkContext
    if not getattr(context, "_has_stratagrade", False):
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp()) / "stratagrade.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted((root / "stratagrade").rglob("*.py")):
                z.write(p, p.relative_to(root))
        context.addPyFile(str(archive))  # the driver serves it to the executors
        context._has_stratagrade = True


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow() with this package at hand in the Python workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
