"""Record ordinals without leaving the DataFrame API."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW = "_row"


def in_file_order(df: DataFrame, file: str, block: str, name: str = ROW) -> DataFrame:
    """Numbers the rows of a scan from 0 in the order of files by name, then of their
    blocks, then of rows within a block; drops the columns `file` (path) and `block` (start
    of a part of the file).

    Spark packs blocks into tasks by size, so the order of partitions is none of the
    files.  A block's rows stand together in one task, though: a row's place in its block
    is that in the task, less that of the block's first row.  There is a line for each
    block; blocks are as large as tasks, so the lines fit in one.
    """
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    blocks = marked.groupBy(F.col(file).alias("__f"), F.col(block).alias("__b")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    base = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__f", "__b")) - F.col("__n")
    starts = F.broadcast(blocks.select("__f", "__b", (base - F.col("__first")).alias("__shift")))  # a row for each block
    placed = marked.join(starts, (F.col(file) == F.col("__f")) & (F.col(block) == F.col("__b")))
    return placed.withColumn(name, F.col("__at") + F.col("__shift")).drop(file, block, "__at", "__f", "__b", "__shift")
