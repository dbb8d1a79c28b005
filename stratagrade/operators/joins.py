"""Joins in which null keys meet, and ranks within keys of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Like join() on key names, but a null equals a null; the keys are the left ones."""
    other = right.withColumnsRenamed({k: f"__same_{i}" for i, k in enumerate(keys)})
    equal: Column = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__same_{i}")) for i, k in enumerate(keys)])
    return left.join(other, equal, how).drop(*[f"__same_{i}" for i in range(len(keys))])


def rank_within(rows: DataFrame, keys: list[str], order: str, name: str, cells: int = 4096) -> DataFrame:
    """Numbers the rows of each key from 0 by `order`, whole numbers that differ.  The
    order's range is cut into cells, so that a task orders a cell of a key and not all
    of a hot key's rows."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    width = (high - low) // cells + 1
    cut = rows.withColumn("__cell", F.floor((F.col(order).cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long"))
    counts = cut.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    base = counts.select(*keys, "__cell", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__cell")) - F.col("__n")).alias("__base"))
    at = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(order)) - 1
    return join_same(cut.withColumn("__at", at), base, [*keys, "__cell"]).withColumn(name, F.col("__base") + F.col("__at")).drop("__cell", "__base", "__at")
