"""Exact token counts from a histogram of encoded lengths.

Documents are reduced to (length, documents) on the map side, so only the histogram
is shuffled.  Sums over all longer documents (suffix sums) then answer, for every
context limit, how many documents reach it, how many tokens they hold and how many
remain if all are truncated to it; quantiles come from the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import map_arrow, materialize
from .encoding import encoder
from .textvec import chunks


def _histogram(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held = encoder(tokenizer), {}
        for batch in batches:
            for texts in chunks(batch.column(0)):
                for n, k in zip(*np.unique(tool.lengths(texts), return_counts=True), strict=True):
                    held[int(n)] = held.get(int(n), 0) + int(k)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["length", "docs"])

    return run


def length_histogram(docs: DataFrame, *, tokenizer: str) -> DataFrame:
    """docs(text, ...) -> length, docs: one row for each encoded length that occurs.

    Texts are whole, however long: a very long one is a block by itself in its task.
    A null text is empty and has length 0; repeated rows count each; an empty table
    gives an empty histogram; other columns are ignored.
    """
    return map_arrow(docs.select("text"), _histogram(tokenizer), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame, block: int = 128) -> DataFrame:
    """Adds to each length: tokens, docs_reaching and tokens_reaching (of documents at
    least that long), truncated_tokens (of all documents cut to that length) and
    quantile (the share of documents up to that length).

    Lengths are summed within blocks of `block` lengths and the blocks among
    themselves, so no task holds the whole range.
    """
    h = materialize(histogram, "lengths").withColumn("tokens", F.col("length") * F.col("docs")).withColumn("_block", F.floor(F.col("length") / block))
    blocks = h.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    longer = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("_d", longer, "_dl"), ("_t", longer, "_tl"), ("_t", shorter, "_ts"), ("_d", shorter, "_ds"))])
    down = Window.partitionBy("_block").orderBy(F.col("length").desc())
    up = Window.partitionBy("_block").orderBy("length")
    h = h.join(blocks, "_block")
    h = h.withColumn("docs_reaching", F.col("_dl") + F.sum("docs").over(down)).withColumn("tokens_reaching", F.col("_tl") + F.sum("tokens").over(down))
    h = h.withColumn("_below", F.col("_ts") + F.sum("tokens").over(up) - F.col("tokens")).withColumn("_upto", F.col("_ds") + F.sum("docs").over(up))
    return h.select(
        "length",
        "docs",
        "tokens",
        "docs_reaching",
        "tokens_reaching",
        (F.col("_below") + F.col("length") * F.col("docs_reaching")).alias("truncated_tokens"),
        (F.col("_upto") / (F.col("_upto") - F.col("docs") + F.col("docs_reaching"))).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits from suffix_sums(): limit, docs_over (longer
    than it), total_tokens, truncated_tokens."""
    spark = table.sparkSession
    total = table.agg(F.coalesce(F.max("tokens_reaching"), F.lit(0)).alias("t")).first()
    wanted = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "limit long"))
    above = wanted.join(table.select("length", "docs_reaching", "tokens_reaching"), F.col("length") > F.col("limit"), "left")
    above = above.groupBy("limit").agg(F.min_by(F.struct("docs_reaching", "tokens_reaching"), "length").alias("next"))  # the sums at the next length
    over, held = F.coalesce("next.docs_reaching", F.lit(0)), F.coalesce("next.tokens_reaching", F.lit(0))
    return above.select("limit", over.alias("docs_over"), F.lit(int(total["t"])).cast("long").alias("total_tokens"), (F.lit(int(total["t"])) - held + F.col("limit") * over).cast("long").alias("truncated_tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that the given share of documents does not exceed."""
    wanted = F.broadcast(table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return wanted.join(table.select("length", "quantile"), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
