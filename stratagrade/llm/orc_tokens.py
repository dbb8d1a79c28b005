"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters.

Documents are dealt by ranges of their id and sorted, so files and stripes hold
ranges of ids in ascending order: readers take stripes in parallel, and a look-up by
id prunes by the stripes' and row groups' statistics and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import map_arrow, materialize, new_path, partitions
from .encoding import encoder
from .textvec import chunks

LAYOUT = "doc_id long, before long, ids array<int>"


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, before = encoder(tokenizer), 0
        for batch in batches:
            for texts in chunks(batch.column(1)):
                ids, at = tool.encode(texts, end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(before + at[:-1]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))],
                    ["doc_id", "before", "ids"],
                )
                before += len(ids)

    return run


def write_orc(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, stripe_mb: int = 16, index_stride: int = 2000, fpp: float = 0.01) -> None:
    """docs(doc_id, text, ...) -> ORC files of (doc_id, before, ids) in ascending
    doc_id order; `before` counts the ids that stand before the document in its file.

    Nulls: a null text is empty and has the end id alone; null ids come first.
    A very long text is one row, of 4 bytes an id.
    Repeated ids are kept, ordered by a hash of the text.  An empty table gives
    files without rows.  Other columns are ignored.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)  # as many files as the input has parts
    (
        map_arrow(rows, _encoded(tokenizer, end_id), LAYOUT)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_orc(); filters on doc_id prune files, stripes and row groups."""
    return spark.read.schema(LAYOUT).orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = np.asarray(ids.offsets, np.int64)
        flat = np.asarray(ids.values).astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("before"), pa.array(np.diff(at)), pa.array(crc, pa.int64()), batch.column("part")],
            ["doc_id", "before", "n_tokens", "ids_crc32", "part"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """The files read back: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = read_orc(spark, path).select("doc_id", "before", "ids", part.alias("part"))
    rows = materialize(map_arrow(rows, _digests, "doc_id long, before long, n_tokens long, ids_crc32 long, part long"), "orc-digests")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row for each file
    base = files.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    return rows.join(base, "part").select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, *, tokenizer: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Writes the files (into the shared folder unless `path` names another place)
    and gives the digests of what is read back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "orc-tokens")
    write_orc(docs, path, tokenizer=tokenizer, end_id=end_id, **options)
    return digests(spark, path)
