"""Sharding by longest-processing-time scheduling: equal texts stay together.

A group is all rows with one text; its size is that of its rows.  The largest groups go
first, each to the shard with the least bytes so far, through a heap.  Groups of one
size are alike to the heap, so it is given sizes with their numbers of groups; many
groups of one size are dealt in one step, to the same effect.  Of the groups of a size,
those that come first by the text's md5 go to the lower shards.

Documents of T bytes have at most sqrt(2 T) sizes of groups (14 million at 100 TB).  The
driver reads them in descending order, 16 bytes each, holds the heap, and writes what
each shard gets of them block by block; nothing else of the groups comes there.  Everything about groups and rows is joined and ordered in
cells: a size with many groups, a shard, and a group with very many rows are cut by a
hash, so that no task orders more than a part of it.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import materialize, new_path

#: Values of a hash's first three hexadecimal digits.
CELLS = 4096


def longest_first(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[list[int]]:
    """(size, groups) of descending sizes -> for each how many groups each shard gets;
    ties go to the lower shard."""
    heap = [(0, s) for s in range(shards)]
    for size, left in classes:
        given = [0] * shards
        if left > 2 * shards:
            load = np.array([x for x, _ in sorted(heap, key=lambda x: x[1])], object)
            upto = lambda v: sum(max(0, (v - x) // size + 1) for x in load)  # steps that the heap takes at loads up to v  # noqa: B023, E731
            low, high = min(load) - 1, max(load) + size * left
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if upto(middle) <= left else (low, middle - 1)
            given = [int(max(0, (low - x) // size + 1)) for x in load]
            left -= sum(given)
            heap = [(int(x) + n * size, s) for s, (x, n) in enumerate(zip(load, given, strict=True))]
            heapq.heapify(heap)
        for _ in range(left):
            load, shard = heap[0]
            given[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        yield given


def _prefix(hexadecimal: str) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 3), 16, 10).cast("int")


#: Sizes of groups that the driver plans at once.
PLAN_BLOCK = 500_000
_PLAN = "_bytes long, _large boolean, _shards array<int>, _upto array<long>"


def _plans(sizes: pa.Table, shards: int, class_groups: int) -> Iterator[pa.Table]:
    """For each size, in blocks: the shards that get groups of it, and how many groups they
    and those before get."""
    batches = sizes.to_batches(max_chunksize=PLAN_BLOCK)
    classes = (c for b in batches for c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    dealt = longest_first(classes, shards)
    for batch in batches:
        at, shard, upto = array("i", [0]), array("i"), array("q")
        for _ in range(batch.num_rows):
            so_far = 0
            for s, k in enumerate(next(dealt)):
                if k:
                    so_far += k
                    shard.append(s)
                    upto.append(so_far)
            at.append(len(shard))
        flat = [pa.array(np.frombuffer(x, kind)) for x, kind in ((shard, np.int32), (upto, np.int64))]
        lists = [pa.ListArray.from_arrays(pa.array(np.frombuffer(at, np.int32)), f) for f in flat]
        yield pa.table([batch.column(0).cast(pa.int64()), pa.array(np.asarray(batch.column(1)) > class_groups), *lists], [c.split()[0] for c in _PLAN.split(", ")])


def _placed(rows: DataFrame, shards: int, class_groups: int, broadcast_sizes: int) -> DataFrame:
    """rows(_group, size) -> _group, _rows, shard: one row for each group."""
    spark = rows.sparkSession
    groups = materialize(rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")), "shard-groups")
    sizes = groups.groupBy("_bytes").agg(F.count("*").alias("n")).toArrow().sort_by([("_bytes", "descending")])
    path = new_path(spark, "shard-plan")
    for block in _plans(sizes, shards, class_groups):
        spark.createDataFrame(block, _PLAN).write.mode("append").parquet(path)
    plan = spark.read.schema(_PLAN).parquet(path) if sizes.num_rows else spark.createDataFrame([], _PLAN)
    held = groups.join(F.broadcast(plan) if sizes.num_rows <= broadcast_sizes else plan, "_bytes").withColumn("_cell", F.when(F.col("_large"), _prefix("_group")).otherwise(0))
    by_cell = held.where("_large").groupBy("_bytes", "_cell").agg(F.count("*").alias("_n"))
    base = by_cell.select("_bytes", "_cell", (F.sum("_n").over(Window.partitionBy("_bytes").orderBy("_cell")) - F.col("_n")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_bytes", "_cell").orderBy("_group")) - 1
    ranked = held.withColumn("_rank", rank).join(base, ["_bytes", "_cell"], "left").withColumn("_rank", F.col("_rank") + F.coalesce("_base", F.lit(0)))
    shard = F.element_at("_shards", F.size(F.filter("_upto", lambda x: x <= F.col("_rank"))) + 1)
    return materialize(ranked.select("_group", "_rows", shard.alias("shard")), "shard-placed")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def assign(docs: DataFrame, *, shards: int = 24, class_groups: int = 100_000, group_rows: int = 1000, group_parts: int = 10_000, broadcast_sizes: int = 100_000) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot,
    grown_shard: one row for each row of `docs`.

    A shard's slots go by the text's md5, then by doc_id (nulls first); groups of more
    than `group_rows` rows come last among those with the same first three digits, cut
    by a hash of the id into parts of about that many, `group_parts` at most.  More than `class_groups` groups of one size are ranked in
    parts.  Neither changes which shard a group gets.

    Texts are whole, however long; only their sizes and digests move.
    Nulls: a null text is grouped with empty ones and has size 8.  Repeated rows stay in
    one shard with slots of their own; they are alike, so whichever gets which slot the
    result is the same.  An empty table gives an empty result.  Other columns are
    ignored.
    """
    marked = docs.select("doc_id", (F.octet_length(_text()) + 8).cast("long").alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), F.md5(_text().cast("binary")).alias("_group"))
    marked = materialize(marked.withColumn("_salt", F.monotonically_increasing_id()), "shard-marked")
    placed = _placed(marked.select("_group", "size"), shards, class_groups, broadcast_sizes)
    large = F.col("_rows") > group_rows
    parts = F.least(F.ceil(F.col("_rows") / group_rows).cast("long"), F.lit(group_parts))
    part = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("_salt"), parts)).otherwise(F.pmod(F.xxhash64("doc_id"), parts))  # rows without an id are alike
    cell = ["shard", "_cell", "_alone", "_part"]
    rows = marked.join(placed, "_group").withColumns({"_cell": _prefix("_group"), "_alone": F.when(large, F.col("_group")).otherwise(""), "_part": F.when(large, part).otherwise(F.lit(0).cast("long"))})
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "_group", *cell), "shard-rows")
    counts = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    base = counts.select(*cell, (F.sum("_n").over(Window.partitionBy("shard").orderBy(*cell[1:])) - F.col("_n")).alias("_base"))
    at = F.row_number().over(Window.partitionBy(*cell).orderBy("_group", F.col("doc_id").asc_nulls_first())) - 1
    slots = rows.withColumn("_at", at).join(base, cell)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, *, shards: int = 24, class_groups: int = 100_000, broadcast_sizes: int = 100_000) -> DataFrame:
    """`docs` with a further column `shard` (replacing one of that name), the same as
    assign()'s; its rules for nulls, repeats, very long texts and empty tables hold."""
    marked = docs.select(F.md5(_text().cast("binary")).alias("_group"), (F.octet_length(_text()) + 8).cast("long").alias("size"))
    placed = _placed(materialize(marked, "shard-marked"), shards, class_groups, broadcast_sizes).select(F.col("_group").alias("__group"), F.col("shard").alias("__shard"))
    names = [c for c in docs.columns if c != "shard"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.md5(_text().cast("binary")).alias("__group"))
    return rows.join(placed, "__group").select("__row.*", F.col("__shard").alias("shard"))
