"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target, in words.  Whole epochs of the source come first; what
is left of the target is filled with documents in the order of their exponential
keys -ln(u) / w (u: uniform from the document's id and text, w: its quality
weight), as far as the running sum of sizes reaches.  The document at the edge
gives as many of its first words as still fit.

The sources need no task of their own: the keys are cut into buckets, and those into
finer ones; totals say in which of each a source's budget ends, and only the rows of
one fine bucket are ordered one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 less the symbols per word, 0.05 at least: junk sorts late."""
    n = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0))
    return F.greatest(F.lit(0.05), F.lit(1.0) - n / F.greatest(size, F.lit(1)))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds _rank: sources by code point, null last.  They are dealt by ranges, so that
    no task orders all of them, and numbered from one count for each range."""
    order, at = F.col("source").asc_nulls_last(), F.monotonically_increasing_id()
    rows = sizes.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_part": F.shiftrightunsigned(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)})
    rows = materialize(rows, "mix-ranked")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    base = F.broadcast(parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base")))  # a row for each partition
    return rows.join(base, "_part").select("source", "source_size", (F.col("_base") + F.col("_at")).alias("_rank"))


def _level(s: DataFrame, goal: float) -> float | None:
    """What a unit of weight gets once all sources with _ratio below it have their _cap;
    None if all have.

    In the order of the ratio, sources are capped as long as the ratio is below what the
    rest would share.  The ratios are cut into 64 classes for each power of two, whose
    sums the driver gets; only the class in which the level lies is gone through.
    """
    by_ratio = s.groupBy("_ratio").agg(F.sum("_cap").alias("c"), F.sum("_w").alias("w"))
    by_ratio = by_ratio.withColumn("_class", F.when(F.col("_ratio") > 0, F.floor(F.log2("_ratio") * 64)).otherwise(-1))
    before, rest, last = 0.0, 0.0, None
    classes = by_ratio.groupBy("_class").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.min("_ratio").alias("least")).orderBy("_class").collect()
    rest = sum(r["w"] for r in classes)
    after = None
    for r in classes:
        if r["least"] >= (goal - before) / rest:
            after = (goal - before) / rest
            break
        last = (r["_class"], before, rest)
        before, rest = before + r["c"], rest - r["w"]
    if last is None:
        return after
    number, before, rest = last
    upto = Window.orderBy("_ratio").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(x).over(upto), F.lit(0.0)) for x in ("c", "w")]
    inside = by_ratio.where(F.col("_class") == number).withColumn("level", (F.lit(goal) - (F.lit(before) + sums[0])) / (F.lit(rest) - sums[1]))
    found = inside.where("_ratio >= level").agg(F.min_by("level", "_ratio").alias("level")).first()["level"]
    return after if found is None else found


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> with target: the total times `share` is dealt by
    weight (sources by code point, null last, take the weights in turn); no target
    is above `most` times its source, and what that frees is dealt again by weight.

    In closed form: a source is capped if cap / weight is below the level at which
    the others share what is left.
    """
    turn = F.pmod("_rank", F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    s = _ranked(sizes).select("source", "source_size", w.alias("_w"), (F.col("source_size") * most).alias("_cap")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level = _level(s, total * share)
    return s.select("source", "source_size", (F.col("_cap") if level is None else F.least("_cap", F.lit(level) * F.col("_w"))).alias("target"))


def _keyed(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """source and doc_id with the size and the key of each row."""
    rows = docs.select("doc_id", "source", "text", *([] if weight is None else [weight.alias("_weight")])).withColumn("_size", n_words(F.col("text")))
    own = quality_weight(F.col("text"), F.col("_size")) if weight is None else _usable("_weight")
    return rows.select("doc_id", "source", "_size", exponential_key(F.col("doc_id"), F.col("text"), own, seed).alias("_key"))


def _usable(weight: str) -> Column:
    """A given weight; nulls, NaN and what isn't above 0 count as the least."""
    w = F.col(weight).cast("double")
    return F.when((w > 1e-6) & ~F.isnan(w), F.least(w, F.lit(1e6))).otherwise(1e-6)


def _bucket(buckets: int) -> Column:
    return F.floor(F.col("_key") / (F.col("_key") + 1) * buckets)


def _edge(cells: DataFrame, budgets: DataFrame, at: str) -> DataFrame:
    """Where each source's budget ends: cells(source, at, _cell), budgets(source, _left)
    -> source, at, _left (what remains of the budget before that cell)."""
    upto = F.sum("_cell").over(Window.partitionBy("source").orderBy(at))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    before = F.col("_sum") - F.col("_cell")
    both = cells.withColumn("_sum", upto).alias("a").join(budgets.select("source", "_left").alias("b"), same)
    return both.where((F.col("_sum") > F.col("_left")) & (before <= F.col("_left"))).select("a.source", f"a.{at}", (F.col("_left") - before).alias("_left"))


def plan(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11, buckets: int = 1 << 14, broadcast_sources: int = 100_000, weight: Column | None = None) -> DataFrame:
    """A row for each source: source, source_size, target, epochs, and where the
    fractional selection ends: rows with a key below `edge` are taken whole, those
    at it (one row, or repeats of it) give `edge_words` words each.  The plan is
    broadcast to the rows if it has no more than `broadcast_sources` of them; else
    the join shuffles, and Spark splits a hot source's partition."""
    side = max(1, math.isqrt(buckets))
    slim = _keyed(docs, seed, weight).select("source", "_size", "_key")
    slim = materialize(slim.withColumn("_bucket", _bucket(side * side)).withColumn("_coarse", F.floor(F.col("_bucket") / side)), "mix-keys")
    coarse = slim.groupBy("source", "_coarse").agg(F.sum("_size").alias("_cell"))
    sources = source_targets(coarse.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, share, most)
    sources = materialize(
        sources.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
        .withColumn("_left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))),
        "mix-sources",
    )
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    wide = _edge(coarse, sources, "_coarse")
    inside = slim.alias("a").join(wide.alias("b"), same & (F.col("a._coarse") == F.col("b._coarse"))).select("a.source", "_bucket", "_size")
    edges = _edge(inside.groupBy("source", "_bucket").agg(F.sum("_size").alias("_cell")), wide, "_bucket")
    keys = (
        slim.alias("a").join(edges.alias("b"), same & (F.col("a._bucket") == F.col("b._bucket")))
        .where("_size > 0")
        .groupBy("a.source", "_key").agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows"), F.first("_left").alias("_left"))
    )
    by_key = Window.partitionBy("source").orderBy("_key")
    at_edge = (
        keys.withColumn("_sum", F.sum("_words").over(by_key))
        .where((F.col("_sum") > F.col("_left")) & (F.col("_sum") - F.col("_words") <= F.col("_left")))
        .select("source", F.col("_key").alias("edge"), F.floor((F.col("_left") - F.col("_sum") + F.col("_words")) / F.col("_rows")).alias("edge_words"))
    )
    out = materialize(sources.alias("a").join(at_edge.alias("b"), same, "left").select("a.source", "source_size", "target", "epochs", "edge", "edge_words"), "mix-plan")
    return F.broadcast(out) if out.count() <= broadcast_sources else out


def mix(docs: DataFrame, *, seed: int = 11, weight: Column | None = None, **options) -> DataFrame:
    """docs(doc_id, source, text, ...) -> doc_id, size, source_size, target, taken,
    epochs, key: one row for each row of `docs`.  `weight`: a column of `docs` with the
    documents' quality (0 or less, null: the least), or else quality_weight()'s.

    Nulls: a null text has no words and takes none; null sources are one source;
    a null id only changes the key.  Repeated rows have one key and share the edge
    evenly.  Texts are whole, however long: only their sizes and keys move.  An empty table
    gives an empty result.  Columns besides the three are
    ignored, whatever their names.
    """
    sources = plan(docs, seed=seed, weight=weight, **options)
    rows = _keyed(docs, seed, weight)
    part = F.when(F.col("_key") < F.coalesce("edge", F.lit(float("-inf"))), F.col("_size")).when(F.col("_key") == F.col("edge"), F.least("_size", "edge_words")).otherwise(0)
    return rows.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("epochs") * F.col("_size") + part).alias("taken"),
        F.col("epochs"),
        F.col("_key").alias("key"),
    )


def mixed_rows(docs: DataFrame, *, seed: int = 11, weight: Column | None = None, **options) -> DataFrame:
    """The mixed corpus itself, with the columns of `docs`: a row stands once for
    each epoch, and once more if the fractional selection takes it whole or at least
    half of it (documents are not cut here).  Rows without words stand once for each
    epoch and at least once, as they take nothing of any budget.

    Null texts have no words, null sources are one source, null ids only change keys;
    repeated rows stand alike; very long texts count whole and are repeated as they are; an
    empty table stays empty.
    """
    sources = plan(docs, seed=seed, weight=weight, **options)
    names = docs.columns
    rows = docs.select([F.col(f"`{c}`") for c in names] + ([] if weight is None else [weight.alias("__mix_weight")]) + [F.struct(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text")).alias("__mix_row")])
    size = n_words(F.col("__mix_row.text"))
    own = quality_weight(F.col("__mix_row.text"), F.col("__mix_size")) if weight is None else _usable("__mix_weight")
    rows = rows.withColumn("__mix_size", size).withColumn("__mix_key", exponential_key(F.col("__mix_row.doc_id"), F.col("__mix_row.text"), own, seed))
    more = F.when(F.col("__mix_key") < F.coalesce("b.edge", F.lit(float("-inf"))), 1).when((F.col("__mix_key") == F.col("b.edge")) & (F.col("b.edge_words") * 2 >= F.col("__mix_size")), 1).otherwise(0)
    times = F.when(F.col("__mix_size") == 0, F.greatest(F.col("b.epochs"), F.lit(1))).otherwise(F.col("b.epochs") + more)
    joined = rows.join(sources.alias("b"), F.col("__mix_row.source").eqNullSafe(F.col("b.source")))
    return joined.withColumn("__mix_times", times.cast("int")).withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_times")))).select([rows[f"`{c}`"] for c in names])
