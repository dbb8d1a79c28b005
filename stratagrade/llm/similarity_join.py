"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with one set of shingles are one class; the join links classes.

1. Every class orders its shingles from rare to frequent, by a sketch (of bounded size)
   of their frequencies in all documents (the order need only be the same for all, so
   the sketch's errors cost time, never links).  Two sets with enough in common share
   at least k shingles in their k-prefixes, for every k.  Each class picks the k
   whose estimated cost is least: a longer prefix reads more postings, but only
   partners with k shared shingles have to be verified.  A pair needs the lesser k.
2. For each shingle one member of its postings, that with the fewest shingles of its
   own before it, is the centre; each class is verified against the centre it shares
   most with.  That ties groups of near copies together by a number of comparisons
   that grows with the group, not with its square.
3. Postings of one shingle are joined for the pairs that step 2 left in different
   parts, under position and size bounds (first each with the smallest set that it
   could meet, so that texts that share a passage and little else never meet), and
   pairs with enough shared shingles are verified on whole sets.  Pairs left out are in one part already, or cannot link.
4. Connected components of all verified links.

Hashes have 64 bits; sets with equal fingerprints are taken for equal.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .cluster import discard, map_arrow, materialize, partitions
from .textvec import LOWER, chunks, hashed, mix, sums, windows

_U = np.uint64
CHUNKS = 128
#: Counters of the sketch, as powers of two: it grows with the input up to what tasks hold and the driver sends.
LEAST_CELLS, MOST_CELLS = 21, 24
MOST_K = 6
RARE = 0.1  # other classes expected at a shingle that doesn't stand out
BITMAP = 24


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles (A-Z lower-cased; fewer
    words: of the whole sequence)."""
    start, end, at = texts.words()
    grams, gram_at = windows(hashed(LOWER[texts.buffer], start, end), at, n, whole=True)
    out = []
    for a, b in zip(gram_at[:-1].tolist(), gram_at[1:].tolist(), strict=True):
        g = np.sort(grams[a:b])
        out.append(g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g)
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.int64)
    total = sums(mix(np.concatenate([np.zeros(0, np.uint64), *sets]), 21), np.concatenate(([0], np.cumsum(size))))
    return mix(total + size.astype(np.uint64), 22).view(np.int64)


_PROFILE = "doc_id long, n_shingles long, fp long, chunk int, cells binary"


def _cell(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> _U(64 - bits)).astype(np.int64)


def _profiled(n: int, bits: int):
    """A row for each document, and each task's sketch in chunks."""

    def run(batches):
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for texts in chunks(batch.column(1)):
                sets = shingle_sets(texts, n)
                size = np.array([len(s) for s in sets], np.int64)
                np.add.at(cells, _cell(np.concatenate(sets), bits), np.uint32(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(size), pa.array(fingerprints(sets), mask=size == 0), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                    ["doc_id", "n_shingles", "fp", "chunk", "cells"],
                )
        parts = [(i, p) for i, p in enumerate(cells.reshape(CHUNKS, -1)) if p.any()]
        if parts:
            nothing = [pa.nulls(len(parts), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([i for i, _ in parts], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for _, p in parts], pa.binary())], ["doc_id", "n_shingles", "fp", "chunk", "cells"])

    return run


def _summed(kind):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(b.as_py()), kind).astype(np.int64)
                held[i] = held[i] + part if i in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["chunk", "cells"])

    return run


def _ranks(profile: DataFrame, tasks: int, bits: int) -> np.ndarray:
    """For each cell its frequency on a log scale, 0 if it doesn't stand out of the
    cells' noise; one byte each.  The tasks' sketches are summed in two steps, so that
    no task reads more than about the square root of them of a chunk."""
    cells = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.int64)
    parts = profile.where("chunk IS NOT NULL").select("chunk", "cells")
    several = parts.repartition("chunk", F.pmod(F.xxhash64("cells"), F.lit(math.isqrt(tasks) + 1)))
    sums = map_arrow(several, _summed(np.uint32), "chunk int, cells binary")
    for r in map_arrow(sums.repartition("chunk"), _summed(np.int64), "chunk int, cells binary").collect():  # 2 ** bits counters in all
        cells[r["chunk"]] = np.frombuffer(zlib.decompress(r["cells"]), np.int64)
    cells = cells.reshape(-1)
    noise = float(np.median(cells))
    excess = np.maximum(cells - noise, 1)
    rank = np.round(4 * np.log2(excess)).clip(1, 250).astype(np.uint8)
    rank[excess < 2 * np.sqrt(noise) + 2] = 0
    return rank


_POSTINGS = "token long, fp long, place long"  # place: n, k and pos in one number


def prefix(s: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The chosen prefix of a sorted set, in the global order, and its k."""
    n = len(s)
    level = rank[_cell(s, len(rank).bit_length() - 1)]
    order = np.lexsort((s, level))
    least = -(-num * n // den)  # what any partner shares with it
    others = np.cumsum(np.where(level == 0, RARE, np.exp2(level / 4.0))[order])
    k = np.arange(1, min(MOST_K, least) + 1)
    length = n - least + k
    verify = 5 + n / 4  # a set against a posting, by size
    best = int(k[np.argmin(length + others[length - 1] * (1 + verify / k))])
    return s[order[: n - least + best]], best


def _posted(n: int, num: int, den: int, rank):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for texts in chunks(batch.column(0)):
                sets = shingle_sets(texts, n)
                token, fps, place = [], [], []
                for s, fp in zip(sets, fingerprints(sets).tolist(), strict=True):
                    if len(s) and fp not in seen:
                        seen.add(fp)
                        p, k = prefix(s, rank.value, num, den)
                        token.append(p)
                        fps.append(np.full(len(p), fp))
                        place.append((len(s) << 36) + (k << 32) + np.arange(len(p)))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in token], fps, place)], ["token", "fp", "place"])

    return run


def _need(n, m, num: int, den: int) -> F.Column:
    """How many shingles linked sets of n and m have in common at least."""
    both = (F.col(n) if isinstance(n, str) else n) + (F.col(m) if isinstance(m, str) else m)
    return F.floor((both.cast("long") * num + (num + den - 1)) / (num + den))


def _bounds(a: str, b: str, num: int, den: int) -> F.Column:
    """Whether two postings of one shingle can belong to a linked pair, and to its
    first k shared shingles: by position, and by how much can be common, before the
    shingle (`i`: shingles before it that any other class has) and after."""
    x = lambda t, c: F.col(f"{t}.{c}")
    need = _need(x(a, "n"), x(b, "n"), num, den)
    k = F.least(x(a, "k"), x(b, "k"))
    tight = lambda t: x(t, "pos") <= x(t, "n") - need + k - 1
    common = F.least(x(a, "i"), x(b, "i")) + F.least(x(a, "n") - x(a, "pos"), x(b, "n") - x(b, "pos"))
    return tight(a) & tight(b) & (common >= need)


def _can_link(num: int, den: int) -> F.Column:
    """Whether a posting passes the bounds with the smallest set (of `least`) that has
    its shingle, with which least must be in common.  In a group of texts that share a
    passage, but too little besides, none does."""
    need = _need("n", "least", num, den)
    return (F.col("pos") <= F.col("n") - need + F.col("k") - 1) & (F.col("i") + F.col("n") - F.col("pos") >= need)


def _packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: two sets of a thousand have a chance of one in
    a hundred million to agree by accident anywhere."""
    s = s[np.concatenate(([True], s[1:] >> _U(16) != s[:-1] >> _U(16)))]
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(raw) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _emitted(n: int, bitmap):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for texts in chunks(batch.column(0)):
                sets = shingle_sets(texts, n)
                fps = fingerprints(sets)
                cell = fps & ((1 << BITMAP) - 1)
                wanted = bitmap.value[cell >> 6] >> (cell & 63).astype(np.uint64) & _U(1)
                out = []
                for i in np.flatnonzero(wanted).tolist():
                    fp = int(fps[i])
                    if len(sets[i]) and fp not in seen:
                        seen.add(fp)
                        out.append((fp, _packed(sets[i])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["fp", "grams"])

    return run


def _compared(num: int, den: int):
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                both = np.concatenate((_unpacked(x.as_buffer()), _unpacked(y.as_buffer())))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(den * common >= num * (len(both) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _verified(text: DataFrame, pairs: DataFrame, n: int, num: int, den: int, tag: str) -> DataFrame:
    """The linked pairs among pairs(a, b).  Only sets that pairs name are made, after
    a bitmap of fixed size; what passes it by chance falls out of the joins."""
    cell = F.col("fp").bitwiseAND((1 << BITMAP) - 1)
    named = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp")))
    words = named.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITMAP - 6), np.uint64)
    for batch in words.toArrow().to_batches():  # 2 ** 18 rows at most
        bitmap[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    bitmap = text.sparkSession.sparkContext.broadcast(bitmap)
    sets = map_arrow(text, _emitted(n, bitmap), "fp long, grams binary")
    sets = materialize(sets.groupBy("fp").agg(F.min("grams").alias("grams")), f"{tag}-sets")
    bitmap.destroy()
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("a_grams")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("b_grams")), "b")
    links = materialize(map_arrow(both.select("a", "b", "a_grams", "b_grams"), _compared(num, den), "a long, b long"), f"{tag}-links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: the least node of each connected component, by
    alternating large and small stars until the edges stay the same."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "edges-least")  # stored, so that a hub's rows in the join can be split
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges-large")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialize(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges, least, large, lower)
        edges = after
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, n_shingles, fp), and fp -> root for the
    classes that are linked with another."""
    spark = docs.sparkSession
    text = docs.select("text")
    tasks = partitions(text)
    bits = min(MOST_CELLS, max(LEAST_CELLS, 14 + tasks.bit_length()))
    profile = materialize(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _profiled(n, bits), _PROFILE), "join-profile")
    rank = spark.sparkContext.broadcast(_ranks(profile, tasks, bits))
    posted = materialize(map_arrow(text, _posted(n, num, den, rank), _POSTINGS), "join-posted")
    rank.destroy()
    shared = posted.groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("token")
    postings = posted.join(shared, "token", "left_semi").groupBy("token", "fp").agg(F.min("place").alias("place"))
    place = F.col("place")
    n_k_pos = [F.shiftright(place, 36).cast("int").alias("n"), F.shiftright(place, 32).bitwiseAND(15).cast("int").alias("k"), place.bitwiseAND((1 << 32) - 1).cast("int").alias("pos")]
    postings = materialize(postings.select("token", "fp", *n_k_pos).withColumn("i", (F.row_number().over(Window.partitionBy("fp").orderBy("pos")) - 1).cast("int")), "join-postings")
    discard(posted)

    # centres
    key = F.struct((F.col("pos") - F.col("i")).alias("lone"), F.xxhash64("fp").alias("h"), "fp", "n", "k", "pos", "i")
    centre = materialize(postings.groupBy("token").agg(F.min(key).alias("c")).select("token", "c.*"), "join-centre")  # stored, so that a hot shingle's postings can be split
    near = postings.alias("p").join(centre.alias("c"), "token").where((F.col("p.fp") != F.col("c.fp")) & _bounds("p", "c", num, den))
    near = near.groupBy(F.col("p.fp").alias("a"), F.col("c.fp").alias("b")).agg(F.count("*").alias("n"), F.min(F.least("p.k", "c.k")).alias("k"))
    best = near.where("n >= k").groupBy("a").agg(F.max(F.struct("n", "b")).alias("best"))
    best = materialize(best.select("a", F.col("best.b").alias("b")), "join-centres")
    starred = _verified(text, best, n, num, den, "join-star")
    up = starred.select("a", "b")
    part = up.alias("x").join(up.alias("y"), F.col("x.b") == F.col("y.a"), "left").select(F.col("x.a").alias("fp"), F.coalesce("y.b", "x.b").alias("part"))

    # the rest: postings of shingles whose classes are in several parts
    placed = postings.join(part, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    placed = materialize(placed, "join-placed")
    by_part = placed.groupBy("token", "part").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    main = by_part.groupBy("token").agg(F.max(F.struct("c", "part")).alias("m"), F.min("least").alias("least"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("token", F.col("m.part").alias("main"), "least")
    several = materialize(placed.join(main, "token").where(_can_link(num, den)).drop("least"), "join-several")
    left = several.where("part <> main")  # pairs within the main part need nothing
    of = lambda c, greater=False: F.when(F.col("q.fp" if greater else "p.fp") < F.col("p.fp" if greater else "q.fp"), F.col(f"p.{c}")).otherwise(F.col(f"q.{c}"))
    pairs = (
        left.alias("p").join(several.alias("q"), "token")
        .where((F.col("p.part") != F.col("q.part")) & ((F.col("q.part") == F.col("q.main")) | (F.col("p.fp") < F.col("q.fp"))) & _bounds("p", "q", num, den))
        .groupBy(F.least("p.fp", "q.fp").alias("a"), F.greatest("p.fp", "q.fp").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(F.least("p.k", "q.k")).alias("k"), F.max(of("pos")).alias("p"), F.max(of("pos", True)).alias("q"), F.min(of("n")).alias("n"), F.min(of("n", True)).alias("m"))
        .where("shared >= k").where(F.col("shared") + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) - 1 >= _need("n", "m", num, den)).select("a", "b")
    )
    pairs = materialize(pairs.join(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "join-pairs")
    rest = _verified(text, pairs, n, num, den, "join-rest")
    discard(postings, placed, several, pairs, best, centre)
    return profile.where("chunk IS NULL").select("doc_id", "n_shingles", "fp"), components(starred.union(rest))


def link(docs: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id: one row for each
    row of `docs`; two documents link when den * common >= num * union of their sets
    of `words`-word shingles, (num, den) = similarity.

    component_id: the smallest doc_id that links reach.  Nulls: a null text has no
    shingles and, as a text without words, links with nothing and is its own
    component; a null id takes part, and names a component of null ids only.
    A very long text is one set in one task, some 30 bytes a word there.
    Repeated rows have one component; an empty table gives an empty result; other
    columns are ignored.
    """
    num, den = similarity
    rows, roots = _classes(docs, words, num, den)
    named = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = named.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(rooted.join(ids, "root").select("fp", "component_id"), "join-components")
    linked = rows.where("fp IS NOT NULL").join(by_fp, "fp").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("fp IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _stamped(n: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            fps = [fingerprints(shingle_sets(texts, n)) for texts in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps) if fps else np.zeros(0, np.int64))], schema=pa.schema([batch.schema.field(0), schema.field(1)]))

    return run


def representatives(docs: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `docs` without all but one of each component: the one with the
    smallest doc_id (nulls last) stays.  Rows without words all stay.  The rules of
    link() hold."""
    num, den = similarity
    rows, roots = _classes(docs, words, num, den)
    known = rows.where("fp IS NOT NULL").select("doc_id", "fp").distinct()
    rooted = known.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("fp"))).alias("first")
    stay = materialize(rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias("doc_id"), F.col("first.fp").alias("fp")), "join-stay")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    fields = held.select("row").schema.add("fp", "long")
    stamped = map_arrow(held.where(has_words), _stamped(words, to_arrow_schema(fields)), fields)
    same = F.col("d.row.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.col("d.fp") == F.col("s.fp"))
    kept = stamped.alias("d").join(stay.alias("s"), same, "left_semi")
    again = Window.partitionBy(F.col("row.doc_id").cast("long"), "fp").orderBy(F.xxhash64("row"))
    kept = kept.withColumn("again", F.row_number().over(again)).where("again = 1").select("row.*")
    return kept.unionByName(held.where(~has_words).select("row.*"))
