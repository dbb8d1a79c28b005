"""Benchmark decontamination by greedy string tiling.

Seeds, runs of `min_match` words that a document shares with a test item, say which
pairs to compare.  A pair is tiled: the longest matches of words that no earlier
tile covers are marked first, found by running Karp-Rabin hashes over windows whose
length is bisected.  The share of an item's words under tiles is its coverage, which
does not fall when a passage's parts are reordered.

An item's words under shared seeds bound its coverage from above, so that items which
share a common phrase and no more are not tiled.  An item of fewer words than a seed is
its own seed: it is shared as a whole or not at all.

The test items make an index of at most `block_words` words, which is broadcast;
documents are never shuffled.  More items make more indexes: each is read in a pass of
its own, so that tasks hold one, and what the passes find is joined by the text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .cluster import map_arrow, materialize
from .textvec import LOWER, NOT_ALNUM, chunks, hashed, windows

_U = np.uint64
_ROLL = 0xD1342543DE82EF95
_ROLL_INV = pow(_ROLL, -1, 1 << 64)
_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("tiled", T.LongType()), T.StructField("words", T.LongType())]))


def words_of(column: pa.Array):
    """Blocks of texts with their word hashes (A-Z lower-cased; runs of letters,
    digits and non-ASCII characters) and offsets."""
    for texts in chunks(column):
        start, end, at = texts.words(NOT_ALNUM)
        yield texts, hashed(LOWER[texts.buffer], start, end), at


# Tiling --------------------------------------------------------------------------


class Running:
    """A sequence of words, some of them marked, with hashes of its windows."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power, self.inverse = (np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, r, np.uint64)))) for r in (_ROLL, _ROLL_INV))
        self.sums = np.concatenate(([_U(0)], np.cumsum(words * power[:n], dtype=np.uint64)))
        self.marked = np.zeros(n, bool)

    def open(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of s words without a marked one, and their hashes."""
        n = len(self.marked) - s + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.concatenate(([0], np.cumsum(self.marked)))
        at = np.flatnonzero(total[s : s + n] == total[:n])
        return at, (self.sums[at + s] - self.sums[at]) * self.inverse[at]

    def mark(self, place: int, s: int) -> None:
        self.marked[place : place + s] = True


def _common(doc: Running, item: Running, s: int):
    """Places in doc of open windows that item has too, which of item's distinct
    windows each is, and item's places by distinct window."""
    q, h = item.open(s)
    distinct, code = np.unique(h, return_inverse=True)
    p, g = doc.open(s)
    if not len(distinct) or not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    near = np.minimum(np.searchsorted(distinct, g), len(distinct) - 1)
    same = distinct[near] == g
    order = np.argsort(code, kind="stable")
    return p[same], near[same], np.split(q[order], np.cumsum(np.bincount(code))[:-1])


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """[(place in doc, place in item, words)] of non-overlapping tiles, the longest
    first, then by place.  The memory is linear in both, whatever repeats; there are at
    most len(item) / min_match tiles and a few passes over doc for each."""
    d, t = Running(doc), Running(item)
    out: list[tuple[int, int, int]] = []
    longest = min(len(doc), len(item))
    while longest >= min_match and len(_common(d, t, min_match)[0]):
        low = min_match
        while low < longest:  # an open match holds open matches of every smaller length
            middle = (low + longest + 1) // 2
            if len(_common(d, t, middle)[0]):
                low = middle
            else:
                longest = middle - 1
        p, window, places = _common(d, t, longest)
        alive, at, free = np.ones(len(places), bool), 0, 0
        while True:
            at = max(at, int(np.searchsorted(p, free)))
            rest = np.flatnonzero(alive[window[at:]])
            if not len(rest):
                break
            at += int(rest[0])
            q = next((q for q in places[window[at]].tolist() if not t.marked[q : q + longest].any()), None)
            if q is None:
                alive[window[at]] = False
                continue
            d.mark(p[at], longest)
            t.mark(q, longest)
            out.append((int(p[at]), q, longest))
            free = int(p[at]) + longest
        longest -= 1
    return out


def _near_seeds(words: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The words under seeds, with one word that equals no other for each gap."""
    inside = np.zeros(len(words), bool)
    for j in range(k):
        inside[seeds + j] = True
    edge = inside & ~np.concatenate(([False], inside[:-1]))
    group = np.cumsum(edge)[inside]
    kept = words[inside]
    at = np.flatnonzero(np.diff(group)) + 1
    return np.insert(kept, at, np.arange(1, len(at) + 1, dtype=np.uint64))


# The index -----------------------------------------------------------------------


class Postings:
    """Distinct seeds of one length, and where they stand: text and place."""

    def __init__(self, seed: np.ndarray, text: np.ndarray, place: np.ndarray):
        order = np.lexsort((place, text, seed))
        self.text, self.place = text[order], place[order]
        self.seed, self.start = np.unique(seed[order], return_index=True)
        self.start = np.append(self.start, len(order))

    def of(self, seeds: np.ndarray) -> np.ndarray:
        """All postings of some distinct seeds, given by number."""
        size = self.start[seeds + 1] - self.start[seeds]
        return np.repeat(self.start[seeds] - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Test items: ids, word hashes and postings of seeds by length."""

    def __init__(self, rows: list, min_match: int, short_items: bool):
        self.ids = [r["item_id"] for r in rows]
        parts, sizes, seeds = [], [], {}
        for texts, words, at in words_of(pa.array([r["text"] for r in rows], pa.string())):
            parts.append(words)
            size = np.diff(at)
            sizes.append(size)
            for k in range(1 if short_items else min_match, min_match + 1):
                grams, gram_at = windows(words, at, k)
                text = np.repeat(np.arange(len(size)), np.diff(gram_at))
                place = np.arange(len(grams)) - gram_at[text]
                wanted = size[text] == k if k < min_match else np.ones(len(text), bool)
                seeds.setdefault(k, []).append((grams[wanted], text[wanted] + texts.first, place[wanted]))
        self.words = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.size = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.seeds = {k: Postings(*(np.concatenate(x) for x in zip(*found, strict=True))) for k, found in seeds.items()}


def _shares(index: Index, words: np.ndarray, seeds: np.ndarray, places: np.ndarray, min_match: int, threshold: float) -> dict[int, tuple[int, int]]:
    """text -> (words under tiles, all words) of the items that a document covers to
    the threshold, and of those that it covers best."""
    postings = index.seeds[min_match]
    own = postings.of(np.unique(seeds))
    text, place = postings.text[own], postings.place[own]
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    step = np.append(np.where(text[1:] == text[:-1], np.minimum(place[1:] - place[:-1], min_match), min_match), min_match)
    texts, first = np.unique(text, return_index=True)
    bound = np.add.reduceat(step, first) / index.size[texts]
    near = _near_seeds(words, places, min_match)
    out, best = {}, 0.0
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < best and bound[i] < threshold:
            break
        t = int(texts[i])
        tiled = sum(n for _, _, n in tiles(near, index.words[index.at[t] : index.at[t + 1]], min_match))
        out[t] = (tiled, int(index.size[t]))
        best = max(best, tiled / out[t][1])
    return out


def _found(index: Index, look_up: dict, texts, words: np.ndarray, at: np.ndarray, min_match: int, threshold: float) -> dict[int, list[dict]]:
    """document -> its entries, for some texts; of texts with one id the best counts."""
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for k, seen in look_up.items():
        grams, gram_at = windows(words, at, k)
        hit = seen.get_indexer(grams)
        places = np.flatnonzero(hit >= 0)
        doc = np.searchsorted(gram_at, places, "right") - 1
        edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d, mine = int(doc[a]), places[a:b]
            if k == min_match:
                more = _shares(index, words[at[d] : at[d + 1]], hit[mine], mine - gram_at[d], k, threshold)
            else:
                short = index.seeds[k]
                more = dict.fromkeys(short.text[short.of(np.unique(hit[mine]))].tolist(), (k, k))
            found.setdefault(d, {}).update(more)
    out = {}
    for d, shares in found.items():
        best: dict = {}
        for t, (tiled, size) in sorted(shares.items()):
            key = (index.ids[t] is None, t if index.ids[t] is None else index.ids[t])
            if key not in best or tiled * best[key]["words"] > best[key]["tiled"] * size:
                best[key] = {"item_id": index.ids[t], "tiled": tiled, "words": size}
        out[d] = [best[key] for key in sorted(best)]
    return out


def _tiled(index, min_match: int, threshold: float, schema: pa.Schema, only_found: bool):
    """Batches of (key, text, found): with `found` filled in, or only those rows where
    something was found, without texts."""

    def run(batches):
        held: Index = index.value
        look_up = {k: pd.Index(p.seed) for k, p in held.seeds.items() if len(p.seed)}
        for batch in batches:
            found: list = [None] * batch.num_rows
            for texts, words, at in words_of(batch.column(1)):
                for d, entries in _found(held, look_up, texts, words, at, min_match, threshold).items():
                    found[texts.first + d] = entries
            if only_found:
                some = pa.array([i for i, f in enumerate(found) if f], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([f for f in found if f], schema.field(1).type)], schema=schema)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f or [] for f in found], schema.field(2).type)], schema=schema)

    return run


def _indexes(benchmark: DataFrame, min_match: int, short_items: bool, block_items: int, block_words: int) -> Iterator[Index]:
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        more = len(r["text"] or "") // 2 + 1  # words at most
        if held and (len(held) == block_items or size + more > block_words):
            yield Index(held, min_match, short_items)
            held, size = [], 0
        held.append(r)
        size += more
    yield Index(held, min_match, short_items)


def covered(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 5, short_items: bool = True, threshold: float = 0.5, block_items: int = 200_000, block_words: int = 8_000_000) -> DataFrame:
    """`docs` as a struct column `row`, with its text and with `found`: id, words under
    tiles and all words of each test item that it covers to the threshold or covers
    best (of those that share a seed).

    benchmark(item_id, text): with `short_items`, items of 1 to `min_match` - 1 words
    are found where all their words stand in a row; without it they give no evidence
    and are left out.  Of items with one id the best counts; items with null ids are
    items of their own.  Up to `block_items` items of `block_words` words in all make
    one index (at most 24 bytes a word); a larger item is one by itself.

    A very long text is searched whole, in one task; what shares no seed with any item is
    left out before tiles are looked for.
    A null text is empty and shares nothing; repeated rows are tiled alike; an empty
    table of either kind finds nothing; columns of `docs` pass through unread.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    indexes = _indexes(benchmark, min_match, short_items, block_items, block_words)
    one, another = next(indexes), next(indexes, None)
    if another is None:
        rows = docs.select(row, F.col("text"), F.array().cast(_FOUND).alias("found"))
        return map_arrow(rows, _tiled(spark.sparkContext.broadcast(one), min_match, threshold, to_arrow_schema(rows.schema), False), rows.schema)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    texts, hits = docs.select(digest.alias("digest"), "text"), None
    while one:
        index = spark.sparkContext.broadcast(one)
        schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("found", _FOUND)])
        passed = map_arrow(texts, _tiled(index, min_match, threshold, to_arrow_schema(schema), True), schema)
        passed = materialize(passed.groupBy("digest").agg(F.min("found").alias("found")), "tiling-found")
        index.destroy()
        hits = passed if hits is None else hits.unionByName(passed)
        one, another = another, next(indexes, None)
    hits = hits.groupBy("digest").agg(F.flatten(F.collect_list("found")).alias("found"))
    joined = docs.select(row, F.col("text"), digest.alias("digest")).join(materialize(hits, "tiling-found"), "digest", "left")
    return joined.select("row", "text", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def _contaminated(threshold: float) -> F.Column:
    return F.filter("found", lambda x: x["tiled"] >= x["words"] * threshold)


def coverage(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, contaminated, coverage (the most of any test
    item, 0 if none), best_item (the lowest id with that coverage), tiled_words (its
    words under tiles), items (ids covered to the threshold, sorted, with a null for
    each item without one): one row for each row of `docs`.  The rules of covered()
    hold."""
    found = covered(docs.select("doc_id", "text"), benchmark, threshold=threshold, **options)
    best = F.array_max(F.transform("found", lambda x: F.struct((x["tiled"] / x["words"]).alias("share"), (-x["item_id"]).alias("id"), x["tiled"].alias("tiled"))))
    ids = F.transform(_contaminated(threshold), lambda x: x["item_id"])
    ids = F.concat(F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))), F.filter(ids, lambda x: x.isNull()))
    out = found.select("row.doc_id", best.alias("best"), ids.alias("items"))
    return out.select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.coalesce("best.share", F.lit(0.0)).alias("coverage"),
        (-F.col("best.id")).alias("best_item"),
        F.coalesce("best.tiled", F.lit(0)).cast("long").alias("tiled_words"),
        "items",
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` that cover no test item to the threshold."""
    return covered(docs, benchmark, threshold=threshold, **options).where(F.size(_contaminated(threshold)) == 0).select("row.*")
