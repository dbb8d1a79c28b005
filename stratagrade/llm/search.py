"""Ranked lexical search: whole score lists of many queries, window by window.

The documents of a task are numbered by ascending id, and the numbers cut into fixed
windows.  A window holds postings of the queries' terms: for each term the numbers of its
documents within the window and how often they have it.  Scores are whole, so each term's
share of a document's score is computed once for a window, whatever query asks.  A query
adds the shares of its terms into an array of a window's size, which stays in the cache,
and marks the cells of 64 documents that it touches; only those are harvested (and set
back to 0), into the query's heap.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import map_arrow, materialize
from .textvec import LOWER, NOT_ALNUM, chunks, hashed

#: Documents of a window; 64-bit scores of them take 64 KB.
WINDOW = 8192
#: Documents and postings that a task numbers at once.
SEGMENT, POSTINGS = 16 * WINDOW, 4_000_000
CELL = 64


def terms(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms, and n + 1 offsets by text."""
    start, end, at = texts.words(NOT_ALNUM)
    return hashed(LOWER[texts.buffer], start, end), at


# Queries -------------------------------------------------------------------------


class Queries:
    """Some queries: ids, all their distinct terms, and of each query which of those."""

    def __init__(self, found: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in found]
        self.terms, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t in found)]), return_inverse=True)
        self.codes = np.split(code, np.cumsum([len(t) for _, t in found])[:-1]) if found else []


def _passes(queries: DataFrame, most_terms: int) -> Iterator[Queries]:
    """Queries with up to `most_terms` terms in all, those of one id together."""
    held, size, last = [], 0, object()
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id")
    for r in rows.toLocalIterator():
        found = [terms(t)[0] for t in chunks(pa.array([r["text"]], pa.string()))]
        words = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        if held and r["item_id"] == last:
            held[-1] = (last, np.union1d(held[-1][1], words))
        else:
            if held and size + len(words) > most_terms:
                yield Queries(held)
                held, size = [], 0
            held.append((r["item_id"], words))
        last, size = r["item_id"], size + len(words)
    if held:
        yield Queries(held)


# The index -----------------------------------------------------------------------


_WINDOWS = "n_docs long, n_terms long, docs array<long>, sizes array<int>, terms array<int>, counts array<int>, places binary, times binary"


def _row(n_docs: int, n_terms: int, docs: pa.Array, size: np.ndarray, code: np.ndarray, doc: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One window: its postings by term, then by document."""
    order = np.lexsort((doc, code))
    code, doc, times = code[order], doc[order], times[order]
    start = np.flatnonzero(np.diff(code, prepend=-1))
    tight = np.uint8 if times.max(initial=0) < 256 else np.uint32
    lists = [docs, pa.array(size.astype(np.int32)), pa.array(code[start].astype(np.int32)), pa.array(np.diff(start, append=len(code)).astype(np.int32))]
    columns = [pa.array([n_docs]), pa.array([n_terms]), *(pa.ListArray.from_arrays([0, len(x)], x) for x in lists), pa.array([doc.astype(np.uint16).tobytes()]), pa.array([times.astype(tight).tobytes()])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _WINDOWS.split(", ")])


class _Segment:
    """Documents of a task and their postings, until there are enough."""

    def __init__(self):
        self.ids, self.size, self.code, self.doc, self.times = ([] for _ in range(5))
        self.held, self.found, self.n_docs, self.n_terms = 0, 0, 0, 0

    def add(self, ids: pa.Array, size: np.ndarray, code: np.ndarray, doc: np.ndarray, times: np.ndarray) -> None:
        """Documents, and postings of them (by their number among these)."""
        self.n_docs += int((size > 0).sum())
        self.n_terms += int(size.sum())
        self.ids.append(ids)
        self.size.append(size)
        self.code.append(code)
        self.doc.append(doc + self.held)
        self.times.append(times)
        self.held += len(size)
        self.found += len(code)

    def windows(self) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        size, code, doc, times = (np.concatenate(x) for x in (self.size, self.code, self.doc, self.times))
        order = np.asarray(pc.sort_indices(ids, null_placement="at_end"), np.int64)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        doc = number[doc]
        by_window = np.argsort(doc // WINDOW, kind="stable")
        code, doc, times = code[by_window], doc[by_window], times[by_window]
        cut = np.searchsorted(doc // WINDOW, np.arange(-(-len(order) // WINDOW) + 1))
        for w, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            inside = order[w * WINDOW : (w + 1) * WINDOW]
            first = w == 0  # the segment's counts go with its first window
            yield _row(self.n_docs if first else 0, self.n_terms if first else 0, ids.take(pa.array(inside)), size[inside], code[a:b], doc[a:b] - w * WINDOW, times[a:b])


def _indexed(queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pd.Index(queries.value.terms)
        n = max(1, len(asked))
        segment = _Segment()
        for batch in batches:
            for texts in chunks(batch.column(1)):
                term, at = terms(texts)
                code = asked.get_indexer(term)
                known = np.flatnonzero(code >= 0)
                doc = np.searchsorted(at, known, "right") - 1
                pair, times = np.unique(doc * n + code[known], return_counts=True)
                segment.add(batch.column(0).slice(texts.first, len(texts)), np.diff(at), pair % n, pair // n, times)
                if segment.held >= SEGMENT or segment.found >= POSTINGS:
                    yield from segment.windows()
                    segment = _Segment()
        if segment.held:
            yield from segment.windows()

    return run


# Scoring -------------------------------------------------------------------------


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def shares(times: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds to a document's score."""
    if 50 * int(size.max(initial=0)) * n_docs < 1 << 63:
        length = 50 + 50 * size * n_docs // n_terms
    else:
        length = np.array([50 + 50 * int(n) * n_docs // n_terms for n in size.tolist()], np.int64)
    return 1_000_000_000 * times // (1000 * times + 20 * length)


class Postings:
    """One window with the postings' shares."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.docs = row["docs"]
        self.terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        self.at = np.concatenate(([0], np.cumsum(counts)))
        self.place = np.frombuffer(row["places"], np.uint16).astype(np.int64)
        raw = row["times"]
        times = np.frombuffer(raw, np.uint8 if len(raw) == len(self.place) else np.uint32).astype(np.int64)
        self.share = np.repeat(weights[self.terms], counts) * shares(times, np.array(row["sizes"], np.int64)[self.place], n_docs, n_terms)
        self.cell = self.place // CELL


class Searcher:
    """The heaps of all queries, fed window by window."""

    def __init__(self, queries: Queries, top: int):
        self.queries, self.top = queries, top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.score = np.zeros(WINDOW, np.int64)
        self.cells = self.score.reshape(-1, CELL)
        self.occupied = np.zeros(WINDOW // CELL, bool)
        self.nth = np.full(len(queries.terms), -1, np.int64)

    def feed(self, window: Postings) -> None:
        self.nth[window.terms] = np.arange(len(window.terms))
        for codes, heap in zip(self.queries.codes, self.heaps, strict=True):
            here = self.nth[codes]
            for k in here[here >= 0].tolist():
                a, b = window.at[k], window.at[k + 1]
                self.score[window.place[a:b]] += window.share[a:b]
                self.occupied[window.cell[a:b]] = True
            self._harvest(window, heap)
        self.nth[window.terms] = -1

    def _harvest(self, window: Postings, heap: list) -> None:
        hit = np.flatnonzero(self.occupied)
        if not len(hit):
            return
        score = self.cells[hit].ravel()
        found = np.flatnonzero(score >= (heap[0][0] if len(heap) == self.top else 1))
        if len(found) > self.top:  # the best of the window; numbers ascend with ids
            found = np.sort(found[np.argsort(-score[found], kind="stable")[: self.top]])
        for value, at in zip(score[found].tolist(), (hit[found // CELL] * CELL + found % CELL).tolist(), strict=True):
            doc = window.docs[at]
            entry = (value, -doc if doc is not None else -(1 << 63))  # of equal scores the lowest id; null ids come last
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        self.cells[hit] = 0
        self.occupied[hit] = False


_RANKED = "item_id long, doc_id long, score long"


def _searched(queries, weights, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(queries.value, top)
        for batch in batches:
            for i in range(batch.num_rows):
                searcher.feed(Postings(batch.slice(i, 1).to_pylist()[0], weights.value, n_docs, n_terms))
        found = [(item, None if doc == -(1 << 63) else -doc, score) for item, heap in zip(queries.value.ids, searcher.heaps, strict=True) for score, doc in heap]
        columns = zip(*found, strict=True) if found else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [c.split()[0] for c in _RANKED.split(", ")])

    return run


def _one_pass(rows: DataFrame, queries: Queries, top: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    asked = context.broadcast(queries)
    windows = materialize(map_arrow(rows, _indexed(asked), _WINDOWS), "search-windows")
    sums = windows.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    holding = windows.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("n")).collect()  # a row for each term of the queries at most
    weights = np.zeros(len(queries.terms), np.int64)
    for r in holding:
        weights[r["terms"]] = weight(sums["n"], r["n"])
    run = _searched(asked, context.broadcast(weights), sums["n"], sums["l"], top)
    return map_arrow(windows.select("docs", "sizes", "terms", "counts", "places", "times"), run, _RANKED)


def rank(docs: DataFrame, queries: DataFrame, *, top: int = 50, most_terms: int = 500_000) -> DataFrame:
    """docs(doc_id, text, ...), queries(item_id, text, ...) -> item_id, rank, doc_id, score:
    for each query its `top` documents of a score above 0, or all if fewer, the
    highest first, equal scores by ascending id, null ids after others.

    Terms are runs of letters, digits and non-ASCII characters; only A-Z are lower-cased.
    Every document is scored for every query.  The queries' terms are broadcast, up to
    `most_terms` of them (40 MB at most in a worker); with more, further passes over the
    documents follow, each with its own queries.  A task keeps one heap of `top` for each
    query of the pass.

    Rows of `queries` with one id (null is one as well) are one query, with the terms of
    all.  A null or empty text has no terms: such a query finds nothing, and such a document
    is found by none and counts in no average.  Repeated documents are found each, and
    count each.  Texts are whole, however long; 64-bit numbers of terms are exact up to
    9 billion repeats of one in a text.  Empty tables give no rows.  Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_one_pass(rows, q, top) for q in _passes(queries, most_terms)]
    if not found:
        found = [docs.sparkSession.createDataFrame([], _RANKED)]
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return reduce(DataFrame.unionByName, found).withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
