"""How the sources of a language differ from each other, and by which terms.

Words are counted by (language, source, term); a language keeps the terms of enough
documents.  For a group g with N occurrences of kept terms, p_g(t) = 1 + floor(10^9 (c + 1)
/ (N + V)), V being the number of terms that its language keeps; f(p, q) = floor((p - q)^2 / q).

The sum of f(p_a, p_b) over all V terms is not taken term by term.  Let a0 and b0 be what
a term of count 0 has.  Then it is

    sum over a's terms of f(p_a, b0)  +  sum over b's terms of f(a0, p_b)
      +  (V - |a| - |b|) f(a0, b0)
      +  sum over common terms of f(p_a, p_b) - f(p_a, b0) - f(a0, p_b) + f(a0, b0).

The first two come from histograms of counts, the third is a constant of the pair, and
only the last needs terms: postings of one term meet in a task, which sums by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import map_arrow, materialize
from .textvec import LOWER, chunks, hashed

BLOCK = 8 << 20
#: Pairs of postings that a task holds at once.
PAIRS = 1 << 20
SCALE = 1_000_000_000
#: Bytes outside [A-Za-z\x80-\xff].
NOT_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])

_COUNTED = "lang string, source string, term string, n long, df long"


def slices(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of a buffer as strings."""
    size = end - start
    to = np.concatenate(([0], np.cumsum(size)))
    flat = buffer[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms by block of texts; and a row with
    the empty term for each group of the block."""
    for batch in batches:
        group, names = pd.factorize(pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()]))
        for texts in chunks(batch.column(2), BLOCK):
            of = group[texts.first : texts.first + len(texts)].astype(np.int64)
            low = LOWER[texts.buffer]
            start, end, at = texts.runs(~NOT_LETTER[texts.buffer])
            code, distinct = pd.factorize(hashed(low, start, end))
            sample = np.empty(len(distinct), np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]
            terms, doc = max(1, len(distinct)), np.repeat(np.arange(len(texts)), np.diff(at))
            place, cells = pd.factorize(of[doc] * terms + code)  # a cell: a term of a group
            once = pd.unique(doc * terms + code)
            held = pd.Index(cells).get_indexer(of[once // terms] * terms + once % terms)
            seen = np.unique(of)
            word = slices(low, start[sample], end[sample]).take(pa.array(cells % terms)) if len(cells) else pa.array([], pa.string())
            owner = [names[g] for g in seen.tolist()]
            which = np.concatenate((np.searchsorted(seen, cells // terms), np.arange(len(seen))))
            nothing = np.zeros(len(seen), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([o[k] for o in owner], pa.string()).take(pa.array(which)) for k in (0, 1)),
                    pa.concat_arrays([word, pa.array([""] * len(seen), pa.string())]),
                    pa.array(np.concatenate((np.bincount(place, minlength=len(cells)), nothing))),
                    pa.array(np.concatenate((np.bincount(held, minlength=len(cells)), nothing))),
                ],
                [c.split()[0] for c in _COUNTED.split(", ")],
            )


def postings(docs: DataFrame, *, min_docs: int = 3) -> DataFrame:
    """docs(text, lang, source, ...) -> lang, term, term_id, total, first, source, n: how
    often each source has each term that its language keeps; `total` is the language's,
    `first` marks one row of each term.  Every group has a row with the empty term too.

    Blocks of texts send each of their terms once for each group, to where the term is
    counted; a term's row there holds a count for each source that has it.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = map_arrow(docs.select(empty("lang"), empty("source"), empty("text")), _counted, _COUNTED).repartition("lang", "term")
    counts = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = kept.where((F.col("df") >= min_docs) | (F.col("term") == "")).withColumn("term_id", F.monotonically_increasing_id())
    rows = kept.select("lang", "term", "term_id", "total", F.posexplode("held"))
    return materialize(rows.select("lang", "term", "term_id", "total", (F.col("pos") == 0).alias("first"), "col.source", "col.n"), "divergence-postings")


def share(n: str, total: str, terms: str) -> Column:
    """p of a count, from the names of columns; in decimals where 64 bits are too few."""
    return F.expr(f"""1 + CASE WHEN {n} < 9000000000 THEN ({n} + 1) * {SCALE} div ({total} + {terms})
        ELSE (CAST({n} + 1 AS DECIMAL(20)) * {SCALE}) div ({total} + {terms}) END""")


def excess(p: str, q: str) -> Column:
    """f(p, q), from the names of columns."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def groups(held: DataFrame) -> DataFrame:
    """postings() -> lang, source, n, lang_n, terms, size, zero: of each group its
    occurrences, its language's, the language's kept terms, how many of them the group has,
    and what p is for a count of 0 (null without kept terms)."""
    is_term = F.col("term") != ""
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if(is_term).alias("size"), F.count_if(is_term & F.col("first")).alias("firsts"))
    whole = Window.partitionBy("lang")  # a row for each group
    sums = sums.select("lang", "source", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("firsts").over(whole).alias("terms"), "size")
    return materialize(sums.withColumn("zero", F.when(F.col("terms") > 0, share("0", "n", "terms"))), "divergence-groups")


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class _Overlaps:
    """Sums by ordered pair of groups over the terms that both have."""

    def __init__(self):
        self.names: dict[tuple[str, str], int] = {}
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, term: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray) -> None:
        """Postings of whole terms, in the order of terms."""
        last = np.append(np.flatnonzero(np.diff(term)), len(term) - 1)
        partners = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(term))  # those that follow in the term
        upto = np.cumsum(partners)
        i = 0
        while i < len(term):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
            n = partners[i:j]
            a = np.repeat(np.arange(i, j), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            for x, y in ((a, b), (b, a)):
                self._sum(group[x] << 32 | group[y], _excess(p[x], p[y]) - _excess(p[x], zero[y]) - _excess(zero[x], p[y]) + _excess(zero[x], zero[y]))
            i = j

    def _sum(self, key: np.ndarray, value: np.ndarray) -> None:
        code, keys = pd.factorize(np.concatenate((self.keys, key)))
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, code, np.concatenate((self.sums, value)))
        self.keys, self.sums = keys, total

    def batch(self) -> pa.RecordBatch:
        names = list(self.names)
        column = lambda at, k: pa.array([names[g][k] for g in at.tolist()], pa.string())
        a, b = self.keys >> 32, self.keys & 0xFFFFFFFF
        out = pa.RecordBatch.from_arrays([column(a, 0), column(a, 1), column(b, 1), pa.array(self.sums)], ["lang", "source", "item", "value"])
        self.keys, self.sums = self.keys[:0], self.sums[:0]
        return out


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term_id, lang, source, p, zero) in the order of terms -> sums by pair."""
    tool, held = _Overlaps(), None
    for batch in batches:
        name, names = pd.factorize(pd.MultiIndex.from_arrays([batch.column(1).to_pandas(), batch.column(2).to_pandas()]))
        known = np.array([tool.names.setdefault(x, len(tool.names)) for x in names.tolist()], np.int64)
        more = [np.asarray(batch.column(0)), known[name], np.asarray(batch.column(3)), np.asarray(batch.column(4))]
        held = more if held is None else [np.concatenate(x) for x in zip(held, more, strict=True)]
        if len(held[0]) > 100_000:
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last term may go on
            tool.add(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
            if len(tool.keys) > PAIRS:
                yield tool.batch()
    if held is not None:
        tool.add(*held)
    yield tool.batch()


def pair_sums(held: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item, value: for each ordered pair of a language's sources the sum of
    f over all its kept terms (0 without any)."""
    terms = held.where(F.col("term") != "").join(known.withColumnRenamed("n", "group_n"), ["lang", "source"]).withColumn("p", share("n", "group_n", "terms"))
    other = known.select("lang", F.col("source").alias("item"), F.col("size").alias("other_size"), F.col("zero").alias("other_zero"))
    apart = known.join(other, "lang").where(F.col("source") != F.col("item"))
    constant = apart.select("lang", "source", "item", F.coalesce(F.expr("terms - size - other_size").cast("decimal(38,0)") * excess("zero", "other_zero"), F.lit(0)).alias("value"))
    counts = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("h")).join(other, "lang").where(F.col("source") != F.col("item"))
    sides = F.array(
        F.struct("source", "item", (F.col("h") * excess("p", "other_zero")).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("h") * excess("other_zero", "p")).alias("value")),
    )
    alone = counts.select("lang", F.inline(sides))
    common = terms.select("term_id", "lang", "source", "p", "zero").repartition("term_id").sortWithinPartitions("term_id")
    common = map_arrow(common, _overlaps, "lang string, source string, item string, value long")
    exact = [x.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")) for x in (constant, alone, common)]
    return exact[0].unionByName(exact[1]).unionByName(exact[2]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def leading_terms(held: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item, value: the terms that a group has in a greater share than its
    language, and f of both."""
    rows = held.where(F.col("term") != "").join(known.withColumnRenamed("n", "group_n"), ["lang", "source"])
    rows = rows.withColumns({"p": share("n", "group_n", "terms"), "q": share("total", "lang_n", "terms")}).where("n > 0 AND p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), excess("p", "q").alias("value"))


def audit(docs: DataFrame, *, min_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """docs(text, lang, source, ...) -> lang, source, part, item, value, rank.

    Part `pair`: the other sources of the language with their sums, all ranks.  Part
    `term`: the terms of leading_terms(), ranks up to `most_terms`.  Ranks go by value
    descending, then by item in the order of its UTF-8 bytes.

    A null text, lang or source is an empty one; documents without terms, and languages
    that keep none, have pairs all the same (of value 0 without kept terms).  Repeated rows
    are documents of their own; a very long text is a block by itself (some 15 bytes of a
    worker's memory for each of its own).  An empty table gives no rows.  Other
    columns are ignored, whatever their names.  Sums are exact while a language keeps
    fewer than 10^9 terms.
    """
    held = postings(docs, min_docs=min_docs)
    known = groups(held)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return ranked(pair_sums(held, known), "pair").unionByName(ranked(leading_terms(held, known), "term").where(F.col("rank") <= most_terms))
