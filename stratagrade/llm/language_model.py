"""Language-model scores from a log-frequency Bloom filter.

Training: documents are cut into blocks; each sends its distinct training n-grams of every
order, with their numbers, to segments of the n-grams' hash.  A segment sums them, quantises a
count c to 1 + floor(log2 c) levels, and puts the keys (n-gram, 1) to (n-gram, level)
into its part of one Bloom filter.  The parts are stored: they are the model, at
`bits_per_key` for each level, however many n-grams there are.

Scoring knows the filter alone.  A filter of up to `broadcast_mb` is broadcast, and every worker
probes it for its blocks; the parts of a larger one meet the blocks' n-grams by segment,
and what their probes find goes back to the blocks.  The bits are the same, and so
are the scores.

P_1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
P_n(w | h) = (c(h w) + m P_(n-1)(w | h')) / (c(h) + m),  h' being h without its first word,
with quantised counts; a text's first word follows a start mark, and no n-gram reaches
beyond it.  The score is that of the highest order.

The base score is defined by exact counts of words; parts for words hold them as well.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_arrow, materialize, ship
from .textvec import LOWER, chunks, hashed, mix

_U = np.uint64
_MASK = _U(0xFFFFFFFFFFFF0000)
END, START = mix(np.array([0x454E44, 0x53544152], np.uint64), 9) & _MASK
WORD = 1
#: Tokens of a block of documents that is scored at once, and of a segment's blocks.
BLOCK, SEGMENT = 2_000_000, 3_000_000
LEVELS = 48
#: What a level stands for: the middle of its counts on a log scale.
VALUE = np.concatenate(([0.0, 1.0], 2.0 ** np.arange(1, LEVELS) * 1.4))


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased; 48 bits, the lower ones are 0), each
    text's followed by END, and n + 1 offsets."""
    start, end, at = texts.words()
    word = hashed(LOWER[texts.buffer], start, end)
    offsets = at + np.arange(len(at))
    out = np.empty(len(word) + len(texts), np.uint64)
    body = np.ones(len(out), bool)
    body[offsets[1:] - 1] = False
    out[body] = word & _MASK
    out[~body] = END
    return out, offsets


def ngrams(token: np.ndarray, at: np.ndarray, most: int):
    """For each order up to `most`: hashes of the n-grams that end at each token, and
    which of them are n-grams (the start mark is the first word of none but those at
    a text's beginning)."""
    size = np.diff(at)
    place = np.arange(len(token)) - np.repeat(at[:-1], size)
    gram = token
    yield gram, np.ones(len(token), bool)
    for n in range(2, most + 1):
        before = np.empty_like(gram)
        before[1:] = gram[:-1]
        if n == 2:
            before[at[:-1]] = START
        gram = mix(before * _U(0x9E3779B97F4A7C15) + (token ^ (token >> _U(29))), 10 + n)
        yield gram, place >= n - 2


# Keys on their way ---------------------------------------------------------------


def width(kind: int, bits: int) -> int:
    """Bits of a key besides its segment's: words must not be mistaken for others; of
    longer n-grams one in 1400 of a full segment may be, fewer than the filter lets pass."""
    return min(48 if kind == WORD else 32, 64 - bits)


def shorten(keys: np.ndarray, bits: int, kind: int) -> np.ndarray:
    """The segment and the `width` bits that follow."""
    return keys >> _U(64 - bits - width(kind, bits))


def _planes(x: np.ndarray, n: int, raw: int = 0) -> bytes:
    """The lower n bytes of the values, byte by byte; all but the first `raw` planes
    are compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n])
    return planes[:raw].tobytes() + zlib.compress(planes[raw:].tobytes(), 1)


def _from_planes(blob: bytes, size: int, n: int, raw: int = 0) -> np.ndarray:
    out = np.zeros((8, size), np.uint8)
    out[:raw] = np.frombuffer(blob, np.uint8, raw * size).reshape(raw, size)
    out[raw:n] = np.frombuffer(zlib.decompress(blob[raw * size :]), np.uint8).reshape(n - raw, size)
    return np.ascontiguousarray(out.T).view("<u8")[:, 0].astype(np.uint64)


def _pack(rest: np.ndarray, wide: int) -> bytes:
    """Sorted distinct keys of one segment, of `wide` bits, as differences."""
    return _planes(np.diff(rest, prepend=_U(0)), -(-wide // 8), 2)


def _unpack(blob: bytes, size: int, wide: int) -> np.ndarray:
    return np.cumsum(_from_planes(blob, size, -(-wide // 8), 2), dtype=np.uint64)


# Blocks --------------------------------------------------------------------------


_BLOCKS = "block long, tokens long, doc_ids array<long>, held_out array<boolean>, starts binary, n_words int, words binary, codes binary"


def _blocks(batches):
    """Documents in blocks: hashes of the block's distinct words, the frequent first,
    and for each token which of them it is (planes of bytes, compressed)."""
    block = TaskContext.get().partitionId() << 32
    ids, held_out, parts, sizes, held = [], [], [], [], 0

    def emit():
        words, codes, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
        blobs = [starts.tobytes()], [_planes(words[order] >> _U(16), 6, 6)], [_planes(rank[codes], 4)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.array([held], pa.int64()), pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([sum(held_out, [])], pa.list_(pa.bool_())),
                pa.array(blobs[0], pa.binary()), pa.array([len(words)], pa.int32()), *(pa.array(b, pa.binary()) for b in blobs[1:]),
            ],
            [c.split()[0] for c in _BLOCKS.split(", ")],
        )

    for batch in batches:
        for texts in chunks(batch.column(1)):
            token, at = tokens(texts)
            rows = slice(texts.first, texts.first + len(texts))
            ids.append(batch.column(0)[rows].to_pylist())
            held_out.append(batch.column(2)[rows].to_pylist())
            parts.append(token)
            sizes.append(np.diff(at))
            held += len(token)
            if held > BLOCK:
                yield emit()
                block, ids, held_out, parts, sizes, held = block + 1, [], [], [], [], 0
    if parts:
        yield emit()


def _read_block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, and n + 1 offsets by text."""
    at = np.frombuffer(row["starts"], np.int64)
    words = _from_planes(row["words"], row["n_words"], 6, 6) << _U(16)
    return words[_from_planes(row["codes"], int(at[-1]), 4).astype(np.int64)], at


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, by sorting alone."""
    keys = np.sort(keys)
    return keys[np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1]))]


def _by_segment(keys: np.ndarray, wide: int) -> list[tuple[int, slice, np.ndarray]]:
    """Sorted keys by segment: which, where, and what remains of them."""
    segment = keys >> _U(wide)
    rest = keys & _U((1 << wide) - 1)
    cut = np.append(np.flatnonzero(np.diff(segment, prepend=segment[:1] + _U(1))), len(keys))
    return [(int(segment[a]), slice(a, b), rest[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_COUNTED = "kind int, segment int, n int, keys binary, counts binary"


def _counted(bits: int, most: int):
    """The distinct training n-grams of each block by segment, in order, with their numbers."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                token, at = _read_block(row)
                trains = np.repeat(~np.array(row["held_out"], bool), np.diff(at))
                for kind, (gram, ok) in enumerate(ngrams(token, at, most), 1):
                    keys, counts = np.unique(shorten(gram[ok & trains], bits, kind), return_counts=True)
                    wide = width(kind, bits)
                    parts = _by_segment(keys, wide)
                    n = len(parts)
                    columns = [
                        pa.array([kind] * n, pa.int32()), pa.array([i for i, _, _ in parts], pa.int32()), pa.array([len(rest) for _, _, rest in parts], pa.int32()),
                        pa.array([_pack(rest, wide) for _, _, rest in parts], pa.binary()), pa.array([_planes(counts[s], 4) for _, s, _ in parts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _COUNTED.split(", ")])

    return run


_ASKED = "block long, kind int, segment int, n int, keys binary"


def _asked(bits: int, most: int):
    """The distinct n-grams of each block by segment, in order."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (gram, ok) in enumerate(ngrams(*_read_block(row), most), 1):
                    wide = width(kind, bits)
                    parts = _by_segment(_distinct(shorten(gram[ok], bits, kind)), wide)
                    n = len(parts)
                    columns = [
                        pa.array([row["block"]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([i for i, _, _ in parts], pa.int32()),
                        pa.array([len(rest) for _, _, rest in parts], pa.int32()), pa.array([_pack(rest, wide) for _, _, rest in parts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ASKED.split(", ")])

    return run


# Segments ------------------------------------------------------------------------


def _places(keys: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word (of `size`) and the four bits of it for (key, level)."""
    g = mix(keys, 100 + level)
    word = ((g >> _U(32)) * _U(size)) >> _U(32)
    one = _U(1)
    return word.astype(np.int64), one << (g & _U(63)) | one << (g >> _U(6) & _U(63)) | one << (g >> _U(12) & _U(63)) | one << (g >> _U(18) & _U(63))


class Filter:
    """A segment's part of the Bloom filter, `bits_per_key` for each level held."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits_per_key: float):
        keys, counts = keys[counts > 0], counts[counts > 0]
        level = 1 + np.floor(np.log2(counts)).astype(np.int64)
        self.words = np.zeros(max(1, int(-(-level.sum() * bits_per_key // 64))), np.uint64)
        for j in range(1, int(level.max(initial=0)) + 1):
            word, mask = _places(keys[level >= j], j, len(self.words))
            np.bitwise_or.at(self.words, word, mask)

    @classmethod
    def of(cls, words: np.ndarray) -> Filter:
        """A part as it was stored."""
        out = cls.__new__(cls)
        out.words = words
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts: the number of levels present, by repeated probes."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for j in range(1, LEVELS):
            if not len(alive):
                break
            word, mask = _places(keys[alive], j, len(self.words))
            alive = alive[self.words[word] & mask == mask]
            out[alive] = j
        return out


class Part:
    """A segment as scoring knows it: its bits, and for words their exact counts."""

    def __init__(self, bits: bytes, keys: bytes, counts: bytes):
        self.filter = Filter.of(np.frombuffer(bits, np.uint64))
        self.keys, self.counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


_PARTS = "kind int, segment int, bits binary, keys binary, counts binary, distinct long, total long"


def _built(bits: int, bits_per_key: float):
    """A segment's part of the filter, from the counts of all blocks."""

    def run(key, table):
        kind, segment = key[0].as_py(), key[1].as_py()
        blobs = zip(table.column("keys"), table.column("counts"), table.column("n").to_pylist(), strict=True)
        keys, counts = (np.concatenate(x) for x in zip(*((_unpack(k.as_py(), n, width(kind, bits)), _from_planes(c.as_py(), n, 4)) for k, c, n in blobs), strict=True))
        distinct, code = np.unique(keys, return_inverse=True)
        total = np.bincount(code, counts, len(distinct)).astype(np.int64)
        exact = (distinct.tobytes(), total.tobytes()) if kind == WORD else (b"", b"")
        values = [kind, segment, Filter(distinct, total, bits_per_key).words.tobytes(), *exact, len(distinct), int(total.sum())]
        names = [c.split() for c in _PARTS.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.table([pa.array([v], kinds[k]) for v, (_, k) in zip(values, names, strict=True)], [n for n, _ in names])

    return run


_ANSWERS = "block long, kind int, segment int, n int, levels binary, counts binary"


def _probed(bits: int):
    """What one part's probes find for all blocks: levels, and for words exact counts."""

    def run(key, asked, parts):
        kind, segment = key[0].as_py(), key[1].as_py()
        held = [Part(*(r[c] for c in ("bits", "keys", "counts"))) for r in parts.select(["bits", "keys", "counts"]).to_pylist()]
        out: dict[str, list] = {c.split()[0]: [] for c in _ANSWERS.split(", ")}
        for block, n, blob in zip(asked.column("block").to_pylist(), asked.column("n").to_pylist(), asked.column("keys"), strict=True):
            keys = _unpack(blob.as_py(), n, width(kind, bits))
            level = held[0].filter.levels(keys) if held else np.zeros(n, np.int64)  # a segment without training n-grams has no part
            exact = (held[0].exact(keys) if held else np.zeros(n, np.int64)) if kind == WORD else None
            found = (block, kind, segment, n, _planes(level, 1), b"" if exact is None else _planes(exact, 8))
            for column, value in zip(out.values(), found, strict=True):
                column.append(value)
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.table([pa.array(out[n], kinds[k]) for n, k in (c.split() for c in _ANSWERS.split(", "))], [c.split()[0] for c in _ANSWERS.split(", ")])

    return run


# Scoring -------------------------------------------------------------------------


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _block_scores(row: dict, found, bits: int, most: int, total: int, distinct: int, texts: int, smoothing: float) -> pa.RecordBatch:
    """One row for each document of a block; found(kind, keys) gives the levels of distinct
    sorted keys, and for words their exact counts."""
    token, at = _read_block(row)
    divisor = total + 0.5 * (distinct + 1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    chance = context = base = known = None
    for kind, (gram, ok) in enumerate(ngrams(token, at, most), 1):
        keys, code = np.unique(shorten(gram[ok], bits, kind), return_inverse=True)
        level, exact = found(kind, keys)
        count = np.zeros(len(token))
        count[ok] = VALUE[level][code]
        if kind == WORD:
            exact = exact[code]
            base = np.bincount(owner, np.log10((exact + 0.5) / divisor), len(at) - 1)
            known = np.bincount(owner, exact > 0, len(at) - 1).astype(np.int64)
            chance = (count + 0.5) / divisor
        else:
            prior = np.empty(len(token))
            prior[1:] = context[:-1]
            if kind == 2:
                prior[at[:-1]] = texts
            better = (count + smoothing * chance) / (np.maximum(prior, count) + smoothing)
            chance = np.where(ok, better, chance)
        context = count
    score = np.bincount(owner, np.log10(np.minimum(chance, 1.0)), len(at) - 1)
    columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCORED.split(", ")])


def _by_answers(bits: int, *options):
    """Blocks with the answers of the parts."""

    def run(_, left, right):
        answers = right.sort_by("segment").to_pylist()  # what was asked is sorted, so answers by segment are in its order

        def found(kind: int, keys: np.ndarray):
            own = [a for a in answers if a["kind"] == kind]
            level = np.concatenate([np.zeros(0, np.uint64), *(_from_planes(a["levels"], a["n"], 1) for a in own)]).astype(np.int64)
            if len(level) != len(keys):
                raise ValueError(f"{len(keys)} n-grams asked, {len(level)} answered")
            return level, np.concatenate([np.zeros(0, np.uint64), *(_from_planes(a["counts"], a["n"], 8) for a in own)]).astype(np.int64) if kind == WORD else None

        return pa.Table.from_batches([_block_scores(left.to_pylist()[0], found, bits, *options)])

    return run


def _by_broadcast(parts, bits: int, *options):
    """Blocks in which the whole filter is probed."""

    def run(batches):
        held = {(r["kind"], r["segment"]): Part(r["bits"], r["keys"], r["counts"]) for r in parts.value}

        def found(kind: int, keys: np.ndarray):
            level, exact = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for segment, s, rest in _by_segment(keys, width(kind, bits)):
                if part := held.get((kind, segment)):
                    level[s] = part.filter.levels(rest)
                    exact[s] = part.exact(rest)
            return level, exact

        for batch in batches:
            for row in batch.to_pylist():
                yield _block_scores(row, found, bits, *options)

    return run


def score(docs: DataFrame, *, held_out_of: int = 5, order: int = 3, bits_per_key: float = 10.0, smoothing: float = 2.0, broadcast_mb: float = 16.0) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score: one row for each row of `docs`; ids whose crc32 leaves 1 by
    `held_out_of` are held out of training.

    `score` uses n-grams of up to `order` words; counts stand for their power of two
    (within a factor of 1.43), and a filter of 10 bits a level takes about one n-gram
    in a hundred for one more frequent, which raises scores by a few percent.  Training
    texts are scored with their own counts, so they score higher than held-out ones.

    Nulls: a null text is empty (its end is its one token); a null id is not held
    out.  Repeated rows count each in training and score alike.  An empty table gives
    an empty result; without training texts every score is finite all the same.  A block ends
    with the text that fills it: a very long text is a block by itself, and needs some 100
    bytes of a worker's memory a word.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of == 1, F.lit(False))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    ship(spark)
    blocks = materialize(map_arrow(rows, _blocks, _BLOCKS), "lm-blocks")
    counted = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.size(F.filter("held_out", lambda h: ~h))), F.lit(0)).alias("texts")).first()
    bits = (int(counted["tokens"]) // SEGMENT).bit_length()  # segments grow with the input
    model = materialize(map_arrow(blocks, _counted(bits, order), _COUNTED).groupBy("kind", "segment").applyInArrow(_built(bits, bits_per_key), _PARTS), "lm-filter")
    size = F.sum(F.length("bits") + F.length("keys") + F.length("counts"))
    words = [F.coalesce(F.sum(F.when(F.col("kind") == WORD, F.col(c))), F.lit(0)).alias(c) for c in ("distinct", "total")]
    known = model.agg(F.coalesce(size, F.lit(0)).alias("size"), *words).first()
    options = (bits, order, int(known["total"]), int(known["distinct"]), int(counted["texts"]), smoothing)
    if known["size"] <= broadcast_mb * 1e6:
        parts = spark.sparkContext.broadcast([r.asDict() for r in model.select("kind", "segment", "bits", "keys", "counts").collect()])  # at most `broadcast_mb`
        scored = map_arrow(blocks, _by_broadcast(parts, *options), _SCORED)
    else:
        asked = map_arrow(blocks, _asked(bits, order), _ASKED)
        answers = asked.groupBy("kind", "segment").cogroup(model.groupBy("kind", "segment")).applyInArrow(_probed(bits), _ANSWERS)
        scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_by_answers(*options), _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(known["total"])).cast("long").alias("train_tokens"), "base_score", "score")
