"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds.

A block of texts is one flat array of symbols.  It is cut into words wherever two
neighbours stand together in no piece of the vocabulary, since no merge can cross such
a place; each distinct word is merged once.  A round finds every word's lowest pair rank
(segmented minimum), merges its leftmost pair of that rank, all words at once, and closes
the gaps; words without a pair leave.  One merge a word and round is what a queue by
(rank, place) would do, so the outcome is the library's.  Words of more than LONG symbols
(rows of blanks or signs) would need as many rounds and go through such a queue.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_arrow
from .textvec import Texts, chunks, hashed

BLOCK = 4 << 20
LONG = 300
SPACE = "▁"
_NONE = np.iinfo(np.int32).max


class Model:
    """A BPE model file with byte fallback, as arrays.

    Symbols are the ids of the pieces; characters that stand in pieces without being
    one follow after them.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as spec

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        read = spec.ModelProto.FromString(self.library.serialized_model_proto())
        kinds = spec.ModelProto.SentencePiece
        usual = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        if read.trainer_spec.model_type != spec.TrainerSpec.BPE or not read.trainer_spec.byte_fallback or any(p.type not in usual for p in read.pieces):
            raise ValueError(f"{path}: not a BPE model with byte fallback and pieces of the usual kinds only")
        form = read.normalizer_spec
        self.plain = not form.precompiled_charsmap and not form.remove_extra_whitespaces and form.escape_whitespaces and form.add_dummy_prefix and not read.trainer_spec.treat_whitespace_as_suffix
        self.strips = form.add_dummy_prefix or form.remove_extra_whitespaces
        self.bos, self.eos = read.trainer_spec.bos_id, read.trainer_spec.eos_id
        normal = {p.piece: i for i, p in enumerate(read.pieces) if p.type == kinds.NORMAL}
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(read.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
        self.n_pieces = len(read.pieces)
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, self.n_pieces + len(symbols) - len(normal))
        self.wide = max(symbols.values(), default=0) + 1
        self._characters(symbols, normal)
        self._pairs(symbols, normal, [p.score for p in read.pieces])
        self._surfaces(read, kinds)

    def _characters(self, symbols: dict, normal: dict) -> None:
        """The symbol of each code point (-1: in no piece), and which neighbours stand
        together in a piece."""
        self.symbol = np.full(0x110000, -1, np.int32)
        alphabet = sorted({c for piece in normal for c in piece} | {SPACE})
        for c in alphabet:
            self.symbol[ord(c)] = symbols.get(c, -1)
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.letter = np.zeros(0x110000, np.int32)  # 0: a character that meets no other
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.letter[ord(" ")] = self.letter[ord(SPACE)]
        self.meet = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        for piece in normal:
            at = self.letter[[ord(c) for c in piece]]
            self.meet[at[:-1], at[1:]] = True

    def _pairs(self, symbols: dict, normal: dict, score: list[float]) -> None:
        """Key, rank and outcome of each pair of symbols that makes a piece."""
        found = [(symbols[p[:k]] * self.wide + symbols[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        key, into = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(key)
        _, rank = np.unique(-np.array(score), return_inverse=True)
        self.into, self.rank = np.append(into[order], 0).astype(np.int32), np.append(rank[into[order]], _NONE).astype(np.int32)
        self.pair = pd.Index(key[order])

    def _surfaces(self, read, kinds) -> None:
        """What each id stands for, back to back in one buffer."""
        out = []
        for p in read.pieces:
            if p.type == kinds.NORMAL:
                out.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.BYTE:
                out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                out.append(read.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
        self.size = np.array([len(x) for x in out], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.surface = np.frombuffer(b"".join(out), np.uint8)
        self.opens = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in read.pieces])
        self.silent = np.array([p.type == kinds.CONTROL for p in read.pieces])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and outcome of pairs of symbols; rank _NONE where they make no piece."""
        at = self.pair.get_indexer(left.astype(np.int64) * self.wide + right)
        return self.rank[at], self.into[at]

    # Encoding ------------------------------------------------------------------------

    def _prepared(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the normalized texts and n + 1 offsets; a blank stands for SPACE."""
        buffer, at = texts.buffer, texts.at
        if not self.plain:
            raw = [self.library.normalize(buffer[a:b].tobytes().decode("utf-8", "replace")).encode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
        full = np.diff(at) > 0
        return np.insert(buffer, at[:-1][full], 32), at + np.concatenate(([0], np.cumsum(full)))

    def encode(self, texts: Texts, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets by text; with `ends`, begin and end ids around each."""
        buffer, at = self._prepared(texts)
        points = np.frombuffer(buffer.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((buffer & 0xC0) != 0x80)  # of each character
        letter = self.letter[points]
        opens = np.ones(len(points), bool)
        opens[1:] = ~self.meet[letter[:-1], letter[1:]]
        opens[np.searchsorted(place, at[:-1][np.diff(at) > 0])] = True
        first = np.flatnonzero(opens)  # words' first characters
        edge = np.append(first, len(points))
        start = np.append(place[first], len(buffer))
        code, distinct = pd.factorize(hashed(buffer, start[:-1], start[1:]))
        sample = np.empty(len(distinct), np.int64)
        sample[code[::-1]] = np.arange(len(code))[::-1]
        ids, size = self._words(points, edge[sample], edge[sample + 1])
        # words back in their places
        begin = np.cumsum(size) - size
        size, begin = size[code], begin[code]
        to = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
        offsets = to[np.searchsorted(start[:-1], at)]
        if not ends:
            return flat, offsets
        n = len(texts)
        out = np.empty(len(flat) + 2 * n, np.int32)
        closed = offsets + 2 * np.arange(n + 1)
        body = np.ones(len(out), bool)
        body[closed[:-1]] = body[closed[1:] - 1] = False
        out[body] = flat
        out[closed[:-1]], out[closed[1:] - 1] = self.bos, self.eos
        return out, closed

    def _words(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words points[begin:end], one after another, and their numbers."""
        size = end - begin
        where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        word = np.repeat(np.arange(len(size)), size)
        symbol = self.symbol[points[where]]
        unknown = symbol < 0  # such a character is a word by itself
        symbol[unknown] = -1 - points[where][unknown].astype(np.int32)
        long = size[word] > LONG
        done = [(word[symbol < 0], symbol[symbol < 0])]
        for w in np.flatnonzero(size > LONG).tolist():
            merged = self._by_queue(symbol[word == w])
            done.append((np.full(len(merged), w), merged))
        rest = ~long & (symbol >= 0)
        done += self._rounds(symbol[rest], word[rest])
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return self._with_bytes(word[order], symbol[order], len(size))

    def _rounds(self, symbol: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(word, symbol) arrays of the merged words, by the round in which they end."""
        out = []
        rank, into = np.full(len(symbol), _NONE, np.int32), np.zeros(len(symbol), np.int32)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], into[same] = self.look_up(symbol[same], symbol[same + 1])
        while len(symbol):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(start, append=len(word))
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            ended = least == _NONE
            if ended.any():
                out.append((word[ended], symbol[ended]))
                symbol, word, rank, into, least = (x[~ended] for x in (symbol, word, rank, into, least))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            at = hit[np.diff(word[hit], prepend=-1) != 0]  # the leftmost of each word
            symbol[at] = into[at]
            alive = np.ones(len(symbol), bool)
            alive[at + 1] = False
            at = at - np.arange(len(at))  # each merge before moved it by one
            symbol, word, rank, into = (x[alive] for x in (symbol, word, rank, into))
            touched = np.zeros(len(symbol), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            rank[fresh] = _NONE
            fresh = fresh[fresh + 1 < len(word)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh], into[fresh] = self.look_up(symbol[fresh], symbol[fresh + 1])
        return out

    def _by_queue(self, symbol: np.ndarray) -> np.ndarray:
        """One long word, merged in the order of (rank, place)."""
        symbols, n = symbol.tolist(), len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, into = (x.tolist() for x in self.look_up(symbol[:-1], symbol[1:]))
        queue = [(r, i, symbols[i], symbols[i + 1], to) for i, (r, to) in enumerate(zip(rank, into, strict=True)) if r != _NONE]
        heapq.heapify(queue)
        known: dict = {}

        def offer(i: int, j: int) -> None:
            pair = symbols[i], symbols[j]
            if pair not in known:
                r, to = self.look_up(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = int(r[0]), int(to[0])
            r, to = known[pair]
            if r != _NONE:
                heapq.heappush(queue, (r, i, *pair, to))

        while queue:
            _, i, left, right, to = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = to, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([s for s in symbols if s is not None], np.int32)

    def _with_bytes(self, word: np.ndarray, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the ids of their bytes."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.n_pieces))
        if not len(odd):
            return symbol, np.bincount(word, minlength=n)
        spelt = dict(zip(self.symbol.tolist(), range(0x110000), strict=True)) if (symbol[odd] >= self.n_pieces).any() else {}
        raw = [chr(-1 - s if s < 0 else spelt[s]).encode() for s in symbol[odd].tolist()]
        size = np.ones(len(symbol), np.int64)
        size[odd] = [len(x) for x in raw]
        out = np.repeat(symbol, size)
        first = (np.cumsum(size) - size)[odd]
        more = np.repeat(first - (np.cumsum(size[odd]) - size[odd]), size[odd]) + np.arange(size[odd].sum())
        out[more] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(np.repeat(word, size), minlength=n)

    # Decoding ------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes and n + 1 offsets: pieces back to back, without the blank
        that opens a text's first piece."""
        size, start = self.size[ids], self.start[ids]
        if self.strips:
            heard = np.flatnonzero(~self.silent[ids])
            nth = np.searchsorted(heard, at)
            first = heard[nth[:-1][nth[:-1] < nth[1:]]]
            first = first[self.opens[ids[first]]]
            size[first] -= 1
            start[first] += 1
        to = np.concatenate(([0], np.cumsum(size)))
        return self.surface[np.repeat(start - to[:-1], size) + np.arange(to[-1])], to[at]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The process's model of a file."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _encoded(path: str, ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(path)
        for batch in batches:
            for texts in chunks(batch.column(1), BLOCK):
                ids, at = tool.encode(texts, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, *, model: str, ends: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids: what the library's encode() gives for each
    whole text, with begin and end ids if `ends`.

    Nulls: a null text is empty and has no ids but begin and end; a null id is kept.
    Repeated rows are encoded each.  A very long text is a block of its own, and needs
    some 40 bytes of a worker's memory for each of its own.  Equal pairs in a word are
    merged from the left.  An empty table gives an empty result.  Other columns are
    ignored, whatever their names.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _encoded(model, ends), "doc_id long, ids array<int>")


def _parts(column: pa.ListArray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lists of a column (null: empty) in blocks: the first row, the values, the offsets."""
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(column.flatten())
    at = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(path)
        for batch in batches:
            for i, ids, at in _parts(batch.column(1)):
                raw, to = tool.decode(ids, at)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(at) - 1), text.cast(pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return run


def decode(rows: DataFrame, *, model: str) -> DataFrame:
    """rows(doc_id, ids, ...) -> doc_id, text, as the library's decode(): control ids say
    nothing, bytes stand for themselves.  Ids must be the model's, and their bytes UTF-8,
    as encode() gives them.  Null or no ids are an empty text."""
    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), _decoded(model), "doc_id long, text string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(path)
        for batch in batches:
            for i, ids, at in _parts(batch.column(1)):
                raw, to = (x.tobytes() if k == 0 else x.tolist() for k, x in enumerate(tool.decode(ids, at)))
                flat, n = ids.astype("<u4").tobytes(), at.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(n) - 1), pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(n[:-1], n[1:], strict=True)]),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(to[:-1], to[1:], strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def digests(encoded: DataFrame, *, model: str) -> DataFrame:
    """encode()'s rows -> doc_id, n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (of the decoded text in UTF-8)."""
    return map_arrow(encoded.select("doc_id", "ids"), _digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
