"""Token ids of whole texts with the tokenizers library, one call for each new piece.

A word-level BPE file gives each pre-token its own ids whatever stands around it.
So a text is cut at places where the pre-tokenizer always cuts too (white space, and
between a letter and an ASCII sign or digit, but never beside an apostrophe or an
unknown non-ASCII character), each distinct piece is encoded once by the library,
and whole batches are put together from the known pieces.  Texts in which a special
token's opening `<|` stands go to the library whole.

That holds for files that normalize and cut as PIECEWISE says.  With any other
file every text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd

from .textvec import BLANK, LOWER, Texts, hashed

#: Normalizers and pre-tokenizers for which the pieces hold.
PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_LETTER, _SIGN, _FIXED = 1, 2, 3
_CLASS = np.array(
    [_LETTER if chr(b).isalpha() and b < 128 else _FIXED if b >= 128 or b == ord("'") else _SIGN for b in range(256)], np.uint8
)
_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and index by text of the pieces."""
    b = texts.buffer
    kind = _CLASS[b]
    if len(b) > 1:  # U+00C0 to U+00FF are letters but for the two arithmetic signs
        lead = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7))
        kind[lead] = _LETTER
        kind[lead + 1] = _LETTER
    cut = np.zeros(len(b), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != _FIXED) & (kind[:-1] != _FIXED)
    return texts.runs(~BLANK[b], cut)


class PieceEncoder:
    """Encodes batches; keeps up to `most` pieces and starts anew beyond."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        self.piecewise = all(spec.get(k) == v for k, v in PIECEWISE.items()) and spec["model"]["type"] == "BPE" and all("<|" in t["content"] for t in spec["added_tokens"])
        self.letters = self._letters() if self.piecewise else None
        self.forget()

    def _letters(self) -> dict[int, str] | None:
        """How the pre-tokenizer writes small letters up to U+00FF, for handing words
        of such letters to the BPE model directly; None if that isn't the same."""
        small = [chr(c) for c in range(0x61, 0x100) if _LATIN.fullmatch(chr(c)) and chr(c).lower() == chr(c)]
        if self.library.pre_tokenizer is None:
            return None
        table = {ord(c): "".join(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(c)) for c in small}
        for word in ("".join(small[i : i + 7]) for i in range(0, len(small), 7)):
            if [t.id for t in self.model.tokenize(word.translate(table))] != self.library.encode(word, add_special_tokens=False).ids:
                return None
        return table

    def _ids(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if self.letters and _LATIN.fullmatch(w):
                out[i] = [t.id for t in self.model.tokenize(w if w.isascii() else w.lower().translate(self.letters))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.library.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def forget(self) -> None:
        self.recent: dict[int, int] = {}
        self.keys: list[int] = []
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            for key, ids in zip(keys[i : i + 4096], self._ids(words[i : i + 4096]), strict=True):
                k = len(self.keys)
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
                if k == len(self.start):
                    self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
                self.flat[self.used : self.used + len(ids)] = ids
                self.start[k], self.size[k] = self.used, len(ids)
                self.recent[key] = k
                self.keys.append(key)
                self.used += len(ids)

    def _indexes(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The known piece at each place, and their index by text."""
        start, end, at = pieces(texts)
        low = LOWER[texts.buffer]
        key = hashed(low, start, end)
        found = self.index.get_indexer(key)
        missed = np.flatnonzero(found < 0)
        if len(missed):
            code, distinct = pd.factorize(key[missed])
            keys = distinct.tolist()
            new = [i for i, k in enumerate(keys) if k not in self.recent]
            if len(self.keys) + len(new) > self.most and self.keys:
                self.forget()
                return self._indexes(texts)
            if new:
                first = np.empty(len(keys), np.int64)
                first[code[::-1]] = missed[::-1]
                s, e = start[first[new]].tolist(), end[first[new]].tolist()
                raw = low.tobytes()
                self._learn([keys[i] for i in new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e, strict=True)])
            found[missed] = np.array([self.recent[k] for k in keys], np.int64)[code]
            if len(self.recent) > 2000 + len(self.index) // 4:
                self.index, self.recent = pd.Index(np.array(self.keys, np.uint64)), {}
        return found, at

    def _special(self, texts: Texts) -> list[int]:
        raw = texts.buffer.tobytes()
        if b"<|" not in raw:
            return []
        return [i for i in range(len(texts)) if b"<|" in raw[texts.at[i] : texts.at[i + 1]]]

    def _whole(self, texts: Texts, i: int) -> list[int]:
        return self.library.encode(self._text(texts, i), add_special_tokens=False).ids

    @staticmethod
    def _text(texts: Texts, i: int) -> str:
        return texts.buffer[texts.at[i] : texts.at[i + 1]].tobytes().decode("utf-8", "replace")

    def _all_whole(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch([self._text(texts, i) for i in range(len(texts))], add_special_tokens=False)]
        at = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        return np.fromiter((t for x in ids for t in x), np.int32, int(at[-1])), at

    def lengths(self, texts: Texts) -> np.ndarray:
        """The number of ids of each text."""
        if not self.piecewise:
            return np.diff(self._all_whole(texts)[1])
        index, at = self._indexes(texts)
        total = np.concatenate(([0], np.cumsum(self.size[index], dtype=np.int64)))
        out = total[at[1:]] - total[at[:-1]]
        for i in self._special(texts):
            out[i] = len(self._whole(texts, i))
        return out

    def encode(self, texts: Texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets by text; `end_id` closes each text."""
        if self.piecewise:
            index, at = self._indexes(texts)
            size = self.size[index].astype(np.int64)
            to = np.concatenate(([0], np.cumsum(size)))
            ids = self.flat[np.repeat(self.start[index] - to[:-1], size) + np.arange(to[-1])]
            offsets = to[at]
        else:
            ids, offsets = self._all_whole(texts)
        if self.piecewise and (special := self._special(texts)):
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            for i in special:
                parts[i] = np.array(self._whole(texts, i), np.int32)
            ids = np.concatenate(parts)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        if end_id is None:
            return ids, offsets
        closed = np.empty(len(ids) + len(texts), np.int32)
        offsets = offsets + np.arange(len(offsets))
        body = np.ones(len(closed), bool)
        body[offsets[1:] - 1] = False
        closed[body] = ids
        closed[~body] = end_id
        return closed, offsets


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
