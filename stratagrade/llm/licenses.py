"""License scans by template markup compiled into token automata.

A template is wording with two kinds of regions.  <<optional>>...<<end>> may be left
out.  Replaceable regions stand for other wording: <<any N>> for up to N words of any
kind, <<one of a | b c>> for one of the listed wordings.  A template is compiled into a
nondeterministic automaton over words; a text is accepted where all mandatory words
follow exactly.  It ends with mandatory wording or a list, so that no license is taken
for another whose name goes on.  Each template opens with three mandatory words, whose
hash marks the places at which its automaton is started, so that texts without such
wording cost one vectorised look-up.

Base phrases are plain word sequences, found at every place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import map_arrow
from .textvec import LOWER, NOT_ALNUM, chunks, hashed, windows

OPENING = 3

#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: License wording, with what may vary marked.
NOTICES = (
    ("gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3", "gpl-3"),
    ("gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 2", "gpl-2"),
    ("gnu general public license v3", "gpl-3"),
    ("gnu general public license v2", "gpl-2"),
    ("gnu lesser general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> <<one of version 2 | version 3 | v2 | v3>>", "lgpl"),
    ("gnu affero general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> <<one of version 3 | v3>>", "agpl-3"),
    ("terms of the mozilla public license <<optional>>version<<end>> <<optional>>v<<end>> 2 0", "mpl-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("eclipse public license <<optional>>version<<end>> <<optional>>v<<end>> 2 0", "epl-2"),
    ("boost software license <<optional>>version<<end>> 1 0", "bsl-1"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    (
        "permission to use copy modify <<optional>>and<<end>> <<optional>>or<<end>> distribute this software <<optional>>and its documentation<<end>>"
        " for any purpose with or without fee is hereby granted",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "bsd",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising"
        " from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to"
        " alter it and redistribute it freely",
        "zlib",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"
        " covered by this license the software to use reproduce display distribute execute and transmit the software",
        "bsl-1",
    ),
    (
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
        "wtfpl",
    ),
)

#: The Creative Commons licenses by label: their full and short names.
CREATIVE_COMMONS = {
    "cc-by": ("", "by"),
    "cc-by-sa": ("<<one of sharealike | share alike>>", "by sa"),
    "cc-by-nc": ("<<one of noncommercial | non commercial>>", "by nc"),
    "cc-by-nd": ("<<one of noderivatives | noderivs | no derivatives | no derivs>>", "by nd"),
    "cc-by-nc-sa": ("<<one of noncommercial | non commercial>> <<one of sharealike | share alike>>", "by nc sa"),
    "cc-by-nc-nd": ("<<one of noncommercial | non commercial>> <<one of noderivatives | noderivs | no derivatives | no derivs>>", "by nc nd"),
}
_VERSION = "1 0 | 2 0 | 2 1 | 2 5 | 3 0 | 4 0"

#: Short identifiers.
IDENTIFIERS = (
    ("mit", "mit"), ("apache 2 0", "apache-2"), ("gpl 3 0", "gpl-3"), ("gpl 2 0", "gpl-2"), ("<<one of lgpl 2 1 | lgpl 3 0>>", "lgpl"), ("agpl 3 0", "agpl-3"), ("mpl 2 0", "mpl-2"),
    ("isc", "isc"), ("<<one of bsd 2 clause | bsd 3 clause>>", "bsd"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl 1 0", "bsl-1"), ("epl 2 0", "epl-2"), ("cc0 1 0", "cc0"),
)

TEMPLATES = (
    *NOTICES,
    *((f"spdx license identifier {name}", label) for name, label in IDENTIFIERS),
    ("cc0 1 0 universal", "cc0"),
    *((f"creative commons attribution {full} <<one of license | {_VERSION}>>", label) for label, (full, _) in CREATIVE_COMMONS.items()),
    *((f"{opening} cc {short} <<one of license | {_VERSION}>>", label) for label, (_, short) in CREATIVE_COMMONS.items() for opening in ("licensed under", "under a", "under the")),
    *((f"creativecommons org licenses {short} <<one of {_VERSION}>>", label) for label, (_, short) in CREATIVE_COMMONS.items()),
    *((f"spdx license identifier cc {short} <<one of {_VERSION}>>", label) for label, (_, short) in CREATIVE_COMMONS.items()),
)


@dataclass
class Automaton:
    """States with word, any-word and empty moves; `weight` counts mandatory words."""

    label: str
    opening: list[str]
    words: list[dict[str, int]] = field(default_factory=list)
    any_word: list[int | None] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    done: list[int] = field(default_factory=list)  # mandatory words before the state
    final: int = 0
    weight: int = 0

    def state(self, done: int) -> int:
        self.words.append({})
        self.any_word.append(None)
        self.empty.append([])
        self.done.append(done)
        return len(self.words) - 1

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def run(self, words: Iterator[str]) -> tuple[bool, int]:
        """Whether some start of `words` is accepted, and the most mandatory words
        that were matched on the way."""
        now, best = self.closed({0}), 0
        for word in words:
            now = self.closed({t for s in now for t in (self.words[s].get(word), self.any_word[s]) if t is not None})
            if not now:
                return False, best
            best = max(best, *(self.done[s] for s in now))
            if self.final in now:
                return True, self.weight
        return False, best


def marks(markup: str) -> list[str]:
    """The words and marks of a template."""
    return re.findall(r"<<(?:optional|end|any \d+|one of [^<>]+)>>|[^\s<>]+", markup.lower())


def compile_template(markup: str, label: str) -> Automaton:
    """Raises ValueError on unbalanced marks, fewer than three opening words, or an end
    that may be left out.  A list of wordings weighs as one mandatory word."""
    tokens = marks(markup)
    out = Automaton(label, tokens[:OPENING])
    if len(tokens) < OPENING or any(t.startswith("<<") for t in tokens[:OPENING]):
        raise ValueError(f"a template opens with {OPENING} mandatory words: {markup[:60]!r}")
    if tokens[-1] == "<<end>>" or tokens[-1].startswith("<<any"):
        raise ValueError(f"a template ends with mandatory wording: {markup[-60:]!r}")
    at, depth = out.state(0), []
    for t in tokens:
        if t == "<<optional>>":
            depth.append(at)
            inner = out.state(out.done[at])
            out.empty[at].append(inner)
            at = inner
        elif t == "<<end>>":
            if not depth:
                raise ValueError("<<end>> without <<optional>>")
            after = out.state(out.done[at])
            out.empty[at].append(after)
            out.empty[depth.pop()].append(after)
            at = after
        elif t.startswith("<<any"):
            last = out.state(out.done[at])
            for _ in range(int(t[6:-2])):
                out.empty[at].append(last)
                following = out.state(out.done[at])
                out.any_word[at] = following
                at = following
            out.empty[at].append(last)
            at = last
        elif t.startswith("<<one of"):
            last = out.state(out.done[at] + (not depth))
            for wording in t[9:-2].split("|"):
                now = out.state(out.done[at])
                out.empty[at].append(now)
                for word in wording.split():
                    following = out.state(out.done[at])
                    out.words[now][word] = following
                    now = following
                out.empty[now].append(last)
            at = last
        else:
            following = out.state(out.done[at] + (not depth))
            out.words[at][t] = following
            at = following
    if depth:
        raise ValueError("<<optional>> without <<end>>")
    out.final, out.weight = at, out.done[at]
    return out


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(r) for r in raw])
    return hashed(np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(phrases, templates):
    machines = [compile_template(*t) for t in templates]
    keyed = [(np.uint64(windows(_hash(m.opening), np.array([0, OPENING]), OPENING)[0][0]), m) for m in machines]
    plain = [(p.split(), _hash(p.split()), label) for p, label in phrases]
    openings = np.array(sorted({int(k) for k, _ in keyed}), np.uint64)

    def one(batch_ids, texts):
        low = LOWER[texts.buffer]
        start, end, at = texts.words(NOT_ALNUM)
        word = hashed(low, start, end)
        n = len(texts)
        text = lambda i: low[start[i] : end[i]].tobytes().decode("utf-8", "replace")
        places: dict[int, list[int]] = {}
        base: dict[int, set[str]] = {}
        more: dict[int, set[str]] = {}
        score = np.zeros(n)
        for words, wanted, label in plain:
            hit = np.flatnonzero(word[: max(0, len(word) - len(wanted) + 1)] == wanted[0])
            for k in range(1, len(wanted)):
                hit = hit[word[hit + k] == wanted[k]]
            owner = np.searchsorted(at, hit, "right") - 1
            for i, d in zip(hit.tolist(), owner.tolist(), strict=True):
                if i + len(wanted) <= at[d + 1] and [text(i + k) for k in range(len(words))] == words:
                    places.setdefault(d, []).append(i - int(at[d]))
                    base.setdefault(d, set()).add(label)
                    score[d] = 1.0
        if len(openings) and len(word) >= OPENING:
            grams, gram_at = windows(word, at, OPENING)
            hit = np.flatnonzero(np.isin(grams, openings))
            for g, d in zip(hit.tolist(), (np.searchsorted(gram_at, hit, "right") - 1).tolist(), strict=True):
                i = int(at[d]) + g - int(gram_at[d])
                for key, machine in keyed:
                    if grams[g] == key:
                        accepted, matched = machine.run(text(j) for j in range(i, int(at[d + 1])))
                        score[d] = max(score[d], matched / machine.weight)
                        if accepted:
                            more.setdefault(d, set()).add(machine.label)
        all_of = lambda x: [x.get(d) for d in range(n)]
        found, by_base, by_all = all_of(places), all_of(base), [base.get(d, set()) | more.get(d, set()) for d in range(n)]
        joined = lambda x: ",".join(sorted(x or ()))
        return pa.RecordBatch.from_arrays(
            [
                batch_ids.slice(texts.first, n),
                pa.array(np.diff(at)),
                pa.array([len(f or ()) for f in found], pa.int64()),
                pa.array([min(f) if f else None for f in found], pa.int64()),
                pa.array([max(f) if f else None for f in found], pa.int64()),
                pa.array([joined(x) for x in by_base], pa.string()),
                pa.array([joined(x) for x in by_all], pa.string()),
                pa.array(score),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                yield one(batch.column(0), texts)

    return run


def scan(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """docs(doc_id, text, ...) -> SCHEMA, one row for each row of `docs`.

    Labels are distinct, sorted and comma-joined, empty if none; `labels` has those
    of accepted templates besides the base ones.  score: the largest share of a
    template's mandatory words that was matched (1: accepted, or a base phrase).

    Nulls: a null text is empty, with no words and empty labels; a null id is kept.
    Very long texts are read whole; wordings at one place each give their label.
    Repeated rows give repeated results, an empty table an empty one.  Other columns
    are ignored, whatever their names.
    """
    return map_arrow(docs.select("doc_id", "text"), _scan(phrases, templates), SCHEMA)
