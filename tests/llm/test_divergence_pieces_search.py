import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratagrade.llm import divergence, pieces, search
from stratagrade.llm.textvec import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Divergence of sources ------------------------------------------------------------


def audited(docs, min_docs=3, most=200):
    """All terms of all pairs, one by one."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for text, lang, source in docs]
    out = set()
    for lang in {x for x, _, _ in words}:
        own = [(s, w) for x, s, w in words if x == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in df.items() if n >= min_docs}
        count = defaultdict(Counter)
        for s, w in own:
            count[s].update(t for t in w if t in kept)
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for n in [c.total()] for t in kept}  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        q, share = p(whole), {s: p(c) for s, c in count.items()}
        for s in count:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(-f(share[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and share[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


def got_audit(df, **options):
    rows = divergence.audit(df, **options).collect()
    assert len(rows) == len(set(rows))
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}


def test_divergence(spark, docs, nothing):
    more = [("alpha Alpha beta", None, None), ("beta ALPHA gamma", None, "b"), ("alpha beta", None, "c"), (None, "zz", "only"), ("", "zz", None), ("solo", "yy", "one")]
    df = docs.select("text", "lang", "source", "size").unionByName(spark.createDataFrame([(*x, "x") for x in more], "text string, lang string, source string, size string"))
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    assert got_audit(df) == audited(rows)
    assert got_audit(df, min_docs=1, most_terms=3) == audited(rows, 1, 3)
    assert divergence.audit(nothing).count() == 0


def test_many_sources_and_a_hot_one(spark):
    rng = random.Random(5)
    rows = [(" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(4))}" for _ in range(rng.randrange(40))), "en", "hot" if i % 3 == 0 else f"s{rng.randrange(40)}") for i in range(600)]
    assert got_audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)) == audited(rows)


def test_overlaps_in_chunks(monkeypatch):
    """A term whose pairs go beyond a chunk, against all pairs."""
    rng = np.random.Generator(np.random.PCG64(3))
    term = np.repeat(np.arange(50), rng.integers(1, 30, 50))
    group = np.concatenate([rng.permutation(40)[:n] for n in np.bincount(term)])
    p, zero = rng.integers(1, 10**9, len(term)), rng.integers(1, 10**6, 40)[group]
    want = Counter()
    for i in range(len(term)):
        for j in range(len(term)):
            if i != j and term[i] == term[j]:
                f = lambda a, b: (int(a) - int(b)) ** 2 // int(b)
                want[int(group[i]), int(group[j])] += f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
    for size in (1, 17, 1 << 20):
        monkeypatch.setattr(divergence, "PAIRS", size)
        tool = divergence._Overlaps()
        tool.add(term, group.astype(np.int64), p, zero)
        assert {(k >> 32, k & 0xFFFFFFFF): v for k, v in zip(tool.keys.tolist(), tool.sums.tolist(), strict=True)} == want


def test_large_counts(spark):
    """10^9 times such a count has more than 64 bits."""
    n, total, terms = 10**13, 5 * 10**13, 7 * 10**8
    row = spark.createDataFrame([(n, total, terms), (3, total, terms)], "n long, total long, terms long").select(divergence.share("n", "total", "terms").alias("p")).collect()
    assert [r["p"] for r in row] == [1 + 10**9 * (x + 1) // (total + terms) for x in (n, 3)]


# SentencePiece --------------------------------------------------------------------

ODD = [
    " ", "  two", "a\nb\tc\r\n", "é\x00x", "<s>hi</s><0x41><unk>", "▁x ▁ y", "a" * 2000, " " * 1500 + "x" + " " * 40, "=-" * 700, "ab" * 500 + "  ", "﻿z", "\x85 　", "日本語😀", "ＡＢ́",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def odd_docs(spark, docs):
    return docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(600000 + i, t, 0) for i, t in enumerate(ODD)], "doc_id long, text string, key int"))


def test_pieces_round_trip(odd_docs, nothing, library):
    want, texts = Counter(), Counter()
    for r in odd_docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        said = library.decode(ids)
        texts[r["doc_id"], said] += 1
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += 1
    encoded = pieces.encode(odd_docs, model=MODEL)
    assert Counter(tuple(r) for r in pieces.digests(encoded, model=MODEL).collect()) == want
    assert Counter(tuple(r) for r in pieces.decode(encoded, model=MODEL).collect()) == texts
    bare = {r["doc_id"]: r["ids"] for r in pieces.encode(odd_docs.where("doc_id BETWEEN 600000 AND 700000"), model=MODEL, ends=False).collect()}
    assert bare == {600000 + i: library.encode(t) for i, t in enumerate(ODD)}
    assert pieces.digests(pieces.encode(nothing, model=MODEL), model=MODEL).count() == 0


def test_rounds_and_queue_agree_with_the_library(library, monkeypatch):
    rng = random.Random(8)
    alphabet = [*"abcdeé ▁ \n\t.,'0123日本語😀 　ünïß", "the", "ing", "  ", "     "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(1500)] + ["".join(rng.choices("aeinst ", k=rng.randint(1, 500))) for _ in range(200)]
    want = [library.encode(t) for t in texts]
    tool = pieces.model(MODEL)
    for long in (300, 3, 1):  # 1: every word of several symbols goes through the queue
        monkeypatch.setattr(pieces, "LONG", long)
        got = []
        for block in chunks(pa.array(texts), 20_000):
            ids, at = tool.encode(block, ends=False)
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == want


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(2)
    lists = [[], [1, 2], [0], [28705], [1, 28705, 28705, 264], [259, 264, 2, 259]] + [[rng.choice([1, 2, *range(259, 32000)]) for _ in range(rng.randint(1, 30))] for _ in range(200)]
    df = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(df, model=MODEL).collect()}
    assert got == {-1: ""} | {i: library.decode(x) for i, x in enumerate(lists)}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as spec

    proto = spec.ModelProto.FromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = spec.TrainerSpec.UNIGRAM
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="BPE"):
        pieces.Model(str(tmp_path / "other.model"))


def test_model_that_normalizes(tmp_path):
    """Blanks that the library drops before it encodes."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as spec

    proto = spec.ModelProto.FromString(open(MODEL, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "strict.model").write_bytes(proto.SerializeToString())
    own = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "strict.model"))
    texts = ["  two   words ", "", "   ", "one", "a  b  c"]
    ids, at = pieces.Model(str(tmp_path / "strict.model")).encode(next(chunks(pa.array(texts))), ends=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.encode(t) for t in texts]


# Search ---------------------------------------------------------------------------


def searched(docs, items, top=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    own = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = Counter()
    for item, terms in asked.items():
        found = []
        for doc, c in own:
            if c:
                m = 50 + 50 * c.total() * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
                if score > 0:
                    found.append((-score, doc is None, doc))
        out.update((item, k, doc, -score) for k, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1))
    return out


def test_search(spark, docs, rows, nothing):
    plain = [(i, t) for i, t, _ in rows]
    some = [t for _, t in plain if t and len(t) > 200]
    items = [(1, some[0][:300]), (2, "words LINE of"), (3, None), (4, ""), (5, "nowhereatall"), (6, "same text"), (6, "日本語 of"), (None, "a null id"), (7, some[3])]
    df = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, size string")
    for top, most in ((50, 500_000), (3, 500_000), (50, 4)):  # 4: a pass for nearly every query
        got = Counter(tuple(r) for r in search.rank(docs, df, top=top, most_terms=most).select("item_id", "rank", "doc_id", "score").collect())
        assert got == searched(plain, items, top)
    assert search.rank(nothing, df).count() == 0
    assert search.rank(docs, df.limit(0)).columns == ["item_id", "rank", "doc_id", "score"] and search.rank(docs, df.limit(0)).count() == 0


def test_windows_and_heaps(monkeypatch):
    """Many small windows of few cells, ties across them, and both widths of repeats."""
    monkeypatch.setattr(search, "WINDOW", 128)
    monkeypatch.setattr(search, "CELL", 16)
    monkeypatch.setattr(search, "SEGMENT", 512)
    rng = random.Random(6)
    ids = rng.sample(range(10**6), 1500)
    plain = [(i, " ".join(rng.choices("abcdefgh", k=rng.choice((2, 2, 2, 30))))) for i in ids] + [(5, "a " * 400), (5, "a " * 400)]
    items = [(1, "a b"), (2, "h"), (3, "a b c d e f g h"), (4, "x")]
    queries = next(search._passes(_Rows(items), 100))
    held = type("Held", (), {"value": queries})
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part])], ["doc_id", "text"])
    windows = [w for b in search._indexed(held)([batch(plain[:700]), batch(plain[700:])]) for w in b.to_pylist()]
    assert len(windows) > 10
    n, total = (sum(w[c] for w in windows) for c in ("n_docs", "n_terms"))
    holding = Counter()
    for w in windows:
        holding.update(dict(zip(w["terms"], w["counts"], strict=True)))
    weights = np.array([search.weight(n, holding[k]) for k in range(len(queries.terms))])
    for top in (1, 50):
        searcher = search.Searcher(queries, top)
        for w in windows:
            searcher.feed(search.Postings(w, weights, n, total))
        got = {(i, -d, s) for i, heap in zip(queries.ids, searcher.heaps, strict=True) for s, d in heap}
        assert got == {(i, d, s) for i, _, d, s in searched(plain, items, top)}


class _Rows:
    """Just enough of a DataFrame for the driver's part."""

    def __init__(self, rows):
        self.rows = rows

    def select(self, *_):
        return self

    def orderBy(self, *_):
        return self

    def toLocalIterator(self):
        return iter([{"item_id": i, "text": t} for i, t in self.rows])


def test_lengths_beyond_64_bits():
    size, n, total = np.array([10**7, 3]), 10**13, 10**15
    m = [50 + 50 * int(s) * n // total for s in size]
    assert search.shares(np.array([7, 2]), size, n, total).tolist() == [7 * 10**9 // (7000 + 20 * m[0]), 2 * 10**9 // (2000 + 20 * m[1])]


def test_search_finds_null_ids_last_and_repeats(spark):
    df = spark.createDataFrame([(None, "q"), (3, "q"), (3, "q"), (-4, "q"), (9, "r s")], "doc_id long, text string")
    got = [(r["rank"], r["doc_id"]) for r in search.rank(df, spark.createDataFrame([(1, "q")], "item_id long, text string")).orderBy("rank").collect()]
    assert got == [(1, -4), (2, 3), (3, 3), (4, None)]
    assert search.rank(df, spark.createDataFrame([(1, "q")], "item_id long, text string")).where(F.col("score") <= 0).isEmpty()
