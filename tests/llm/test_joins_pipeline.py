import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from test_mixing_sharding import WORD, fill, shards_by_hand
from stratagrade.llm import rules, similarity_join, tiling
from stratagrade.llm.queries import oracle_sql, queries


def low(text):
    return (text or "").encode().lower().split()


def by_hand(texts, n, num, den):
    """id -> (set size, component) by comparing all pairs."""
    sets = []
    for _, t in texts:
        w = low(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                    links += 1
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(texts):
        if key is not None:
            least[find(i)].append(key)
    return Counter((key, len(sets[i]), min(least[find(i)], default=None)) for i, (key, _) in enumerate(texts)), links


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100)])
def test_join_finds_every_link(spark, copies, n, num, den):
    texts = list(enumerate(copies))
    want, links = by_hand(texts, n, num, den)
    assert links > 50
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = similarity_join.link(df, words=n, similarity=(num, den)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_join_edges(docs, rows, nothing):
    got = similarity_join.link(docs, words=4, similarity=(85, 100)).collect()
    assert Counter(tuple(r) for r in got) == by_hand([(i, t) for i, t, _ in rows], 4, 85, 100)[0]
    assert similarity_join.link(nothing).count() == 0


def test_any_order_gives_all_links(spark, copies, monkeypatch):
    """The sketch only orders: with every shingle ranked alike the result is the same."""
    texts = list(enumerate(copies))
    monkeypatch.setattr(similarity_join, "_ranks", lambda *_: np.zeros(1 << 21, np.uint8))
    got = similarity_join.link(spark.createDataFrame(texts, "doc_id long, text string"), words=4, similarity=(85, 100)).collect()
    assert Counter(tuple(r) for r in got) == by_hand(texts, 4, 85, 100)[0]


def test_texts_just_below_the_threshold_do_not_meet(spark, monkeypatch):
    """Texts that share a passage of nine tenths of their words: no pair links but the
    planted ones, and the postings of the passage are not joined with each other."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(91)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(10**7)}" for _ in range(9))]) for _ in range(150)]
    texts += [t + " end" for t in texts[:5]]
    kept, whole = {}, similarity_join.materialize

    def noted(df, tag):
        out = whole(df, tag)
        kept[tag] = out.count()
        return out

    monkeypatch.setattr(similarity_join, "materialize", noted)
    got = similarity_join.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4, similarity=(85, 100)).collect()
    assert Counter(tuple(r) for r in got) == by_hand(list(enumerate(texts)), 4, 85, 100)[0]
    assert kept["join-placed"] > 500 and kept["join-several"] < 100


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in similarity_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_representatives(docs, rows, nothing):
    out = similarity_join.representatives(docs, words=5, similarity=(80, 100))
    assert out.columns == docs.columns
    component = {(i, low(t) != []): c for (i, n, c) in by_hand([(i, t) for i, t, _ in rows], 5, 80, 100)[0] for t in ("x" if n else "",)}
    got = Counter(r["doc_id"] for r in out.collect())
    for (i, words), c in component.items():
        if i is not None:
            assert got[i] == (1 if not words or c == i else 0)
    assert got[None] == 1 and similarity_join.representatives(nothing).count() == 0


def items_and_docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    items = [[word() for _ in range(n)] for n in (12, 30, 45, 60, 4)]
    filler = lambda n: [word() for _ in range(n)]
    docs = {
        0: filler(100), 1: filler(40) + items[1] + filler(30), 2: items[2][30:] + filler(20) + items[2][15:30] + filler(9) + items[2][:15],
        3: filler(10) + items[3][:20] + filler(10), 4: items[0] * 30 + items[1], 5: items[4] + filler(8), 6: [], 7: [w.upper() + "," for w in items[3]],
    }
    return items, docs


def covered_by_hand(doc, item, k):
    """Longest open matches first, found by trying all places."""
    d, t, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not d[p + n] and not t[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < k:
            return total
        d[p : p + n] = [True] * n
        t[q : q + n] = [True] * n
        total += n


def test_tiling_against_all_places(spark):
    items, docs = items_and_docs()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (None, "a b c d e f")], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(8, None)], "doc_id long, text string")
    for block in (2, 1000):
        got = {r["doc_id"]: r for r in tiling.coverage(df, bench, block_items=block, short_items=False).collect()}
        for i, words in docs.items():
            plain = [w.lower().strip(",") for w in words]
            share = {j: covered_by_hand(plain, x, 5) / len(x) for j, x in enumerate(items) if len(x) >= 5}
            assert abs(got[i]["coverage"] - max(share.values())) < 1e-9
            assert got[i]["items"] == sorted(j for j, s in share.items() if s >= 0.5)
        assert [i for i, r in sorted(got.items()) if r["contaminated"]] == [1, 2, 4, 7]
    kept = tiling.clean_rows(df, bench, short_items=False).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 3, 5, 6, 8]


def test_tiles_are_maximal_and_apart():
    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(30):
        doc, item = (rng.integers(0, 6, n).astype(np.uint64) for n in (60, 25))
        tiles = tiling.tiles(doc, item, 3)
        used = Counter(p + i for p, _, n in tiles for i in range(n)), Counter(q + i for _, q, n in tiles for i in range(n))
        assert all(max(u.values(), default=1) == 1 for u in used)
        assert all((doc[p : p + n] == item[q : q + n]).all() and n >= 3 for p, q, n in tiles)
        longest = max((n for p in range(60) for q in range(25) for n in [next((k for k in range(min(60 - p, 25 - q)) if doc[p + k] != item[q + k]), min(60 - p, 25 - q))]), default=0)
        assert not tiles and longest < 3 or max(n for _, _, n in tiles) == longest


def test_tiles_equal_the_greedy_ones():
    rng = np.random.Generator(np.random.PCG64(8))
    for letters in (1, 2, 3, 6):
        for _ in range(25):
            doc, item = (rng.integers(0, letters, n).astype(np.uint64) for n in (50, 25))
            assert sum(n for _, _, n in tiling.tiles(doc, item, 3)) == covered_by_hand(doc.tolist(), item.tolist(), 3)


def test_repeated_words_take_linear_memory():
    rng = np.random.Generator(np.random.PCG64(9))
    began = time.time()
    same = tiling.tiles(np.full(1_000_000, 7, np.uint64), np.full(300, 7, np.uint64), 5)
    assert same == [(0, 0, 300)]
    two = tiling.tiles(rng.integers(0, 2, 1_000_000).astype(np.uint64), rng.integers(0, 2, 300).astype(np.uint64), 5)
    assert sum(n for _, _, n in two) > 250 and time.time() - began < 60


def test_items_that_share_a_phrase_are_not_all_tiled(spark, monkeypatch):
    """Pruning changes nothing: the best item and those above the threshold are found."""
    rng = random.Random(6)
    phrase = "one two three four five".split()
    items = [(i, " ".join([*phrase, *(f"w{rng.randrange(10**6)}" for _ in range(20))])) for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(phrase)), (2, "x " + items[7][1]), (3, items[9][1][:80])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in tiling.coverage(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1]["best_item"], got[1]["items"], got[1]["tiled_words"]) == (0, [], 5)
    assert (got[2]["best_item"], got[2]["items"], got[2]["coverage"]) == (7, [7], 1.0) and got[3]["best_item"] == 9
    index, tiled, whole = tiling.Index([{"item_id": i, "text": t} for i, t in items], 5, False), [], tiling.tiles
    monkeypatch.setattr(tiling, "tiles", lambda *a: tiled.append(1) or whole(*a))
    for texts, words, at in tiling.words_of(pa.array([items[7][1]])):
        tiling._found(index, {5: pd.Index(index.seeds[5].seed)}, texts, words, at, 5, 0.5)
    assert len(tiled) == 1


def test_decontamination_edges(spark, docs, rows, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(r["doc_id"] for r in tiling.coverage(docs, none).collect()) == Counter(i for i, _, _ in rows)
    bench = spark.createDataFrame([(1, "same text of four words or more")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in tiling.coverage(docs, bench).where("contaminated").collect()) == [900005, 900006, 900006, 900007]
    assert tiling.clean_rows(docs, bench).columns == docs.columns and tiling.clean_rows(nothing, bench).count() == 0


def test_short_items_and_items_without_ids(spark, tmp_path):
    import __spark_entry__

    items = [(1, "what is it"), (2, "Yes"), (None, "one two three four five six"), (None, "a, b"), (3, "what is it"), (3, "red green blue black white"), (4, None), (None, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {1: "So: What IS it?", 2: "what it is", 3: "oh yes.", 4: "zero one two three four five six", 5: "a b", 6: "ab yesterday", 7: "red green blue black white", 8: "", 9: "one two three four"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {1: [1, 3], 2: [], 3: [2], 4: [None], 5: [None], 6: [], 7: [3], 8: [], 9: []}
    for block in (1, 2, 1000):
        got = {r["doc_id"]: r for r in tiling.coverage(df, bench, short_items=True, block_items=block).collect()}
        assert {i: sorted(set(r["items"]), key=str) for i, r in got.items()} == want
        assert all(r["contaminated"] == bool(want[i]) and r["coverage"] == float(bool(want[i])) for i, r in got.items())
        assert [got[i]["best_item"] for i in (1, 3, 4, 5, 7)] == [1, 2, None, None, 3] and [got[i]["tiled_words"] for i in (1, 3, 4, 5)] == [3, 1, 6, 2]
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in __spark_entry__.queries()["op10_decontaminate"](spark, str(tmp_path)).where("contaminated").collect()} == {1, 3, 4, 5, 7}
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, df, str(tmp_path)).collect()} == {2, 6, 8, 9}
    assert {r["doc_id"] for r in tiling.clean_rows(df, bench).collect()} == {2, 6, 8, 9}
    assert {r["doc_id"] for r in tiling.clean_rows(df, bench, short_items=False).collect()} == {1, 2, 3, 5, 6, 8, 9}


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    """Each stage's decisions, by hand, on what its predecessor kept."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bench = [(1, "line of words here line of words here"), (2, "nothing like this stands in any of the documents")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    out = plain
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        out = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append([(r["doc_id"], r["text"], r["source"]) for r in out.collect()])
        assert set(plain.columns) <= set(out.columns)
    kept = {r["doc_id"] for r in rules.verdicts(plain).where("kept").collect()}
    assert Counter(i for i, _, _ in seen[0]) == Counter(i for i, _, _ in [tuple(r)[:3] for r in plain.collect()] if i in kept)
    component = by_hand([(i, t) for i, t, _ in seen[0]], 5, 80, 100)[0]
    assert Counter(i for i, _, _ in seen[1]) == Counter({c for _, _, c in component})
    assert {i for i, _, _ in seen[2]} == {i for i, _, _ in seen[1]}
    assert {i for i, _, _ in seen[3]} <= {i for i, _, _ in seen[2]} and len(seen[3]) > len(seen[2]) * 0.8
    shards = defaultdict(set)
    for r in out.collect():
        shards[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, out.collect()))


def mixed_by_hand(rows):
    """How often each row stands in the mix, source by source in the order of keys."""
    size = lambda t: len(WORD.findall(t))
    by_source = defaultdict(list)
    for i, t, s in rows:
        chance = (int(hashlib.md5(f"11|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        by_source[s].append((-math.log(chance) / max(0.05, 1 - len(re.findall(r"[#*$%&|<>]", t)) / size(t)), i, size(t)))
    out = Counter()
    targets = fill({s: sum(n for _, _, n in found) for s, found in by_source.items()})
    for s, found in by_source.items():
        whole = sum(n for _, _, n in found)
        epochs = int(targets[s] // whole + 1e-12)
        left = math.floor(targets[s] - epochs * whole)
        for _, i, n in sorted(found):
            out[i] += epochs + (n <= left or 2 * max(left, 0) >= n)
            left -= n
    return +out


def test_pipeline_against_naive_steps(spark, tmp_path):
    """Every stage's rows by hand, with test items that do remove documents."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(800)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [prose(n) for n in (30, 44, 60)]
    texts = [prose(rng.randint(24, 110)) for _ in range(100)]
    texts += [prose(20) + items[0] + prose(15), items[1][22:] + prose(10) + items[1][:22], prose(30) + items[2][:20] + prose(9), items[2], prose(25) + items[2][5:50]]
    near = list(texts[0])
    near[5] = "changed"
    texts += [near, texts[1], texts[2] + ["more"], prose(8), ["#", "*"] * 30]
    rows = [(100 + i, " ".join(t) + ".", "en", rng.choice(("a", "b", "c", None)), 1) for i, t in enumerate(texts)]
    rows += [(900, None, "en", "a", 0), (901, "click here\n" * 12 + "some words that are prose and stay here for good.", "en", "b", 1), (902, " ".join(prose(40)) + ".\nhome\nnext", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    short = {100 + i for i, t in enumerate(texts) if len(t) < 20}
    assert {i for i, _, _ in seen[0]} == {r[0] for r in rows} - short - {900, 901, 100 + len(texts) - 1}
    assert next(t for i, t, _ in seen[0] if i == 902).count("\n") == 0  # menu lines are gone
    component = by_hand([(i, t) for i, t, _ in seen[0]], 5, 80, 100)[0]
    assert Counter(i for i, _, _ in seen[1]) == Counter({c for _, _, c in component}) and len(seen[0]) - len(seen[1]) == 3
    words = lambda t: re.findall("[0-9a-z]+", t.lower())
    leaks = {i for i, t, _ in seen[1] if any(2 * covered_by_hand(words(t), x, 5) >= len(x) for x in items)}
    assert len(leaks) == 4 and Counter(i for i, _, _ in seen[2]) == Counter(i for i, _, _ in seen[1] if i not in leaks)
    assert Counter(i for i, _, _ in seen[3]) == mixed_by_hand(seen[2])
    shards = shards_by_hand([t for _, t, _ in seen[3]], 24)
    assert {(r["doc_id"], r["shard"]) for r in docs.collect()} == {(i, shards[t]) for i, t, _ in seen[3]}


def test_pipeline_on_edges(spark, docs, tmp_path):
    """No document, only such as the rules reject, repeated rows, and no test items."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    good = " ".join(f"word{i}" for i in range(40)) + "."
    for name, df, want in (
        ("none", docs.select(*columns).limit(0), 0),
        ("short", docs.select(*columns).where("length(text) < 20 OR text IS NULL"), 0),
        ("twice", spark.createDataFrame([(1, good, "en", None, 10)] * 3 + [(None, good + " more", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long"), None),
    ):
        folder = tmp_path / name
        df.write.parquet(str(folder / "documents.parquet"))
        if name != "none":
            spark.createDataFrame([(1, None), (None, "...")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == [*columns, "shard"]
        rows = out.collect()
        assert len(rows) == want or want is None and {r["text"] for r in rows} <= {good, good + " more"} and rows


def test_pipeline_keeps_clashing_columns(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.drop("__rules", "shard").limit(60).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [*docs.drop("__rules", "shard").columns, "shard"]


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())
