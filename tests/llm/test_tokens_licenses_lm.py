import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratagrade.llm import language_model, licenses, orc_tokens, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows)


def test_orc_round_trip(spark, docs, encoded, tmp_path):
    path = (tmp_path / "orc").as_uri()
    got = orc_tokens.tokens_round_trip(docs, tokenizer=PATH, end_id=2, path=path, stripe_mb=1, index_stride=1000).collect()
    want = Counter((i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in encoded.elements())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    back = orc_tokens.read_orc(spark, path)
    one = back.where("doc_id = 900008").first()
    assert (900008, tuple(one["ids"][:-1])) in encoded and one["ids"][-1] == 2


def test_orc_files_have_bloom_filters(spark, docs, tmp_path):
    orc_tokens.write_orc(docs, (tmp_path / "o").as_uri(), tokenizer=PATH, end_id=2)
    jvm = spark._jvm
    found = [p for p in (tmp_path / "o").glob("part-*.orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(found[0])), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    stripe = reader.getStripes().get(0)
    kinds = str(reader.rows().readStripeFooter(stripe))
    assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds and "DIRECT_V2" in kinds


def test_orc_of_nothing(nothing):
    assert orc_tokens.tokens_round_trip(nothing, tokenizer=PATH, end_id=2).count() == 0


def test_token_counts(docs, encoded, nothing):
    table = token_counts.suffix_sums(token_counts.length_histogram(docs, tokenizer=PATH), block=64)
    lengths = sorted(len(ids) for _, ids in encoded.elements())
    for r in table.collect():
        n = r["length"]
        over = [x for x in lengths if x >= n]
        assert (r["docs"], r["tokens"], r["docs_reaching"], r["tokens_reaching"]) == (lengths.count(n), n * lengths.count(n), len(over), sum(over))
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert math.isclose(r["quantile"], sum(x <= n for x in lengths) / len(lengths))
    limits = [0, 1, 7, 100, 512, 10**6]
    got = {r["limit"]: r for r in token_counts.at_limits(table, limits).collect()}
    assert {n: (got[n]["docs_over"], got[n]["truncated_tokens"]) for n in limits} == {n: (sum(x > n for x in lengths), sum(min(x, n) for x in lengths)) for n in limits}
    half = token_counts.quantiles(table, [0.5, 1.0]).collect()
    assert {r["share"]: r["length"] for r in half} == {0.5: lengths[(len(lengths) - 1) // 2], 1.0: lengths[-1]}
    assert token_counts.suffix_sums(token_counts.length_histogram(nothing, tokenizer=PATH)).count() == 0


def test_other_tokenizer_files(spark, tmp_path):
    """Files that keep letter case or white space, against the library."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(PATH).read())
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    texts = ["Hello World FOO", "  two  blanks\n\nand lines ", "", "Ünï <|endoftext|> 12.5%", "it's THE end"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json"), PATH):
        library = Tokenizer.from_file(path)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        got = {r["doc_id"]: r["ids_crc32"] for r in orc_tokens.tokens_round_trip(df, tokenizer=path, end_id=2).collect()}
        assert got == {i: zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for i, ids in enumerate(want)}
        lengths = {r["length"]: r["docs"] for r in token_counts.length_histogram(df, tokenizer=path).collect()}
        assert lengths == Counter(map(len, want))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_license_base(spark, docs, rows, nothing):
    extra = ["Released UNDER the MIT license. under-the_mit license!", "Apache License, Version 2.0; cc by\nnc", "under the mit", "the mit license under", "cc by nc by nc cc by nc"]
    texts = [(800000 + i, t) for i, t in enumerate(extra)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    want = Counter()
    for i, t in [(i, t) for i, t, _ in rows] + texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        at = [(p, label) for phrase, label in licenses.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        want[i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    got = licenses.scan(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(nothing).count() == 0


def labels_of(spark, texts):
    return {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_templates(spark):
    mit = next(t for t, label in licenses.TEMPLATES if label == "mit" and len(t) > 200)
    texts = {
        1: f"Copyright X. {mit} Then more.", 2: mit.upper(), 3: mit.replace("without restriction", "with restriction"),
        4: "This work is licensed under the GNU General Public License, version 3.", 5: "GNU General Public License as published by the Free Software Foundation, either version 3", 6: "GNU General Public License as it was, version 3",
        7: "Licensed under the Apache License, Version 2.0", 8: "",
    }
    got = labels_of(spark, texts)
    assert {i: r["labels"] for i, r in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "gpl-3", 5: "gpl-3", 6: "", 7: "apache-2", 8: ""}
    assert got[1]["score"] == 1 and 0 < got[3]["score"] < 1 and got[8]["score"] == 0


#: Official names and notices, with the labels they should get.
OFFICIAL = [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("Creative Commons Attribution-NoDerivs 3.0 Unported License", "cc-by-nd"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "cc-by-nc-nd"),
    ("Creative Commons Attribution-Share Alike 2.5 Generic License", "cc-by-sa"),
    ("Creative Commons Attribution License", "cc-by"),
    ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc,cc-by-nc-nd"),
    ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc,cc-by-nc-nd"),
    ("Made available under the CC BY-ND 4.0 terms.", "cc-by-nd"),
    ("licensed under cc by", ""),
    ("CC0 1.0 Universal", "cc0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", "lgpl"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "agpl-3"),
    ("subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1"),
]


def test_official_wordings(spark):
    got = labels_of(spark, dict(enumerate(t for t, _ in OFFICIAL)))
    base = {i: "cc-by-nc" for i, (t, _) in enumerate(OFFICIAL) if "CC BY-NC" in t}
    want = {i: label for i, (_, label) in enumerate(OFFICIAL)}
    want[8] = "cc-by-nc-nd"  # no base phrase stands there
    assert {i: r["labels"] for i, r in got.items()} == want
    assert {i: r["base_labels"] for i, r in got.items() if r["base_labels"]} == base


def test_scan_against_sql(spark, docs, tmp_path):
    """The automata against regular expressions, partial wordings included."""
    import duckdb

    from stratagrade.llm.queries import oracle_sql

    full = [re.sub("<<[^>]*>>", " ", t) for t, _ in licenses.TEMPLATES]
    cut = [" ".join(t.split()[: k]) for t in full for k in (3, 5, 9, 40)]
    texts = [(700000 + i, t) for i, t in enumerate([*(t for t, _ in OFFICIAL), *full, *cut])]
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string")).coalesce(1).write.parquet(str(tmp_path / "d"))
    got = licenses.scan(spark.read.parquet(str(tmp_path / "d")))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = c.sql("SELECT " + ", ".join(got.columns) + " FROM (" + oracle_sql()["op5_license_scan"] + ")").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_automaton():
    m = licenses.compile_template("a b c <<optional>>d <<optional>>e<<end>><<end>> <<any 2>> f", "x")
    accepts = lambda s: m.run(iter(s.split()))[0]
    assert all(map(accepts, ("a b c f", "a b c d f", "a b c d e f", "a b c x y f z", "a b c d x y f")))
    assert not any(map(accepts, ("a b c", "a b f", "a b c x y z f", "a b c d e x y z f", "")))
    assert m.weight == 4
    either = licenses.compile_template("a b c <<one of d | e f>>", "x")
    assert [either.run(iter(f"a b c {s}".split())) for s in ("d", "e f", "e", "f", "")] == [(True, 4), (True, 4), (False, 3), (False, 3), (False, 3)]
    for bad in ("a b", "a <<any 1>> b c", "a b c <<end>>", "a b c <<optional>> d", "a b c <<any 2>>", "a b c <<optional>> d <<end>>"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad, "x")


def base_by_hand(rows):
    token = [(i, [*low(t).encode().split(), None]) for i, t, _ in rows]
    train = [w for i, w in token if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    return token, train


def test_language_model(docs, rows, nothing, monkeypatch):
    token, train = base_by_hand(rows)
    count = Counter(w for ws in train for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w in token)
    for segment in (language_model.SEGMENT, 2000):
        monkeypatch.setattr(language_model, "SEGMENT", segment)
        got = language_model.score(docs).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n}
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
    assert language_model.score(nothing).count() == 0
    blank = language_model.score(docs.sparkSession.createDataFrame([(1, ""), (2, None), (3, "  ")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in blank} == {(1, 1), (2, 1), (3, 1)} and all(math.isfinite(r["score"]) for r in blank)


def test_model_beats_the_base_on_held_out_text(spark):
    lines = [(i, " ".join(f"w{(i + k * k) % 40} then{(i + k * k) % 40}" for k in range(30))) for i in range(400)]
    got = language_model.score(spark.createDataFrame(lines, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


def test_texts_that_occur_twice_score_higher(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(80)) for _ in range(300)]
    got = language_model.score(spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string")).where("NOT held_out").collect()
    held = {i for i in range(330) if zlib.crc32(str(i).encode()) % 5 == 1}
    per_word = lambda chosen: [r["score"] / r["n_tokens"] for r in got if chosen(r["doc_id"])]
    twice, once = per_word(lambda i: i % 300 < 30 and not {i % 300, i % 300 + 300} & held), per_word(lambda i: 30 <= i < 300)
    assert len(twice) > 20 and min(twice) > max(once)


def test_filter_never_counts_too_little():
    rng = np.random.Generator(np.random.PCG64(1))
    keys = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    counts = rng.integers(1, 300, len(keys))
    held = language_model.Filter(keys, counts, 10.0)
    level = 1 + np.floor(np.log2(counts)).astype(int)
    got = held.levels(keys)
    assert (got >= level).all() and (got == level).mean() > 0.9
    strange = held.levels(np.setdiff1d(rng.integers(0, 1 << 48, 5000, dtype=np.uint64), keys))
    assert (strange > 0).mean() < 0.1
    assert len(language_model.Filter(np.arange(1 << 20, dtype=np.uint64), np.ones(1 << 20, np.int64), 10.0).words) * 64 >= 9.99 * (1 << 20)  # it grows with the levels


def test_keys_come_back():
    rng = np.random.Generator(np.random.PCG64(2))
    for kind in (1, 2):
        for n in (1, 2, 1000):
            for bits in (0, 7, 16, 25):  # 25: segments of 100 TB
                wide = language_model.width(kind, bits)
                whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) << np.uint64(1))
                short = language_model.shorten(whole, bits, kind)
                assert ((short >> np.uint64(wide)) == (whole >> np.uint64(64 - bits) if bits else 0)).all()
                keys = np.unique(short & np.uint64((1 << wide) - 1))
                assert (language_model._unpack(language_model._pack(keys, wide), len(keys), wide) == keys).all()


def test_parts_and_broadcast_score_alike(docs, monkeypatch):
    """The same bits, whether a worker holds all of them or they meet the blocks by segment."""
    rows = lambda **o: sorted(((r["doc_id"] or -1, r["n_known"], r["base_score"], r["score"]) for r in language_model.score(docs.repartition(5), **o).collect()))
    for segment in (language_model.SEGMENT, 3000):
        monkeypatch.setattr(language_model, "SEGMENT", segment)
        assert rows(broadcast_mb=0) == rows()


def test_parts_hold_no_counts_of_ngrams(docs):
    """What scoring is given of orders above 1: bits alone."""
    import pyarrow as pa

    keys = np.arange(1000, dtype=np.uint64)
    table = pa.table({"n": [1000], "keys": [language_model._pack(keys, 32)], "counts": [language_model._planes(keys + np.uint64(1), 4)]})
    for kind in (1, 2, 3):
        row = language_model._built(0, 10.0)((pa.scalar(kind), pa.scalar(0)), table if kind > 1 else table.set_column(1, "keys", [[language_model._pack(keys, 48)]])).to_pylist()[0]
        assert (len(row["keys"]), len(row["counts"])) == ((8000, 8000) if kind == 1 else (0, 0)) and row["distinct"] == 1000
        part = language_model.Part(row["bits"], row["keys"], row["counts"])
        assert (part.filter.levels(keys) >= 1 + np.floor(np.log2(keys.astype(float) + 1))).all()


def test_scores_by_hand(docs, rows, monkeypatch):
    """Quantised counts in the formula, over several blocks and segments and with nearly no false positives."""
    token, train = base_by_hand(rows)
    marked = lambda w: [0, *w]
    grams = {k: Counter(tuple(x[i : i + k]) for w in train for x in [marked(w)] for i in range(len(x) - k + 1)) for k in range(2, 6)} | {1: Counter((x,) for w in train for x in w)}
    n, v = grams[1].total(), len(grams[1])
    held = lambda c: 0 if not c else 1 if c == 1 else 1.4 * 2 ** math.floor(math.log2(c))

    def one(x, at, most):
        p = (held(grams[1][x[at],]) + 0.5) / (n + 0.5 * (v + 1))
        for k in range(2, min(most, at + 1) + 1):
            whole, prior = (tuple(x[at - k + 1 : at + 1]), tuple(x[at - k + 1 : at]))
            c = held(grams[k][whole])
            p = (c + 2 * p) / (max(len(train) if prior == (0,) else held(grams[k - 1][prior]), c) + 2)
        return math.log10(min(1.0, p))

    monkeypatch.setattr(language_model, "SEGMENT", 20_000)
    for most in (1, 2, 5):
        want = Counter((i, round(sum(one(marked(w), at, most) for at in range(1, len(w) + 1)), 3)) for i, w in token)
        got = Counter((r["doc_id"], round(r["score"], 3)) for r in language_model.score(docs.repartition(20), order=most, bits_per_key=400.0).collect())
        assert (want - got).total() <= 0.05 * len(rows)
    rough = {r["doc_id"]: r["score"] for r in language_model.score(docs, order=5).collect()}
    exact = {i: s for i, s in want}
    off = [abs(rough[i] / exact[i] - 1) for i in exact]
    assert np.median(off) < 0.05  # what the filter's false positives cost
