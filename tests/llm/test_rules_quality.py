import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from stratagrade.llm import quality_model, rules
from stratagrade.llm.textvec import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_measures(docs, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = rules.verdicts(docs).collect()
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((i, *by_hand(t)) for i, t, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_lines_go_first(spark):
    good = [" ".join(f"plain{i}word{k}" for k in range(12)) + "." for i in range(4)]
    texts = {
        1: "\n".join([*good, "Home | About | Contact | Login", "All rights reserved", "$$$ ### *** %%%"]),
        2: "\n".join(["Home | About | News | Contact | Login | Search | Help | Shop"] * 1 + [f"item{i} | thing{i} | stuff{i} | more{i} | end{i}" for i in range(9)]),
        3: " ".join(f"w{i}###" for i in range(60)),
        4: " ".join(f"plain{i}" for i in range(60)),
        5: "\n".join([*good, "Released under the MIT License."]),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["__rules"] for r in rules.measure(df).collect()}
    assert {i: r["kept"] for i, r in out.items()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    assert out[1]["clean_text"] == "\n".join(good) and out[3]["clean_text"] == ""


def test_menus_and_notices_of_four_languages(spark):
    good = " ".join(f"wort{k}" for k in range(30)) + "."
    failing = ["Startseite", "Über uns", "ALLE RECHTE VORBEHALTEN", "Accueil", "À propos", "Tous droits réservés.", "Inicio", "Leer más", "Política de privacidad"]
    out = rules.measure(spark.createDataFrame([(1, "\n".join([good, *failing, "Ein Satz, der bleibt."]))], "doc_id long, text string")).first()["__rules"]
    assert out["clean_text"] == good + "\nEin Satz, der bleibt."


def test_kept_rows(docs, nothing):
    kept = rules.kept_rows(docs.drop("__rules"))
    assert kept.columns == docs.drop("__rules").columns
    want = Counter(r["doc_id"] for r in rules.verdicts(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert rules.verdicts(nothing).count() == 0


def test_kept_rows_lose_failing_lines(spark):
    good = [" ".join(f"plain{i}word{k}" for k in range(12)) + "." for i in range(4)]
    texts = {1: "\n".join([good[0], "Home | About | Contact | Login", *good[1:], "All rights reserved", "$$$ ### *** %%%"]), 2: "\n".join([good[0], "", *good[1:]]), 3: "Menu"}
    df = spark.createDataFrame([(i, t, "s", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, n_chars int")
    clean = {1: "\n".join(good), 2: texts[2]}
    out = rules.kept_rows(df)
    assert out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == {i: (t, "s", len(t)) for i, t in clean.items()}
    assert {r["text"] for r in rules.kept_rows(df.select("doc_id", "text")).collect()} == set(clean.values())


def test_plan_is_native_and_without_shuffle(docs):
    plan = docs.sparkSession.createDataFrame([], "doc_id long, text string")
    text = rules.verdicts(plan)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", text)


def labelled(spark, n=700):
    rng = random.Random(1)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        text = rng.choices(words, k=rng.randint(30, 90)) if good else [w + rng.choice(("###", "!!")) for w in rng.choices(words, k=40)] if i % 8 else [rng.choice(words)] * 40
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def naive_features(text):
    """Bucket by bucket, with one hash at a time."""
    from stratagrade.llm.textvec import hashed, mix

    one = lambda s: hashed(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s.encode())]))
    bucket = lambda h, salt: int(mix(h, salt)[0] % np.uint64(quality_model.BUCKETS))
    words = WORD.findall(text)
    out = [bucket(one(w), 2) for w in words]
    for a, b in zip(words, words[1:]):
        out.append(bucket(np.zeros(1, np.uint64) if a == b else one(b) * np.uint64(0x9E3779B97F4A7C15) + one(a), 3))
    for n in quality_model.NGRAMS:
        for i in range(len(text) - n + 1):
            if not re.search(r"[\x20\x09-\x0D]", text[i + 1 : i + n - 1]):
                out.append(bucket(one(text[i : i + n]), 3 + n))
    return Counter(out)


def test_features_against_naive_ones():
    texts = ["", "one", "ab cd cd  ef", "ünï 日本語 it's\n#12", "x y z " * 5]
    for block in chunks(pa.array(texts)):
        for text, (ids, share) in zip(texts, quality_model.bags(block)):
            want = naive_features(text)
            assert ids.tolist() == sorted(want)
            assert np.allclose(share, [want[i] / max(1, want.total()) for i in ids.tolist()])


def test_training_against_naive_steps():
    """Softmax of the averaged vectors, one document and one bucket at a time."""
    rng = np.random.Generator(np.random.PCG64(7))
    bags = []
    for _ in range(12):
        ids = np.unique(rng.integers(0, 40, 6)).astype(np.int32)
        bags.append((ids, np.full(len(ids), 1 / len(ids), np.float32)))
    labels, dim, rate, gain, epochs = [0, 1, 1] * 4, 3, 0.5, 10.0, 4
    got = quality_model.train(bags, labels, dim=dim, epochs=epochs, least_steps=0, batch=5, rate=rate, gain=gain, seed=3)
    rng = np.random.Generator(np.random.PCG64(3))
    vectors = rng.uniform(-1 / dim, 1 / dim, (quality_model.BUCKETS, dim)).astype(np.float32).astype(float)
    output, bias = np.zeros((dim, 2)), np.zeros(2)
    share = np.bincount(labels) / len(labels)
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(len(labels))
        for at in range(0, len(order), 5):
            chosen, d_output, d_bias, d_vectors = order[at : at + 5], np.zeros((dim, 2)), np.zeros(2), {}
            for i in chosen:
                hidden = sum(vectors[b] * s for b, s in zip(*bags[i]))
                p = np.exp(hidden @ output + bias)
                wrong = (p / p.sum() - np.eye(2)[labels[i]]) * 0.5 / share[labels[i]] / len(chosen)
                d_output += np.outer(hidden, wrong)
                d_bias += wrong
                for b, s in zip(*bags[i]):
                    d_vectors[b] = d_vectors.get(b, 0) + s * (output @ wrong)
            output, bias = output - step * d_output, bias - step * d_bias
            for b, g in d_vectors.items():
                vectors[b] -= step * gain * g
    assert np.allclose(got.weight[:40], (vectors @ (output[:, 1] - output[:, 0]))[:40], atol=1e-4) and abs(got.bias - (bias[1] - bias[0])) < 1e-4


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == 700
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_training_ignores_held_out_labels(spark):
    docs, labels = labelled(spark, 200)
    rows = quality_model.sample(docs, labels, per_class=20)
    assert len(rows) == 40 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted(map(str, quality_model.classify(docs, x, per_class=20).collect())) for x in (labels, other))
    assert a == b


def test_classifier_edges(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(900005, 1, 0), (900006, 0, 0), (900006, 1, 0), (None, 0, 0), (900008, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows) and all(r["score"] == 0.5 for r in got)
    assert quality_model.classify(nothing, labels).count() == 0
