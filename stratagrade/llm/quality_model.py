"""A quality classifier of supervised subword embeddings.

Hashed words, pairs of words and character n-grams have learned vectors; a document is
the average of its own, and a softmax over two classes gives its score.  Training runs
on the driver with numpy stochastic gradient descent, over a bounded sample of labelled
documents; scoring runs over all documents.  Whole texts stay with the workers: of each
sampled document the driver gets its buckets and their shares, 8 bytes for each of
BUCKETS at most, and usually for a few hundred.

The softmax of an average is linear in the features before it: for scoring, each
vector is reduced to the difference of its two logits, so the model sent to the
workers is one float32 for each bucket, however large the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_arrow
from .textvec import BLANK, Texts, chunks, hashed, mix

BUCKETS = 1 << 17
NGRAMS = (3, 4)


def features(texts: Texts):
    """Bucket and text of each feature: words, pairs of words (a word that repeats
    the one before makes the same feature whatever the word), and runs of 3 and 4
    characters that hold white space at their ends only.  Letter case counts."""
    b = texts.buffer
    start, end, at = texts.words()
    word = hashed(b, start, end)
    buckets = [(mix(word, 2) % np.uint64(BUCKETS)).astype(np.int32)]
    owners = [np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))]
    same = owners[0][1:] == owners[0][:-1]
    pair = np.where(word[1:] == word[:-1], np.uint64(0), word[1:] * np.uint64(0x9E3779B97F4A7C15) + word[:-1])[same]
    buckets.append((mix(pair, 3) % np.uint64(BUCKETS)).astype(np.int32))
    owners.append(owners[0][1:][same])
    first = np.flatnonzero((b & 0xC0) != 0x80)
    if len(first):
        stop = np.append(first[1:], len(b))
        blank = np.concatenate(([0], np.cumsum(BLANK[b[first]])))
        owner = np.searchsorted(texts.at, first, "right") - 1
        for n in NGRAMS:
            k = len(first) - n + 1
            if k <= 0:
                continue
            inner = blank[n - 1 : n - 1 + k] - blank[1 : k + 1]
            ok = np.flatnonzero((inner == 0) & (owner[:k] == owner[n - 1 : n - 1 + k]))
            buckets.append((mix(hashed(b, first[ok], stop[ok + n - 1]), 3 + n) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[ok].astype(np.int32))
    return buckets, owners


@dataclass
class Model:
    """weight[b]: what bucket b adds to the log-odds of class 1, per share of a
    document's features; bias: the log-odds of a document without features."""

    weight: np.ndarray
    bias: float

    def score(self, texts: Texts) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, owner in zip(*features(texts), strict=True):
            total += np.bincount(owner, self.weight[bucket], len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def bags(texts: Texts):
    """For each text its distinct buckets, sorted, and the share of each."""
    bucket, owner = (np.concatenate(x) for x in features(texts))
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    for i in range(len(texts)):
        ids, n = np.unique(bucket[order[cut[i] : cut[i + 1]]], return_counts=True)
        yield ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, dim: int = 8, epochs: int = 5, least_steps: int = 400, batch: int = 32, rate: float = 1.0, gain: float = 100.0, seed: int = 5) -> Model:
    """Without bags of both classes the model scores 0.5 everywhere.

    `gain`: how much longer steps the vectors take than the output layer; a vector
    sees only its share of a document's gradient.  Small samples get more epochs, up
    to `least_steps` steps."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.array(labels)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2) / len(y)
    epochs = max(epochs, -(-least_steps * batch // len(y)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in chosen])
            part = np.concatenate([bags[i][1] for i in chosen])
            size = np.array([len(bags[i][0]) for i in chosen])
            row = np.repeat(np.arange(len(chosen)), size)
            hidden = np.zeros((len(chosen), dim), np.float32)
            hidden[size > 0] = np.add.reduceat(vectors[ids] * part[:, None], (np.cumsum(size) - size)[size > 0], axis=0) if len(ids) else 0
            logit = hidden @ output + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = p.copy()
            wrong[np.arange(len(chosen)), y[chosen]] -= 1
            wrong *= (0.5 / share[y[chosen]] / len(chosen))[:, None]  # classes weigh alike
            back = wrong @ output.T
            output -= step * hidden.T @ wrong
            bias -= step * wrong.sum(0)
            by_id = np.argsort(ids)
            ids = ids[by_id]
            if len(ids):
                first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
                vectors[ids[first]] -= (step * gain) * np.add.reduceat(part[by_id, None] * back[row[by_id]], first, axis=0)
    difference = output[:, 1] - output[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


_BAG = "doc_id long, label int, buckets binary, shares binary"


def _bagged(batches):
    for batch in batches:
        for texts in chunks(batch.column(2)):
            made = list(bags(texts))
            rows = [c.slice(texts.first, len(texts)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.array([b[k].tobytes() for b in made], pa.binary()) for k in (0, 1))], [c.split()[0] for c in _BAG.split(", ")])


def sample(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000) -> list:
    """At most `per_class` labelled documents of each class, by a hash of their id,
    from ids whose crc32 leaves another remainder than 1 by 3.  Ids labelled both ways
    or with nulls are left out; repeated labels count once."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1")
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_other")).where("label = _other").select("doc_id", "label")
    known = docs.select("doc_id").where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1").join(one, "doc_id", "left_semi").distinct()
    one = one.join(known, "doc_id")
    chosen = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = {r["doc_id"]: r["label"] for c in chosen for r in c.collect()}
    if not ids:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, label int"))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return sorted(map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text"), _bagged, _BAG).collect(), key=lambda r: r["doc_id"])


def _scored(model):
    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                score = model.value.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), batch.column(2).slice(texts.first, len(texts)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def classify(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, **options) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score
    (0 to 1, higher: label 1 likelier), predicted: one row for each row of `docs`.

    Nulls: a null text is scored as an empty one (by the bias alone); a null id is
    never held out and never trained on.  Repeated rows score alike.  A very long text is scored
    whole, in one block of its task; as a sampled row it sends the driver its distinct buckets only,
    1 MB at most.  Without usable
    labels every score is 0.5.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), per_class=per_class)
    bag = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    model = spark.sparkContext.broadcast(train(bag, [r["label"] for r in rows], **options))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    return map_arrow(docs.select("doc_id", "text", held_out), _scored(model), "doc_id long, held_out boolean, score double, predicted int")
