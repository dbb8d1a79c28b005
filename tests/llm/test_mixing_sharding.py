import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stratagrade.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by dealing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        offer = {s: out[s] + left * w[s] / total for s in open_}
        left = sum(max(0, offer[s] - most * sizes[s]) for s in open_)
        out |= {s: min(offer[s], most * sizes[s]) for s in open_}
        open_ = {s for s in open_ if out[s] < most * sizes[s] - 1e-9}
    return out


def test_targets_and_taken(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    want = fill(size)
    taken, by_target = Counter(), {}
    pairs = {(r["source_size"], round(r["target"], 4)) for r in got}
    assert pairs == {(size[s], round(t, 4)) for s, t in want.items()}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
        by_target[r["source_size"], r["target"]] = r["target"]
    counts = Counter(size[s] for s in want)
    for (s, t), n in taken.items():
        if counts[s] == 1:
            assert t - 4 <= n <= t
    again = sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert again == sorted(map(str, got))


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    for n, most in ((1, 2.0), (7, 1.2), (400, 2.0), (400, 1.6), (3, 1.5)):
        sizes = {(f"s{i}" if i else None): rng.choice((0, 3, 50, rng.randint(1, 10**6))) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
        got = {r["source"]: r["target"] for r in mixing.source_targets(df, most=most).collect()}
        want = fill(sizes, most=most)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-3) for s in want)


def test_keys_follow_weights(spark):
    df = spark.createDataFrame([(i, ("good words " if i % 2 else "ba#d w#o#r#d#s ") * 10, "s") for i in range(400)], "doc_id long, text string, source string")
    taken = mixing.mix(df, share=0.3).groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("n")).collect()
    n = {r["good"]: r["n"] for r in taken}
    assert n[1] > 3 * n[0] and n[1] + n[0] == math.floor(0.3 * 400 * 20)


def test_given_weights(spark):
    df = spark.createDataFrame([(i, "some good words " * 10, "s", None if i % 5 == 4 else float(i % 5)) for i in range(500)], "doc_id long, text string, source string, quality double")
    taken = {r["q"]: r["n"] for r in mixing.mix(df, share=0.3, weight=F.col("quality")).join(df.select("doc_id", F.col("quality").alias("q")), "doc_id").groupBy("q").agg(F.sum("taken").alias("n")).collect()}
    assert taken[3.0] > taken[1.0] > 0 and taken[0.0] == taken[None] == 0
    rows = {r["quality"]: r["n"] for r in mixing.mixed_rows(df, share=0.3, weight=F.col("quality")).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    assert rows == {q: n // 30 for q, n in taken.items() if n}


def test_buckets_do_not_matter(docs):
    assert sorted(map(str, mixing.mix(docs, buckets=2).collect())) == sorted(map(str, mixing.mix(docs, buckets=1 << 16).collect()))


def test_epochs_come_first(spark):
    df = spark.createDataFrame([(i, "w " * (i + 1), s) for i in range(30) for s in ("a", "b", None)], "doc_id long, text string, source string")
    for r in mixing.mix(df).collect():
        assert r["epochs"] * r["size"] <= r["taken"]


def test_mixed_rows(docs, nothing):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    per_row = mixing.mix(docs)
    times = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in per_row.collect():
        if r["taken"] >= r["size"] > 0 and r["doc_id"] not in (None, 900006):
            part = r["taken"] - r["epochs"] * r["size"]
            assert times[r["doc_id"]] == r["epochs"] + (2 * part >= r["size"])
    assert mixing.mix(nothing).count() == 0 == mixing.mixed_rows(nothing).count()


def by_heap(sizes, shards):
    """Group by group."""
    heap, out = [(0, s) for s in range(shards)], []
    for size in sorted(sizes, reverse=True):
        load, shard = heapq.heappop(heap)
        out.append((size, shard))
        heapq.heappush(heap, (load + size, shard))
    return Counter(out)


def test_longest_first():
    rng = random.Random(3)
    for shards in (1, 2, 5, 24):
        for _ in range(20):
            classes = {rng.randint(1, 40) * rng.choice((1, 1, 100)): rng.choice((1, 2, 60, 700)) for _ in range(12)}
            order = sorted(classes.items(), reverse=True)
            got = list(sharding.longest_first(iter(order), shards))
            assert all(sum(given) == n for given, (_, n) in zip(got, order))
            assert Counter({(size, s): n for given, (size, _) in zip(got, order) for s, n in enumerate(given) if n}) == by_heap([size for size, n in classes.items() for _ in range(n)], shards)


def shards_by_hand(texts, shards):
    """text -> shard: group by group, and of a size's groups the lower shards first by md5."""
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 8
    free = defaultdict(list)
    for (size, shard), n in by_heap(groups.values(), shards).items():
        free[size] += [shard] * n
    by_md5 = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    turn = {size: iter(sorted(x)) for size, x in free.items()}
    return {t: next(turn[groups[t]]) for t in by_md5}


def check_shards(got, rows, shards):
    assert len(got) == len(rows)
    slots, groups, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    return load


def test_assign(docs, rows, nothing):
    got = sharding.assign(docs).collect()
    load = check_shards(got, rows, 24)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert max(load.values()) == max(len((t or "").encode()) for _, t, _ in rows) + 8  # one text is larger than an even share
    assert sharding.assign(nothing).count() == 0


def test_shards_and_slots_by_hand(spark, docs, rows):
    """Also with sizes and groups that are cut into parts, and in any partitioning."""
    want = shards_by_hand([t for _, t, _ in rows], 24)
    assert {(zlib.crc32(t.encode()), s) for t, s in want.items()} == {(r["text_crc32"], r["shard"]) for r in sharding.assign(docs).collect()}
    order = sorted(((want[t or ""], hashlib.md5((t or "").encode()).hexdigest(), -1 if i is None else i) for i, t, _ in rows))
    slot = Counter()
    expected = Counter()
    for s, _, i in order:
        expected[i, s, slot[s]] += 1
        slot[s] += 1
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs.repartition(9)).collect()) == expected

    rows = [(None if i % 7 == 0 else i, "hot " * 10 if i % 3 == 0 else f"text {i:04d}" + " more" * (i % 5), "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = shards_by_hand([t for _, t, _ in rows], 4)
    for options in ({}, {"class_groups": 50, "group_rows": 100, "broadcast_sizes": 0}):
        got = sharding.assign(df, shards=4, **options).collect()
        *others, hot = sorted(check_shards(got, rows, 4).values())  # the hot group alone is larger than an even share
        assert hot == 1000 * 48 and others[-1] - others[0] < 100
        assert {(zlib.crc32(t.encode()), s) for t, s in want.items()} == {(r["text_crc32"], r["shard"]) for r in got}
        again = sharding.assign(df.repartition(5, "doc_id"), shards=4, **options).collect()
        assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"]) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again if r["doc_id"])
        assert sorted(map(str, got)) == sorted(map(str, again)) or options


def test_shards_against_sql(docs, tmp_path):
    import duckdb

    from stratagrade.llm.queries import OP4_SQL

    docs.where("length(text) < 20000 OR text IS NULL").select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    df = docs.sparkSession.read.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = sharding.assign(df)
    assert Counter(map(tuple, got.collect())) == Counter(c.sql("SELECT " + ", ".join(got.columns) + f" FROM ({OP4_SQL})").fetchall())


def test_with_shard(docs):
    out = sharding.with_shard(docs)
    assert out.columns == [*(c for c in docs.columns if c != "shard"), "shard"]
    a = {(r["doc_id"], r["shard"]) for r in out.collect()}
    assert a == {(r["doc_id"], r["shard"]) for r in sharding.assign(docs).collect()}
