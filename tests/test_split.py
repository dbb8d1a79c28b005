import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratagrade.operators import chat, dealing, split


@pytest.mark.parametrize("total, ratios, want", [
    (1, (0.8, 0.1, 0.1), [1, 0, 0]), (3, (0.8, 0.1, 0.1), [3, 0, 0]), (5, (0.8, 0.1, 0.1), [4, 1, 0]), (7, (0.8, 0.1, 0.1), [5, 1, 1]), (10, (0.8, 0.1, 0.1), [8, 1, 1]),
    (15, (0.8, 0.1, 0.1), [12, 2, 1]), (25, (0.8, 0.1, 0.1), [20, 3, 2]), (104, (0.8, 0.1, 0.1), [83, 11, 10]), (1, (0.1, 0.8, 0.1), [1, 0, 0]),
    (3, (0.34, 0.33, 0.33), [1, 1, 1]), (10, (0.5, 0.5, 0), [5, 5, 0]), (7, (0.6, 0.2, 0.2), [4, 2, 1]),
])
def test_allocate_counts(spark, total, ratios, want):
    assert split.allocate_counts(total, ratios) == want
    row = split.quotas(spark.createDataFrame([(total,)], "total long"), ratios).first()
    assert [row["n_train"], row["n_val"], row["n_test"]] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(0, 99))
def test_stratified_plan_partitions(sizes, seed):
    plan = split.plan_stratified(sizes, (0.8, 0.1, 0.1), seed)
    flat = [x for s in plan for x in s]
    count = Counter(i for i, _ in flat)
    assert [count[i] for i in range(3)] == split.allocate_counts(sum(sizes), (0.8, 0.1, 0.1))
    for i in range(3):
        assert sorted(at for j, at in flat if j == i) == list(range(count[i]))
    assert plan == split.plan_stratified(sizes, (0.8, 0.1, 0.1), seed)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=3, max_size=12), st.integers(0, 99))
def test_grouped_plan(sizes, seed):
    plan = split.plan_grouped([(n, {("f", n % 3): n}) for n in sizes], (0.8, 0.1, 0.1), seed)
    assert {i for i, _ in plan} == {0, 1, 2}
    for i in range(3):
        spans = sorted((at, n) for (j, at), n in zip(plan, sizes, strict=True) if j == i)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_too_few_groups():
    with pytest.raises(ValueError, match="Only 2 groups"):
        split.plan_grouped([(1, {}), (1, {})], (0.8, 0.1, 0.1), 1)


def item(i, table="t", leaf="A"):
    meta = {f: "" for f in ("database_name", "database_description", "table_name", "table_description", "field_name", "field_description", "field_type", "value")}
    levels = {f"category_{x}_level": "" for x in ("root", "branch", "subbranch")} | {"category_leaf_level": leaf}
    return {"id": f"r{i}", "extra": {"z": 1, "a": [1.5, None]}, "metadata": meta | {"table_name": table, "field_name": f"f{i}"}, "classification": levels, "grading": {"sensitivity_level": "L1"}}


@pytest.fixture
def data(tmp_path):
    items = [item(i, f"t{i % 6}", "AB"[i % 2]) for i in range(40)]
    items[3]["metadata"]["table_name"] = " "
    items[5]["classification"]["category_leaf_level"] = ""
    path = tmp_path / "all.json"
    path.write_text("﻿" + json.dumps(items, ensure_ascii=False), "utf-8")
    return path, items


def read(folder, name):
    return json.loads((folder / f"{name}.json").read_text("utf-8"))


def test_random_split(spark, data, tmp_path):
    path, items = data
    report = split.split_dataset(spark, path, tmp_path / "out")
    parts = {s: read(tmp_path / "out", s) for s in ("train", "val", "test")}
    assert report["sizes"] == {"train": 32, "val": 4, "test": 4} == {s: len(x) for s, x in parts.items()}
    assert sorted((x for p in parts.values() for x in p), key=lambda x: x["id"]) == sorted(items, key=lambda x: x["id"])
    assert list(parts["train"][0]) == list(items[0])
    assert report["distributions"]["grading.sensitivity_level"]["val"] == {"L1": 4}
    with pytest.raises(FileExistsError):
        split.split_dataset(spark, path, tmp_path / "out")
    again = split.split_dataset(spark, path, tmp_path / "two", random_seed=42)
    assert again == report and read(tmp_path / "two", "test") == parts["test"]


def test_group_split(spark, data, tmp_path):
    path, _ = data
    with pytest.raises(ValueError, match="item.s.: 3"):
        split.split_dataset(spark, path, tmp_path / "g", split_type="group", group_key="metadata.table_name")
    with pytest.warns(UserWarning):
        report = split.split_dataset(spark, path, tmp_path / "g", split_type="group", group_key="metadata.table_name", missing_group_policy="skip")
    assert report["included_size"] == 39 and report["skipped_records"]["reasons"][0]["item_indexes"] == [3]
    tables = [{x["metadata"]["table_name"] for x in read(tmp_path / "g", s)} for s in ("train", "val", "test")]
    assert all(tables) and not (tables[0] & tables[1] or tables[0] & tables[2] or tables[1] & tables[2])
    with pytest.raises(ValueError, match="must resolve to a scalar at item 0"):
        split.split_dataset(spark, path, tmp_path / "h", split_type="group", group_key="extra.a")
    with pytest.raises(ValueError, match="group_key is required"):
        split.split_dataset(spark, path, tmp_path / "h", split_type="group")


def test_bad_ratios():
    for bad in ((0.5, 0.1, 0.1), (0, 0.5, 0.5), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            split.check_ratios(bad)


def test_hash_split_hot_stratum(spark):
    df = spark.range(6000).select(F.col("id"), F.when(F.col("id") < 4500, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("k"))
    got = dealing.split_by_hash(df, ["k"], "id").groupBy("k", "split").count().collect()
    sizes = Counter({(r["k"], r["split"]): r["count"] for r in got})
    for k, total in Counter(r["k"] for r in df.select("k").collect()).items():
        assert all(abs(sizes[k, s] - total * r) <= 2 for s, r in zip(("train", "val", "test"), (0.8, 0.1, 0.1), strict=True))
    assert [sum(n for (_, s), n in sizes.items() if s == x) for x in ("train", "val", "test")] == split.allocate_counts(6000, (0.8, 0.1, 0.1))


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.1), (0.6, 0.4, 0), (1, 0, 0), (0.34, 0.33, 0.33), (0.05, 0.15, 0.8)])
def test_quotas_of_small_strata(spark, ratios):
    """Strata of one row to thousands, nulls among their keys."""
    import random

    rng = random.Random(3)
    sizes = [*([1] * 300), *([4] * 300), *(rng.randint(2, 40) for _ in range(100)), 7000]
    df = spark.createDataFrame([(None if i == 5 else f"k{i}", i % 3 if i % 7 else None, n) for i, n in enumerate(sizes)], "k string, g long, total long")
    rows = dealing.stratum_quotas(df, ["k", "g"], ratios).join(df.withColumnsRenamed({"k": "a", "g": "b"}), F.expr("k <=> a AND g <=> b")).collect()
    assert len(rows) == len(sizes)
    for r in rows:
        got = [r["n_train"], r["n_val"], r["n_test"]]
        assert sum(got) == r["total"] and all(n >= 0 and abs(n - r["total"] * x) <= 2 for n, x in zip(got, ratios, strict=True)) and abs(got[0] - r["total"] * ratios[0]) <= 1.5
    assert [sum(r[c] for r in rows) for c in ("n_train", "n_val", "n_test")] == split.allocate_counts(sum(sizes), ratios)
    assert dealing.stratum_quotas(df.limit(0), ["k", "g"], ratios).count() == 0


def grouped_rows(spark, n_groups=400):
    """Groups from one row to a third of all, with labels that lean by group."""
    import random

    rng = random.Random(9)
    rows = []
    for g in range(n_groups):
        lean = rng.choice("abcdefg")
        rows += [(None if g == 7 else g, lean if rng.random() < 0.8 else rng.choice("abcdefg"), f"rare{g}" if rng.random() < 0.02 else None) for _ in range(1500 if g == 3 else rng.choice((1, 2, 5, 12)))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g long, x string, y string")


@pytest.mark.parametrize("most", [128, 2])
def test_groups_by_class(spark, most):
    df = grouped_rows(spark)
    out = dealing.split_groups_by_class(df, F.col("g"), {"x": F.col("x"), "y": F.col("y")}, most=most).collect()
    assert sorted(r["id"] for r in out) == list(range(df.count()))
    by_group: dict = {}
    for r in out:
        by_group.setdefault(r["g"], Counter())[r["split"]] += 1
    assert all(len(c) == 1 for c in by_group.values())
    held = {("rows", ""): Counter(), **{("x", x): Counter() for x in "abcdefg"}}
    for r in out:
        held["rows", ""][r["g"], r["split"]] += 1
        held["x", r["x"]][r["g"], r["split"]] += 1
    for counts in held.values():
        total, squares = sum(counts.values()), sum(n * n for n in counts.values())
        for s, r in zip(("train", "val", "test"), (0.8, 0.1, 0.1), strict=True):
            n = sum(n for (_, x), n in counts.items() if x == s)
            assert abs(n - total * r) < 4 * (r * (1 - r) * squares) ** 0.5 + 2 * max(counts.values())
    again = dealing.split_groups_by_class(df.repartition(5), F.col("g"), {"x": F.col("x"), "y": F.col("y")}, most=most)
    assert {(r["id"], r["split"]) for r in again.collect()} == {(r["id"], r["split"]) for r in out}


def test_groups_by_class_edges(spark):
    df = grouped_rows(spark, 5)
    few = df.where("g IN (0, 1, 2)")
    out = dealing.split_groups_by_class(few, F.col("g"), {})
    assert {r["split"] for r in out.collect()} == {"train", "val", "test"}  # no split stays empty
    with pytest.raises(ValueError, match="Only 2 groups"):
        dealing.split_groups_by_class(df.where("g IN (0, 1)"), F.col("g"), {"x": F.col("x")})
    assert dealing.split_groups_by_class(df.limit(0), F.col("g"), {"x": F.col("x")}).count() == 0
    two = dealing.split_groups_by_class(df, F.col("g"), {"x": F.col("x")}, ratios=(0.5, 0.5, 0))
    assert {r["split"] for r in two.collect()} == {"train", "val"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 30)), min_size=3, max_size=12))
def test_class_plan(found):
    classes = [(m, m * size, {("f", size % 3): m * size}) for m, size in found]
    plan = dealing.plan_classes(classes, (0.8, 0.1, 0.1))
    assert [sum(d) for d in plan] == [m for m, _, _ in classes] and all(n >= 0 for d in plan for n in d)
    assert all(sum(d[i] for d in plan) for i in range(3))


def test_nulls_lose_no_row(spark):
    from stratagrade.operators import corpus

    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 2}", None if i % 5 == 0 else i % 4) for i in range(30)], "id long, k string, g long")
    for keys in (["k"], ["k", "g"]):
        out = dealing.split_by_hash(df, keys, "id")
        assert sorted(r["id"] for r in out.collect()) == list(range(30)) and out.where("split IS NULL").isEmpty()
    hashed = dealing.split_by_hash(df.select(F.when(F.col("id") > 9, F.col("id")).alias("id"), "k"), ["k"], "id")
    assert hashed.count() == 30
    grouped = split.split_grouped(df, F.col("g"), {"k": F.coalesce("k", F.lit(""))}, "id")
    assert sorted(r["id"] for r in grouped.collect()) == list(range(30)) and grouped.where("g IS NULL").select("split").distinct().count() == 1
    assert sorted(r["id"] for r in split.split_stratified(df, [F.col("k")], "id").collect()) == list(range(30))
    assert {r["id"]: r["first_row"] for r in corpus.duplicate_of(df, "k", order="id").collect()} == {i: 0 if i % 3 == 0 else 1 if i % 2 else 2 for i in range(30)}


def test_ranks_of_hot_keys(spark):
    from stratagrade.operators.joins import rank_within

    rows = [(7 * i - 5000, None if i % 2 else f"k{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "at long, k string")
    seen, want = Counter(), {}
    for at, k in rows:
        want[at] = seen[k]
        seen[k] += 1
    for cells in (1, 10, 4096):
        assert {r["at"]: r["rank"] for r in rank_within(df, ["k"], "at", "rank", cells).collect()} == want
    assert rank_within(df.limit(0), ["k"], "at", "rank").count() == 0


def test_json_arrays(spark, tmp_path):
    from stratagrade.sources.json_arrays import read_array

    path = tmp_path / "a.json"

    def read(text, **options):
        path.write_text(text, "utf-8")
        return [(r["pos"], json.loads(r["item"])) for r in read_array(spark, path, **options).orderBy("pos").collect()]

    items = [{"b": 1, "a": [1.5, None, {"x": "é\n\"q\" {"}]}, {}, {"n": 12345678901234567890, "t": True}]
    assert read("﻿ " + json.dumps(items)) == list(enumerate(items))
    assert read("[]", empty_ok=True) == [] and read('[{"x": NaN}]')[0][1]["x"] != 0
    for text, message in (("[]", "empty"), ("{}", "must contain a list"), ('[{"a": 1}, "{}x"]', "must be a JSON object"), ("[1]", "must be a JSON object"), ("[{", "Invalid input JSON"), ("", "Invalid input JSON")):
        with pytest.raises(ValueError, match=message):
            read(text)


def test_arrays_are_cut_into_blocks(spark, tmp_path):
    """As the writers lay them out: the same rows as from one task, from many."""
    from stratagrade.sources import json_arrays
    from stratagrade.sources.places import Place

    path = tmp_path / "laid.json"
    tricky = [{"s": "},\n  {\n", "n": {"a": [{"x": 1}, {"y": {"z": []}}], "e": {}}}, {"b": [[1.5, None, True], "[\n  {\n"], "ü": "日本 \u2028"}, {"s": "\n  }\n]"}]
    items = [{"id": i, "pad": "x" * (i % 90), **tricky[i % 3]} for i in range(700)]

    def read(text):
        path.write_text(text, "utf-8")
        found = json_arrays.read_laid_out(spark, Place(path))
        return found and (found, [(r["pos"], r["item"]) for r in found.orderBy("pos").collect()])

    whole = lambda data: [(r["pos"], r["item"]) for r in json_arrays.read_raw(spark, path.as_uri()).orderBy("pos").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        for data, mark in ((items, ""), (items, "\ufeff"), (items[:1], ""), (items[:2], "")):
            df, rows = read(mark + json.dumps(data, ensure_ascii=False, indent=2) + "\n")
            assert [json.loads(x) for _, x in rows] == data and rows == whole(data)
            assert len(data) < 10 or df.select("item").rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for other in ([], [{}, {"a": 1}], [{"a": 1}, {}], [{"a": 1}, 5], {"a": 1}):
        assert read(json.dumps(other, indent=2)) is None
    for text in (json.dumps(items), json.dumps(items, indent=4), json.dumps(items[:2], indent=2)[:-2], json.dumps(items[:2], indent=2).replace('"id": 1', '"id": 1 1'), json.dumps(items[:2], indent=2) * 2):
        assert read(text) is None
    path.write_text(json.dumps([{"a": 1}, {}], indent=2), "utf-8")
    assert json_arrays.read_array(spark, path).count() == 2


def test_json_scalars_as_python_writes_them(spark):
    item = {"metadata": {"table_name": None}, "classification": {"category_leaf_level": True}, "id": None}
    df = spark.createDataFrame([(0, json.dumps(item)), (1, "{}")], "pos int, item string")
    rows = chat.parsed_records(df).orderBy("pos").collect()
    assert [r["id"] for r in rows] == ["None", ""] and rows[0]["classification"]["category_leaf_level"] == "True" and rows[0]["metadata"]["table_name"] == "None"
    labels = df.select(split.label_value(F.col("item"), "classification.category_leaf_level").alias("x"), split.label_value(F.col("item"), "metadata.table_name").alias("y")).collect()
    assert [tuple(r) for r in labels] == [("True", ""), ("", "")]


def test_export(spark, data, tmp_path):
    path, items = data
    split.split_dataset(spark, path, tmp_path / "out")
    report = chat.export_dataset(spark, tmp_path / "out", tmp_path / "rft")
    assert sum(s["exported_records"] for s in report["splits"].values()) == 39 and sum(s["skipped_unlabeled"] for s in report["splits"].values()) == 1
    line = json.loads((tmp_path / "rft" / "test.jsonl").read_text("utf-8").splitlines()[0])
    assert list(line) == ["messages", "reference_answer", "reference_answer_json", "source_id"]
    assert json.loads(line["reference_answer_json"]) == line["reference_answer"] and [m["role"] for m in line["messages"]] == ["developer", "user"]
    assert line["messages"][1]["content"].split("\n")[1].startswith("表名称：t")
    broken = dict(items[0])
    del broken["grading"]
    (tmp_path / "out" / "train.json").write_text(json.dumps([broken]), "utf-8")
    with pytest.raises(ValueError, match="Item 0 in .* has invalid grading"):
        chat.export_dataset(spark, tmp_path / "out", tmp_path / "rft")
