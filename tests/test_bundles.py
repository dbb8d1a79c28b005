import json

import pytest
from pyspark.sql import functions as F

from stratagrade.operators import folders
from stratagrade.sinks.bundles import MANIFEST, BundleFolder, read_manifest, read_part, read_report
from stratagrade.sources.places import Place

LEVELS = ("root", "branch", "subbranch", "leaf")


@pytest.fixture(params=["local", "viewfs"])
def folder(request, spark, tmp_path):
    (tmp_path / "store").mkdir()
    if request.param == "local":
        return Place(tmp_path / "store") / "b"
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.bundles.link./in", (tmp_path / "store").as_uri())
    spark._jvm.org.apache.hadoop.fs.FileSystem.closeAll()
    return Place("viewfs://bundles/in/b")


def put(spark, folder, n, **options):
    with BundleFolder(folder, **options) as b:
        assert b.write("numbers", spark.range(n)) == n
        b.write("lines", spark.range(n).select(F.concat(F.lit("ü"), "id")))
        b.write_json("report", {"n": n})


def seen(spark, folder):
    return sorted(r["id"] for r in read_part(spark, folder, "numbers").collect()), {r["value"] for r in read_part(spark, folder, "lines").collect()}, read_report(folder, "report")


def whole(n):
    return list(range(n)), {f"ü{i}" for i in range(n)}, {"n": n}


def test_versions(spark, folder):
    with pytest.raises(FileNotFoundError):
        read_manifest(folder)
    put(spark, folder, 3)
    assert seen(spark, folder) == whole(3)
    with pytest.raises(FileExistsError):
        put(spark, folder, 4)
    began = read_part(spark, folder, "numbers")
    put(spark, folder, 5, overwrite=True)
    assert seen(spark, folder) == whole(5) and began.count() == 3  # who has begun with the old version ends with it
    put(spark, folder, 0, overwrite=True)
    assert seen(spark, folder) == whole(0)
    assert sorted(p.name for p in folder.files() if not p.name.endswith(".crc")) == [MANIFEST]


def test_a_failing_stage_leaves_the_old_version(spark, folder):
    put(spark, folder, 3)
    old = read_manifest(folder)
    with pytest.raises(Exception, match="broken"):
        with BundleFolder(folder, overwrite=True) as b:
            b.write("numbers", spark.range(9))
            b.write("lines", spark.range(9).select(F.when(F.col("id") < 8, "x").otherwise(F.raise_error(F.lit("broken")))))
    assert read_manifest(folder) == old and seen(spark, folder) == whole(3) and not b.stage.exists()
    halted = BundleFolder(folder, overwrite=True)  # a process that dies never gets to its end
    halted.write("numbers", spark.range(7))
    assert seen(spark, folder) == whole(3)
    with pytest.raises(ValueError, match="other than a, b"):
        with BundleFolder(folder, overwrite=True) as b:
            b.write_by("k", spark.createDataFrame([("a", 1), ("c", 2)], "k string, n int"), ("a", "b"))
    assert seen(spark, folder) == whole(3)


def test_parts_by_a_column(spark, folder):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("a", 3, "y")], "k string, n int, t string")
    with BundleFolder(folder) as b:
        assert b.write_by("k", rows, ("a", "b", "c")) == {"a": 2, "b": 1, "c": 0}
    assert sorted(tuple(r) for r in read_part(spark, folder, "a").select("n", "t").collect()) == [(1, None), (3, "y")]
    assert read_part(spark, folder, "c").columns == ["n", "t"] and read_part(spark, folder, "c").count() == 0


def item(i, table, leaf):
    levels = {f"category_{x}_level": "" for x in LEVELS[:3]} | {"category_leaf_level": leaf}
    names = ("database_name", "database_description", "table_name", "table_description", "field_name", "field_description", "field_type", "value")
    return {"id": f"r{i}", "extra": {"z": 1.50, "ü": [None]}, "metadata": dict.fromkeys(names, "") | {"table_name": table}, "classification": levels, "grading": {"sensitivity_level": "L1"}}


@pytest.fixture
def lines(tmp_path):
    items = [item(i, f"t{i % 12}" if i != 5 else " ", f"leaf{i // 4}" if i != 7 else "") for i in range(200)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in items[k::3]), "utf-8")
    return tmp_path / "in", items


def records(spark, out):
    return {s: [json.loads(r["value"]) for r in read_part(spark, out, s).collect()] for s in ("train", "val", "test")}


def test_split_folder(spark, lines, tmp_path):
    source, items = lines
    report = folders.split_folder(spark, folders.read_items(spark, source), tmp_path / "out")
    assert report["sizes"] == {"train": 160, "val": 20, "test": 20} and read_report(tmp_path / "out", "report") == report  # fifty strata of four
    parts = records(spark, tmp_path / "out")
    assert sorted((x for p in parts.values() for x in p), key=lambda x: int(x["id"][1:])) == items and {s: len(p) for s, p in parts.items()} == report["sizes"]
    told = {(r["field"], r["split"], r["value"]): r["n"] for r in read_part(spark, tmp_path / "out", "distributions").collect()}
    assert told["classification.category_leaf_level", next(s for s, p in parts.items() if any(x["id"] == "r7" for x in p)), "<EMPTY>"] == 1
    assert sum(n for (f, s, _), n in told.items() if f == "grading.sensitivity_level" and s == "val") == 20
    gaps = {(r["type"], r["label"]) for r in read_part(spark, tmp_path / "out", "warnings").collect()}
    have = {s: {x["classification"]["category_leaf_level"] for x in p} - {""} for s, p in parts.items()}
    assert {x for t, x in gaps if t == "train_labels_missing_from_val"} == have["train"] - have["val"] and {x for t, x in gaps if t == "labels_missing_from_train"} == (have["val"] | have["test"]) - have["train"]
    assert folders.read_items(spark, tmp_path / "out", "val").count() == 20


def test_group_split_folder(spark, lines, tmp_path):
    source, _ = lines
    read = folders.read_items(spark, source)
    with pytest.raises(ValueError, match="missing or empty"):
        folders.split_folder(spark, read, tmp_path / "g", split_type="group", group_key="metadata.table_name")
    with pytest.raises(ValueError, match="scalar"):
        folders.split_folder(spark, read, tmp_path / "g", split_type="group", group_key="extra.ü")
    assert not (tmp_path / "g" / MANIFEST).exists()
    with pytest.warns(UserWarning):
        report = folders.split_folder(spark, read, tmp_path / "g", split_type="group", group_key="metadata.table_name", missing_group_policy="skip")
    assert report["included_size"] == 199 and report["skipped_records"] == 1
    tables = [{x["metadata"]["table_name"] for x in p} for p in records(spark, tmp_path / "g").values()]
    assert all(tables) and sum(map(len, tables)) == 12


def test_export_and_corpus_folders(spark, lines, tmp_path):
    source, _ = lines
    folders.split_folder(spark, folders.read_items(spark, source), tmp_path / "out")
    report = folders.export_folder(spark, tmp_path / "out", tmp_path / "chat")
    assert sum(s["exported_records"] for s in report["splits"].values()) == 199 and sum(s["skipped_unlabeled"] for s in report["splits"].values()) == 1
    line = read_part(spark, tmp_path / "chat", "test").first()
    assert line["messages"][0]["role"] == "developer" and json.loads(line["reference_answer_json"])["grading"] == {"sensitivity_level": "L1"}
    guide = spark.createDataFrame([(0, "A（A1）", "x  y"), (1, "A", "x y"), (2, "(A3)", "z"), (3, " ", "q")], "_row long, l string, c string")
    made = folders.corpus_folder(spark, guide, "d", "g.csv", tmp_path / "corpus", label_column="l", content_column="c")
    assert (made["input_rows"], made["exported_documents"], made["skipped_missing"], made["skipped_exact_duplicates"], made["normalized_labels"]) == (4, 2, 1, 1, 2)
    assert [tuple(r) for r in read_part(spark, tmp_path / "corpus", "duplicates").collect()] == [(3, 2)]
    assert {r["text"] for r in read_part(spark, tmp_path / "corpus", "documents").collect()} == {"x y", "z"}
    with pytest.raises(ValueError, match="missing column"):
        folders.corpus_folder(spark, guide, "d", "g.csv", tmp_path / "other")
    with pytest.raises(ValueError, match="Skipping 1"):
        folders.corpus_folder(spark, guide, "d", "g.csv", tmp_path / "corpus", label_column="l", content_column="c", missing_policy="error", overwrite=True)
    assert read_report(tmp_path / "corpus", "report") == made  # the old version is as it was


def counting(spark, df):
    """The same rows, and a count of how many were read."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(through, df.schema), read


def jobs_of(spark, run):
    group = f"group-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


MAPPING = {"db": "database_name", "tb": "table_name", "f": "field_name", "leaf": "level_4", "grade": "data_level"}
COLUMNS = "_row long, db string, tb string, f string, leaf string, grade string, augmented_column_name1 string, augmented_column_name2 string"
#: As in the tests of single files.
MINI = [(0, "d", "t", "f", "A（A1）", "L2", "f1", ""), (1, "d", "t", "f", "A", "L2", "f9", ""), (2, "d", "t", " ", "B", "L1", "", ""), (3, "d", "t", "g", "B", "L1", "g1", "g1"), (4, "d", "t", "g", "C", "L1", "", "")]


def test_preprocess_reads_its_input_once(spark, tmp_path):
    clean = [(i, "d", f"t{i % 7}", f"f{i % 50}", f"A{i % 50} (X1)", "L1", "extra", " ") for i in range(3000)]
    table, read = counting(spark, spark.createDataFrame(clean, COLUMNS))
    jobs = jobs_of(spark, lambda: folders.preprocess_folder(spark, table, MAPPING, tmp_path / "p", source_name="s.csv", domain="x"))
    assert read.value == 3000 and jobs <= 3
    assert read_report(tmp_path / "p", "report") == {"input_rows": 3000, "missing_field_names": 0, "conflicts": 0, "records": 700}
    made = read_part(spark, tmp_path / "p", "records")
    assert made.count() == 700 and made.select("id").distinct().count() == 700 and made.groupBy("label_status").count().collect()[0]["count"] == 350


def test_preprocess_policies(spark, tmp_path):
    from stratagrade.operators import records as single

    df = spark.createDataFrame(MINI, COLUMNS)
    run = lambda **o: folders.preprocess_folder(spark, df, MAPPING, tmp_path / "q", source_name="mini.csv", **o)
    with pytest.raises(ValueError, match="field_name is empty at source rows: 4"):
        run()
    with pytest.raises(ValueError, match="Conflicting labels found for the same field: d/t/g"), pytest.warns(UserWarning):
        run(missing_field_policy="skip")
    assert not (tmp_path / "q" / MANIFEST).exists()
    with pytest.warns(UserWarning):
        report = run(missing_field_policy="skip", conflicting_label_policy="keep")
    assert report == {"input_rows": 5, "missing_field_names": 1, "conflicts": 1, "records": 6}
    with pytest.warns(UserWarning):
        want = single.build_records(df, MAPPING, source_name="mini.csv", missing_field_policy="skip", conflicting_label_policy="keep")
    got = read_part(spark, tmp_path / "q", "records")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
    with pytest.raises(ValueError, match="empty"):
        folders.preprocess_folder(spark, df.limit(0), MAPPING, tmp_path / "r", source_name="x")
    with pytest.raises(ValueError, match="missing_field_policy"):
        run(missing_field_policy="no")


def test_corpus_reads_its_input_once(spark, tmp_path):
    rows = [(i, f"L{i % 9}（A1）" if i % 11 else "", f"text  {i % 400}" if i % 13 else " ") for i in range(2000)]
    table, read = counting(spark, spark.createDataFrame(rows, "_row long, l string, c string"))
    report = folders.corpus_folder(spark, table, "d", "g", tmp_path / "c", label_column="l", content_column="c")
    assert read.value == 2000 and not (tmp_path / "c" / read_manifest(tmp_path / "c")["version"] / "work").exists()
    kept = [(label, text) for _, label, text in rows if label and text.strip()]
    assert (report["input_rows"], report["exported_documents"], report["skipped_missing"]) == (2000, len(set(kept)), 2000 - len(kept))
    assert report["skipped_exact_duplicates"] == len(kept) - len(set(kept)) and report["normalized_labels"] == len(kept)


def test_commands_with_bundles(spark, tmp_path, capsys):
    """From a folder of tables to chat lines, by tasks all the way."""
    from stratagrade import cli

    (tmp_path / "raw").mkdir()
    for k in range(3):
        (tmp_path / "raw" / f"{k}.csv").write_text("db,tb,f,leaf,grade\n" + "".join(f"d,t{i % 8},f{k}_{i},A（A{i % 3}）,L1\n" for i in range(40)), "utf-8")
    (tmp_path / "m.json").write_text(json.dumps(MAPPING), "utf-8")
    say = lambda *args: cli.main(["--root", str(tmp_path), *map(str, args), "--bundle"]) or json.loads(capsys.readouterr().out)
    assert say("preprocess", "--input", tmp_path / "raw", "--mapping", tmp_path / "m.json", "--output", tmp_path / "all")["records"] == 120
    assert say("split", "--input", tmp_path / "all", "--output-dir", tmp_path / "splits", "--type", "group", "--group-key", "metadata.table_name")["included_size"] == 120
    assert sum(s["exported_records"] for s in say("export", "--input-dir", tmp_path / "splits", "--output-dir", tmp_path / "chat")["splits"].values()) == 120
    (tmp_path / "g.csv").write_text("四级子类,内容\nA（A1）,x\n", "utf-8")
    assert say("build", "--dataset", "d", "--input", tmp_path / "g.csv", "--output-dir", tmp_path / "corpus")["exported_documents"] == 1
    assert say("standard", "--dataset", "D", "--input", tmp_path / "g.csv", "--output", tmp_path / "flat", "--content-column", "内容", "--leaf-column", "四级子类", "--processed", tmp_path / "all")["exported_documents"] == 1
    assert say("normalize", "--dataset", "E", "--input", tmp_path / "flat", "--output", tmp_path / "flat", "--overwrite")["exported_documents"] == 1


def test_flat_corpus_folders(spark, tmp_path):
    guide = spark.createDataFrame([(0, "A（A1）", "x  y", ""), (1, "A", "x y", "R9"), (2, "(A3)", "z", ""), (3, "B", "q", "own")], "_row long, l string, c string, r string")
    known = [{"classification": {"category_leaf_level": "A", "category_root_level": "R1", "category_branch_level": b}, "grading": {"sensitivity_level": "L1"}} for b in ("B1", "B2")]
    items = spark.createDataFrame([(json.dumps(x),) for x in known], "item string")
    columns = {"data_description_and_example": "c", "category_leaf_level": "l", "category_root_level": "r"}
    report = folders.standard_folder(spark, guide, "Edu", tmp_path / "flat", columns=columns, processed=items, reference_standard="S")
    assert report == {"dataset": "Edu", "input_rows": 4, "exported_documents": 2, "skipped_rows": 1, "duplicate_rows": 1, "ambiguous_processed_fields": 1}
    rows = {r["category_leaf_level"]: r for r in read_part(spark, tmp_path / "flat", "documents").collect()}
    assert (rows["A"]["category_root_level"], rows["A"]["category_branch_level"], rows["A"]["sensitivity_level"], rows["B"]["category_root_level"]) == ("R1", "", "L1", "own")
    assert [tuple(r) for r in read_part(spark, tmp_path / "flat", "ambiguous").collect()] == [(2, "category_branch_level", ["B1", "B2"])]
    with pytest.raises(ValueError, match="missing column"):
        folders.standard_folder(spark, guide, "Edu", tmp_path / "none", columns=columns | {"sensitivity_level": "zz"})
    again = folders.normalize_folder(spark, folders.read_items(spark, tmp_path / "flat", "documents"), "other", tmp_path / "flat", overwrite=True)  # in its own place
    assert again == {"input_rows": 2, "exported_documents": 2}
    renamed = {r["category_leaf_level"]: r for r in read_part(spark, tmp_path / "flat", "documents").collect()}
    assert {r["dataset"] for r in renamed.values()} == {"other"} and {k: r["id"] for k, r in renamed.items()} == {k: r["id"] for k, r in rows.items()}
    with pytest.raises(ValueError, match="is missing: .*dataset"):
        folders.normalize_folder(spark, spark.createDataFrame([("{}",)], "item string"), "x", tmp_path / "bad")
