import json
import warnings
import zipfile

import pytest

from stratagrade.operators import records
from stratagrade.sources import mapping as places
from stratagrade.sources.places import Place
from stratagrade.sources.tables import column_names, read_csv, read_table

MAPPING = {"db": "database_name", "tb": "table_name", "f": "field_name", "leaf": "level_4", "grade": "data_level"}
HEADER = "db,tb,f,leaf,grade,augmented_column_name1,augmented_column_name2\n"
TABLE = HEADER + "d,t,f,A（A1）,L2,f1,\nd,t,f,A,L2,f9,\nd,t, ,B,L1,,\nd,t,g,B,L1,g1,g1\nd,t,g,C,L1,,\n"


@pytest.fixture
def source(tmp_path):
    (tmp_path / "mini.csv").write_text(TABLE, "utf-8-sig")
    (tmp_path / "m.json").write_text(json.dumps(MAPPING), "utf-8")
    return tmp_path


def run(spark, folder, **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        records.preprocess(spark, folder / "mini.csv", folder / "m.json", folder / "all.json", **options)
    return json.loads((folder / "all.json").read_text("utf-8"))


def test_mini_table(spark, source):
    out = run(spark, source, missing_field_policy="skip", conflicting_label_policy="keep")
    assert [(r["metadata"]["field_name"], r["label_status"], r["classification"]["category_leaf_level"]) for r in out] == [
        ("f", "original", "A"), ("f1", "synthesized", "A"), ("g", "original", "B"), ("g1", "synthesized", "B"), ("g1", "synthesized", "B"), ("g", "original", "C"),
    ]
    assert len({r["id"] for r in out}) == 6
    assert list(out[0]) == ["id", "domain", "label_status", "metadata", "classification", "grading"] and out[0]["domain"] == "mini"
    with pytest.raises(FileExistsError):
        run(spark, source, missing_field_policy="skip", conflicting_label_policy="keep")


def test_policies(spark, source):
    with pytest.raises(ValueError, match="source rows: 4"):
        run(spark, source)
    with pytest.raises(ValueError, match="Conflicting labels found for the same field: d/t/g"):
        run(spark, source, missing_field_policy="skip")
    with pytest.raises(ValueError, match="missing_field_policy"):
        run(spark, source, missing_field_policy="drop")


def test_record_ids_match_the_fixture(spark, tmp_path):
    (tmp_path / "sample.csv").write_text("db,tb,f,leaf,grade,root,augmented_column_name1\ndb1,t_user,user_name,基本信息,L2,个人信息,login_name\n", "utf-8")
    got = records.build_records(read_table(spark, tmp_path / "sample.csv"), MAPPING | {"root": "level_1"}, source_name="sample.csv", domain="x").orderBy("_pos").collect()
    assert [r["id"] for r in got] == ["d5cd84f6-b99e-5cd3-89b2-e6fce0488898", "96564593-08a1-5439-b3f2-6fb07300c9c1"]


def test_schema_checks(spark):
    df = spark.createDataFrame([("x", "y")], "`a.b` string, field_name string")
    with pytest.raises(ValueError, match="Unsupported mapping targets"):
        records.convert_schema(df, {"a.b": "nope"})
    with pytest.raises(ValueError, match="Multiple source columns"):
        records.convert_schema(df, {"a.b": "table_name", "field_name": "table_name"})
    with pytest.raises(ValueError, match="not found: zz"):
        records.convert_schema(df, {"zz": "table_name"})
    with pytest.raises(ValueError, match="already exist"):
        records.convert_schema(df, {"a.b": "field_name"})
    row = records.convert_schema(df, {"a.b": "table_name"}).first()
    assert (row["table_name"], row["field_name"], row["database_name"]) == ("x", "y", "")


def test_mapping_checks():
    for bad in ({}, [], {"a": 1}, {" ": "x"}, {"a": "table_name", " a": "field_name"}):
        with pytest.raises(ValueError):
            records.check_mapping(bad)
    assert records.check_mapping({" a ": " level_4 "}) == {"a": "category_leaf_level"}


def test_places(tmp_path):
    assert places.discover_datasets() == ("education", "finance", "infra", "pers_info", "shougang")
    raw = tmp_path / "data" / "raw"
    raw.mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        places.default_input("infra", tmp_path)
    (raw / "infras.csv").write_text("x")
    assert places.default_input("INFRA ", tmp_path).name == "infras.csv"
    (raw / "infra.xlsx").write_text("x")
    with pytest.raises(ValueError, match="Multiple"):
        places.default_input("infra", tmp_path)
    with pytest.raises(ValueError):
        places.dataset_name("../x")


def test_headers():
    assert column_names(["a", "a", " b "]) == ["a", "a.1", "b"]
    with pytest.raises(ValueError, match="Duplicate source columns: a"):
        column_names(["a", " a"])


def test_quoted_cells_and_ordinals(spark, tmp_path):
    (tmp_path / "q.csv").write_text('x,y\n"two\nlines","say ""hi"""\n\n007,NA\n', "utf-8")
    rows = read_table(spark, tmp_path / "q.csv").orderBy("_row").collect()
    assert [tuple(r) for r in rows] == [("two\nlines", 'say "hi"', 0), ("007", "", 1)]
    (tmp_path / "q.txt").write_text("x")
    with pytest.raises(ValueError, match="Unsupported input type"):
        read_table(spark, tmp_path / "q.txt")


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2" t="b"><v>1</v></c></row>'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    df = read_table(spark, tmp_path / "t.xlsx")
    assert df.columns == ["a", "Unnamed: 1", "c", "_row"] and tuple(df.first()) == ("7", "", "True", 0)


def test_xlsx_order_and_dates(spark, tmp_path):
    from stratagrade.plans.files import write_xlsx

    write_xlsx(tmp_path / "t.xlsx", [["day", "n"], [("date", 45000), 1], [("date", 45000.75), 1.5], [("date", 0.5), ""]])
    df = read_table(spark, tmp_path / "t.xlsx")
    assert [tuple(r) for r in df.orderBy("_row").collect()] == [("2023-03-15 00:00:00", "1", 0), ("2023-03-15 18:00:00", "1.5", 1), ("12:00:00", "", 2)]


def test_csv_is_cut_unless_cells_have_line_breaks(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(5000)), "utf-8")
    (tmp_path / "broken.csv").write_text('"a\nhead",b\n1,"two\nlines"\n2,y\n', "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        plain = read_table(spark, tmp_path / "plain.csv")
        assert plain.select("a", "b").rdd.getNumPartitions() > 4
        assert [r["_row"] for r in plain.orderBy("_row").collect()] == [int(r["a"]) for r in plain.orderBy("_row").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    broken = read_table(spark, tmp_path / "broken.csv")
    assert broken.columns == ["a\nhead", "b", "_row"] and [tuple(r) for r in broken.orderBy("_row").collect()] == [("1", "two\nlines", 0), ("2", "y", 1)]


def test_all_binding_problems_are_named(spark):
    df = spark.createDataFrame([("x", "y")], "a string, field_name string")
    with pytest.raises(ValueError, match="Unsupported mapping targets: nope; Mapped source columns not found: zz; Mapped columns already exist: field_name"):
        records.convert_schema(df, {"a": "field_name", "zz": "nope"})


def test_own_mappings(tmp_path, capsys):
    from stratagrade import cli

    (tmp_path / "mappings").mkdir()
    (tmp_path / "mappings" / "mine.json").write_text(json.dumps(MAPPING))
    cli.main(["--root", str(tmp_path), "list-datasets"])
    assert "mine" in capsys.readouterr().out.split()
    assert places.resolve_mapping("mine", folder=tmp_path / "mappings")["leaf"] == "category_leaf_level"


def test_bundles_are_whole_or_nothing(tmp_path):
    from stratagrade.sinks.files import Bundle, write_json, write_json_array

    (tmp_path / "a.json").write_text("old")
    with pytest.raises(RuntimeError), Bundle() as bundle:
        write_json({"x": 1}, tmp_path / "a.json", bundle=bundle)
        write_json_array(iter([{"y": 2}]), tmp_path / "b.json", bundle=bundle)
        raise RuntimeError
    assert [p.name for p in tmp_path.iterdir()] == ["a.json"] and (tmp_path / "a.json").read_text() == "old"
    with Bundle() as bundle:
        write_json({"x": 1}, tmp_path / "a.json", bundle=bundle)
        write_json([], tmp_path / "b.json", bundle=bundle)
        assert (tmp_path / "a.json").read_text() == "old"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"] and json.loads((tmp_path / "a.json").read_text()) == {"x": 1}


def test_partition_count_does_not_matter(spark):
    rows = [(i, "d", "t", f"f{i % 7}", "A", "L1") for i in range(200)]
    df = spark.createDataFrame(rows, "_row long, database_name string, table_name string, field_name string, category_leaf_level string, sensitivity_level string")
    from pyspark.sql import functions as F

    df = df.withColumns({f: F.lit("") for f in ("category_root_level", "category_branch_level", "category_subbranch_level")})
    for n in (1, 2, 8):
        assert sorted(r["_row"] for r in records.first_per_identity(df.repartition(n)).collect()) == list(range(7))


def test_folder_ordinals_follow_names(spark, tmp_path):
    """A small file before a large one, which Spark reads first; and a file in several blocks."""
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n" + "".join(f"a{i},x\n" for i in range(3)), "utf-8")
    (folder / "b c.csv").write_text("k,v\n" + "".join(f"b{i},x\n" for i in range(3000)), "utf-8")
    (folder / "d.csv").write_text('"k",v\n' + "".join(f"d{i},\n" for i in range(2)), "utf-8")
    (folder / "e.csv").write_text("", "utf-8")
    want = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(3000)] + ["d0", "d1"]
    for size in ("4096", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_csv(spark, folder.as_uri()).orderBy("_row").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r["k"], r["_row"]) for r in rows] == [(k, i) for i, k in enumerate(want)]
    (folder / "c.csv").write_text("k,w\nx,y\n", "utf-8")
    with pytest.raises(ValueError, match=r"header of .*c\.csv is not that of .*a\.csv"):
        read_csv(spark, folder.as_uri())


def test_folder_with_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "z.csv").write_text('"k\nk",v\n1,"two\nlines"\n', "utf-8")
    (tmp_path / "y.csv").write_text('"k\nk",v\n2,\n3,w\n', "utf-8")
    rows = read_csv(spark, tmp_path.as_uri()).orderBy("_row")
    assert rows.columns == ["k\nk", "v", "_row"] and [tuple(r) for r in rows.collect()] == [("2", "", 0), ("3", "w", 1), ("1", "two\nlines", 2)]


@pytest.fixture
def store(spark, tmp_path):
    """The same folder under another scheme, which only Hadoop's file systems reach."""
    (tmp_path / "store").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.places.link./in", (tmp_path / "store").as_uri())
    spark._jvm.org.apache.hadoop.fs.FileSystem.closeAll()
    return "viewfs://places/in"


@pytest.fixture(params=["local", "viewfs"])
def anywhere(request, tmp_path, store):
    return Place(store) if request.param == "viewfs" else Place((tmp_path / "store").as_uri())


def test_files_on_any_file_system(spark, anywhere):
    assert str(Place("s3a://bucket/a/../b.csv")) == "s3a://bucket/b.csv" and Place("hdfs:/x").uri == "hdfs:///x" and Place("file:///a/b").local is not None
    raw = anywhere / "data" / "raw"
    with pytest.raises(FileNotFoundError, match="No raw 'infra' file"):
        places.default_input("infra", anywhere)
    (raw / "infras.csv").write(["db,tb,f,leaf,grade\n", "d,t,ü,A（A1）,L1\n", "d,t,g,B,L2\n"])
    assert places.default_input(" INFRA", anywhere) == raw / "infras.csv"
    (raw / "infra.xlsx").write_bytes(b"x")
    with pytest.raises(ValueError, match="Multiple"):
        places.default_input("infra", anywhere)
    (anywhere / "mappings" / "own.json").write(["﻿", json.dumps(MAPPING)])
    (anywhere / "mappings" / "no name!.json").write(["{}"])
    assert "own" in places.discover_datasets(anywhere / "mappings") and len(places.discover_datasets(anywhere / "mappings")) == 6
    mapping = places.resolve_mapping("own", folder=anywhere / "mappings")
    records.preprocess(spark, raw / "infras.csv", mapping, anywhere / "out" / "all.json")
    made = json.loads((anywhere / "out" / "all.json").read_text())
    assert [r["metadata"]["field_name"] for r in made] == ["ü", "g"] and (anywhere / "out" / "all.json").read_bytes().endswith(b"\n]\n")
    with pytest.raises(FileExistsError, match="Refusing to overwrite"):
        records.preprocess(spark, raw / "infras.csv", mapping, anywhere / "out" / "all.json")
    records.preprocess(spark, raw / "infras.csv", mapping, anywhere / "out" / "all.json", overwrite=True, domain="x")
    assert json.loads((anywhere / "out" / "all.json").read_text())[0]["domain"] == "x"
    assert [p.name for p in (anywhere / "out").files() if not p.name.endswith(".crc")] == ["all.json"]  # nothing staged is left
    with pytest.raises(FileNotFoundError, match="Input file not found"):
        read_table(spark, raw / "nothing.csv")
    (anywhere / "out").delete()
    assert not (anywhere / "out").exists() and (anywhere / "out").files() == []


def test_tables_and_splits_elsewhere(spark, anywhere):
    from stratagrade.operators import chat, corpus, split
    from stratagrade.plans.files import write_xlsx

    write_xlsx(anywhere / "g.xlsx", [["四级子类", "内容"], ["A（A1）", "x  y"], ["B", "z"]])
    corpus.build_corpus(spark, "d", anywhere / "g.xlsx", anywhere / "corpus", project_root=anywhere)
    assert json.loads((anywhere / "corpus" / "build_report.json").read_text())["source"] == "g.xlsx"
    levels = {f"category_{x}_level": "" for x in ("root", "branch", "subbranch")} | {"category_leaf_level": "A"}
    names = ("database_name", "database_description", "table_name", "table_description", "field_name", "field_description", "field_type", "value")
    items = [{"id": f"r{i}", "metadata": dict.fromkeys(names, "m"), "classification": levels, "grading": {"sensitivity_level": "L1"}} for i in range(20)]
    (anywhere / "all.json").write([json.dumps(items)])
    assert split.split_dataset(spark, anywhere / "all.json", anywhere / "splits")["sizes"] == {"train": 16, "val": 2, "test": 2}
    assert chat.export_dataset(spark, anywhere / "splits", anywhere / "lines")["splits"]["train"]["exported_records"] == 16
    assert len((anywhere / "lines" / "train.jsonl").read_text().splitlines()) == 16
