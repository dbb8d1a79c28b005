import json

import pytest

from stratagrade import cli
from stratagrade.operators import corpus, standards

TABLE = "四级子类,内容\nA（A1）,x  y\nA,x y\n(A3),z\n,q\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "g.csv").write_text(TABLE, "utf-8")
    return tmp_path


def processed(folder, branches=("B1", "B2")):
    items = [{"classification": {"category_leaf_level": "A", "category_root_level": "R1", "category_branch_level": b}, "grading": {"sensitivity_level": "L2"}} for b in branches]
    items.append({"classification": {"category_leaf_level": "Z"}})
    (folder / "all.json").write_text(json.dumps(items), "utf-8")
    return folder / "all.json"


def test_build(spark, folder):
    with pytest.warns(UserWarning):
        report = corpus.build_corpus(spark, "d", folder / "g.csv", folder / "out", processed_file=processed(folder), project_root=folder)
    docs = json.loads((folder / "out" / "corpus.json").read_text("utf-8"))
    assert [(d["metadata"]["level_4"], d["metadata"].get("source_level_4"), d["metadata"]["source_row"], d["text"]) for d in docs] == [("A", "A（A1）", 2, "x y"), ("", "(A3)", 4, "z")]
    assert list(docs[0]) == ["id", "text", "metadata"] and docs[0]["metadata"]["source"] == "g.csv"
    assert report["skipped_missing"] == {"count": 1, "rows": [{"source_row": 5, "missing_columns": ["四级子类"]}]}
    assert report["skipped_exact_duplicates"]["rows"] == [{"source_row": 3, "duplicate_of_source_row": 2}]
    assert report["normalized_labels"]["source_rows"] == [2, 4]
    assert report["corpus_statistics"]["content_length"] == {"min": 1, "max": 3, "average": 2.0}
    assert report["processed_label_coverage"] == {"available": True, "processed_unique_level_4": 2, "overlap": 1, "processed_labels_without_corpus": ["Z"], "corpus_labels_unused_by_processed": [""]}
    with pytest.raises(FileExistsError):
        corpus.build_corpus(spark, "d", folder / "g.csv", folder / "out")
    with pytest.raises(ValueError, match="Missing 四级子类 at source row 5"):
        corpus.build_corpus(spark, "d", folder / "g.csv", folder / "o2", missing_policy="error")
    with pytest.raises(ValueError, match="missing column"):
        corpus.build_corpus(spark, "d", folder / "g.csv", folder / "o2", label_column="nope")


def test_standard_and_normalize(spark, folder):
    made = folder / "flat.json"
    report = corpus.build_standard_corpus(spark, "Edu", folder / "g.csv", made, processed_file=processed(folder), content_column="内容", leaf_column="四级子类", reference_standard="S")
    rows = json.loads(made.read_text("utf-8"))
    assert len(rows) == 1 and rows[0]["category_root_level"] == "R1" and rows[0]["category_branch_level"] == "" and rows[0]["sensitivity_level"] == "L2"
    assert rows[0]["id"].startswith("edu-") and rows[0]["dataset"] == "Edu" and list(rows[0])[0] == "id"
    assert report["ambiguous_processed_fields"] == [{"source_row": 2, "field": "category_branch_level", "values": ["B1", "B2"]}]
    assert report["skipped_rows"] == [4, 5] and report["duplicate_rows"] == [{"source_row": 3, "duplicate_of_source_row": 2}]
    assert corpus.normalize_standard_corpus(spark, made, made, dataset="new")["exported_documents"] == 1
    assert json.loads(made.read_text("utf-8"))[0] == rows[0] | {"dataset": "new"}
    (folder / "bad.json").write_text('[{"id": "x"}]')
    with pytest.raises(ValueError, match="Corpus item 0 is missing"):
        corpus.normalize_standard_corpus(spark, folder / "bad.json", folder / "o.json", dataset="n")


def test_standards(spark, folder):
    (folder / "s.csv").write_text("skip,,,\n定义说明3,定义说明4,三级分类,四级分类\na,——,c3,——\nb,d,c3,\"c\n4\"\nb,d,c3,last\n", "utf-8")
    from stratagrade.functions.order import ROW

    rows = [("a", "——", "c3", "——", 0), ("b", "d", "c3", "c\n4", 1), ("b", "d", "c3", "last", 2)]
    table = spark.createDataFrame(rows, f"`定义说明3` string, `定义说明4` string, `三级分类` string, `四级分类` string, {ROW} long")
    assert [tuple(r) for r in standards.standards_from_table(table).collect()] == [("a", "c3"), ("d", "last")]
    (folder / "d.json").write_text(json.dumps({"x": {"category": "c", "class": "k", "ref": "r"}}))
    (folder / "e.json").write_text(json.dumps({"xx": "x"}))
    joined = standards.expanded_standards(standards.read_expansions(spark, str(folder / "e.json")), standards.read_dictionary(spark, str(folder / "d.json")))
    assert joined.first().asDict() == {"description": "x", "expanded": "xx", "category": "c", "class": "k", "ref": "r"}


def test_commands(spark, folder, capsys):
    (folder / "raw.csv").write_text("数据库名,表名,表描述,字段名,字段描述,一级分类,二级分类,三级分类,四级分类,分级\n" + "".join(f"d,t{i % 5},,f{i},,r,,,A,L1\n" for i in range(20)), "utf-8")
    assert cli.main(["list-datasets"]) == 0
    assert cli.main(["--root", str(folder), "prepare", "--dataset", "infra", "--input", str(folder / "raw.csv")]) == 0
    out = folder / "data" / "processed" / "infra"
    assert {p.name for p in out.iterdir()} == {"all.json", "train.json", "val.json", "test.json", "split_report.json"}
    assert cli.main(["export", "--input-dir", str(out), "--output-dir", str(folder / "rft")]) == 0
    assert "train: exported=" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["split", "--input", str(folder / "none.json"), "--output-dir", str(folder / "x")])
    assert e.value.code == 2


def test_stream(spark, folder):
    from stratagrade.streaming.records import normalized_stream

    (folder / "in").mkdir()
    (folder / "in" / "a.csv").write_text("T,F1（A1）\nT,\n", "utf-8")
    stream = spark.readStream.schema("tb string, f string").csv(str(folder / "in"))
    q = normalized_stream(stream, {"tb": "table_name", "f": "field_name"}).writeStream.format("memory").queryName("rows").start()
    q.processAllAvailable()
    q.stop()
    assert [r["field_name"] for r in spark.table("rows").collect()] == ["F1（A1）"]
