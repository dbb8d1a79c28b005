"""Single files whose texts tasks write: the bytes of Python's own writer, and no row on the driver."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrade.sinks.files import Bundle, write_json_array, write_jsonl


def test_no_row_reaches_the_driver(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rows on the driver")

    for name in ("toLocalIterator", "collect", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, refuse)
    df = spark.range(300).repartition(7).orderBy("id").select("id", F.struct(F.lit('ü\n"').alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b")).alias("in"))
    want = [{"id": i, "in": {"a": 'ü\n"', "b": "x" if i % 2 == 0 else None}} for i in range(300)]
    write_json_array(df, tmp_path / "a.json")
    assert (tmp_path / "a.json").read_text("utf-8") == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
    write_jsonl(df, tmp_path / "a.jsonl")
    assert (tmp_path / "a.jsonl").read_text("utf-8") == "".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) + "\n" for x in want)
    write_json_array(df.select("id"), tmp_path / "of.json", of=lambda row: {"n": -row["id"]})
    assert json.loads((tmp_path / "of.json").read_text()) == [{"n": -i} for i in range(300)]
    write_json_array(df.where("id < 0"), tmp_path / "none.json")
    write_jsonl(df.where("id < 0"), tmp_path / "none.jsonl")
    assert (tmp_path / "none.json").read_text() == "[]\n" and (tmp_path / "none.jsonl").read_text() == ""
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "a.jsonl", "none.json", "none.jsonl", "of.json"]


def test_a_failing_task_leaves_the_file(spark, tmp_path):
    (tmp_path / "a.json").write_text("old")
    bad = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("stop"))).otherwise("x").alias("value"))
    try:
        with Bundle() as bundle:
            bundle.add_lines(tmp_path / "a.json", bad, "\n")
    except Exception as e:
        assert "stop" in str(e)
    assert (tmp_path / "a.json").read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["a.json"]
