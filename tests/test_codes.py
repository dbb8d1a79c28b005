import json

import pytest
from pyspark.sql import functions as F

from stratagrade.operators import codes, standards


@pytest.fixture
def dictionary(spark, tmp_path):
    """As the education standard is written: the code leads the category."""
    entries = {
        "姓名、手机号": "A1-1:基本信息", "身份证件号": "A1-2:身份信息", "成绩": "A2-10：成绩信息", "全部": "A2:教学", "另一个": "A1-1:重复", "无编码": "其他信息",
    }
    (tmp_path / "d.json").write_text(json.dumps({k: {"category": c, "class": "敏感数据", "ref": "r"} for k, c in entries.items()}, ensure_ascii=False), "utf-8")
    return standards.read_dictionary(spark, (tmp_path / "d.json").as_uri())


def test_codes(spark):
    rows = [("A1-1:基本信息", "A1-1", "基本信息"), (" a１-2 ： x", "A1-2", "x"), ("VIN:x", "", "VIN:x"), ("基本信息", "", "基本信息"), (None, "", ""), ("A1-", "", "A1-")]
    df = spark.createDataFrame([(c,) for c, _, _ in rows], "c string").select(codes.leading_code(F.col("c")).alias("code"), codes.without_leading_code(F.col("c")).alias("name"))
    assert [tuple(r) for r in df.collect()] == [(code, name) for _, code, name in rows]
    labels = [("基本信息（A1-1-3）", "A1-1-3"), ("x [b２] ", "B2"), ("车辆(VIN)", ""), ("x（A1）y", ""), (None, "")]
    df = spark.createDataFrame([(c,) for c, _ in labels], "c string").select(codes.trailing_code(F.col("c")).alias("code"))
    assert [r["code"] for r in df.collect()] == [code for _, code in labels]
    paths = spark.createDataFrame([("",), ("AB12",), ("A1-2-3",)], "c string").select(codes.code_prefixes(F.col("c")).alias("p"))
    assert [r["p"] for r in paths.collect()] == [[], ["AB", "AB12"], ["A", "A1", "A1-2", "A1-2-3"]]


def test_education_form_resolves(spark, dictionary):
    trie = codes.code_trie(dictionary, codes.leading_code(F.col("category")))
    nodes = {r["prefix"]: (r["depth"], r["parent"], r["codes"], r["entry"] and r["entry"]["category"]) for r in trie.collect()}
    assert nodes == {"A": (0, None, 4, None), "A1": (1, "A", 2, None), "A1-1": (2, "A1", 1, "A1-1:重复"), "A1-2": (2, "A1", 1, "A1-2:身份信息"), "A2": (1, "A", 2, "A2:教学"), "A2-10": (2, "A2", 1, "A2-10：成绩信息")}
    leaves = [("基本信息（A1-1-3）", "A1-1", False, 0), ("身份（A1－2）", None, False, 0), ("身份（A1-2）", "A1-2", True, 0), ("教学（A2-1）", "A2", False, 0), ("教学[a2]", "A2", True, 1), ("个人（A1）", None, False, 2), ("无", None, False, 0), (None, None, False, 0), ("Z（Z9-1）", None, False, 0)]
    df = spark.createDataFrame([(c, i) for i, (c, *_) in enumerate(leaves)], "leaf string, below_it int")
    got = codes.link_codes(df, codes.trailing_code(F.col("leaf")), trie).orderBy("below_it").collect()
    assert [(r["leaf"], r["linked_code"], r["exact"], r["below"]) for r in got] == leaves
    assert got[0]["class"] == "敏感数据" and got[1]["class"] is None
    assert codes.link_codes(df, codes.trailing_code(F.col("leaf")), trie.limit(0)).where("linked_code IS NOT NULL").isEmpty()
