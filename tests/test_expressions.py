import uuid

import pytest
from pyspark.sql import functions as F

from stratagrade.functions import text as tx


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_clean_text(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    given = [None, "a　b\x1fc\xa0 ", "\n\t", *[f"{s}a{s}{s}b{s}" for s in spaces]]
    assert values(spark, tx.clean_text, given) == ["", "a b c", "", *["a b"] * len(spaces)]


@pytest.mark.parametrize("raw, want", [
    ("基本信息（A3）", "基本信息"), ("x (A01) ", "x"), ("学籍（A1-1-3）", "学籍"), ("信息（A３）", "信息"), ("客户 [B2-1]  ", "客户"), ("车辆(VIN)", "车辆"),
    ("X（A1）（A2）", "X（A1）"), ("(A3】", ""), ("【A】", ""), ("(A3)", ""), ("用户(含APP)", "用户(含APP)"), ("定位(GPS信息)", "定位(GPS信息)"), (None, ""),
])
def test_normalize_label(spark, raw, want):
    assert values(spark, tx.normalize_label, [raw]) == [want]


def test_normalize_type(spark):
    given = ["varchar(20)", "INT UNSIGNED", "timestamp(6) with time zone", "Number(10,2)", "character varying(20)", "", None]
    want = ["STRING", "INTEGER", "DATETIME", "DECIMAL", "CHARACTER VARYING(20)", "", ""]
    assert values(spark, tx.normalize_type, given) == want
    assert values(spark, tx.normalize_type, ["INTEGER", "DATETIME"]) == ["INTEGER", "DATETIME"]


def test_normalize_name_and_level(spark):
    assert values(spark, tx.normalize_name, ["User  Name-ID", "用户 名称(Id)", "__a__b__", "ａ１"]) == ["user_name_id", "用户_名称_id", "a_b", ""]
    assert values(spark, tx.normalize_level, ["1", "level3", "l4", "", None]) == ["L1", "L3", "L4", "", ""]
    with pytest.raises(Exception, match="Unsupported data level"):
        values(spark, tx.normalize_level, ["高"])


def test_identifiers(spark):
    name = "sample.csv db1 t_user user_name user_name  个人信息   基本信息 L2".replace(" ", "\x1f")
    assert values(spark, tx.uuid5, [name, "x", "é"]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in (name, "x", "é")]
    assert values(spark, lambda c: tx.document_id(F.lit("edu"), F.lit("基本信息"), c), ["姓名、性别"]) == ["edu-99a0c2ee0057d4f0096d5de8"]


def test_missing_cells(spark):
    assert values(spark, tx.missing_to_empty, ["NA", "null", None, "na", "0", " "]) == ["", "", "", "na", "0", " "]


def test_domain(spark):
    got = values(spark, lambda c: tx.domain_description(c, F.lit(" ")), [" Finance ", "other"])
    assert got[0].startswith("金融") and got[1].startswith("业务数据")
