"""What the plans of some operators must and must not hold."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratagrade.functions import text as tx
from stratagrade.operators import chat, corpus, split
from stratagrade.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_items_are_parsed_once(spark):
    items = spark.createDataFrame([(0, "{}")], "pos int, item string")
    for df in (chat.parsed_records(items), split.with_labels(items)):
        assert len(re.findall("parse_?json", plan(df), re.I)) == 1 and "get_json_object" not in plan(df)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_texts_stay_where_they_are(spark):
    """What the exchanges of the search for duplicates move."""
    df = corpus.repeated_pairs(catalogue.guide(spark, DATA).where("missing = ''"), "label", "content")
    df.collect()
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df, "executedPlan"))
    assert moved and all(re.fullmatch(r"(coalesce\()?_*digest#\d+.*", x) for x in moved)
    assert "text#" not in plan(df).split("Aggregate")[0].split("Join")[0]


def test_blank_tests_clean_nothing(spark):
    rows = spark.createDataFrame([(0, " a ", "x  y")], "_row long, l string, c string")
    kept = corpus.guide_rows(rows, F.col("l"), F.col("c")).where("missing = ''").select("source_row")
    assert "regexp_replace" not in plan(kept)


def test_blank_is_what_cleaning_leaves_empty(spark):
    spaces = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    values = [None, "", spaces, "​", "x", f"{spaces}x", "\x00", "\n\n", "é", "\U0001f600"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(tx.is_blank(F.col("v")).alias("blank"), (tx.clean_text(F.col("v")) == "").alias("cleaned")).collect()
    assert [r["blank"] for r in got] == [r["cleaned"] for r in got] == [True, True, True, False, False, False, False, True, False, False]
