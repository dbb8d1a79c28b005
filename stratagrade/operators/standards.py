"""Dictionaries of data descriptions: description -> (category, class, ref)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import ROW

ABSENT = "——"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file as rows (description, category, class, ref)."""
    kind = "map<string,struct<category:string,class:string,ref:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("description", "entry"))
    return rows.select("description", "entry.category", "entry.class", "entry.ref")


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file as rows (expanded, description)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("expanded", "description"))


def expanded_standards(expansions: DataFrame, standards: DataFrame) -> DataFrame:
    return expansions.join(standards, "description")


def fall_back(value: Column, other: Column) -> Column:
    return F.when(value == ABSENT, other).otherwise(value)


def last_entries(rows: DataFrame, key: str, value: str, order: str = ROW) -> DataFrame:
    """The last value of each key, and the key's first place."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias("first_at"))


def standards_from_table(table: DataFrame) -> DataFrame:
    """A catalogue sheet to (description, category): level 4, or level 3 where level 4
    is absent; line feeds go from categories; later rows win."""
    c = lambda name: F.col(f"`{name}`")
    rows = table.select(ROW, fall_back(c("定义说明4"), c("定义说明3")).alias("description"), F.replace(fall_back(c("四级分类"), c("三级分类")), F.lit("\n"), F.lit("")).alias("category"))
    return last_entries(rows, "description", "category").orderBy("first_at").select("description", "category")


def write_standards(spark: SparkSession, table_path, output_path) -> int:
    from ..sinks.files import write_json_object
    from ..sources.tables import read_table

    rows = standards_from_table(read_table(spark, table_path, header_row=1))
    return write_json_object(((r["description"], {"category": r["category"]}) for r in rows.toLocalIterator()), output_path)
