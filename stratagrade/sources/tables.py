"""CSV and XLSX tables as string columns with a record ordinal.

Cells keep their text (`007`, `1.50` and `true` stay as written); texts that count
as missing become empty; XLSX cells with a date format are written as dates and times.
XLSX files are read by `workbooks`.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import messages as say
from ..functions.order import ROW, in_file_order
from ..functions.text import missing_to_empty
from .mapping import existing_file
from .workbooks import read_first_sheet


def column_names(header: list[str]) -> list[str]:
    """Repeated headers get .1, .2, ...; then ends are trimmed, and headers that are
    equal only now are refused."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append((f"{name}.{k}" if k else name).strip())
    if twice := sorted({n for n in out if out.count(n) > 1}):
        raise ValueError(say.DUPLICATE_COLUMNS.format(names=", ".join(twice)))
    return out


def read_xlsx(spark: SparkSession, path, header_row: int = 0) -> DataFrame:
    header, rows = read_first_sheet(spark, existing_file(path, "Input file"), header_row)
    names = column_names(header)
    return rows.select(*[missing_to_empty(F.get("text", F.lit(i))) for i in range(len(names))], "at").toDF(*names, ROW)


def _head(lines: DataFrame, file: str, head_lines: int) -> list[str]:
    """The header of one file, which may span lines."""
    rows = lines.where(F.col("file") == file).orderBy("block", "at").limit(head_lines).select("value").collect()
    return next(csv.reader(f"{line}\n" for line in [rows[0][0].lstrip("\ufeff"), *(r[0] for r in rows[1:])]))


def read_csv(spark: SparkSession, path, head_lines: int = 1000) -> DataFrame:
    """`path` is a file, a folder or any URI that Spark reads.  Rows are numbered in the
    order of files by name, whatever their sizes.  The header may span `head_lines` lines;
    files whose header is not that of the first are refused.

    Files without line breaks inside cells are cut into parts that tasks read side by
    side; a file with such cells is one task's.
    """
    lines = spark.read.text(str(path)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    quotes = F.regexp_count("value", F.lit('"')) % 2 == 1
    opening = F.min(F.when(F.trim("value") != "", F.struct("block", "at", "value")))["value"]  # of each file the first line that says something
    heads = lines.groupBy("file").agg(opening.alias("opening"), F.max(quotes).alias("broken")).where("opening IS NOT NULL")
    heads = heads.groupBy("opening").agg(F.min("file").alias("file"), F.max("broken").alias("broken")).orderBy("file").limit(head_lines).collect()
    if not heads:
        raise ValueError(f"No header row in {path}")
    lines = lines.where(F.trim("value") != "")
    alone = lambda h: h["opening"].count('"') % 2 == 0
    headers = [next(csv.reader([h["opening"].lstrip("\ufeff")])) if alone(h) else _head(lines, h["file"], head_lines) for h in heads]
    names = column_names(headers[0])
    if other := next((h["file"] for h, header in zip(heads, headers, strict=True) if column_names(header) != names), None):
        raise ValueError(say.OTHER_HEADER.format(path=other, first=heads[0]["file"]))
    plain = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in plain])
    df = spark.read.schema(schema).csv(str(path), header=True, multiLine=any(h["broken"] for h in heads), escape='"', enforceSchema=True)
    df = df.select(*[missing_to_empty(F.col(c)).alias(c) for c in plain], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    return in_file_order(df, "__file", "__block").toDF(*names, ROW)


def read_table(spark: SparkSession, path, header_row: int = 0) -> DataFrame:
    source = existing_file(path, "Input file")
    kind = source.suffix.lower()
    if kind == ".xlsx":
        return read_xlsx(spark, source, header_row)
    if kind == ".csv":
        return read_csv(spark, source.uri)
    raise ValueError(say.UNSUPPORTED_INPUT.format(kind=kind))
