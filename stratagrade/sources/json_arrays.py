"""Files that hold one JSON array, read by Spark: a row for each item."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as say
from ..functions.order import in_file_order
from .mapping import existing_file, load_json
from .places import Place


def read_raw(spark: SparkSession, path) -> DataFrame:
    """item (the object's own text, compact, with its keys in their order), pos."""
    text = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(str(path), wholetext=True).select(F.posexplode(F.from_json(text, "array<string>")).alias("pos", "item"))


def json_kind(item: Column, path: str = "$") -> Column:
    """The JSON type at a path (OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, ...); null if
    nothing stands there."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), path, "variant"))


def said(value: Column, path: str) -> Column:
    """The scalar at a path of a VARIANT as Python writes it, `True` or `False` or its text;
    null if there is a null or nothing.  Objects and lists keep their JSON text."""
    text = F.try_variant_get(value, "$." + path, "string")
    is_boolean = F.schema_of_variant(F.try_variant_get(value, "$." + path, "variant")) == "BOOLEAN"
    return F.when(text.isin("true", "false") & is_boolean, F.initcap(text)).otherwise(text)


def is_object(item: Column, path: str = "$") -> Column:
    return F.coalesce(json_kind(item, path).startswith("OBJECT"), F.lit(False))


def has_key(item: Column, part: str, key: str) -> Column:
    """Whether the object at $.part has the key, be its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(item, f"$.{part}")), key), F.lit(False))


def check_array(path, what: str = "Input", empty_ok: bool = False) -> list:
    """The same file parsed on the driver: for its errors' exact words, and for files
    that only Python's parser takes (NaN, say)."""
    data = load_json(path, what)
    if not isinstance(data, list):
        raise ValueError(say.JSON_LIST.format(what=what))
    if not data and not empty_ok:
        raise ValueError(say.EMPTY_INPUT)
    if not all(isinstance(x, dict) for x in data):
        raise ValueError(say.JSON_OBJECTS)
    return data


def from_objects(spark: SparkSession, items: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False, separators=(",", ":"))) for i, x in enumerate(items)], "pos int, item string")


#: What stands before the first, between, and after the last of the objects of
#: an array that is written with an indent of two blanks.  Within an object every line
#: has four blanks at least, and strings have no line breaks, so that between two objects is
#: the only place where BETWEEN can stand.
BEFORE, BETWEEN, AFTER = "[\n  {\n", "\n  },\n  {\n", "\n  }\n]"


def read_laid_out(spark: SparkSession, source: Place) -> DataFrame | None:
    """pos and item of an array that is written with an indent of two blanks, as the
    writers of these files do; None of any other.

    Spark reads such a file as lines that end with BETWEEN, so it is cut into blocks like
    any text, and an object is a row for whichever task its end falls to.
    """
    if not source.read_head(16).removeprefix(b"\xef\xbb\xbf").startswith(BEFORE.encode()):
        return None
    rows = spark.read.option("lineSep", BETWEEN).text(source.uri)
    opens, closes = F.col("value").rlike(r"^\ufeff?\[\n  \{\n"), F.col("value").rlike(r"\n  \}\n\]\s*\z")
    body = F.regexp_replace(F.regexp_replace("value", r"^\ufeff?\[\n  \{\n", ""), r"\n  \}\n\]\s*\z", "")
    one = F.concat(F.lit("[{"), body, F.lit("}]"))
    an_object = ~body.rlike(r"(?:^|\n)(?!    )") & (F.size(F.from_json(one, "array<map<string,string>>")) == 1)
    seen = rows.agg(F.count_if(opens).alias("opens"), F.count_if(closes).alias("closes"), F.coalesce(F.bool_and(F.coalesce(an_object, F.lit(False))), F.lit(False)).alias("objects")).first()
    if not (seen["opens"] == seen["closes"] == 1 and seen["objects"]):
        return None
    placed = rows.select(F.from_json(one, "array<string>")[0].alias("item"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    return in_file_order(placed, "__file", "__block", "pos").select(F.col("pos").cast("int").alias("pos"), "item")


def read_array(spark: SparkSession, path, what: str = "Input", empty_ok: bool = False) -> DataFrame:
    """pos and item of each object.

    An array written with an indent of two blanks is cut into blocks that tasks read side by
    side (see read_laid_out()).  Any other is one task's, and its items are spread over
    tasks when they are next shuffled; the driver reads it only if something is wrong
    with it.  An object with a repeated key keeps its text."""
    source = existing_file(path, f"{what} file")
    if (found := read_laid_out(spark, source)) is not None:
        return found
    text = F.regexp_replace("value", "^﻿", "")
    items, maps = F.from_json(text, "array<string>"), F.from_json(text, "array<map<string,string>>")  # a string that looks like an object is no map
    whole = spark.read.text(source.uri, wholetext=True)
    seen = whole.select(F.coalesce(F.size(items), F.lit(-1)).alias("n"), text.rlike(r"^\s*\[[\s\S]*\]\s*\z").alias("list"), F.coalesce(F.forall(maps, lambda x: x.isNotNull()), F.lit(False)).alias("objects")).first()
    if seen and seen["list"] and seen["objects"] and (seen["n"] > 0 or empty_ok and seen["n"] == 0):
        return read_raw(spark, source.uri)
    return from_objects(spark, check_array(source, what, empty_ok))
