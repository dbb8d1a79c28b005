"""Chat-style fine-tuning records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as say
from ..functions import text as tx
from ..schemas import DEVELOPER_PROMPT, GRADE, LEVELS, METADATA, SPLITS
from ..sources.json_arrays import has_key, is_object, said
from ..sources.places import Place


def is_labeled(levels: list[Column]) -> Column:
    """Whether any level isn't blank; a JSON null counts as a label."""
    return reduce(lambda a, b: a | b, [c.isNull() | ~tx.is_blank(c) for c in levels])


def reference_answer(levels: list[Column], grade: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.struct(F.struct(*[text(c).alias(f) for f, c in zip(LEVELS, levels, strict=True)]).alias("classification"), F.struct(text(grade).alias(GRADE)).alias("grading"))


def messages(metadata: dict[str, Column]) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("developer", F.lit(DEVELOPER_PROMPT)), message("user", tx.prompt(metadata)))


def chat_records(records: DataFrame) -> DataFrame:
    """records(id, metadata, classification, grading, ...) -> one line for each that
    is labeled."""
    levels, grade = [F.col(f"classification.{f}") for f in LEVELS], F.col(f"grading.{GRADE}")
    keep = [c for c in ("pos", "split") if c in records.columns]
    out = records.where(is_labeled(levels)).select(
        *keep,
        messages({f: F.col(f"metadata.{f}") for f in METADATA}).alias("messages"),
        reference_answer(levels, grade).alias("reference_answer"),
        F.coalesce(F.col("id").cast("string"), F.lit("None")).alias("source_id"),  # as other null values
    )
    return out.select(*keep, "messages", "reference_answer", F.to_json("reference_answer").alias("reference_answer_json"), "source_id")


PARTS = {"metadata": METADATA, "classification": LEVELS, "grading": (GRADE,)}


def check_items(items: DataFrame, path) -> None:
    """All parts and fields must be there; null values are allowed.  The first item with
    a fault is named."""
    faults = F.struct(
        F.array_compact(F.array(*[F.when(~is_object(F.col("item"), f"$.{part}"), part) for part in PARTS])).alias("invalid"),
        F.array(*[F.struct(F.lit(part).alias("part"), F.array_compact(F.array(*[F.when(~has_key(F.col("item"), part, f), f) for f in fields])).alias("fields")) for part, fields in PARTS.items()]).alias("absent"),
    )
    found = items.select("pos", faults.alias("f")).where((F.size("f.invalid") > 0) | F.exists("f.absent", lambda x: F.size(x["fields"]) > 0)).orderBy("pos").first()
    if found:
        for part in found["f"]["invalid"]:
            raise ValueError(say.EXPORT_PART.format(item=found["pos"], path=path, part=part))
        part, fields = next(x for x in found["f"]["absent"] if x["fields"])
        raise ValueError(say.EXPORT_FIELDS.format(item=found["pos"], path=path, part=part, names=", ".join(fields)))


def conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, messages (JSON, in order of turns)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = turns.groupBy("conv_id").agg(ordered.alias("t"))
    return rows.select("conv_id", F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))


def export_counts(records: DataFrame, levels: list[Column]) -> DataFrame:
    """One row: input_records, exported_records, skipped_unlabeled."""
    labeled = is_labeled(levels)
    return records.agg(F.count("*").alias("input_records"), F.count_if(labeled).alias("exported_records"), F.count_if(~labeled).alias("skipped_unlabeled"))


def scalar(item: Column, path: str) -> Column:
    """The value at a path of a JSON text as Python writes it; `None` without one."""
    return F.coalesce(said(F.try_parse_json(item), path), F.lit("None"))


def parsed_records(items: DataFrame) -> DataFrame:
    """items(pos, item) -> pos, id (an absent one is empty), metadata, classification, grading.

    Each item is parsed once, to a VARIANT that is then read by path; an item that is no JSON
    object, or has a key twice, has no values.
    """
    v = F.col("__v")
    none = F.lit("None")
    parts = [F.struct(*[F.coalesce(said(v, f"{part}.{f}"), none).alias(f) for f in fields]).alias(part) for part, fields in PARTS.items()]
    there = F.try_variant_get(v, "$.id", "variant").isNotNull()  # a null that is there is a VARIANT too
    return items.withColumn("__v", F.try_parse_json("item")).select("pos", F.when(there, F.coalesce(said(v, "id"), none)).otherwise("").alias("id"), *parts)


def export_split(spark: SparkSession, input_path, output_path) -> dict:
    from ..sinks.files import write_jsonl
    from ..sources.json_arrays import read_array

    items = read_array(spark, input_path, empty_ok=True).persist()
    check_items(items, input_path)
    read = parsed_records(items)
    counts = export_counts(read, [F.col(f"classification.{f}") for f in LEVELS]).first().asDict()
    if not counts["exported_records"]:
        raise ValueError(say.NOTHING_LABELED.format(path=input_path))
    write_jsonl(chat_records(read).orderBy("pos").drop("pos"), output_path)
    items.unpersist()
    return counts | {"output_file": str(output_path)}


def export_dataset(spark: SparkSession, input_dir, output_dir) -> dict:
    """train, val and test.json to JSON lines, and export_report.json."""
    from ..sinks.files import write_json

    report = {"format": "openai_rft_jsonl", "splits": {s: export_split(spark, Place(input_dir) / f"{s}.json", Place(output_dir) / f"{s}.jsonl") for s in SPLITS}}
    write_json(report, Place(output_dir) / "export_report.json", indent=4, newline=False)
    return report
