"""Retrieval corpora from classification guides."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import messages as say
from ..functions import text as tx
from ..functions.order import ROW
from ..schemas import FLAT_CORPUS, GRADE, GUIDE_CONTENT, GUIDE_LABEL, HIERARCHY, LEVELS
from ..sources.json_arrays import said
from ..sources.places import Place
from .joins import join_same


def guide_rows(df: DataFrame, label: Column, content: Column, *, by_normalized: bool = False) -> DataFrame:
    """Adds raw_label, label, content, source_row and `missing`: what the row lacks.

    The label counts as missing by its cleaned text, or with `by_normalized` by what
    is left without its code.  Whether something is there is asked of the texts as they come, so
    that a filter on `missing` cleans nothing."""
    raw, body = tx.clean_text(label), tx.clean_text(content)
    short = tx.normalize_label(label)
    lacks = F.concat_ws(",", F.when(short == "" if by_normalized else tx.is_blank(label), "label"), F.when(tx.is_blank(content), "content"))
    return df.select("*", raw.alias("raw_label"), short.alias("label"), body.alias("content"), (F.col(ROW) + 2).alias("source_row"), lacks.alias("missing"))


def duplicate_of(rows: DataFrame, *key: str, order: str = "source_row") -> DataFrame:
    """Adds first_row: the first row with the same key, nulls being alike (by aggregation
    and join, so that a hot key's partition can be split)."""
    first = rows.groupBy(*key).agg(F.min(order).alias("first_row"))
    return join_same(rows, first, list(key))


def pair_digest(label: str, content: str) -> Column:
    """32 bytes that stand for a (label, content); nulls are values of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return F.unhex(F.sha2(F.concat_ws(tx.UNIT, F.sha2(part(label), 256), part(content)), 256))


def repeated_pairs(rows: DataFrame, label: str, content: str, order: str = "source_row") -> DataFrame:
    """order, first_row: the rows whose (label, content) an earlier row has.  Only digests and
    orders are moved, never texts."""
    return repeated_digests(rows.select(order, pair_digest(label, content).alias("digest")), order)


def repeated_digests(rows: DataFrame, order: str = "source_row") -> DataFrame:
    """rows(order, digest) -> order, first_row: those whose digest an earlier row has."""
    slim = rows.select(order, "digest")
    first = slim.groupBy("digest").agg(F.min(order).alias("first_row"), F.count("*").alias("__n")).where("__n > 1")
    return join_same(slim, first, ["digest"]).where(F.col("first_row") < F.col(order)).select(order, "first_row")


def first_pairs(rows: DataFrame, label: str, content: str, order: str = "source_row") -> DataFrame:
    """The first row of each (label, content), compared by digests of 32 bytes.  Spark
    limits each pair's rows to the first before they are moved."""
    ranked = rows.withColumn("__digest", pair_digest(label, content))
    return ranked.withColumn("__rank", F.row_number().over(Window.partitionBy("__digest").orderBy(order))).where("__rank = 1").drop("__rank", "__digest")


def documents(rows: DataFrame, dataset: str, source: str) -> DataFrame:
    """Corpus documents of guide rows that lack nothing, first of each pair."""
    return document_rows(first_pairs(rows.where("missing = ''"), "label", "content"), dataset, source)


def document_rows(kept: DataFrame, dataset: str, source: str) -> DataFrame:
    """A document of each row."""
    meta = F.struct(
        F.lit(dataset).alias("dataset"), F.col("label").alias("level_4"), F.lit(source).alias("source"), F.col("source_row"),
        F.when(F.col("label") != F.col("raw_label"), F.col("raw_label")).alias("source_level_4"),
    )
    return kept.select("source_row", tx.document_id(F.lit(dataset), F.col("label"), F.col("content")).alias("id"), F.col("content").alias("text"), meta.alias("metadata"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row over docs(label, content): counts of labels and lengths."""
    by_label = docs.groupBy("label").agg(F.count("*").alias("n"), F.min(F.length("content")).alias("lo"), F.max(F.length("content")).alias("hi"), F.sum(F.length("content")).alias("len"))
    return by_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count("*").alias("unique_labels"), F.count_if(F.col("n") > 1).alias("labels_with_multiple"),
        F.min("lo").cast("long").alias("min_length"), F.max("hi").cast("long").alias("max_length"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_length"),
    )


def leaf_index(records: DataFrame, leaf: Column, values: dict[str, Column]) -> DataFrame:
    """leaf -> for each field the sorted set of its values that aren't blank."""
    cleaned = records.select(tx.normalize_label(leaf).alias("leaf"), *[F.nullif(tx.clean_text(c), F.lit("")).alias(f) for f, c in values.items()])
    return cleaned.where("leaf <> ''").groupBy("leaf").agg(*[F.sort_array(F.collect_set(f)).alias(f) for f in values])


def index_of_items(items: DataFrame) -> DataFrame:
    """leaf_index() of processed records, given as JSON texts; each is parsed once."""
    parsed = items.select(F.try_parse_json("item").alias("v"))
    at = lambda p: said(F.col("v"), p)
    values = {f: at(f"classification.{f}") for f in LEVELS[:3]} | {GRADE: at(f"grading.{GRADE}")}
    return leaf_index(parsed, at("classification.category_leaf_level"), values)


def fill_hierarchy(rows: DataFrame, index: DataFrame, fields: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """rows(leaf, fields...): blank fields take the leaf's value if it has just one;
    `ambiguous` lists (field, values) where it has several."""
    known = index.select("leaf", *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(known, "leaf", "left")
    one = lambda f: F.when((F.col(f) == "") & (F.size(f"__{f}") == 1), F.element_at(f"__{f}", 1)).otherwise(F.col(f))
    several = F.array_compact(F.array(*[F.when((F.col(f) == "") & (F.size(f"__{f}") > 1), F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("values"))) for f in fields]))
    others = [c for c in joined.columns if c not in fields and not c.startswith("__")]
    return joined.select(*others, *[one(f).alias(f) for f in fields], several.alias("ambiguous"))


def label_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "label", "left_semi").distinct()


def label_gap(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "label", "left_anti").distinct()


def _table(spark: SparkSession, path) -> tuple[Place, DataFrame]:
    from ..sources.tables import read_table

    source = Place(path)
    if not source.is_file():
        raise FileNotFoundError(say.CORPUS_NOT_FOUND.format(path=source))
    if source.suffix.lower() not in (".xlsx", ".csv"):
        raise ValueError(say.CORPUS_KIND)
    return source, read_table(spark, source)


def _lacking(columns: list[str]) -> None:
    if columns:
        raise ValueError(say.CORPUS_COLUMNS.format(names=", ".join(columns)))


def _missing_policy(value: str) -> None:
    if value not in ("error", "skip"):
        raise ValueError(say.BAD_POLICY.format(name="missing_policy", choices="'error' or 'skip'"))


def _processed(spark: SparkSession, path) -> DataFrame:
    """item of each processed record."""
    from ..sources.json_arrays import json_kind, read_array

    items = read_array(spark, path, "Processed", empty_ok=True)
    kinds = [json_kind(F.col("item"), f"$.{part}") for part in ("classification", "grading")]
    if bad := items.where(~kinds[0].startswith("OBJECT") | ~kinds[1].startswith("OBJECT")).orderBy("pos").first():  # an absent part is fine
        raise ValueError(say.PROCESSED_PARTS.format(item=bad["pos"]))
    return items


def _cell(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def display_path(path: Place, root: Place | None) -> str:
    return root and path.below(root) or path.name


def build_corpus(
    spark: SparkSession, dataset: str, input_file, output_dir, *, processed_file=None, label_column: str = GUIDE_LABEL, content_column: str = GUIDE_CONTENT,
    missing_policy: str = "skip", overwrite: bool = False, project_root=None,
) -> dict:
    """A guide table to corpus.json and build_report.json; returns the report."""
    from ..sinks.files import Bundle, refuse_existing, write_json, write_json_array

    _missing_policy(missing_policy)
    out = Place(output_dir)
    refuse_existing([out / "corpus.json", out / "build_report.json"], overwrite)
    source, table = _table(spark, input_file)
    label_column, content_column = label_column.strip(), content_column.strip()
    _lacking([c for c in (label_column, content_column) if c not in table.columns])
    root = Place(project_root) if project_root else None
    rows = guide_rows(table.select(ROW, _cell(label_column).alias("l"), _cell(content_column).alias("c")), F.col("l"), F.col("c")).persist()
    names = {"label": label_column, "content": content_column}
    lacking = [{"source_row": r["source_row"], "missing_columns": [names[x] for x in r["missing"].split(",")]} for r in rows.where("missing <> ''").orderBy("source_row").collect()]
    if lacking and missing_policy == "error":
        raise ValueError(say.CORPUS_MISSING.format(names=", ".join(lacking[0]["missing_columns"]), row=lacking[0]["source_row"]))
    if lacking:
        warnings.warn(say.SKIPPING_CORPUS.format(count=len(lacking)), UserWarning, stacklevel=2)
    whole = rows.where("missing = ''")
    docs = documents(rows, dataset, display_path(source, root)).persist()
    if docs.isEmpty():
        raise ValueError(say.NO_DOCUMENTS)
    if docs.groupBy("id").count().where("count > 1").limit(1).count():
        raise RuntimeError(say.ID_COLLISION)
    repeats = repeated_pairs(whole, "label", "content").orderBy("source_row").collect()
    renamed = [r[0] for r in whole.where("label <> raw_label").orderBy("source_row").select("source_row").collect()]
    stats = corpus_statistics(docs.select(F.col("metadata.level_4").alias("label"), F.col("text").alias("content"))).first()
    used = docs.select(F.col("metadata.level_4").alias("label")).distinct()
    processed = Place(processed_file) if processed_file else None
    known = _processed(spark, processed) if processed else spark.createDataFrame([], "item string")
    known = known.select(tx.clean_text(F.get_json_object("item", "$.classification.category_leaf_level")).alias("label")).where("label <> ''").distinct()
    listed = lambda df: [r["label"] for r in df.orderBy("label").collect()]
    report = {
        "dataset": dataset,
        "source": display_path(source, root),
        "processed_source": display_path(processed, root) if processed else None,
        "input_rows": rows.count(),
        "exported_documents": stats["documents"],
        "skipped_missing": {"count": len(lacking), "rows": lacking},
        "skipped_exact_duplicates": {"count": len(repeats), "rows": [{"source_row": r[0], "duplicate_of_source_row": r[1]} for r in repeats]},
        "normalized_labels": {"count": len(renamed), "source_rows": renamed},
        "corpus_statistics": {
            "unique_level_4": stats["unique_labels"],
            "labels_with_multiple_documents": stats["labels_with_multiple"],
            "content_length": {"min": stats["min_length"], "max": stats["max_length"], "average": round(stats["total_length"] / stats["documents"], 2)},
        },
        "processed_label_coverage": {
            "available": processed is not None,
            "processed_unique_level_4": known.count(),
            "overlap": label_overlap(used, known).count(),
            "processed_labels_without_corpus": listed(label_gap(known, used)),
            "corpus_labels_unused_by_processed": listed(label_gap(used, known)),
        },
    }
    bodies = docs.orderBy("source_row").drop("source_row")
    with Bundle() as bundle:
        write_json_array(bodies, out / "corpus.json", bundle=bundle, of=lambda d: {**d, "metadata": {k: v for k, v in d["metadata"].items() if v is not None}})
        write_json(report, out / "build_report.json", bundle=bundle)
    docs.unpersist()
    rows.unpersist()
    return report


def flat_rows(table: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """source_row, leaf, content, missing and the hierarchy of a guide table."""
    optional = [tx.clean_text(_cell(columns[f])).alias(f) if columns.get(f) else F.lit("").alias(f) for f in HIERARCHY]
    plain = table.select(ROW, _cell(columns["category_leaf_level"]).alias("l"), _cell(columns["data_description_and_example"]).alias("c"), *optional)
    return guide_rows(plain, F.col("l"), F.col("c"), by_normalized=True).select("source_row", F.col("label").alias("leaf"), "content", "missing", *HIERARCHY)


def flat_records(filled: DataFrame, dataset: str, reference_standard: str = "") -> DataFrame:
    made = {
        "id": tx.document_id(F.lit(dataset.lower()), F.col("leaf"), F.col("content")), "data_description_and_example": F.col("content"), "dataset": F.lit(dataset),
        "category_leaf_level": F.col("leaf"), "reference_standard": F.lit(reference_standard),
    }
    return filled.select("source_row", *[made.get(f, F.col(f)).alias(f) for f in FLAT_CORPUS])


def build_standard_corpus(
    spark: SparkSession, dataset: str, input_file, output_file, *, processed_file=None, content_column: str, leaf_column: str, root_column: str | None = None, branch_column: str | None = None,
    subbranch_column: str | None = None, sensitivity_column: str | None = None, reference_standard: str = "", missing_policy: str = "skip", overwrite: bool = False,
) -> dict:
    """A guide table to the flat corpus; blanks are filled from processed records."""
    from ..sinks.files import refuse_existing, write_json_array

    _missing_policy(missing_policy)
    out = Place(output_file)
    refuse_existing([out], overwrite)
    source, table = _table(spark, input_file)
    columns = {
        "data_description_and_example": content_column, "category_leaf_level": leaf_column, "category_root_level": root_column, "category_branch_level": branch_column,
        "category_subbranch_level": subbranch_column, GRADE: sensitivity_column,
    }
    _lacking(sorted({c for c in columns.values() if c is not None and c not in table.columns}))
    rows = flat_rows(table, columns).persist()
    skipped = [r[0] for r in rows.where("missing <> ''").orderBy("source_row").select("source_row").collect()]
    if skipped and missing_policy == "error":
        raise ValueError(say.FLAT_MISSING.format(row=skipped[0]))
    whole = rows.where("missing = ''")
    processed = Place(processed_file) if processed_file else None
    known = _processed(spark, processed) if processed else spark.createDataFrame([], "item string")
    filled = fill_hierarchy(first_pairs(whole, "leaf", "content"), index_of_items(known)).persist()
    if filled.isEmpty():
        raise ValueError(say.NO_DOCUMENTS)
    repeats = repeated_pairs(whole, "leaf", "content").orderBy("source_row").collect()
    unclear = filled.orderBy("source_row").select("source_row", F.inline("ambiguous")).collect()
    write_json_array(flat_records(filled, dataset, reference_standard).orderBy("source_row").drop("source_row"), out)
    report = {
        "dataset": dataset,
        "source": str(source),
        "processed_source": str(processed) if processed else None,
        "input_rows": rows.count(),
        "exported_documents": filled.count(),
        "skipped_rows": skipped,
        "duplicate_rows": [{"source_row": r[0], "duplicate_of_source_row": r[1]} for r in repeats],
        "ambiguous_processed_fields": [r.asDict() for r in unclear],
        "output_file": str(out),
    }
    filled.unpersist()
    rows.unpersist()
    return report


def normalize_standard_corpus(spark: SparkSession, input_file, output_file, *, dataset: str, overwrite: bool = False) -> dict:
    """A flat corpus with cleaned values and another dataset name; ids stay.  The
    source itself may be the output."""
    from ..sinks.files import refuse_existing, write_json_array
    from ..sources.json_arrays import read_array

    source, out = Place(input_file), Place(output_file)
    rows = read_array(spark, source, "Corpus", empty_ok=True)
    absent = F.array_except(F.array(*map(F.lit, FLAT_CORPUS)), F.json_object_keys("item"))
    if bad := rows.select("pos", absent.alias("absent")).where("size(absent) > 0").orderBy("pos").first():
        raise ValueError(say.FLAT_FIELDS.format(item=bad["pos"], names=", ".join(bad["absent"])))
    if out != source:
        refuse_existing([out], overwrite)
    count = rows.count()
    made = rows.select("pos", *[F.lit(dataset).alias(f) if f == "dataset" else tx.clean_text(F.get_json_object("item", "$." + f)).alias(f) for f in FLAT_CORPUS])
    write_json_array(made.orderBy("pos").drop("pos"), out)
    return {"input_rows": count, "exported_documents": count, "output_file": str(out)}
