"""Splits, corpora and chat lines of any size: bundles of JSON lines in and out.

What the single-file forms send through the driver, tasks write here; reports are parts
of the bundle as well, with a row for each label or source row.  See sinks/bundles.py for how
a bundle is published.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import messages as say
from ..functions import text as tx
from ..functions.order import ROW
from ..schemas import FLAT_CORPUS, GUIDE_CONTENT, GUIDE_LABEL, LABEL_PATHS, LEVELS, SPLITS
from ..sinks.bundles import MANIFEST, BundleFolder, read_lines, read_manifest
from ..sources.json_arrays import read_array
from ..sources.places import Place
from . import chat, corpus, dealing, records, split


def read_items(spark: SparkSession, path, part: str | None = None) -> DataFrame:
    """item, the text of each record: of a bundle's part (its first by default), of a JSON array in a .json file, or
    of JSON lines in any other file or a folder."""
    place = Place(path)
    if (place / MANIFEST).exists():
        return read_lines(spark, place, part or next(iter(read_manifest(place)["parts"]))).select(F.col("value").alias("item"))
    if place.suffix.lower() == ".json" and place.is_file():
        return read_array(spark, place).select("item")
    if not place.exists():
        raise FileNotFoundError(say.NOT_FOUND.format(what="Input", path=place))
    return spark.read.text(place.uri).where(F.trim("value") != "").select(F.col("value").alias("item"))


def split_folder(
    spark: SparkSession, items: DataFrame, output_dir, *, split_type: str = "random", ratios=split.DEFAULT_RATIOS, random_seed: int = 42,
    group_key: str | None = None, missing_group_policy: str = "error", overwrite: bool = False,
) -> dict:
    """items(item) -> a bundle with the parts train, val and test (items as they are),
    distributions (field, split, value, n), warnings (type, field, label) and report.

    Strata and groups are those of split_dataset(); rows are dealt by a hash of the item
    (split_by_hash()), or groups by classes (split_groups_by_class()).  Returns the report.
    """
    if split_type == "group" and not group_key:
        raise ValueError(say.GROUP_KEY_NEEDED)
    split.check_ratios(ratios)
    rows, skipped = items.select("item"), 0
    with BundleFolder(output_dir, overwrite) as bundle:
        paths = {p: f"__l{i}" for i, p in enumerate(LABEL_PATHS)}
        at = lambda df: split.with_labels(df).withColumns({n: F.element_at("labels", i + 1) for i, n in enumerate(paths.values())}).drop("labels")
        labeled = at(rows)
        if split_type == "random":
            done = dealing.split_by_hash(labeled, [*paths.values()], "item", ratios, random_seed)
        else:
            kind, text = split.group_kind(F.col("item"), group_key)
            keyed = labeled.withColumns({"__kind": kind, "__key": text})
            lacking = ~split.has_group(F.col("__key"))
            state = keyed.agg(F.count_if(lacking).alias("skipped"), F.count_if(~lacking).alias("kept"), F.count_if(F.col("__kind").rlike("^(OBJECT|ARRAY)")).alias("nested")).first()
            skipped = state["skipped"]
            if skipped and missing_group_policy == "error":
                raise ValueError(say.GROUP_MISSING.format(key=group_key, items=f"{skipped} of them"))
            if skipped:
                warnings.warn(say.SKIPPING_RECORDS.format(count=skipped, reason=f"no {group_key}"), UserWarning, stacklevel=2)
            if not state["kept"]:
                raise ValueError(say.NO_RECORDS_LEFT.format(key=group_key))
            if state["nested"]:
                raise ValueError(say.GROUP_SCALAR.format(key=group_key, item=f"{state['nested']} of them"))
            done = dealing.split_groups_by_class(keyed.where(~lacking), split.group_value(F.col("__kind"), F.col("__key")), {p: F.col(n) for p, n in paths.items()}, ratios, random_seed)
        sizes = bundle.write_by("split", done.select("split", "item"), SPLITS)
        staged = spark.read.text((bundle.stage / "by-split").uri, pathGlobFilter="*.txt")  # with the split from the folders' names
        counts = split.label_counts(at(staged.withColumnRenamed("value", "item")), {p: F.col(n) for p, n in paths.items()})
        bundle.write("distributions", counts)
        told = spark.read.schema(counts.schema).json((bundle.stage / "distributions").uri)
        bundle.write("warnings", split.label_gaps(told))
        report = {"sizes": sizes, "input_size": sum(sizes.values()) + skipped, "included_size": sum(sizes.values()), "skipped_records": skipped}
        bundle.write_json("report", report)
    return report


def preprocess_folder(
    spark: SparkSession, table: DataFrame, mapping: dict[str, str], output_dir, *, source_name: str, domain: str = "", missing_field_policy: str = "error", conflicting_label_policy: str = "error", overwrite: bool = False
) -> dict:
    """A table (with `_row`) -> a bundle with the part records (one JSON record a line) and a
    report of counts: input_rows, missing_field_names, conflicts, records.

    One pass reads, cleans, counts, finds conflicts, deduplicates, expands and writes; the
    policies are applied to what the write has counted, before anything is published.
    Only an error or a warning that names rows reads them again.
    """
    records.check_policies(missing_field_policy, conflicting_label_policy)
    seen, told = Observation(), Observation()
    cleaned = records.clean_columns(records.convert_schema(table, records.check_mapping(mapping)))
    blank = F.col("field_name") == ""
    watched = cleaned.observe(seen, F.count("*").alias("input_rows"), F.count_if(blank).alias("missing"))
    first = records.first_with_conflicts(records.normalize_columns(watched.where(~blank)), with_labels=conflicting_label_policy == "keep")
    first = first.observe(told, F.count_if("conflicting").alias("conflicts")).drop("conflicting")
    with BundleFolder(output_dir, overwrite) as bundle:
        made = bundle.write("records", records.to_records(records.expand_augmented(first), source_name, domain).drop(ROW, "_pos"))
        n, missing, conflicts = seen.get["input_rows"], seen.get["missing"], told.get["conflicts"]
        if not n:
            raise ValueError(say.EMPTY_INPUT)
        if missing:
            records.drop_missing(cleaned, missing_field_policy)  # words the error or the warning
        if conflicts:
            records.report_conflicts(records.normalize_columns(cleaned.where(~blank)), conflicting_label_policy)
        report = {"input_rows": n, "missing_field_names": missing, "conflicts": conflicts, "records": made}
        bundle.write_json("report", report)
    return report


def corpus_folder(
    spark: SparkSession, table: DataFrame, dataset: str, source: str, output_dir, *, label_column: str = GUIDE_LABEL, content_column: str = GUIDE_CONTENT, missing_policy: str = "skip", overwrite: bool = False,
) -> dict:
    """A guide table (with `_row`) -> a bundle with the parts documents, skipped (source_row,
    missing), duplicates (source_row, first_row), normalized (source_row) and report.

    The table is read and cleaned once, into an intermediate table that also counts it;
    duplicates are looked for in its column of digests."""
    named = {"label": label_column, "content": content_column}
    if absent := [c for c in named.values() if c not in table.columns]:
        raise ValueError(say.CORPUS_COLUMNS.format(names=", ".join(absent)))
    cell = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = corpus.guide_rows(table.select(ROW, cell(label_column).alias("l"), cell(content_column).alias("c")), F.col("l"), F.col("c"))
    lacks, other = F.col("missing") != "", F.col("label") != F.col("raw_label")
    columns = [F.col("source_row"), *(F.when(~lacks, F.col(c)).alias(c) for c in ("raw_label", "label", "content")), F.col("missing")]
    with BundleFolder(output_dir, overwrite) as bundle:
        counts = {"input_rows": F.count("*"), "skipped": F.count_if(lacks), "normalized": F.count_if(~lacks & other)}
        kept, seen = bundle.keep("rows", rows.select(*columns, F.when(~lacks, corpus.pair_digest("label", "content")).alias("digest")), **counts)
        if seen["skipped"] and missing_policy == "error":
            raise ValueError(say.SKIPPING_CORPUS.format(count=seen["skipped"]))
        if seen["skipped"] == seen["input_rows"]:
            raise ValueError(say.NO_DOCUMENTS)
        repeats, found = bundle.keep("repeats", corpus.repeated_digests(kept.where("digest IS NOT NULL")), n=F.count("*"))
        bundle.write("skipped", kept.where("missing <> ''").select("source_row", "missing"))
        bundle.write("duplicates", repeats)
        bundle.write("normalized", kept.where("label <> raw_label").select("source_row"))
        first = kept.where("missing = ''").join(repeats.select("source_row"), "source_row", "left_anti")
        made = bundle.write("documents", corpus.document_rows(first, dataset, source).drop("source_row"))
        staged = spark.read.schema("text string, metadata struct<level_4: string>").json((bundle.stage / "documents").uri)
        stats = corpus.corpus_statistics(staged.select(F.col("metadata.level_4").alias("label"), F.col("text").alias("content"))).first()
        report = {
            "dataset": dataset, "source": source, "input_rows": seen["input_rows"], "exported_documents": made, "skipped_missing": seen["skipped"], "skipped_exact_duplicates": found["n"], "normalized_labels": seen["normalized"],
            "corpus_statistics": {
                "unique_level_4": stats["unique_labels"], "labels_with_multiple_documents": stats["labels_with_multiple"],
                "content_length": {"min": stats["min_length"], "max": stats["max_length"], "average": round(stats["total_length"] / stats["documents"], 2)},
            },
        }
        bundle.write_json("report", report)
    return report


def standard_folder(
    spark: SparkSession, table: DataFrame, dataset: str, output_dir, *, columns: dict[str, str | None], processed: DataFrame | None = None, reference_standard: str = "", missing_policy: str = "skip", overwrite: bool = False
) -> dict:
    """A guide table (with `_row`) -> a bundle with the parts documents (flat records), skipped
    (source_row), duplicates (source_row, first_row), ambiguous (source_row, field, values)
    and report.

    `columns`: the table's names for the fields of a flat record (content and leaf at least).
    Blanks are filled from `processed`(item), the processed records, where they agree.
    """
    named = {f: c for f, c in columns.items() if c is not None}
    if absent := sorted({c for c in named.values() if c not in table.columns}):
        raise ValueError(say.CORPUS_COLUMNS.format(names=", ".join(absent)))
    rows = corpus.flat_rows(table, columns)
    lacks = F.col("missing") != ""
    with BundleFolder(output_dir, overwrite) as bundle:
        digest = F.when(~lacks, corpus.pair_digest("leaf", "content")).alias("digest")
        kept, seen = bundle.keep("rows", rows.select("*", digest), input_rows=F.count("*"), skipped=F.count_if(lacks))
        if seen["skipped"] and missing_policy == "error":
            raise ValueError(say.SKIPPING_CORPUS.format(count=seen["skipped"]))
        if seen["skipped"] == seen["input_rows"]:
            raise ValueError(say.NO_DOCUMENTS)
        repeats, found = bundle.keep("repeats", corpus.repeated_digests(kept.where("digest IS NOT NULL")), n=F.count("*"))
        bundle.write("skipped", kept.where(lacks).select("source_row"))
        bundle.write("duplicates", repeats)
        first = kept.where("missing = ''").drop("missing", "digest").join(repeats.select("source_row"), "source_row", "left_anti")
        filled, _ = bundle.keep("filled", corpus.fill_hierarchy(first, corpus.index_of_items(spark.createDataFrame([], "item string") if processed is None else processed)))
        unclear = bundle.write("ambiguous", filled.select("source_row", F.inline("ambiguous")))
        made = bundle.write("documents", corpus.flat_records(filled, dataset, reference_standard).drop("source_row"))
        report = {"dataset": dataset, "input_rows": seen["input_rows"], "exported_documents": made, "skipped_rows": seen["skipped"], "duplicate_rows": found["n"], "ambiguous_processed_fields": unclear}
        bundle.write_json("report", report)
    return report


def normalize_folder(spark: SparkSession, items: DataFrame, dataset: str, output_dir, *, overwrite: bool = False) -> dict:
    """Flat records (item) -> a bundle with the part documents, cleaned and under another
    dataset's name, and report.  The bundle that is read may be the one that is written."""
    absent = F.array_except(F.array(*map(F.lit, FLAT_CORPUS)), F.json_object_keys("item"))
    cleaned = [F.lit(dataset).alias(f) if f == "dataset" else tx.clean_text(F.get_json_object("item", "$." + f)).alias(f) for f in FLAT_CORPUS]
    with BundleFolder(output_dir, overwrite) as bundle:
        made, seen = bundle.keep("rows", items.select(*cleaned, F.coalesce(F.array_join(absent, ", "), F.lit("?")).alias("absent")), n=F.count("*"), bad=F.count_if(F.col("absent") != ""))
        if seen["bad"]:
            names = made.where("absent <> ''").agg(F.min("absent")).first()[0]
            raise ValueError(say.FLAT_FIELDS.format(item=f"({seen['bad']} of them)", names=names))
        bundle.write("documents", made.drop("absent"))
        report = {"input_rows": seen["n"], "exported_documents": seen["n"]}
        bundle.write_json("report", report)
    return report


def export_folder(spark: SparkSession, split_dir, output_dir, *, overwrite: bool = False) -> dict:
    """A bundle of splits -> a bundle of chat lines, with the same parts and a report."""
    with BundleFolder(output_dir, overwrite) as bundle:
        splits = {}
        for name in SPLITS:
            read = chat.parsed_records(read_items(spark, split_dir, name).select(F.lit(0).alias("pos"), "item"))
            labeled = chat.is_labeled([F.col(f"classification.{f}") for f in LEVELS])
            rows = bundle.write(name, chat.chat_records(read.where(labeled)).drop("pos"))
            total = read_items(spark, split_dir, name).count()
            splits[name] = {"input_records": total, "exported_records": rows, "skipped_unlabeled": total - rows}
        report = {"format": "openai_rft_jsonl", "splits": splits}
        bundle.write_json("report", report)
    return report

