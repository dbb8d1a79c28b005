"""Queries that go through files: tables are written as CSV, XLSX or JSON files in a
scratch folder that executors see, run through the commands' functions, and read back.
"""

from __future__ import annotations

import csv
import io
import json
import warnings
import zipfile
from collections.abc import Iterable
from itertools import chain
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import ROW
from ..operators import chat, corpus, folders, records, split, standards
from ..schemas import GUIDE_CONTENT, GUIDE_LABEL
from ..sinks.bundles import read_part, read_report
from ..sinks.files import Bundle, texts
from ..sources.json_arrays import check_array, read_array
from ..sources.places import Place, scratch_folder
from ..sources.tables import read_csv, read_table
from .catalogue import MAPPING, S_CATALOGUE, S_RAW, query, raw, s_clean, s_document_id, s_expanded, s_first, s_identity, s_label, s_quota, s_text, s_uuid5, table


def scratch() -> Place:
    return scratch_folder("queries")


def csv_line(row: Iterable) -> str:
    line = io.StringIO(newline="")
    csv.writer(line).writerow(row)
    return line.getvalue()


def write_csv(place: Place, header: Iterable[str], rows: DataFrame, by: str) -> Place:
    """A table's rows in the order of a column, which isn't written."""
    lines = texts(rows.orderBy(by).drop(by).toDF(*map(str, range(len(rows.columns) - 1))), lambda row: csv_line(row.values()).removesuffix("\r\n"))
    with Bundle() as files:
        files.add_lines(place, lines, "\r\n", head=csv_line(header), empty=csv_line(header))
    return place


def write_xlsx(place: Place, rows: Iterable[Iterable]) -> Place:
    """Texts, numbers and (as ("date", serial)) dates.  The first sheet of the workbook is
    not the one with the lowest number."""
    main, links = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(x) -> str:
        if isinstance(x, tuple):
            return f'<c s="1"><v>{x[1]}</v></c>'
        return f"<c><v>{x}</v></c>" if isinstance(x, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x or "")}</t></is></c>'

    relations = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2))
    with Place(place).writer() as made, zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="a" sheetId="2" r:id="r2"/><sheet name="b" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>')
        with z.open("xl/worksheets/sheet2.xml", "w", force_zip64=True) as opened, io.BufferedWriter(opened, 1 << 20) as sheet:  # rows as they come
            sheet.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for r in rows:
                sheet.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
            sheet.write(b"</sheetData></worksheet>")
    return place


def ordered(df: DataFrame, by: str) -> Iterable[tuple]:
    return (tuple(r) for r in df.orderBy(by).drop(by).toLocalIterator())


def quiet(f, *args, **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f(*args, **options)


# Tables -----------------------------------------------------------------------------

S_CELL = "CASE p_size % 4 WHEN 0 THEN 'NA' WHEN 1 THEN p_name || chr(10) || '\"q\", z' ELSE p_name END"
S_CELLS = f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _row, '00' || p_partkey AS code, CASE p_size % 4 WHEN 0 THEN '' ELSE {S_CELL} END AS cell, p_size::VARCHAR AS number"


@query(f"{S_CELLS} FROM part")
def q_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, line breaks and commas in cells, texts that mean a missing cell, leading zeros."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("'00' || p_partkey"), F.expr(S_CELL.replace("chr(10)", "'\\n'")), "p_size")
    return read_table(spark, write_csv(scratch() / "t.csv", ["code", " cell ", "number"], rows, "p_partkey"))


@query(f"{S_CELLS.replace('chr(10)', repr(' '))}, (TIMESTAMP '2023-03-15 12:00:00' + to_days(p_size::INTEGER))::VARCHAR AS day FROM part")
def q_xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbook's first sheet, with dates."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("'00' || p_partkey"), F.expr(S_CELL.replace("chr(10)", "' '")), "p_size")
    cells = ((code, cell, size, ("date", 45000.5 + size)) for code, cell, size in ordered(rows, "p_partkey"))
    return read_table(spark, write_xlsx(scratch() / "t.xlsx", chain([["code", " cell ", "number", "day"]], cells)))


#: Shares of the rows in files whose names go another way than their sizes.
S_FILE = "CASE WHEN p_partkey % 100 < 3 THEN 'a' WHEN p_partkey % 100 < 90 THEN 'b' WHEN p_partkey % 100 < 91 THEN 'c' ELSE 'd' END"


@query(f"SELECT row_number() OVER (ORDER BY {S_FILE}, p_partkey) - 1 AS _row, p_partkey::VARCHAR AS code, {S_FILE} AS file FROM part")
def q_csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's rows are numbered in the order of its files' names, whatever their sizes."""
    folder = scratch()
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(S_FILE).alias("file"))
    for name in "dbac":
        write_csv(folder / f"{name}.csv", ["code", "file"], rows.where(F.col("file") == name).select(F.col("p_partkey").alias("at"), "p_partkey", "file"), "at")
    return read_csv(spark, folder.uri)


@query("SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INTEGER AS pos, p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part")
def q_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("id"), "p_name", F.expr("CASE WHEN p_size % 2 = 0 THEN p_type END"))
    path = scratch() / "a.json"
    path.write(["﻿", json.dumps([{"id": i, "in": {"name": n, "kind": k}} for i, n, k in ordered(rows, "p_partkey")], ensure_ascii=False, indent=1)])
    assert check_array(path)
    at = lambda p: F.get_json_object("item", p)
    return read_array(spark, path).select("pos", at("$.id").alias("id"), at("$.in.name").alias("name"), at("$.in.kind").alias("kind"))


# Records and splits -----------------------------------------------------------------

S_KEPT = s_expanded(s_first("database_name, table_name, field_name, category_leaf_level, sensitivity_level"))
S_MADE = f"SELECT row_number() OVER (ORDER BY _row, _pos) - 1 AS pos, *, {s_uuid5(s_identity('catalogue.csv'))} AS id FROM ({S_KEPT})"


def prepared(spark: SparkSession, sf_dir: str) -> Place:
    """all.json of the derived catalogue, through a CSV table and a mapping file."""
    folder = scratch()
    source = raw(spark, sf_dir)
    names = [c for c in source.columns if c != ROW]
    write_csv(folder / "catalogue.csv", names, source.select(ROW, *[F.col(f"`{c}`") for c in names]), ROW)
    (folder / "mapping.json").write([json.dumps(MAPPING)])
    quiet(records.preprocess, spark, folder / "catalogue.csv", folder / "mapping.json", folder / "all.json", missing_field_policy="skip", conflicting_label_policy="keep", domain="Parts")
    return folder


def parsed(spark: SparkSession, path: Place) -> DataFrame:
    return chat.parsed_records(read_array(spark, path))


@query(f"SELECT pos::INTEGER AS pos, id, database_name, table_name, field_name, category_leaf_level, sensitivity_level FROM ({S_MADE})")
def q_preprocess_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = parsed(spark, prepared(spark, sf_dir) / "all.json")
    return made.select("pos", "id", *[f"metadata.{f}" for f in ("database_name", "table_name", "field_name")], "classification.category_leaf_level", "grading.sensitivity_level")


def split_files(spark: SparkSession, folder: Place, **options) -> DataFrame:
    quiet(split.split_dataset, spark, folder / "all.json", folder / "out", **options)
    parts = [parsed(spark, folder / "out" / f"{s}.json").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"SELECT unnest(['train', 'val', 'test']) AS split, unnest([n_train, n_val, n_test]) AS n, total FROM ({s_quota(f'SELECT 1 AS one, count(*) AS total FROM ({S_KEPT})', 'one')})")
def q_split_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified split: the sizes of its files, which together have every record."""
    files = split_files(spark, prepared(spark, sf_dir))
    total = files.select("id", "pos").distinct().count() and files.count()
    return split.split_sizes(files).select("split", "n", F.lit(total).cast("long").alias("total"))


@query(f"SELECT id, count(*) AS n FROM ({S_MADE}) GROUP BY id")
def q_split_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all files of a stratified split."""
    return split_files(spark, prepared(spark, sf_dir), random_seed=7).groupBy("id").agg(F.count("*").alias("n"))


@query(f"SELECT table_name, count(*) AS n, 1::BIGINT AS splits FROM ({S_KEPT}) GROUP BY table_name")
def q_group_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped split: every group is whole and in one file."""
    files = split_files(spark, prepared(spark, sf_dir), split_type="group", group_key="metadata.table_name")
    return files.groupBy("metadata.table_name").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))


@query(f"SELECT id AS source_id, category_leaf_level, sensitivity_level, count(*) AS n FROM ({S_MADE}) WHERE category_leaf_level <> '' GROUP BY ALL")
def q_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all exported splits."""
    folder = prepared(spark, sf_dir)
    quiet(split.split_dataset, spark, folder / "all.json", folder / "out")
    chat.export_dataset(spark, folder / "out", folder / "lines")
    lines = spark.read.text([(folder / "lines" / f"{s}.jsonl").uri for s in ("train", "val", "test")])
    at = lambda p: F.get_json_object("value", "$." + p)
    answer = F.get_json_object(at("reference_answer_json"), "$.classification.category_leaf_level")
    return lines.groupBy(at("source_id").alias("source_id"), answer.alias("category_leaf_level"), at("reference_answer.grading.sensitivity_level").alias("sensitivity_level")).agg(F.count("*").alias("n"))


# Bundles ------------------------------------------------------------------------------


def split_bundle(spark: SparkSession, sf_dir: str, **options) -> Place:
    folder = prepared(spark, sf_dir)
    quiet(folders.split_folder, spark, folders.read_items(spark, folder / "all.json"), folder / "bundle", **options)
    return folder / "bundle"


def bundle_records(spark: SparkSession, folder: Place) -> DataFrame:
    parts = [chat.parsed_records(read_part(spark, folder, s).select(F.lit(0).alias("pos"), F.col("value").alias("item"))).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"SELECT id, count(*) AS n FROM ({S_MADE}) GROUP BY id")
def q_split_bundle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all parts of a split bundle."""
    return bundle_records(spark, split_bundle(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"))


@query(f"SELECT unnest(['train', 'val', 'test']) AS split, unnest([n_train, n_val, n_test]) AS n, unnest([n_train, n_val, n_test]) AS told FROM ({s_quota(f'SELECT 1 AS one, count(*) AS total FROM ({S_KEPT})', 'one')})")
def q_split_bundle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the parts, counted and as the report tells them: the quotas of all records,
    though nearly every stratum is small."""
    folder = split_bundle(spark, sf_dir)
    told = spark.createDataFrame([(s, n) for s, n in read_report(folder, "report")["sizes"].items()], "split string, told long")
    return split.split_sizes(bundle_records(spark, folder)).join(told, "split")


@query(f"SELECT table_name, count(*) AS n, 1::BIGINT AS splits FROM ({S_KEPT}) GROUP BY table_name")
def q_group_split_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group is whole and in one part, without a line for it on the driver."""
    folder = split_bundle(spark, sf_dir, split_type="group", group_key="metadata.table_name")
    return bundle_records(spark, folder).groupBy("metadata.table_name").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))


# Corpora and standards ---------------------------------------------------------------

S_GUIDE = f"""SELECT *, {s_clean("raw_label")} AS clean_label, {s_label("raw_label")} AS label, {s_clean("raw_content")} AS content FROM (
  SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS source_row, CASE WHEN p_size % 11 = 0 THEN '' ELSE p_type || '（A' || (p_size % 3) || '）' END AS raw_label,
    CASE WHEN p_size % 13 = 0 THEN '' ELSE p_brand || '  ' || (p_size % 5) END AS raw_content FROM part)"""
S_PAIRS = f"SELECT * FROM ({S_GUIDE}) WHERE label <> '' AND content <> '' QUALIFY row_number() OVER (PARTITION BY label, content ORDER BY source_row) = 1"


def guide_file(spark: SparkSession, sf_dir: str) -> Place:
    folder = scratch()
    label, content = "CASE WHEN p_size % 11 = 0 THEN '' ELSE p_type || '（A' || (p_size % 3) || '）' END", "CASE WHEN p_size % 13 = 0 THEN '' ELSE p_brand || '  ' || (p_size % 5) END"
    write_csv(folder / "guide.csv", [GUIDE_LABEL, GUIDE_CONTENT], table(spark, sf_dir, "part").select("p_partkey", F.expr(label), F.expr(content)), "p_partkey")
    known = table(spark, sf_dir, "part").where("p_size < 40").groupBy("p_type").agg(F.min("p_brand").alias("root"), F.min("p_name").alias("grade")).collect()
    items = [{"classification": {"category_leaf_level": f"{r['p_type']} (B2)", "category_root_level": r["root"]}, "grading": {"sensitivity_level": r["grade"]}} for r in known]
    (folder / "all.json").write([json.dumps(items, ensure_ascii=False)])
    return folder


@query(f"SELECT {s_document_id(s_text('guide'), 'label', 'content')} AS id, content AS text, label AS level_4, clean_label AS source_level_4, source_row::VARCHAR AS source_row, 'guide.csv' AS source FROM ({S_PAIRS})")
def q_corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = guide_file(spark, sf_dir)
    quiet(corpus.build_corpus, spark, "guide", folder / "guide.csv", folder / "out")
    at = lambda p: F.get_json_object("item", "$." + p)
    made = read_array(spark, folder / "out" / "corpus.json")
    return made.select(at("id").alias("id"), at("text").alias("text"), *[at(f"metadata.{f}").alias(f) for f in ("level_4", "source_level_4", "source_row", "source")])


def corpus_bundle(spark: SparkSession, sf_dir: str) -> Place:
    folder = guide_file(spark, sf_dir)
    folders.corpus_folder(spark, read_csv(spark, (folder / "guide.csv").uri), "guide", "guide.csv", folder / "bundle")
    return folder / "bundle"


@query(f"SELECT {s_document_id(s_text('guide'), 'label', 'content')} AS id, content AS text, label AS level_4, clean_label AS source_level_4, source_row, 'guide.csv' AS source FROM ({S_PAIRS})")
def q_corpus_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read_part(spark, corpus_bundle(spark, sf_dir), "documents")
    return made.select("id", "text", *[f"metadata.{f}" for f in ("level_4", "source_level_4", "source_row", "source")])


@query(f"""SELECT source_row, first_row FROM (SELECT source_row, min(source_row) OVER (PARTITION BY label, content) AS first_row FROM ({S_GUIDE}) WHERE clean_label <> '' AND content <> '') WHERE first_row < source_row""")
def q_corpus_bundle_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_part(spark, corpus_bundle(spark, sf_dir), "duplicates")


@query(f"SELECT id, database_name, table_name, field_name, category_leaf_level, sensitivity_level FROM ({S_MADE})")
def q_preprocess_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the one pass that reads, checks and writes."""
    folder = scratch() / "bundle"
    quiet(folders.preprocess_folder, spark, raw(spark, sf_dir), MAPPING, folder, source_name="catalogue.csv", missing_field_policy="skip", conflicting_label_policy="keep")
    return read_part(spark, folder, "records").select("id", *[f"metadata.{f}" for f in ("database_name", "table_name", "field_name")], "classification.category_leaf_level", "grading.sensitivity_level")


@query(f"""SELECT (SELECT count(*) FROM ({S_RAW})) AS input_rows, (SELECT count(*) FROM ({S_RAW}) WHERE {s_clean("field_name")} = '') AS missing_field_names,
  (SELECT count(*) FROM (SELECT 1 FROM ({S_CATALOGUE}) GROUP BY database_name, table_name, field_name HAVING count(DISTINCT category_leaf_level || chr(31) || sensitivity_level) > 1)) AS conflicts, (SELECT count(*) FROM ({S_MADE})) AS records""")
def q_preprocess_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the write itself has counted."""
    folder = scratch() / "bundle"
    r = quiet(folders.preprocess_folder, spark, raw(spark, sf_dir), MAPPING, folder, source_name="catalogue.csv", missing_field_policy="skip", conflicting_label_policy="keep")
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} long" for k in r))


S_KNOWN = f"SELECT DISTINCT {s_clean(chr(34) + 'p_type' + chr(34))} || ' (B2)' AS label FROM part WHERE p_size < 40"


@query(f"""SELECT (SELECT count(*) FROM part) AS input_rows, (SELECT count(*) FROM ({S_PAIRS})) AS exported, (SELECT count(*) FROM ({S_GUIDE}) WHERE clean_label = '' OR content = '') AS skipped,
  (SELECT count(*) FROM ({S_GUIDE}) WHERE label <> '' AND content <> '') - (SELECT count(*) FROM ({S_PAIRS})) AS duplicates, (SELECT count(*) FROM ({S_GUIDE}) WHERE clean_label <> '' AND content <> '' AND label <> clean_label) AS normalized,
  (SELECT count(*) FROM ({S_KNOWN})) AS known, (SELECT count(*) FROM ({S_KNOWN}) WHERE label IN (SELECT label FROM ({S_PAIRS}))) AS overlap, (SELECT count(DISTINCT label) FROM ({S_PAIRS})) AS labels,
  (SELECT round(avg(length(content)), 2) FROM ({S_PAIRS})) AS average_length""")
def q_corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the build report."""
    folder = guide_file(spark, sf_dir)
    r = quiet(corpus.build_corpus, spark, "guide", folder / "guide.csv", folder / "out", processed_file=folder / "all.json")
    r = json.loads((folder / "out" / "build_report.json").read_text())
    cover = r["processed_label_coverage"]
    row = (r["input_rows"], r["exported_documents"], r["skipped_missing"]["count"], r["skipped_exact_duplicates"]["count"], r["normalized_labels"]["count"], cover["processed_unique_level_4"], cover["overlap"])
    row += (r["corpus_statistics"]["unique_level_4"], float(r["corpus_statistics"]["content_length"]["average"]))
    return spark.createDataFrame([row], "input_rows long, exported long, skipped long, duplicates long, normalized long, known long, overlap long, labels long, average_length double")


S_FLAT = f"""SELECT {s_document_id(s_text('guide'), 'label', 'content')} AS id, content AS data_description_and_example, 'DATASET' AS dataset, label AS category_leaf_level,
  coalesce(root, '') AS category_root_level, coalesce(grade, '') AS sensitivity_level, 'ref' AS reference_standard
  FROM ({S_PAIRS}) LEFT JOIN (SELECT p_type, min(p_brand) AS root, min(p_name) AS grade FROM part WHERE p_size < 40 GROUP BY p_type) ON label = p_type"""


def flat_file(spark: SparkSession, sf_dir: str) -> Place:
    folder = guide_file(spark, sf_dir)
    corpus.build_standard_corpus(spark, "Guide", folder / "guide.csv", folder / "flat.json", processed_file=folder / "all.json", content_column=GUIDE_CONTENT, leaf_column=GUIDE_LABEL, reference_standard="ref")
    return folder


def flat_read(spark: SparkSession, path: Place) -> DataFrame:
    fields = ("id", "data_description_and_example", "dataset", "category_leaf_level", "category_root_level", "sensitivity_level", "reference_standard")
    return read_array(spark, path).select(*[F.get_json_object("item", "$." + f).alias(f) for f in fields])


@query(S_FLAT.replace("DATASET", "Guide"))
def q_flat_corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_read(spark, flat_file(spark, sf_dir) / "flat.json")


@query(S_FLAT.replace("DATASET", "Guide"))
def q_flat_corpus_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = guide_file(spark, sf_dir)
    columns = {"data_description_and_example": GUIDE_CONTENT, "category_leaf_level": GUIDE_LABEL}
    folders.standard_folder(spark, read_csv(spark, (folder / "guide.csv").uri), "Guide", folder / "flat", columns=columns, processed=folders.read_items(spark, folder / "all.json"), reference_standard="ref")
    return read_part(spark, folder / "flat", "documents").drop("category_subbranch_level", "category_branch_level")


@query(S_FLAT.replace("DATASET", "other"))
def q_normalized_corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat corpus rewritten in its own place."""
    path = flat_file(spark, sf_dir) / "flat.json"
    corpus.normalize_standard_corpus(spark, path, path, dataset="other")
    return flat_read(spark, path)


@query("SELECT p_type AS description, arg_max(CASE WHEN p_size % 7 = 0 THEN p_brand ELSE replace(p_name, ' ', '') END, p_partkey) AS category FROM part GROUP BY p_type")
def q_standards_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue sheet under a title line to a dictionary file, and that file read."""
    folder = scratch()
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("——"), "p_type", F.expr("CASE WHEN p_size % 7 = 0 THEN '——' ELSE replace(p_name, ' ', '\\n') END"), "p_brand")
    write_xlsx(folder / "s.xlsx", chain([["title"], ["定义说明4", "定义说明3", "四级分类", "三级分类"]], ordered(rows, "p_partkey")))
    standards.write_standards(spark, folder / "s.xlsx", folder / "s.json")
    return standards.read_dictionary(spark, (folder / "s.json").uri).select("description", "category")


@query("SELECT DISTINCT p_type AS description, p_brand AS category, p_name AS class, 'r' AS ref FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1")
def q_dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of descriptions, as shipped ones are."""
    path = scratch() / "d.json"
    found: dict = {}
    for kind, brand, container in ordered(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name"), "p_partkey"):
        found.setdefault(kind, {"category": brand, "class": container, "ref": "r"})
    path.write([json.dumps(found, ensure_ascii=False)])
    return standards.read_dictionary(spark, path.uri)


@query("SELECT level, path, CASE WHEN n = 0 THEN 'None' WHEN n = 1 THEN 'True' WHEN n = 2 THEN '7' ELSE 'x' || event_id END AS value FROM (SELECT event_id % 4 AS n, event_id, 'a' AS path, 1 AS level FROM events)")
def q_json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How scalars of JSON objects are written."""
    item = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"a":null}' WHEN 1 THEN '{"a":true}' WHEN 2 THEN '{"a":7}' ELSE '{"a":"x' || event_id || '"}' END""")
    return table(spark, sf_dir, "events").select(F.lit(1).alias("level"), F.lit("a").alias("path"), chat.scalar(item, "a").alias("value"))


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'False' WHEN 2 THEN '' ELSE 'x' END AS label FROM events")
def q_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"a":{"b":null}}' WHEN 1 THEN '{"a":{"b":false}}' WHEN 2 THEN '{"a":{}}' ELSE '{"a":{"b":"x"}}' END""")
    return table(spark, sf_dir, "events").select("event_id", split.label_value(item, "a.b").alias("label"))

