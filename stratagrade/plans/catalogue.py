"""Every operator over the test tables, with its DuckDB twin.

The tables hold no column catalogue, so one is derived: from `part` a catalogue
(database, table, field, leaf with a code, grade), from `documents` a guide, from
`events` grouped records.  Both engines derive them alike.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.order import ROW
from ..operators import chat, codes, corpus, dealing, records, split, standards
from ..schemas import CANONICAL, DEVELOPER_PROMPT, DOMAINS, EMPTY_LABEL, GENERIC_DOMAIN, METADATA, NA_TOKENS, PROMPT_HEAD, PROMPT_LABELS, SPLITS, TYPE_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# SQL twins of the expressions ------------------------------------------------------


def s_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def s_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{tx.SPACES}+', ' ', 'g'))"


def s_label(x: str) -> str:
    return rf"trim(regexp_replace({s_clean(x)}, ' *[(\[（【] *[A-Za-z]+\p{{Nd}}*(?:-\p{{Nd}}+)* *[)\]）】] *$', ''))"


def s_uuid5(x: str) -> str:
    h = f"sha1(unhex('{tx.URL_NAMESPACE}') || encode({x}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '{'89ab' * 4}')"
        f" || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


def s_document_id(dataset: str, label: str, content: str) -> str:
    return f"{dataset} || '-' || substr(sha256({dataset} || chr(31) || {label} || chr(31) || {content}), 1, 24)"


S_TYPE_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TYPE_OF.items()) + "}"
S_RAW = """
  SELECT p_partkey - 1 AS _row, p_brand AS database_name, p_type AS table_name, CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_name END AS field_name,
    p_name || '（A' || p_size || '）' AS leaf, 'L' || (p_size % 4 + 1) AS grade, CASE WHEN p_size % 3 = 0 THEN p_name || '_x' END AS aug1, CASE WHEN p_size % 5 = 0 THEN p_name || '_y' ELSE '  ' END AS aug2
  FROM part
"""
S_CATALOGUE = f"""
  SELECT _row, {s_clean("database_name")} AS database_name, {s_clean("table_name")} AS table_name, {s_clean("field_name")} AS field_name, {s_label("leaf")} AS category_leaf_level,
    {s_clean("grade")} AS sensitivity_level, {s_clean("aug1")} AS augmented_column_name1, {s_clean("aug2")} AS augmented_column_name2
  FROM ({S_RAW}) WHERE {s_clean("field_name")} <> ''
"""


def s_first(key: str) -> str:
    return f"SELECT * FROM ({S_CATALOGUE}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY _row) = 1"


def s_expanded(first: str) -> str:
    return f"""
  SELECT _row, 0 AS _pos, database_name, table_name, field_name, field_name AS source_field, '' AS augmentation, 'original' AS label_status, category_leaf_level, sensitivity_level FROM ({first})
  UNION ALL SELECT _row, 1, database_name, table_name, augmented_column_name1, field_name, 'augmented_column_name1', 'synthesized', category_leaf_level, sensitivity_level FROM ({first}) WHERE augmented_column_name1 <> ''
  UNION ALL SELECT _row, CASE WHEN augmented_column_name1 <> '' THEN 2 ELSE 1 END, database_name, table_name, augmented_column_name2, field_name, 'augmented_column_name2', 'synthesized', category_leaf_level, sensitivity_level
    FROM ({first}) WHERE augmented_column_name2 <> ''
"""


S_FIRST = s_first("database_name, table_name, field_name")
S_EXPANDED = s_expanded(S_FIRST)


# The derived tables ----------------------------------------------------------------

MAPPING = {"db name": "database_name", "表名": "table_name", "field.name": "field_name", "leaf": "level_4", "grade": "data_level"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") - 1).alias(ROW), F.col("p_brand").alias("db name"), F.col("p_type").alias("表名"), F.when(size % 13 != 0, name).alias("field.name"),
        F.concat(name, F.lit("（A"), size, F.lit("）")).alias("leaf"), F.concat(F.lit("L"), size % 4 + 1).alias("grade"),
        F.when(size % 3 == 0, F.concat(name, F.lit("_x"))).alias("augmented_column_name1"), F.when(size % 5 == 0, F.concat(name, F.lit("_y"))).otherwise("  ").alias("augmented_column_name2"),
    )


def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.convert_schema(raw(spark, sf_dir), records.check_mapping(MAPPING))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return records.normalize_columns(records.drop_missing(records.clean_columns(bound(spark, sf_dir)), "skip"))


SHOWN = (ROW, "database_name", "table_name", "field_name", "category_leaf_level", "sensitivity_level")


def guide(spark: SparkSession, sf_dir: str, by_normalized: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), "source", "lang", "text")
    label = F.when(F.col(ROW) % 17 == 0, "(A3)").when(F.col(ROW) % 19 == 0, " ").otherwise(F.concat("source", F.lit(" ("), F.upper("lang"), F.lit("1)")))
    return corpus.guide_rows(docs, label, F.col("text"), by_normalized=by_normalized)


S_GUIDE_LABEL = "CASE WHEN doc_id % 17 = 0 THEN '(A3)' WHEN doc_id % 19 = 0 THEN ' ' ELSE source || ' (' || upper(lang) || '1)' END"


def s_guide(test: str) -> str:
    return f"""SELECT doc_id, doc_id + 2 AS source_row, raw_label, {s_label("raw_label")} AS label, content FROM (
      SELECT doc_id, {s_clean(S_GUIDE_LABEL)} AS raw_label, {s_clean("text")} AS content FROM documents) WHERE {test} <> '' AND content <> ''"""


# Text, labels, types, identifiers ---------------------------------------------------


@query(f"SELECT doc_id, {s_clean('text')} AS text FROM documents")
def q_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query(f"""SELECT p_partkey, {s_label("p_name || '（A' || p_size || '）'")} AS label, {s_label("p_name || ' (VIN) [B-' || p_size || '】'")} AS other FROM part""")
def q_normalize_label(spark, sf_dir):
    other = F.concat("p_name", F.lit(" (VIN) [B-"), "p_size", F.lit("】"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize_label(F.concat("p_name", F.lit("（A"), "p_size", F.lit("）"))).alias("label"), tx.normalize_label(other).alias("other"))


S_DECLARED = "CASE p_size % 6 WHEN 0 THEN 'varchar(' || p_size || ')' WHEN 1 THEN 'INT UNSIGNED' WHEN 2 THEN ' timestamp(6) with time zone' WHEN 3 THEN 'Number(10,2)' WHEN 4 THEN 'character varying(20)' ELSE '' END"


@query(f"""SELECT p_partkey, CASE WHEN t = '' THEN '' ELSE coalesce({S_TYPE_MAP}[regexp_split_to_array(t, '[\\s(]')[1]], upper(t)) END AS field_type
  FROM (SELECT p_partkey, lower({s_clean(S_DECLARED)}) AS t FROM part)""")
def q_normalize_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize_type(F.expr(S_DECLARED)).alias("field_type"))


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(lower({s_clean('p_type')}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def q_normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize_name(F.col("p_type")).alias("name"))


S_LEVEL = "CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN ' level2 ' WHEN 2 THEN 'l3' ELSE 'LEVEL4' END"


@query("SELECT p_partkey, 'L' || (p_size % 4 + 1) AS level FROM part")
def q_normalize_level(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize_level(F.expr(S_LEVEL)).alias("level"))


def s_identity(source: str) -> str:
    return f"concat_ws(chr(31), '{source}', database_name, table_name, field_name, source_field, augmentation, '', '', '', category_leaf_level, sensitivity_level)"


S_IDENTITY = s_identity("part.csv")


@query(f"SELECT _row, _pos::INTEGER AS _pos, {s_uuid5(S_IDENTITY)} AS id FROM ({S_EXPANDED})")
def q_record_id(spark, sf_dir):
    made = records.to_records(records.expand_augmented(records.first_per_identity(catalogue(spark, sf_dir))), "part.csv", "part")
    return made.select(ROW, "_pos", "id")


@query(f"SELECT doc_id, {s_document_id(s_text('guide'), 'source', s_clean('text'))} AS id FROM documents")
def q_document_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.document_id(F.lit("guide"), F.col("source"), tx.clean_text(F.col("text"))).alias("id"))


# The row pipeline ------------------------------------------------------------------


@query(f"""SELECT _row, {", ".join({"database_name": "database_name", "table_name": "table_name", "field_name": "field_name", "category_leaf_level": "leaf", "sensitivity_level": "grade"}.get(c, "''") + " AS " + c for c in CANONICAL)},
  aug1 AS augmented_column_name1, aug2 AS augmented_column_name2 FROM ({S_RAW})""")
def q_schema_map(spark, sf_dir):
    return bound(spark, sf_dir)


@query(f"SELECT {', '.join(SHOWN)} FROM ({S_CATALOGUE})")
def q_filter_missing(spark, sf_dir):
    return catalogue(spark, sf_dir).select(*SHOWN)


@query(f"""SELECT _row + 2 AS source_row FROM ({S_RAW}) WHERE {s_clean("field_name")} = '' ORDER BY 1 LIMIT 10""")
def q_missing_examples(spark, sf_dir):
    rows = records.clean_columns(bound(spark, sf_dir)).where(F.col("field_name") == "")
    return spark.createDataFrame([(x,) for x in records.examples(rows, F.col(ROW) + 2)[1]], "source_row long")


@query(f"SELECT database_name, table_name, field_name, min(_row) AS _row FROM ({S_CATALOGUE}) GROUP BY ALL HAVING count(DISTINCT category_leaf_level || chr(31) || sensitivity_level) > 1")
def q_conflicts(spark, sf_dir):
    return records.conflicts(catalogue(spark, sf_dir))


@query(f"SELECT {', '.join(SHOWN)} FROM ({S_FIRST})")
def q_first_per_identity(spark, sf_dir):
    return records.first_per_identity(catalogue(spark, sf_dir)).select(*SHOWN)


@query(f"SELECT {', '.join(SHOWN)} FROM ({S_CATALOGUE}) QUALIFY row_number() OVER (PARTITION BY database_name, table_name, field_name, category_leaf_level, sensitivity_level ORDER BY _row) = 1")
def q_first_per_identity_labels(spark, sf_dir):
    return records.first_per_identity(catalogue(spark, sf_dir), with_labels=True).select(*SHOWN)


@query(f"SELECT _row, min(_row) OVER (PARTITION BY database_name, table_name, field_name) AS first_row FROM ({S_RAW})")
def q_duplicate_of(spark, sf_dir):
    """Over rows as they come, with null field names."""
    return corpus.duplicate_of(bound(spark, sf_dir), "database_name", "table_name", "field_name", order=ROW).select(ROW, "first_row")


@query(f"SELECT _row, _pos::INTEGER AS _pos, field_name, source_field, augmentation, label_status FROM ({S_EXPANDED})")
def q_augment(spark, sf_dir):
    return records.expand_augmented(records.first_per_identity(catalogue(spark, sf_dir))).select(ROW, "_pos", "field_name", "source_field", "augmentation", "label_status")


@query(f"""SELECT _row, _pos::INTEGER AS _pos, {s_uuid5(S_IDENTITY)} AS id, 'part' AS domain, label_status, database_name, table_name, field_name, '' AS value, category_leaf_level, sensitivity_level FROM ({S_EXPANDED})""")
def q_nested_record(spark, sf_dir):
    made = records.to_records(records.expand_augmented(records.first_per_identity(catalogue(spark, sf_dir))), "part.csv", "part")
    return made.select(ROW, "_pos", "id", "domain", "label_status", "metadata.database_name", "metadata.table_name", "metadata.field_name", "metadata.value", "classification.category_leaf_level", "grading.sensitivity_level")


@query(f"SELECT p_partkey, CASE WHEN v IS NULL OR v IN ({', '.join(map(s_text, NA_TOKENS))}) THEN '' ELSE v END AS cell FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '#N/A' WHEN 2 THEN NULL ELSE p_name END AS v FROM part)")
def q_missing_cells(spark, sf_dir):
    v = F.expr("CASE p_size % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '#N/A' WHEN 2 THEN NULL ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", tx.missing_to_empty(v).alias("cell"))


# Corpora ---------------------------------------------------------------------------


@query(f"SELECT source_row, raw_label, label, content FROM ({s_guide('raw_label')})")
def q_guide_filter_raw(spark, sf_dir):
    return guide(spark, sf_dir).where("missing = ''").select("source_row", "raw_label", "label", "content")


@query(f"SELECT source_row, raw_label, label, content FROM ({s_guide('label')})")
def q_guide_filter_normalized(spark, sf_dir):
    return guide(spark, sf_dir, True).where("missing = ''").select("source_row", "raw_label", "label", "content")


@query(f"""SELECT source_row, {s_document_id("'guide'", "label", "content")} AS id, content AS text, label AS level_4, CASE WHEN label <> raw_label THEN raw_label END AS source_level_4
  FROM ({s_guide("raw_label")}) QUALIFY row_number() OVER (PARTITION BY label, content ORDER BY source_row) = 1""")
def q_corpus_documents(spark, sf_dir):
    return corpus.documents(guide(spark, sf_dir), "guide", "documents").select("source_row", "id", "text", "metadata.level_4", "metadata.source_level_4")


@query(f"SELECT source_row, min(source_row) OVER (PARTITION BY label, content) AS first_row FROM ({s_guide('raw_label')}) QUALIFY first_row < source_row")
def q_corpus_duplicates(spark, sf_dir):
    return corpus.repeated_pairs(guide(spark, sf_dir).where("missing = ''"), "label", "content")


@query(f"""WITH d AS (SELECT DISTINCT label, content FROM ({s_guide("raw_label")})), l AS (SELECT label, count(*) AS n FROM d GROUP BY label)
  SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM l) AS unique_labels, (SELECT count(*) FROM l WHERE n > 1) AS labels_with_multiple,
    min(length(content))::BIGINT AS min_length, max(length(content))::BIGINT AS max_length, sum(length(content))::BIGINT AS total_length FROM d""")
def q_corpus_stats(spark, sf_dir):
    return corpus.corpus_statistics(corpus.first_pairs(guide(spark, sf_dir).where("missing = ''"), "label", "content"))


S_CUSTOMER = "'c' || (c_custkey % 300)"
S_FIELDS = {"category_root_level": "c_mktsegment", "category_branch_level": "CASE WHEN c_custkey % 300 < 100 THEN 'B' || (c_custkey % 300) ELSE ' ' END", "category_subbranch_level": "''", "sensitivity_level": "'N' || c_nationkey"}


def _index(spark, sf_dir):
    return corpus.leaf_index(table(spark, sf_dir, "customer"), F.expr(f"{S_CUSTOMER} || ' (A1)'"), {f: F.expr(x) for f, x in S_FIELDS.items()})


def _guide_rows(spark, sf_dir):
    own = {"category_root_level": F.lit(""), "category_branch_level": F.lit(""), "category_subbranch_level": F.lit("own"), "sensitivity_level": F.when(F.col("o_orderkey") % 2 == 0, "own").otherwise("")}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey") % 350).alias("leaf"), *[c.alias(f) for f, c in own.items()])


S_INDEX = "SELECT leaf, " + ", ".join(f"list_sort(list(DISTINCT nullif({s_clean(x)}, '')) FILTER (WHERE {s_clean(x)} <> '')) AS {f}" for f, x in S_FIELDS.items()) + f" FROM (SELECT *, {S_CUSTOMER} AS leaf FROM customer) GROUP BY leaf"
S_FILL = {"category_root_level": "''", "category_branch_level": "''", "category_subbranch_level": "'own'", "sensitivity_level": "CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE '' END"}


@query("SELECT o_orderkey, o.leaf, " + ", ".join(f"CASE WHEN {own} = '' AND coalesce(len(i.{f}), 0) = 1 THEN i.{f}[1] ELSE {own} END AS {f}" for f, own in S_FILL.items())
       + f" FROM (SELECT *, 'c' || (o_custkey % 350) AS leaf FROM orders) o LEFT JOIN ({S_INDEX}) i ON o.leaf = i.leaf")
def q_hierarchy_fallback(spark, sf_dir):
    return corpus.fill_hierarchy(_guide_rows(spark, sf_dir), _index(spark, sf_dir)).drop("ambiguous")


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{f}' AS field, array_to_string(i.{f}, ',') AS candidates FROM orders o JOIN ({S_INDEX}) i ON 'c' || (o_custkey % 350) = i.leaf WHERE {own} = '' AND len(i.{f}) > 1" for f, own in S_FILL.items()))
def q_ambiguous(spark, sf_dir):
    filled = corpus.fill_hierarchy(_guide_rows(spark, sf_dir), _index(spark, sf_dir))
    return filled.select("o_orderkey", F.inline("ambiguous")).select("o_orderkey", "field", F.array_join("values", ",").alias("candidates"))


def _two_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.col("doc_id") % 7).alias("label")), docs.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi").select(F.concat("source", F.col("doc_id") % 9).alias("label"))


S_SETS = "WITH a AS (SELECT DISTINCT source || (doc_id % 7) AS label FROM documents), b AS (SELECT DISTINCT source || (doc_id % 9) AS label FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))"


@query(f"{S_SETS} SELECT label FROM a INTERSECT SELECT label FROM b")
def q_label_overlap(spark, sf_dir):
    return corpus.label_overlap(*_two_sets(spark, sf_dir))


@query(f"{S_SETS} SELECT 'left' AS only_in, label FROM a WHERE label NOT IN (SELECT label FROM b) UNION ALL SELECT 'right', label FROM b WHERE label NOT IN (SELECT label FROM a)")
def q_label_gaps(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    return corpus.label_gap(a, b).select(F.lit("left").alias("only_in"), "label").unionByName(corpus.label_gap(b, a).select(F.lit("right").alias("only_in"), "label"))


@query(f"""SELECT source_row, {s_document_id("'guide'", "label", "content")} AS id, content AS data_description_and_example, 'Guide' AS dataset, label AS category_leaf_level, '' AS category_subbranch_level,
  '' AS category_branch_level, '' AS category_root_level, '' AS sensitivity_level, 'ref' AS reference_standard FROM ({s_guide("label")}) QUALIFY row_number() OVER (PARTITION BY label, content ORDER BY source_row) = 1""")
def q_flat_corpus(spark, sf_dir):
    rows = corpus.first_pairs(guide(spark, sf_dir, True).where("missing = ''"), "label", "content").withColumnRenamed("label", "leaf")
    blank = {f: F.lit("") for f in ("category_root_level", "category_branch_level", "category_subbranch_level", "sensitivity_level")}
    return corpus.flat_records(rows.withColumns(blank), "Guide", "ref")


# Splits and reports ----------------------------------------------------------------


#: Strata and groups with nulls among them.
KIND, USER = "CASE WHEN event_id % 11 <> 0 THEN event_type END", "CASE WHEN user_id % 13 <> 0 THEN user_id END"


def grouped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(KIND).alias("kind"), F.expr(USER).alias("user_id"), "value")


S_EVENTS = f"(SELECT event_id, {KIND} AS kind, {USER} AS user_id, value FROM events)"


@query(f"SELECT kind AS k0, user_id % 4 AS k1, count(*) AS n, min(event_id) AS first FROM {S_EVENTS} GROUP BY ALL")
def q_strata(spark, sf_dir):
    return split.strata(grouped_events(spark, sf_dir), [F.col("kind"), F.col("user_id") % 4], "event_id")


S_SIDE = "CASE WHEN value > 50 THEN 'high' ELSE 'low' END"


@query(f"""SELECT user_id AS "group", 'kind' AS field, kind AS value, count(*) AS n, min(event_id) AS first FROM {S_EVENTS} GROUP BY ALL
  UNION ALL SELECT user_id, 'side', {S_SIDE}, count(*), min(event_id) FROM {S_EVENTS} GROUP BY ALL""")
def q_group_counters(spark, sf_dir):
    return split.group_labels(grouped_events(spark, sf_dir), F.col("user_id"), {"kind": F.col("kind"), "side": F.expr(S_SIDE)}, "event_id")


def s_quota(sizes: str, keys: str) -> str:
    x = [f"total::DOUBLE * {r}::DOUBLE" for r in ("0.8", "0.1", "0.1")]
    return f"""WITH z AS (SELECT *, {", ".join(f"floor({e})::BIGINT AS f{i}, {e} - floor({e}) AS r{i}" for i, e in enumerate(x))} FROM ({sizes})),
      y AS (SELECT *, total - f0 - f1 - f2 AS rest FROM z),
      g AS (SELECT {keys}, total,
        f0 + ((CASE WHEN r1 > r0 THEN 1 ELSE 0 END + CASE WHEN r2 > r0 THEN 1 ELSE 0 END) < rest)::INT AS a,
        f1 + ((CASE WHEN r0 >= r1 THEN 1 ELSE 0 END + CASE WHEN r2 > r1 THEN 1 ELSE 0 END) < rest)::INT AS b,
        f2 + ((CASE WHEN r0 >= r2 THEN 1 ELSE 0 END + CASE WHEN r1 >= r2 THEN 1 ELSE 0 END) < rest)::INT AS c FROM y)
      SELECT {keys}, total, a + (a = 0 AND b + c > 0)::INT AS n_train, b - (a = 0 AND b >= c AND b > 0)::INT AS n_val, c - (a = 0 AND b < c)::INT AS n_test FROM g"""


S_SIZES = "SELECT user_id, count(*) AS total FROM events GROUP BY user_id"


@query(s_quota(S_SIZES, "user_id"))
def q_quota(spark, sf_dir):
    return split.quotas(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total")))


def _hash_split(spark, sf_dir):
    return dealing.split_by_hash(grouped_events(spark, sf_dir).select("event_id", "kind", "user_id"), ["kind"], "event_id", seed=42)


def s_stratum_quotas(sizes: str, key: str) -> str:
    """Quotas by rounded cumulative targets, strata in the order of a digest."""
    t = lambda c: f"((2 * {c}::HUGEINT * n_train + a) // (2 * a))"
    v = lambda u: f"(CASE WHEN a = n_train THEN 0 ELSE (2 * {u}::HUGEINT * n_val + (a - n_train)) // (2 * (a - n_train)) END)"
    return f"""SELECT {key}, total, (te - ts)::BIGINT AS n_train, ({v("(c_end - te)")} - {v("(c_start - ts)")})::BIGINT AS n_val FROM (
      SELECT *, {t("c_end")} AS te, {t("c_start")} AS ts FROM (
        SELECT {key}, total, sum(total) OVER w AS c_end, sum(total) OVER w - total AS c_start
        FROM (SELECT *, md5(CASE WHEN {key} IS NULL THEN 'n' ELSE 's' || {key} END) AS m FROM ({sizes})) WINDOW w AS (ORDER BY m)) c,
      (SELECT total AS a, n_train, n_val FROM ({s_quota(f"SELECT 1 AS one, sum(total)::BIGINT AS total FROM ({sizes})", "one")})) q)"""


def s_hash_split(rows: str, key: str) -> str:
    return f"""SELECT e.*, CASE WHEN place < n_train THEN 'train' WHEN place < n_train + n_val THEN 'val' ELSE 'test' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY md5('42|' || event_id), event_id) - 1 AS place FROM {rows}) e
      JOIN ({s_stratum_quotas(f"SELECT {key}, count(*) AS total FROM {rows} GROUP BY {key}", key)}) q ON e.{key} IS NOT DISTINCT FROM q.{key}"""


S_HASH_SPLIT = f"SELECT event_id, kind, user_id, split FROM ({s_hash_split(S_EVENTS, 'kind')})"


@query(S_HASH_SPLIT)
def q_split_hash(spark, sf_dir):
    """Strata with nulls among them: no row is lost."""
    return _hash_split(spark, sf_dir)


#: Strata of four rows.
FOURS = "event_id div 4"
S_FOURS = "(SELECT event_id, event_id // 4 AS four FROM events)"


def _fours_split(spark, sf_dir):
    return dealing.split_by_hash(table(spark, sf_dir, "events").select("event_id", F.expr(FOURS).alias("four")), ["four"], "event_id")


@query(f"SELECT event_id, four, split FROM ({s_hash_split(S_FOURS, 'four')})")
def q_split_hash_small(spark, sf_dir):
    """Thousands of small strata, row by row."""
    return _fours_split(spark, sf_dir)


@query(f"""SELECT unnest(['train', 'val', 'test']) AS split, unnest([n_train, n_val, n_test]) AS n, true AS near FROM ({s_quota('SELECT 1 AS one, count(*) AS total FROM events', 'one')})""")
def q_split_hash_totals(spark, sf_dir):
    """Sizes are the quotas of all rows, and every stratum is within two rows of its shares."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    by_four = _fours_split(spark, sf_dir).groupBy("four").agg(F.count("*").alias("all"), *counts)
    sides = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n"), (F.abs(F.col(s) - F.col("all") * r) <= 2).alias("near")) for s, r in zip(SPLITS, split.DEFAULT_RATIOS, strict=True)])
    return by_four.select(F.inline(sides)).groupBy("split").agg(F.sum("n").alias("n"), F.bool_and("near").alias("near"))


#: Every 97th event has a label of its own, which some splits must lack.
S_RARE = "CASE WHEN event_id % 97 = 0 THEN 'rare' || event_id ELSE 'usual' END"
S_FIELD_ROWS = f"""SELECT split, 'kind' AS field, coalesce(kind, 'none') AS value FROM ({S_HASH_SPLIT}) UNION ALL SELECT split, 'rare', {S_RARE} FROM ({S_HASH_SPLIT})
  UNION ALL SELECT split, 'user', CASE WHEN user_id % 10 = 0 THEN '{EMPTY_LABEL}' ELSE coalesce('u' || user_id, 'none') END FROM ({S_HASH_SPLIT})"""


def _counts(spark, sf_dir):
    user = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.coalesce(F.concat(F.lit("u"), "user_id"), F.lit("none")))
    return split.label_counts(_hash_split(spark, sf_dir), {"kind": F.coalesce("kind", F.lit("none")), "rare": F.expr(S_RARE), "user": user})


@query(f"SELECT field, split, value, count(*) AS n FROM ({S_FIELD_ROWS}) GROUP BY ALL")
def q_split_report(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"SELECT split, count(*) AS n FROM ({S_HASH_SPLIT}) GROUP BY split")
def q_split_sizes(spark, sf_dir):
    return split.split_sizes(_hash_split(spark, sf_dir))


@query(f"""WITH c AS (SELECT field, value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'val') AS b, count(*) FILTER (WHERE split = 'test') AS c FROM ({S_FIELD_ROWS}) WHERE value <> '{EMPTY_LABEL}' GROUP BY ALL)
  SELECT 'labels_missing_from_train' AS type, field, value AS label FROM c WHERE a = 0 UNION ALL SELECT 'train_labels_missing_from_val', field, value FROM c WHERE a > 0 AND b = 0
  UNION ALL SELECT 'train_labels_missing_from_test', field, value FROM c WHERE a > 0 AND c = 0""")
def q_split_warnings(spark, sf_dir):
    return split.label_gaps(_counts(spark, sf_dir))


@query()
def q_split_stratified(spark, sf_dir):
    return split.split_stratified(grouped_events(spark, sf_dir).select("event_id", "kind"), [F.col("kind")], "event_id")


@query()
def q_split_group(spark, sf_dir):
    return split.split_grouped(grouped_events(spark, sf_dir), F.col("user_id"), {"kind": F.col("kind")}, "event_id").drop("value")


@query(f"SELECT unnest(['train', 'val', 'test']) AS split, unnest([n_train, n_val, n_test]) AS n, unnest([n_train, n_val, n_test]) AS places FROM ({s_quota('SELECT 1 AS one, count(*) AS total FROM events', 'one')})")
def q_split_stratified_sizes(spark, sf_dir):
    """Whatever the random stream: every row is in one split, at a place of its own, and sizes are the quotas."""
    return q_split_stratified(spark, sf_dir).groupBy("split").agg(F.count_distinct("event_id").alias("n"), F.count_distinct("split_pos").alias("places"))


@query(f"SELECT user_id, count(*) AS n, 1::BIGINT AS splits, count(*) - 1 AS span FROM {S_EVENTS} GROUP BY user_id")
def q_split_group_whole(spark, sf_dir):
    """Every group, that of nulls too, is whole, in one split and at places in a row."""
    span = (F.max("split_pos") - F.min("split_pos")).alias("span")
    return q_split_group(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), span)


def _class_split(spark, sf_dir):
    return dealing.split_groups_by_class(grouped_events(spark, sf_dir), F.col("user_id"), {"kind": F.col("kind"), "side": F.expr(S_SIDE)})


@query(f"SELECT user_id, count(*) AS n, 1::BIGINT AS splits FROM {S_EVENTS} GROUP BY user_id")
def q_class_split_whole(spark, sf_dir):
    """Every group, that of nulls too, is in one split."""
    return _class_split(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))


@query(f"""WITH e AS (SELECT user_id, unnest([{{'field': 'rows', 'value': ''}}, {{'field': 'kind', 'value': coalesce(kind, '')}}, {{'field': 'side', 'value': {S_SIDE}}}], recursive := true) FROM {S_EVENTS}),
  g AS (SELECT user_id, field, value, count(*) AS x FROM e GROUP BY ALL)
  SELECT field, value, split, sum(x)::BIGINT AS n, round(sum(x) * ratio, 6) AS target, round(4 * sqrt(ratio * (1 - ratio) * sum(x * x)) + 2 * max(x), 6) AS bound, true AS within
  FROM g, (VALUES ('train', 0.8::DOUBLE), ('val', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) r(split, ratio) GROUP BY field, value, split, ratio""")
def q_class_split_errors(spark, sf_dir):
    """Sizes and labels of the splits are within the stated bound of their shares."""
    one = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit("")).alias("value")) for n, c in {"rows": F.lit(""), "kind": F.col("kind"), "side": F.expr(S_SIDE)}.items()])
    sums = _class_split(spark, sf_dir).select("user_id", "split", F.explode(one).alias("e")).groupBy("user_id", "split", "e.field", "e.value").agg(F.count("*").alias("x"))
    held = [F.sum(F.when(F.col("split") == s, F.col("x")).otherwise(0)).alias(s) for s in SPLITS]
    by_label = sums.groupBy("field", "value").agg(F.sum("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("squares"), F.max("x").alias("most"), *held)
    sides = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(r).alias("ratio"), F.col(s).alias("held")) for s, r in zip(SPLITS, split.DEFAULT_RATIOS, strict=True)])
    out = by_label.select("field", "value", "n", "squares", "most", F.inline(sides))
    target, bound = F.col("n") * F.col("ratio"), 4 * F.sqrt(F.col("ratio") * (1 - F.col("ratio")) * F.col("squares")) + 2 * F.col("most")
    return out.select("field", "value", "split", "n", F.round(target, 6).alias("target"), F.round(bound, 6).alias("bound"), (F.abs(F.col("held") - target) < bound).alias("within"))


S_PROPS = "CASE event_id % 5 WHEN 0 THEN '{\"a\":{\"g\":\" \"}}' WHEN 1 THEN '{\"a\":{\"g\":null}}' WHEN 2 THEN '{\"a\":{}}' ELSE '{\"a\":{\"g\":\"x' || event_type || '\"}}' END"


@query("SELECT event_id, 'x' || event_type AS g FROM events WHERE event_id % 5 IN (3, 4)")
def q_missing_group(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object(F.expr(S_PROPS), "$.a.g").alias("g"))
    return rows.where(split.has_group(F.col("g")))


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(CAST(quality AS VARCHAR), '') <> ''")
def q_labeled(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.coalesce(F.col("quality").cast("string"), F.lit(""))
    return rows.select("doc_id", quality.alias("quality")).where(chat.is_labeled([F.col("quality"), F.lit(" ")]))


@query("SELECT count(*) AS input_records, count(quality) AS exported_records, count(*) - count(quality) AS skipped_unlabeled FROM documents LEFT JOIN labels USING (doc_id)")
def q_export_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return chat.export_counts(rows, [F.coalesce(F.col("quality").cast("string"), F.lit(""))])


# Prompts and chat ------------------------------------------------------------------

S_META = {"database_name": "p_brand", "table_name": "p_type", "field_name": "p_name", "field_type": "CASE WHEN p_size % 2 = 0 THEN 'INTEGER' ELSE ' ' END"}


@query(f"SELECT p_partkey, concat_ws(chr(10), '{PROMPT_HEAD}', " + ", ".join(f"CASE WHEN trim({S_META[f]}) <> '' THEN '{PROMPT_LABELS[f]}：' || trim({S_META[f]}) END" for f in METADATA if f in S_META) + ") AS prompt FROM part")
def q_prompt(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.prompt({f: F.expr(S_META.get(f, "''")) for f in METADATA}).alias("prompt"))


@query(f"""SELECT _row, '{{"classification":{{"category_root_level":"","category_branch_level":"","category_subbranch_level":"","category_leaf_level":"' || category_leaf_level || '"}},"grading":{{"sensitivity_level":"' || sensitivity_level || '"}}}}' AS reference_answer_json,
  {s_text(DEVELOPER_PROMPT)} AS developer, concat_ws(chr(10), '{PROMPT_HEAD}', '{PROMPT_LABELS["database_name"]}：' || database_name, '{PROMPT_LABELS["table_name"]}：' || table_name, '{PROMPT_LABELS["field_name"]}：' || field_name) AS prompt
  FROM ({S_FIRST}) WHERE category_leaf_level <> ''""")
def q_chat_records(spark, sf_dir):
    first = records.first_per_identity(catalogue(spark, sf_dir))
    made = records.to_records(records.expand_augmented(first.drop("augmented_column_name1", "augmented_column_name2")), "part.csv", "part")
    chats = chat.chat_records(made.withColumn("pos", F.col(ROW)))
    return chats.select(F.col("pos").alias(ROW), "reference_answer_json", F.col("messages")[0]["content"].alias("developer"), F.col("messages")[1]["content"].alias("prompt"))


@query("""SELECT conv_id, to_json(list(struct_pack(role := role, content := text) ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id""")
def q_chat_messages(spark, sf_dir):
    return chat.conversations(table(spark, sf_dir, "conversations"))


# Standards -------------------------------------------------------------------------


@query("SELECT p_type AS description, arg_max(CASE WHEN p_size % 7 = 0 THEN p_brand ELSE p_name END, p_partkey) AS category, min(p_partkey) AS first_at FROM part GROUP BY p_type")
def q_last_wins(spark, sf_dir):
    fourth = F.when(F.col("p_size") % 7 == 0, standards.ABSENT).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), F.col("p_type").alias("description"), standards.fall_back(fourth, F.col("p_brand")).alias("category"))
    return standards.last_entries(rows, "description", "category")


@query("""SELECT e.p_name AS expanded, s.description, s.category FROM part e JOIN (SELECT p_type AS description, min(p_brand) AS category FROM part WHERE p_size < 25 GROUP BY p_type) s ON e.p_type = s.description""")
def q_expansion_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    known = parts.where("p_size < 25").groupBy(F.col("p_type").alias("description")).agg(F.min("p_brand").alias("category"))
    return standards.expanded_standards(parts.select(F.col("p_name").alias("expanded"), F.col("p_type").alias("description")), known).select("expanded", "description", "category")


#: Leaves with codes of one to three numbers, some in full-width digits or without a code; a dictionary with codes of every depth.
S_LEAF_CODE = "CASE p_size % 6 WHEN 0 THEN 'A' || (p_size % 4) WHEN 1 THEN 'a' || (p_size % 4) || '-' || (p_partkey % 5) WHEN 2 THEN 'B１-' || (p_partkey % 5) || '-' || p_size WHEN 3 THEN 'C' || p_size ELSE 'A' || (p_size % 4) || '-' || (p_partkey % 7) || '-' || p_size END"
S_LEAF_LABEL = f"CASE WHEN p_partkey % 10 = 0 THEN p_name || ' (VIN)' ELSE p_name || '（' || {S_LEAF_CODE} || '） ' END"
S_STANDARD = "CASE WHEN p_size % 3 = 0 THEN 'A' || (p_size % 4) || '：' WHEN p_size % 3 = 1 THEN 'A' || (p_size % 4) || '-' || (p_partkey % 4) || ':' WHEN p_size % 5 = 0 THEN 'B1 :' WHEN p_size % 5 = 1 THEN 'no code ' ELSE 'B1-' || (p_partkey % 3) || ':' END || p_brand"


@query(f"""WITH d AS (SELECT code, min(category) AS category FROM (SELECT regexp_extract({S_STANDARD}, '^([A-Z]+[0-9]+(-[0-9]+)*) ?[:：]', 1) AS code, {S_STANDARD} AS category FROM part WHERE p_partkey % 3 = 0) WHERE code <> '' GROUP BY code),
  l AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE upper(replace({S_LEAF_CODE}, '１', '1')) END AS code FROM part),
  m AS (SELECT p_partkey, d.code AS linked_code, d.category, l.code = d.code AS exact FROM l JOIN d ON l.code = d.code OR starts_with(l.code, d.code || '-') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(d.code) DESC) = 1)
  SELECT p_partkey, linked_code, category, coalesce(exact, false) AS exact, (SELECT count(*) FROM d WHERE l.code <> '' AND starts_with(d.code, l.code || '-')) AS below FROM l LEFT JOIN m USING (p_partkey)""")
def q_code_prefix_join(spark, sf_dir):
    """Leaves linked to the longest code of a dictionary on their code's path."""
    parts = table(spark, sf_dir, "part")
    standard = parts.where("p_partkey % 3 = 0").select(F.expr(S_STANDARD).alias("category"))
    trie = codes.code_trie(standard, codes.leading_code(F.col("category")), ("category",))
    return codes.link_codes(parts.select("p_partkey", F.expr(S_LEAF_LABEL).alias("leaf")), codes.trailing_code(F.col("leaf")), trie).drop("leaf")


@query(f"""WITH d AS (SELECT DISTINCT regexp_extract({S_STANDARD}, '^([A-Z]+[0-9]+(-[0-9]+)*) ?[:：]', 1) AS code FROM part WHERE p_partkey % 3 = 0),
  p AS (SELECT code, unnest([regexp_extract(code, '^[A-Z]+'), split_part(code, '-', 1), code]) AS prefix FROM d WHERE code <> '')
  SELECT prefix, count(DISTINCT code) AS codes, bool_or(prefix = code) AS is_code FROM p GROUP BY prefix""")
def q_code_trie(spark, sf_dir):
    standard = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.expr(S_STANDARD).alias("category"))
    return codes.code_trie(standard, codes.leading_code(F.col("category")), ("category",)).select("prefix", "codes", F.col("entry").isNotNull().alias("is_code"))


S_NATION = "CASE n_nationkey % 5 WHEN 0 THEN ' Finance ' WHEN 1 THEN 'INFRA' WHEN 2 THEN 'education' ELSE n_name END"


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'given' ELSE coalesce(MAP {{{', '.join(f'{s_text(k)}: {s_text(v)}' for k, v in DOMAINS.items())}}}[lower(trim({S_NATION}))], {s_text(GENERIC_DOMAIN)}) END AS domain FROM nation")
def q_domain_lookup(spark, sf_dir):
    override = F.when(F.col("n_nationkey") % 6 == 0, " given ").otherwise(" ")
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.domain_description(F.expr(S_NATION), override).alias("domain"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files  # registers the queries that go through files

    assert files
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import files

    assert files
    return dict(SQL)
