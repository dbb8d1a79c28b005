"""Codes of classification standards: `A1-1:name` in dictionaries, `name（A1-1-3）` in
catalogues.

A code is a path: letters, a number, and more numbers after hyphens.  The codes of a
dictionary make a trie, held as a table with a row for each prefix; a catalogue's leaf is
linked to the longest code of the dictionary on its own code's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, clean_text

#: Fixed value: digits that stand for 0 to 9 in full-width writing.
WIDE_DIGITS = "０１２３４５６７８９"
_CODE = r"[A-Za-z]+\p{Nd}+(?:-\p{Nd}+)*"


def normalize_code(c: Column) -> Column:
    """Capital letters and ASCII digits."""
    return F.upper(F.translate(c, WIDE_DIGITS, "0123456789"))


def leading_code(c: Column) -> Column:
    """The code before a colon at the start of a category; empty if none stands there."""
    return normalize_code(F.regexp_extract(F.coalesce(c, F.lit("")), rf"^{SPACES}*({_CODE}){SPACES}*[:：]", 1))


def without_leading_code(c: Column) -> Column:
    return F.regexp_replace(clean_text(c), rf"^{_CODE} ?[:：] ?", "")


def trailing_code(c: Column) -> Column:
    """The bracketed code at the end of a label; empty if none stands there."""
    return normalize_code(F.regexp_extract(F.coalesce(c, F.lit("")), rf"[(\[（【]{SPACES}*({_CODE}){SPACES}*[)\]）】]{SPACES}*\z", 1))


def code_prefixes(code: Column) -> Column:
    """The path to a code, itself last: A, A1, A1-1 for A1-1; none for an empty one."""
    parts = F.split(code, "-")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    return F.when(code == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.regexp_extract(code, "^[A-Z]+", 0)), steps))


def code_trie(standards: DataFrame, code: Column, keep: tuple[str, ...] = ("description", "category", "class", "ref")) -> DataFrame:
    """prefix, depth, parent, codes (how many of the dictionary are at or below it), entry:
    a row for each prefix of the dictionary's codes.

    `entry` holds the columns `keep` of the standard with that very code (the first by
    them, if several have it), and is null for a prefix that is no code itself.
    """
    known = standards.select(code.alias("code"), F.struct(*keep).alias("entry")).where("code <> ''").groupBy("code").agg(F.min("entry").alias("entry"))
    nodes = known.select("code", "entry", F.posexplode(code_prefixes(F.col("code"))).alias("depth", "prefix"), code_prefixes(F.col("code")).alias("path"))
    parent = F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))
    own = F.when(F.col("prefix") == F.col("code"), F.col("entry"))
    return nodes.groupBy("prefix", "depth", parent.alias("parent")).agg(F.count("*").alias("codes"), F.max(own).alias("entry"))


def link_codes(leaves: DataFrame, code: Column, trie: DataFrame) -> DataFrame:
    """`leaves` with linked_code, exact, below and the entry's columns: the longest code of the
    dictionary that is a prefix of the leaf's (null without any), whether it is the
    leaf's own, and how many codes of the dictionary lie below the leaf's code.

    Only distinct codes are spread over their prefixes and looked up; the rows take the
    outcome by their code, and rows without a code keep nulls.
    """
    entry = trie.schema["entry"].dataType.fieldNames()
    rows = leaves.withColumn("__code", code)
    asked = rows.select("__code").where("__code <> ''").distinct()
    steps = asked.select("__code", F.explode(code_prefixes(F.col("__code"))).alias("__prefix"))
    met = steps.join(trie.withColumnRenamed("prefix", "__prefix"), "__prefix")
    itself = F.col("__prefix") == F.col("__code")
    found = met.groupBy("__code").agg(
        F.max_by("__prefix", F.when(F.col("entry").isNotNull(), F.col("depth"))).alias("linked_code"), F.max_by("entry", F.when(F.col("entry").isNotNull(), F.col("depth"))).alias("__entry"),
        F.coalesce(F.max(F.when(itself, F.col("codes") - F.col("entry").isNotNull().cast("long"))), F.lit(0)).alias("below"),
    )
    linked = rows.join(found, "__code", "left").withColumn("exact", F.coalesce(F.col("linked_code") == F.col("__code"), F.lit(False)))
    return linked.select(*[F.col(f"`{c}`") for c in leaves.columns], "linked_code", "exact", F.coalesce("below", F.lit(0)).cast("long").alias("below"), *[F.col(f"__entry.{f}").alias(f) for f in entry])
