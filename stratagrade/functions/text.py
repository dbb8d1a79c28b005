"""Text cleaning, label and type normalization, and identifiers, all JVM-side.

Each function takes and returns Columns; there is no Python in any of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DOMAINS, GENERIC_DOMAIN, LABELS, IDENTITY, METADATA, NA_TOKENS, PROMPT_HEAD, PROMPT_LABELS, TYPE_OF

#: Everything that str.strip() and \s take for white space in Python, which is more
#: than either does in Java.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACES.replace("[", "[^", 1)
UNIT = "\x1f"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 9562


def clean_text(c: Column) -> Column:
    """Null becomes empty; runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACES + "+", " "))


def is_blank(c: Column) -> Column:
    """Whether clean_text() would leave nothing, without cleaning: null, or no character
    that isn't white space."""
    return ~F.coalesce(c.cast("string"), F.lit("")).rlike(NOT_SPACE)


def missing_to_empty(c: Column) -> Column:
    """The cell texts that table readers take for missing become empty."""
    return F.when(c.isNull() | c.isin(*NA_TOKENS), F.lit("")).otherwise(c)


def normalize_label(c: Column) -> Column:
    """Clean, and drop one bracketed code (letters, then perhaps digits and -digits)
    from the end."""
    return F.trim(F.regexp_replace(clean_text(c), r" *[(\[（【] *[A-Za-z]+\p{Nd}*(?:-\p{Nd}+)* *[)\]）】] *\z", ""))


def normalize_name(c: Column) -> Column:
    """Lower case; everything but ASCII letters, digits and CJK becomes single _."""
    return F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "_"), "^_+|_+$", "")


def normalize_type(c: Column) -> Column:
    """The token of a declared SQL type; unknown types in upper case."""
    text = F.lower(clean_text(c))
    tokens = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(tokens, F.element_at(F.split(text, r"[\s(]", 2), 1)), F.upper(text))


def normalize_level(c: Column) -> Column:
    """1 to 4, L1 to L4 or LEVEL1 to LEVEL4 -> L1 to L4; empty stays; else an error."""
    text = F.upper(clean_text(c))
    level = F.concat(F.lit("L"), F.regexp_extract(text, r"^(?:L|LEVEL)?([1-4])\z", 1))
    return F.when(text == "", "").when(level != "L", level).otherwise(F.raise_error(F.concat(F.lit("Unsupported data level: "), text)))


def identity_text(source_name: Column, field_source: Column, augmented: Column, columns: dict[str, Column]) -> Column:
    return F.concat_ws(UNIT, F.lower(source_name), *[columns[f] for f in IDENTITY], field_source, augmented, *[columns[f] for f in LABELS])


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def document_id(dataset: Column, label: Column, content: Column) -> Column:
    return F.concat(dataset, F.lit("-"), F.substring(F.sha2(F.concat_ws(UNIT, dataset, label, content), 256), 1, 24))


def prompt(metadata: dict[str, Column]) -> Column:
    """The user message: a head line, and a line for each field that isn't blank."""
    lines = []
    for field in METADATA:
        said = F.coalesce(metadata[field].cast("string"), F.lit("None"))
        ends = said.rlike(rf"^{SPACES}|{SPACES}\z")  # few values have blanks to cut off
        value = F.when(ends, F.regexp_replace(said, rf"^{SPACES}+|{SPACES}+\z", "")).otherwise(said)
        lines.append(F.when(~is_blank(said), F.concat(F.lit(PROMPT_LABELS[field] + "："), value)))
    return F.concat_ws("\n", F.lit(PROMPT_HEAD), *lines)


def domain_description(dataset: Column, override: Column | None = None) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    found = F.coalesce(F.try_element_at(texts, F.lower(F.trim(dataset))), F.lit(GENERIC_DOMAIN))
    return found if override is None else F.coalesce(F.nullif(F.trim(override), F.lit("")), found)
