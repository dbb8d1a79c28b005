"""XLSX workbooks, read with the standard library alone and in parts of bounded size.

A sheet is one deflate stream, which has no entry but its start: one task inflates it
and cuts its text between rows, holding one cut at a time, and all tasks parse the cuts.  Shared
strings go the same way and are joined to the cells that name them.  The driver reads the small
parts (sheets' names, styles) and the sheet's beginning up to the header.
"""

from __future__ import annotations

import codecs
import datetime as dt
import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as say
from .places import Place, scratch_folder

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The format numbers that the file format itself gives to dates and times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_STRINGS = "xl/sharedStrings.xml"
#: Characters after which a text is cut, and bytes that are inflated at a time.
CUT, _PIECE = 1 << 18, 1 << 16


class Cells:
    """How the texts of cells are read; small, and sent to every task."""

    def __init__(self, is_date: list[bool], epoch: dt.datetime):
        self.is_date, self.epoch = is_date, epoch

    def date(self, serial: float) -> str:
        """A time of day below one day; else a date with its time."""
        at = self.epoch + dt.timedelta(seconds=round(serial * 86400, 3))
        return str(at.time() if 0 <= serial < 1 else at)

    def text(self, c: ElementTree.Element) -> tuple[str, int | None]:
        """The text of a cell, or the number of its shared string."""
        kind, value = c.get("t"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return plain_text(c), None
        if value is None or not value.text:
            return "", None
        if kind == "s":
            return "", int(value.text)
        if kind == "b":
            return {"1": "True", "0": "False"}.get(value.text, value.text), None
        style = int(c.get("s", -1))
        if kind in (None, "n") and 0 <= style < len(self.is_date) and self.is_date[style]:
            return self.date(float(value.text)), None
        return value.text.replace("T", " ") if kind == "d" else value.text, None

    def row(self, row: ElementTree.Element) -> list[tuple[str, int | None]]:
        line: list[tuple[str, int | None]] = []
        for c in row.iter(f"{_MAIN}c"):
            at = len(line)
            if letters := re.match("[A-Z]+", c.get("r", "") or ""):
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            line += [("", None)] * (at + 1 - len(line))
            line[at] = self.text(c)
        return line


def plain_text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))


class _Workbook:
    """The small parts of an XLSX file."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.names = z, set(z.namelist())
        styles = self.part("xl/styles.xml")
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
        formats = [x.get("numFmtId", "0") for cells in styles.iter(f"{_MAIN}cellXfs") for x in cells]
        is_date = [int(n) in _DATE_FORMATS or bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(n, "")), re.I)) for n in formats]
        self.book = self.part("xl/workbook.xml")
        since_1904 = any(p.get("date1904") in ("1", "true") for p in self.book.iter(f"{_MAIN}workbookPr"))
        self.cells = Cells(is_date, dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30))

    def part(self, name: str) -> ElementTree.Element:
        return ElementTree.parse(io.BytesIO(self.z.read(name))).getroot() if name in self.names else ElementTree.Element("none")

    def first_sheet(self) -> str:
        """The first in the workbook's own order; without such a list the lowest number."""
        target = {r.get("Id"): r.get("Target", "") for r in self.part("xl/_rels/workbook.xml.rels")}
        for sheet in self.book.iter(f"{_MAIN}sheet"):
            path = target.get(sheet.get(_LINK), "")
            name = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
            if name in self.names:
                return name
        numbered = [n for n in self.names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        return min(numbered, key=lambda n: int(re.findall(r"\d+", n)[-1]))

    def cuts(self, name: str, tag: str) -> Iterator[tuple[int, list[ElementTree.Element]]]:
        """The elements of a part, cut by cut, with the number of each cut's first."""
        with self.z.open(name) as f:
            for first, n, xml in cut(iter(lambda: f.read(_PIECE), b""), tag):
                yield first, elements(xml, tag, n)

    def header(self, sheet: str, at: int) -> list[str] | None:
        for first, rows in self.cuts(sheet, "row"):
            if at < first + len(rows):
                return self.said(self.cells.row(rows[at - first]))
        return None

    def said(self, line: list[tuple[str, int | None]]) -> list[str]:
        """One row with its shared strings, which are looked up from the first on."""
        wanted, found = {shared for _, shared in line if shared is not None}, {}
        for first, items in self.cuts(_STRINGS, "si") if wanted else ():
            found |= {i: plain_text(items[i - first]) for i in wanted if first <= i < first + len(items)}
            if len(found) == len(wanted):
                break
        return [text if shared is None else found[shared] for text, shared in line]


# Cutting ------------------------------------------------------------------------------


def _decoded(chunks: Iterable[bytes]) -> Iterator[str]:
    """The text of an XML file, by its byte order mark or its declaration."""
    chunks, head = iter(chunks), b""
    for chunk in chunks:
        head += chunk
        if len(head) > 256:
            break
    declared = re.match(rb"""(?:\xef\xbb\xbf)?<\?xml[^>]*?\bencoding\s*=\s*["']([\w.-]+)""", head)
    name = declared[1].decode() if declared else "utf-8"
    name = "utf-16" if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else {b"<\0": "utf-16-le", b"\0<": "utf-16-be"}.get(head[:2], name)
    decoder = codecs.getincrementaldecoder("utf-8-sig" if codecs.lookup(name).name == "utf-8" else name)()
    yield decoder.decode(head)
    for chunk in chunks:
        yield decoder.decode(chunk)
    yield decoder.decode(b"", True)


_INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_TAG = re.compile(rf"<!--.*?-->|<\?.*?\?>|<(?P<end>/?)(?P<name>[^\s<>/!?]+)(?P<inside>{_INSIDE})>", re.S)


def _around(text: str, tag: str) -> tuple[str, str]:
    """The start tags that are open where the first element of a name begins, and their ends."""
    held: list[tuple[str, str]] = []
    for m in _TAG.finditer(text):
        if not m["name"]:
            continue
        if m["name"].split(":")[-1] == tag:
            break
        if m["end"]:
            held.pop()
        elif not m["inside"].endswith("/"):
            held.append((m[0], m["name"]))
    return "".join(start for start, _ in held), "".join(f"</{name}>" for _, name in reversed(held))


def cut(chunks: Iterable[bytes], tag: str) -> Iterator[tuple[int, int, str]]:
    """An XML file in documents of about CUT characters that hold whole elements of a name:
    the number of the first, how many, and the text."""
    ends = re.compile(rf"<!\[CDATA\[.*?(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|(</(?:[^\s<>/:]+:)?{tag}\s*>|<(?:[^\s<>/:]+:)?{tag}(?:\s{_INSIDE})?/>)", re.S)
    text, first, look, opening, closing = "", 0, CUT, "", None
    for more in _decoded(chunks):
        text += more
        if len(text) < look:
            continue
        found = [m.end() for m in ends.finditer(text) if m[1]]
        if not found:
            look = 2 * len(text)  # one long element
            continue
        if closing is None:
            around, closing = _around(text, tag)
        yield first, len(found), opening + text[: found[-1]] + closing
        text, first, look, opening = text[found[-1] :], first + len(found), CUT, around
    yield first, sum(1 for m in ends.finditer(text) if m[1]), opening + text


def elements(xml: str, tag: str, n: int) -> list[ElementTree.Element]:
    found = list(ElementTree.fromstring(xml).iter(f"{_MAIN}{tag}"))
    if len(found) != n:
        raise ValueError(say.SHEET_ELEMENTS.format(tag=tag, found=len(found), n=n))
    return found


def member(pieces: Iterable[bytes], start: int, info: zipfile.ZipInfo) -> Iterator[bytes]:
    """One file of an archive, of which the bytes come in order; it begins at `start`."""
    inflate = zlib.decompressobj(-15) if info.compress_type == zipfile.ZIP_DEFLATED else None
    at, left, crc = 0, info.compress_size, 0
    for piece in pieces:
        begin, at = max(start - at, 0), at + len(piece)
        for i in range(begin, min(len(piece), begin + left), _PIECE):
            part = piece[i : i + min(_PIECE, left)]
            left -= len(part)
            data = inflate.decompress(part) if inflate else part
            crc = zlib.crc32(data, crc)
            yield data
    if left or crc != info.CRC:
        raise zipfile.BadZipFile(say.BAD_ARCHIVE.format(name=info.filename))


# Tables ---------------------------------------------------------------------------------


def _cut_by_tasks(spark: SparkSession, place: Place, z: zipfile.ZipFile, name: str, tag: str) -> DataFrame:
    """first, n, xml: a part of the workbook as cut() gives it.

    Spark reads the archive as lines, which any of its file systems has; put in order
    again and joined with what ended them they are its bytes.
    """
    info = z.getinfo(name)
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & 1:
        raise zipfile.BadZipFile(say.BAD_ARCHIVE.format(name=name))
    z.fp.seek(info.header_offset)
    local = z.fp.read(30)
    start = info.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
    mark = "\n" if info.compress_type == zipfile.ZIP_DEFLATED else ">"  # a stored text may have no line breaks
    schema = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("xml", pa.string())])

    def cut_all(batches):
        pieces = (b"".join(x + mark.encode() for x in b.column(0).to_pylist()) for b in batches)
        for found in cut(member(pieces, start, info), tag):
            yield pa.record_batch([[x] for x in found], schema=schema)

    path = re.sub(r"([\[\]{}*?\\])", r"\\\1", place.uri)
    at = [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.option("lineSep", mark).text(path).select(F.col("value").cast("binary").alias("line"), *at)
    return lines.repartition(1).sortWithinPartitions("block", "at").select("line").mapInArrow(cut_all, "first long, n long, xml string").repartition("first")


def _shared(cuts: DataFrame) -> DataFrame:
    """k, text of each shared string."""
    schema = pa.schema([("k", pa.int64()), ("text", pa.string())])

    def parse(batches):
        for b in batches:
            for row in b.to_pylist():
                texts = [plain_text(e) for e in elements(row["xml"], "si", row["n"])]
                yield pa.record_batch([[*range(row["first"], row["first"] + len(texts))], texts], schema=schema)

    return cuts.mapInArrow(parse, "k long, text string")


def _rows(cuts: DataFrame, cells: Cells) -> DataFrame:
    """at, cells (text, shared) of each row."""
    kind = pa.struct([("text", pa.string()), ("shared", pa.int64())])
    schema = pa.schema([("at", pa.int64()), ("cells", pa.list_(kind))])

    def parse(batches):
        for b in batches:
            for row in b.to_pylist():
                lines = [[{"text": t, "shared": k} for t, k in cells.row(e)] for e in elements(row["xml"], "row", row["n"])]
                yield pa.record_batch([pa.array(range(row["first"], row["first"] + len(lines)), pa.int64()), pa.array(lines, schema.field(1).type)], schema=schema)

    return cuts.mapInArrow(parse, "at long, cells array<struct<text:string,shared:long>>")


def read_first_sheet(spark: SparkSession, place: Place, header_row: int) -> tuple[list[str], DataFrame]:
    """The header, and at (a number from 0) and cells (texts) of each row after it."""
    if place.name[0] in "._":  # which Spark's readers pass over
        copy = scratch_folder("workbook") / "t.xlsx"
        place.copy_to(copy)
        place = copy
    with place.reader() as opened, zipfile.ZipFile(opened) as z:
        book = _Workbook(z)
        sheet = book.first_sheet()
        header = book.header(sheet, header_row)
        if header is None:
            raise ValueError(f"No header row in {place}")
        rows = _rows(_cut_by_tasks(spark, place, z, sheet, "row"), book.cells).where(F.col("at") > header_row)
        rows = rows.withColumn("at", F.col("at") - header_row - 1)
        if _STRINGS not in book.names:
            return header, rows.select("at", "cells.text")
        strings = _shared(_cut_by_tasks(spark, place, z, _STRINGS, "si"))
    cells = rows.select("at", F.posexplode_outer("cells").alias("i", "cell")).withColumn("key", F.coalesce("cell.shared", -1 - F.col("at")))  # cells without one meet none, each row's elsewhere
    joined = cells.join(strings.withColumnRenamed("text", "found"), cells["key"] == F.col("k"), "left")
    lost = F.raise_error(F.format_string("%s has no shared string %d", F.lit(str(place)), F.col("key"))).cast("string")
    text = F.when(F.col("cell.shared").isNull(), F.col("cell.text")).otherwise(F.coalesce("found", lost))
    return header, joined.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("text")))), lambda x: x["text"]).alias("text"))
