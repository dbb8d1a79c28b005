"""Workbooks in cuts: what the driver holds, shared strings, and odd XML."""

import json
import tracemalloc
import zipfile

import pytest

from stratagrade.operators import standards
from stratagrade.plans.files import write_xlsx
from stratagrade.sources import workbooks
from stratagrade.sources.tables import read_table

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(path, sheet, strings=None, kind=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", kind) as z:
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", strings)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return path


def test_driver_holds_no_sheet(spark, tmp_path):
    n = 60000
    tracemalloc.start()
    try:
        write_xlsx(tmp_path / "t.xlsx", ([f"c{i}", "x" * 40] for i in range(n + 1)))
        df = read_table(spark, tmp_path / "t.xlsx")
        assert df.columns == ["c0", "x" * 40, "_row"] and df.where("c0 = concat('c', _row + 1)").count() == n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12_000_000  # the sheet has 8 MB of XML, its tree ten times that


def test_standards_hold_no_dictionary(spark, tmp_path):
    head = [["title"], ["定义说明4", "定义说明3", "四级分类", "三级分类"]]
    write_xlsx(tmp_path / "s.xlsx", [*head, ["d\"1", "", "a\nb", ""], ["——", "d2", "——", "c"], ["d\"1", "", "last", ""]])
    assert standards.write_standards(spark, tmp_path / "s.xlsx", tmp_path / "s.json") == 2
    want = {'d"1': {"category": "last"}, "d2": {"category": "c"}}
    assert (tmp_path / "s.json").read_text("utf-8") == json.dumps(want, ensure_ascii=False, indent=4)
    write_xlsx(tmp_path / "none.xlsx", head)
    assert standards.write_standards(spark, tmp_path / "none.xlsx", tmp_path / "none.json") == 0 and (tmp_path / "none.json").read_text() == "{}"


@pytest.mark.parametrize("kind", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_shared_strings_over_cuts(spark, tmp_path, kind):
    n = 9000
    strings = f"<sst {NS}>" + "".join(f"<si><r><t>s{i}</t></r><r><t>{'y' * 40}\n</t></r></si>" for i in range(n)) + "</sst>"
    rows = "".join(f'<row><c t="s"><v>{n - 1 - i}</v></c><c><v>{i}</v></c></row><row/>' for i in range(n))
    df = read_table(spark, archive(tmp_path / "_t [1].xlsx", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>", strings, kind))
    assert df.columns == [(f"s{n - 1}" + "y" * 40), "0", "_row"]
    got = sorted((r[2], r[0], r[1]) for r in df.collect())
    want = [(2 * i - 1, f"s{n - 1 - i}" + "y" * 40 + "\n", str(i)) for i in range(1, n)] + [(2 * i, "", "") for i in range(n)]
    assert got == sorted(want)


def test_cuts_are_whole_elements(monkeypatch):
    monkeypatch.setattr(workbooks, "CUT", 50)
    rows = "".join(f"<x:row r='{i}'><x:c><x:v><![CDATA[</x:row>{i}]]></x:v></x:c><!-- </x:row> --></x:row><x:row r='>'/>" for i in range(40))
    sheet = f"<?xml version='1.0' encoding='UTF-16'?><x:worksheet {NS.replace('xmlns=', 'xmlns:x=')}><x:cols><x:col/></x:cols><x:sheetData>{rows}</x:sheetData><x:tail/></x:worksheet>"
    for data in (sheet.encode("utf-16"), sheet.replace("UTF-16", "UTF-8").encode("utf-8-sig")):
        found = list(workbooks.cut((data[i : i + 7] for i in range(0, len(data), 7)), "row"))
        assert len(found) > 30 and [f for f, _, _ in found] == [sum(n for _, n, _ in found[:k]) for k in range(len(found))]
        texts = ["".join(e.itertext()) for _, n, xml in found for e in workbooks.elements(xml, "row", n)]
        assert texts == [t for i in range(40) for t in (f"</x:row>{i}", "")]


def test_damage_is_told(tmp_path):
    path = archive(tmp_path / "t.xlsx", f"<worksheet {NS}/>")
    with zipfile.ZipFile(path) as z:
        info = z.getinfo("xl/worksheets/sheet1.xml")
        start = info.header_offset + 30 + len(info.filename)
    data = path.read_bytes()
    assert b"".join(workbooks.member([data[:50], data[50:]], start, info)) == f"<worksheet {NS}/>".encode()
    with pytest.raises(zipfile.BadZipFile, match="sheet1.xml"):
        list(workbooks.member([data[: start + 9]], start, info))


def test_absent_shared_string(spark, tmp_path):
    sheet = f'<worksheet {NS}><sheetData><row><c><v>h</v></c></row><row><c t="s"><v>7</v></c></row></sheetData></worksheet>'
    with pytest.raises(Exception, match="no shared string 7"):
        read_table(spark, archive(tmp_path / "t.xlsx", sheet, f"<sst {NS}><si><t>a</t></si></sst>")).collect()
