"""Workbooks against CSV, and cells of every kind."""

import zipfile
from datetime import datetime

import pytest

from terrachron.sources import sheets, tables

HEAD = ["id", "2020-01-05", None, "id", "v"]
ROWS = [[1, "a<&>", 2.5, True, datetime(2020, 2, 29)], [None] * 5, [2, None, 1e300, None, datetime(2021, 2, 1, 12, 30)], [3, " pad ", 7.0, False, None]]


def test_cells_become_texts_and_folders_one_table(spark, tmp_path):
    for name, rows in (("a", ROWS), ("b", [[9, "z", None, None, None]])):
        (tmp_path / f"{name}.xlsx").write_bytes(sheets.encode_workbook(HEAD, rows))
    (tmp_path / "c.xlsx").write_bytes(sheets.encode_workbook([], []))  # nothing in it
    got = tables.read_table(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == ["id0", "2020-01-05", "_c2", "id3", "v"]
    assert sorted(map(tuple, got.collect())) == [("1", "a<&>", "2.5", "true", "2020-02-29"), ("2", None, "1e+300", None, "2021-02-01 12:30:00"), ("3", " pad ", "7", "false", None)]
    assert sheets.read_sheet(spark, str(tmp_path)).count() == 4
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, str(tmp_path / "c.xlsx"))
    with pytest.raises(ValueError, match="older binary"):
        tables.read_table(spark, "wells.xls")


def test_serial_dates_of_both_counts():
    assert [sheets.date_text(v, False) for v in (1, 59, 61, 43831, 43831.5)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2020-01-01", "2020-01-01 12:00:00"]
    assert sheets.date_text(0, True) == "1904-01-01"
    assert [sheets.column_of(r) for r in ("A1", "Z9", "AA10", "XFD3")] == [0, 25, 26, 16383]


def test_references_styles_and_named_sheets(tmp_path):
    """A workbook as other programs write it: gaps by references, runs in shared texts, own date formats, errors, two sheets."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "w.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="First" r:id="r1"/><sheet name="水位" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Q Id="r1" Target="worksheets/one.xml"/><Q Id="r2" Target="/xl/worksheets/two.xml"/></R>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy/m/d;@"/><numFmt numFmtId="171" formatCode="0.00&quot;m&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><r><t>wa</t></r><r><t>ter</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/one.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/two.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" s="1"><v>43831</v></c></row><row r="4"><c r="B4" t="e"><v>#N/A</v></c><c r="C4" s="2"><v>2.50</v></c><c r="D4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    book = sheets.Workbook(path.read_bytes())
    assert list(book.rows("水位")) == list(book.rows(1)) == [["water", None, "2020-01-01"], [None, None, "2.5", "x"]]
    assert list(book.rows()) == []
    with pytest.raises(ValueError, match="First"):
        list(book.rows("none"))


def test_a_sheet_gives_what_a_csv_gives(spark, tmp_path):
    rows = [[f"W{i}", i * 0.25, -i] for i in range(7000)]  # more than a batch
    (tmp_path / "t.xlsx").write_bytes(sheets.encode_workbook(["w", "x", "n"], rows))
    (tmp_path / "t.csv").write_text("w,x,n\n" + "\n".join(f"{a},{sheets.number_text(repr(b))},{c}" for a, b, c in rows))
    sides = [{tuple(r) for r in tables.read_table(spark, str(tmp_path / f"t.{kind}")).collect()} for kind in ("xlsx", "csv")]
    assert sides[0] == sides[1] and len(sides[0]) == 7000
