"""Workbooks (xlsx): a task reads a file as a stream of rows, so a folder of workbooks is read side by side.

Files come through Spark's own binary source, from any file system it knows. Cells become texts: numbers as short as they
can be written, dates as ISO dates (with a time, if they have one), truth values as true and false; errors and empty
cells are null. A row without a value is no row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Formats of dates and times among the built-in number formats.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a batch that a task hands on.
BATCH = 5000


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node if local(c.tag) == name]


def plain_text(node: ElementTree.Element) -> str:
    """The text of a string item: its runs, without reading aids."""
    return "".join((n.text or "") if local(n.tag) == "t" else plain_text(n) if local(n.tag) == "r" else "" for n in node)


def number_text(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def date_text(serial: float, since_1904: bool) -> str:
    """The date of a serial number; the 29th of February 1900, which the older count has, never was."""
    first = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if serial < 60 else 30)
    moment = first + timedelta(seconds=round(serial * 86400))
    return moment.strftime("%Y-%m-%d" if not (moment.hour or moment.minute or moment.second) else "%Y-%m-%d %H:%M:%S")


def column_of(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook:
    """A workbook's sheets, shared texts and date styles."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = self.part("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self.part("xl/_rels/workbook.xml.rels")}
        folder = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): folder(targets[s.get(RELATION)]) for sheets in children(book, "sheets") for s in sheets}
        self.since_1904 = any(p.get("date1904") in ("1", "true") for p in children(book, "workbookPr"))
        self.texts = [plain_text(item) for item in self.part("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dated: list[bool] = []
        if "xl/styles.xml" in self.zip.namelist():
            styles = self.part("xl/styles.xml")
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for g in children(styles, "numFmts") for f in g}
            for group in children(styles, "cellXfs"):
                for xf in group:
                    code = int(xf.get("numFmtId") or 0)
                    self.dated.append(bool(re.search("[dmyhs]", own[code], re.I)) and own[code].lower() != "general" if code in own else code in DATES)

    def part(self, name: str) -> ElementTree.Element:
        with self.zip.open(name) as file:
            return ElementTree.parse(file).getroot()

    def value(self, cell: ElementTree.Element) -> str | None:
        kind, style = cell.get("t", "n"), int(cell.get("s") or 0)
        if kind == "inlineStr":
            return "".join(plain_text(c) for c in children(cell, "is"))
        text = next((c.text for c in children(cell, "v")), None)
        if text is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(text)]
        if kind == "b":
            return "true" if text.strip() == "1" else "false"
        if kind in ("str", "d"):
            return text
        return date_text(float(text), self.since_1904) if style < len(self.dated) and self.dated[style] else number_text(text)

    def rows(self, sheet: int | str = 0) -> Iterator[list[str | None]]:
        """The rows with a value, from the first column on; a sheet goes by name or by place from 0."""
        names = list(self.sheets)
        if isinstance(sheet, str) and sheet not in self.sheets or isinstance(sheet, int) and not 0 <= sheet < len(names):
            raise ValueError(f"no sheet {sheet!r} among {names}")
        with self.zip.open(self.sheets[sheet if isinstance(sheet, str) else names[sheet]]) as file:
            inside: list[ElementTree.Element] = []
            for event, node in ElementTree.iterparse(file, ("start", "end")):
                if event == "start":
                    inside.append(node)
                    continue
                inside.pop()
                if local(node.tag) != "row":
                    continue
                out: list[str | None] = []
                for cell in children(node, "c"):
                    at = column_of(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at - len(out)) + [self.value(cell)]
                inside[-1].clear()  # rows that were read
                if any(v is not None for v in out):
                    yield out


def column_names(first: Sequence[str | None]) -> list[str]:
    """Names by the first row, as CSV's: empty ones become _c and their place, equal ones get their place at the end."""
    n = Counter(v.lower() for v in first if v)
    return [f"_c{i}" if not v else f"{v}{i}" if n[v.lower()] > 1 else v for i, v in enumerate(first)]


def read_workbooks(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """One table of texts from the same sheet of all workbooks in ``files`` (path, content), each with its names in its first row.

    Names and their order are those of the first file by path; a column that a workbook lacks is null there, and one that
    only others have is an error, as a table without a row of names is.
    """

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"names": [column_names(next(Workbook(c).rows(sheet), [])) for c in frame["content"]], "path": frame["path"]})

    first = files.mapInPandas(heads, "names array<string>, path string").where("size(names) > 0").orderBy("path").limit(1).collect()  # a row a task before the last one
    if not first:
        raise ValueError(f"no workbook has names in its sheet {sheet!r}")
    names = first[0]["names"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = Workbook(content).rows(sheet)
                own = column_names(next(rows, []))
                if set(own) - set(names):
                    raise ValueError(f"{path} has columns that others lack: {sorted(set(own) - set(names))}")
                batch: list[list[str | None]] = []
                for row in rows:
                    found = dict(zip(own, row, strict=False))
                    batch.append([found.get(c) for c in names])
                    if len(batch) == BATCH:
                        yield pd.DataFrame(batch, columns=names, dtype=object)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, ", ".join(f"`{c.replace('`', '``')}` string" for c in names))


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of a workbook, or of all workbooks of a folder, as a table of texts."""
    return read_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content"), sheet)


def encode_workbook(names: Sequence[str], rows: Sequence[Sequence[object]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: texts are shared, dates are serial numbers with a date style, None is no cell."""
    texts: dict[str, int] = {}

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, datetime):
            return f'<c s="1"><v>{(v - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
        if isinstance(v, str):
            return f'<c t="s"><v>{texts.setdefault(v, len(texts))}</v></c>'
        return f"<c><v>{v!r}</v></c>"

    body = "".join("<row>" + "".join(cell(v) for v in row) + "</row>" for row in [list(names), *rows])
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{RELATION[1:-3]}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts) + "</sst>")
    return out.getvalue()
