"""Workbooks with the standard library: cells in, cells out.

Reading gives a Spark data source, ``xlsx``.  A column whose cells are all whole
numbers, numbers, dates or booleans has that type; any other is text, with cells
the way their type prints (integers without a point, ISO dates, true and false).
"""

from __future__ import annotations

import datetime
import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _letters(index: int) -> str:
    out = ""
    while index >= 0:
        index, rest = divmod(index, 26)
        out, index = chr(65 + rest) + out, index - 1
    return out


def _index(reference: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


Cell = str | bool | int | float | datetime.datetime | None


def as_text(cell: Cell) -> str | None:
    if isinstance(cell, bool):
        return "true" if cell else "false"
    if isinstance(cell, datetime.datetime):
        return cell.date().isoformat() if cell.time() == datetime.time() else cell.isoformat()
    return repr(cell) if isinstance(cell, float) else None if cell is None else str(cell)


def column_type(kinds: set[type]) -> DataType:
    """What a column's cells have in common."""
    if kinds == {int, float}:
        return DoubleType()
    one = {bool: BooleanType(), int: LongType(), float: DoubleType(), datetime.datetime: TimestampNTZType()}
    return one.get(next(iter(kinds)), StringType()) if len(kinds) == 1 else StringType()


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        book = self._xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): targets[s.get(RELATION)].lstrip("/").removeprefix("xl/") for s in book.iter(f"{MAIN}sheet")}
        properties = book.find(f"{MAIN}workbookPr")
        early = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = datetime.datetime(1904, 1, 1) if early else datetime.datetime(1899, 12, 30)
        self.shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.date_styles: set[int] = set()
        if "xl/styles.xml" in names:
            styles = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode")) for f in styles.iter(f"{MAIN}numFmt")}
            cells = styles.find(f"{MAIN}cellXfs")
            for i, x in enumerate(cells if cells is not None else []):
                f = int(x.get("numFmtId") or 0)
                if f in DATE_FORMATS or re.search("[dmyhs]", own.get(f, ""), re.I):
                    self.date_styles.add(i)

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _cell(self, c: ElementTree.Element) -> Cell:
        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind == "e":
            return None
        if kind != "n":
            return v.text
        number = float(v.text)
        if int(c.get("s") or 0) in self.date_styles:
            return self.epoch + datetime.timedelta(seconds=round(number * 86400))
        return int(number) if number == int(number) and abs(number) < 1e15 else number

    def rows(self, sheet: str) -> Iterator[list[Cell]]:
        with self.zip.open(f"xl/{self.sheets[sheet]}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag == f"{MAIN}row":
                    out: list[Cell] = []
                    for i, c in enumerate(row.findall(f"{MAIN}c")):
                        at = _index(c.get("r")) if c.get("r") else i
                        out += [None] * (at + 1 - len(out))
                        out[at] = self._cell(c)
                    yield out
                    row.clear()


def header_names(cells: Iterable[Cell]) -> list[str]:
    """Names of columns: an empty one is named by its place, one seen before gets .1, .2 and so on."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = base = as_text(cell) if cell not in (None, "") else f"Unnamed: {i}"
        k = 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


class XlsxSource(DataSource):
    """Options: path, sheet.  A sheet is one partition: it is one compressed stream."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _rows(self) -> Iterator[list[Cell]]:
        with open(self.options["path"], "rb") as f:
            return Workbook(f.read()).rows(self.options["sheet"])

    def schema(self) -> StructType:
        rows = self._rows()
        names = header_names(next(rows, []))
        kinds: list[set[type]] = [set() for _ in names]
        for row in rows:
            for found, cell in zip(kinds, row):
                if cell is not None:
                    found.add(type(cell))
        return StructType([*[StructField(n, column_type(k)) for n, k in zip(names, kinds)], StructField("_row_idx", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        rows, width = self._rows, len(schema) - 1
        held = [float if isinstance(f.dataType, DoubleType) else as_text if isinstance(f.dataType, StringType) else (lambda x: x) for f in schema.fields[:-1]]

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(0)]

            def read(self, partition):
                cells = rows()
                next(cells, None)
                for i, row in enumerate(cells):
                    if any(x is not None for x in row):
                        yield (*[None if x is None else f(x) for f, x in zip(held, (row + [None] * width)[:width])], i)

        return Reader()


def _xml_cell(value, reference: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    if isinstance(value, datetime.date):
        return f'<c r="{reference}" s="1"><v>{(value - datetime.date(1899, 12, 30)).days}</v></c>'
    text = escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, tuple[list[str], Iterable[Iterable]]]) -> dict[str, int]:
    """Sheets of (header, rows), row by row; numbers, booleans and dates keep their types.  Returns rows of each sheet."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    space = MAIN[1:-1]
    counts = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="r" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{space}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        related = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">{related}<Relationship Id="s" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{space}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, (name, (header, rows)) in enumerate(sheets.items(), 1):
            n = 0
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                # Widths from the header and the first rows, which are held until then, within 10 and 60.
                rows = iter(rows)
                first = list(itertools.islice(rows, 1000))
                longest = [max(len(str(h)), *(len(str(r[k])) for r in first if k < len(r) and r[k] is not None), 0) for k, h in enumerate(header)]
                rows = itertools.chain(first, rows)
                widths = "".join(f'<col min="{k}" max="{k}" width="{min(60, max(10, x + 2))}" customWidth="1"/>' for k, x in enumerate(longest, 1))
                f.write(f'{head}<worksheet xmlns="{space}"><cols>{widths}</cols><sheetData>'.encode())
                for n, row in enumerate([header], 1):
                    f.write(f'<row r="1">{"".join(_xml_cell(v, f"{_letters(k)}1") for k, v in enumerate(row))}</row>'.encode())
                n = 0
                for n, row in enumerate(rows, 1):
                    f.write(f'<row r="{n + 1}">{"".join(_xml_cell(v, f"{_letters(k)}{n + 1}") for k, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
            counts[name] = n
    return counts
