"""A small reader and writer of .xlsx workbooks (zipped XML), for tables of a header row and values."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = dt.datetime(1899, 12, 30)
# The built-in number formats that are dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


class Workbook:
    def __init__(self, source: str | io.IOBase):
        self.zip = zipfile.ZipFile(source)
        names = set(self.zip.namelist())
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        target = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + t
        self.sheets = {s.get("name"): target(links[s.get(_REL + "id")]) for s in book.iter(_MAIN + "sheet")}
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            self.shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(_MAIN + "si")]
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(_MAIN + "numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            formats = styles.find(_MAIN + "cellXfs")
            self.dates = {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}

    def _value(self, cell: ET.Element):
        kind, v = cell.get("t", "n"), cell.find(_MAIN + "v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind in ("str", "d"):
            return v.text
        if kind == "b":
            return v.text == "1"
        if kind == "e":
            return None
        number = float(v.text)
        if int(cell.get("s", 0)) in self.dates:
            return _EPOCH + dt.timedelta(microseconds=round(number * 86_400_000_000))
        return int(number) if number.is_integer() and abs(number) < 2**53 else number

    def rows(self, sheet: str) -> Iterator[list]:
        """The rows of a sheet, streamed; cells that are left out are None."""
        with self.zip.open(self.sheets[sheet]) as f:
            for _, row in ET.iterparse(f):
                if row.tag == _MAIN + "row":
                    out: list = []
                    for cell in row.iter(_MAIN + "c"):
                        at = _column(cell.get("r")) if cell.get("r") else len(out)
                        out += [None] * (at - len(out))
                        out.append(self._value(cell))
                    yield out
                    row.clear()


def _cell(ref: str, v) -> str:
    if v is None or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) != float("inf") and abs(v) < 2**53:
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, dt.datetime):
        return f'<c r="{ref}" s="2"><v>{(v.replace(tzinfo=None) - _EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(v, dt.date):
        return f'<c r="{ref}" s="1"><v>{(dt.datetime.combine(v, dt.time()) - _EPOCH).days}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write(target, columns: list[str], rows: Iterable, sheet: str = "Sheet1") -> None:
    """Write one sheet, streaming the rows."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel, pack = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet[:31], {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, head + body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for n, row in ((1, columns),):
                f.write(f'<row r="{n}">{"".join(_cell(f"{_name(i)}{n}", str(v)) for i, v in enumerate(row))}</row>'.encode())
            for n, row in enumerate(rows, 2):
                f.write(f'<row r="{n}">{"".join(_cell(f"{_name(i)}{n}", v) for i, v in enumerate(row))}</row>'.encode("utf-8", "replace"))
            f.write(b"</sheetData></worksheet>")
