"""Workbooks: tables as sheets of one XLSX file, written part by part.

Rows become XML in Spark's tasks; the driver gets them one partition at a time, in order, and
writes them on.  A table of more rows than a sheet holds goes on in further sheets.  The
file is one, so its writing isn't distributed: project.export() is for large tables.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StructType

#: Rows of a sheet and characters of its name at most, and what a name may not hold.
SHEET_ROWS, NAME_CHARS = 1_048_576, 31
NOT_IN_NAMES = re.compile(r"[\[\]:*?/\\]")
#: Control characters that XML can't hold.
CONTROLS = "[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _text(value: Column) -> Column:
    out = F.regexp_replace(value, CONTROLS, "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), out, F.lit("</t></is></c>"))


def _cell(df: DataFrame, name: str) -> Column:
    """One value as a cell: numbers and booleans as such, nested values as JSON, others as text; an empty cell for null (and for what is no number)."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, BooleanType):
        cell = F.concat(F.lit('<c t="b"><v>'), value.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(kind, NumericType):
        finite = F.abs(value.cast("double")) < float("inf")
        cell = F.when(finite, F.concat(F.lit("<c><v>"), value.cast("string"), F.lit("</v></c>")))
    else:
        cell = _text(F.to_json(value) if isinstance(kind, (ArrayType, MapType, StructType)) else value.cast("string"))
    return F.coalesce(cell, F.lit("<c/>"))


def _header(columns: Sequence[str]) -> str:
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in columns) + "</row>"


def sheet_name(name: str, taken: Sequence[str], number: int = 1) -> str:
    """A name that a sheet may have and no other has."""
    base, k = NOT_IN_NAMES.sub("_", name).strip("'") or "table", number
    while True:
        end = f" ({k})" if k > 1 else ""
        told = base[: NAME_CHARS - len(end)] + end
        if told.lower() not in {t.lower() for t in taken}:
            return told
        k += 1


def write(path: str, tables: dict[str, DataFrame], rows_of_sheet: int = SHEET_ROWS) -> list[str]:
    """One sheet with a header for each table that has rows, in their order; returns the sheets' names."""
    sheets: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        for name, df in tables.items():
            rows = df.select(F.concat(F.lit("<row>"), *(_cell(df, c) for c in df.columns), F.lit("</row>")).alias("row")).toLocalIterator(prefetchPartitions=True)
            ahead = next(rows, None)
            while ahead is not None:
                sheets.append(sheet_name(name, sheets))
                with file.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>{_header(df.columns)}'.encode())
                    written = 1
                    while ahead is not None and written < rows_of_sheet:
                        sheet.write(ahead["row"].encode())
                        written += 1
                        ahead = next(rows, None)
                    sheet.write(b"</sheetData></worksheet>")
        if not sheets:  # a workbook has one sheet at least
            sheets.append("empty")
            file.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        numbers = range(1, len(sheets) + 1)
        book = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets))
        file.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{book}</sheets></workbook>')
        parts = "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        file.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{parts}</Relationships>')
        file.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        file.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )
    return [] if sheets == ["empty"] and not any(not df.isEmpty() for df in tables.values()) else sheets


def read(path: str) -> Iterator[tuple[str, list[list]]]:
    """(name, rows) of every sheet: texts, numbers, booleans and None, the header first."""
    with zipfile.ZipFile(path) as file:
        book = ElementTree.fromstring(file.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(file.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.iter(f"{{{MAIN}}}sheet"):
            rows = []
            with file.open("xl/" + targets[sheet.get(f"{{{RELATIONS}}}id")]) as part:
                for _, row in ElementTree.iterparse(part):
                    if row.tag == f"{{{MAIN}}}row":
                        rows.append([_value(c) for c in row])
                        row.clear()
            yield sheet.get("name"), rows


def _value(cell: ElementTree.Element):
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
    v = cell.find(f"{{{MAIN}}}v")
    if v is None:
        return None
    return v.text == "1" if cell.get("t") == "b" else float(v.text)
