"""Office files without office libraries: sheets and tables of zipped XML as rows of cells, and small sheets written."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of one sheet; the format holds no more, and a larger table belongs into another format.
SHEET_ROWS = 1_048_576

# The namespaces and part names of the two formats.
_SHEET, _DOC = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'


def column_number(reference: str) -> int:
    """The column of a cell reference such as 'AB12', from 0."""
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of a workbook: numbers as they stand, shared and inline texts, true and false; gaps are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(s, f"{_SHEET}t") for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = links[sheet.get(_LINK)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as part:
                number = 0
                for _, row in ET.iterparse(part):
                    if row.tag != f"{_SHEET}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    cells: list[str | None] = []
                    for c in row.iter(f"{_SHEET}c"):
                        at = column_number(c.get("r") or "") if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value, kind = c.find(f"{_SHEET}v"), c.get("t")
                        if kind == "inlineStr":
                            cells[at] = _text(c, f"{_SHEET}t")
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if kind == "s" else str(value.text == "1").lower() if kind == "b" else value.text
                    yield sheet.get("name"), number, cells
                    row.clear()


def document_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(table number, row number from 1, cells) of the tables of a text document, paragraphs of a cell as lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    for n, table in enumerate(body.iter(f"{_DOC}tbl"), 1):
        for k, row in enumerate(table.findall(f"{_DOC}tr"), 1):
            yield str(n), k, ["\n".join(_text(p, f"{_DOC}t") for p in cell.iter(f"{_DOC}p")) for cell in row.findall(f"{_DOC}tc")]


_READERS = {"xlsx": sheet_rows, "docx": document_rows}


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row_no, cells, problem): the rows of xlsx and docx files (path, format, content), each file in one task.

    A file that cannot be read gives one row with the problem and no cells; other formats and null contents give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet", "row_no", "cells", "problem"]
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["format"], batch["content"], strict=True):
                try:
                    rows = [(path, sheet, n, cells, None) for sheet, n, cells in _READERS[kind](bytes(content))]
                except Exception as error:  # a damaged file is a row of the result
                    rows = [(path, None, None, None, f"{type(error).__name__}: {error}"[:200])]
                yield pd.DataFrame(rows, columns=columns).astype({"row_no": "Int32"})

    wanted = files.where(F.lower("format").isin(*_READERS) & F.col("content").isNotNull()).select("path", F.lower("format").alias("format"), "content")
    return wanted.mapInPandas(run, "path string, sheet string, row_no int, cells array<string>, problem string")


def write_sheet(df: DataFrame, path: str, name: str = "Sheet1") -> None:
    """A table of SHEET_ROWS - 1 rows at most as a workbook of one sheet with a header row; more raise. Numbers stay numbers, nulls are gaps."""
    rows = df.limit(SHEET_ROWS).collect()  # bounded by the format
    if len(rows) == SHEET_ROWS:
        raise ValueError("too many rows for a sheet")

    def cell(x: object) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        if isinstance(x, (int, float)):
            return f"<c><v>{x!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *rows])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml"))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SHEET[1:-1]}" xmlns:r="{_LINK[1:-3]}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
