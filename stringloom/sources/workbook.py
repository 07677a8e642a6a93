"""Worksheet rows from many .xlsx files, one file per task row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

ROW_SCHEMA = "path string, sheet string, row_no long, record map<string,string>"
# XML names of the open worksheet format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class MissingWorksheet(LookupError):
    """The wanted worksheet is not in the workbook."""


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(MAIN + "t"))


def _column(ref: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", ref).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    with book.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != MAIN + "row":
                continue
            cells = {}
            for at, cell in enumerate(row.iter(MAIN + "c")):
                place = _column(cell.get("r")) if cell.get("r") else at
                value = cell.find(MAIN + "v")
                if cell.get("t") == "inlineStr":
                    cells[place] = _text(cell)
                elif value is not None and value.text is not None:
                    cells[place] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield int(row.get("r") or 0), cells
            row.clear()


def _open_sheets(content: bytes) -> Iterator[tuple[str, Iterator]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_text(item) for item in root.iter(MAIN + "si")]
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = {link.get("Id"): link.get("Target").lstrip("/") for link in links}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
            part = target[sheet.get(RELATION)]
            yield sheet.get("name"), _sheet_rows(book, part if part.startswith("xl/") else "xl/" + part, shared)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for sheet, rows in _open_sheets(content):
                header, out = None, []
                for number, cells in rows:
                    if header is None:
                        header = {at: name or f"_c{at}" for at, name in cells.items()}
                        continue
                    out.append((path, sheet, number, {h: cells.get(at) for at, h in header.items()}))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["path", "sheet", "row_no", "record"])
                        out = []
                yield pd.DataFrame(out, columns=["path", "sheet", "row_no", "record"])


def read_workbooks(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sheet, row_no, record): one row per data row, cells keyed by the header of its sheet."""
    return parse_workbooks(spark.read.format("binaryFile").load(pattern).select("path", "content"))


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Rows of the workbooks in a (path, content) frame."""
    return files.mapInPandas(_parse, ROW_SCHEMA)


def pick_sheet(rows: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """The named worksheet as a table of string ``columns``."""
    record = F.col("record")
    cells = [record.getItem(name).alias(name) for name in columns]
    return blank_to_null(rows.where(F.col("sheet") == sheet).select("path", "row_no", *cells), columns)


def require_sheet(rows: DataFrame, sheet: str) -> None:
    """Raise with the list of worksheet names when ``sheet`` is absent."""
    if rows.where(F.col("sheet") == sheet).isEmpty():
        present = [r["sheet"] for r in rows.select("sheet").distinct().orderBy("sheet").collect()]
        raise MissingWorksheet(f"no worksheet {sheet!r}; found {present}")
