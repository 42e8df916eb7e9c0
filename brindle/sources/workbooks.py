"""Workbooks (.xlsx) as tables of cells, and tables as workbooks.

Files are read by Spark's binaryFile source, so they may lie in any store, and each is parsed where it
is read.  Legacy binary .xls files are not read."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import CONTROL

SCHEMA = "file string, sheet string, sheet_ord int, row_idx int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _value(cell: ET.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    v = cell.find(f"{_MAIN}v")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    return v.text


def parse_workbook(content: bytes, max_rows: int | None = None) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, sheet_ord, row_idx, cells) of every row up to max_rows; rows left out in the file are
    empty rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.parse(z.open("xl/sharedStrings.xml")).getroot()]
        targets = {r.get("Id"): r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        book = ET.parse(z.open("xl/workbook.xml")).getroot()
        for k, s in enumerate(book.find(f"{_MAIN}sheets")):
            target = targets[s.get(_REL)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                at = 0
                for _, row in ET.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r", at + 1)) - 1
                    if max_rows is not None and number >= max_rows:
                        break
                    while at < number:
                        yield s.get("name"), k, at, []
                        at += 1
                    cells: list[str | None] = []
                    for c in row.findall(f"{_MAIN}c"):
                        col = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (col - len(cells)) + [_value(c, shared)]
                    yield s.get("name"), k, at, cells
                    at += 1
                    row.clear()


def read_workbooks(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Cells of all .xlsx files under a path (others are passed over); max_rows: only the first rows of
    each sheet, for headers and previews."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                held = []
                for row in parse_workbook(content, max_rows):
                    held.append((name, *row))
                    if len(held) >= 10_000:
                        yield pd.DataFrame(held, columns=["file", "sheet", "sheet_ord", "row_idx", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "sheet", "sheet_ord", "row_idx", "cells"])

    return files.mapInPandas(parse, SCHEMA)


def sheet_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, ord, name): labels of each sheet's header row; unlabelled ones are `Unnamed: k`."""
    rows = cells.join(headers, "sheet").where("row_idx = header").select("sheet", F.posexplode("cells").alias("ord", "name"))
    return rows.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Unnamed: "), F.col("ord").cast("string"))))


def workbook_bytes(sheets: dict[str, tuple[list[str], Iterable[Iterable]]]) -> bytes:
    """An .xlsx of {name: (header, rows)}; names are cut to 31 characters, control characters dropped."""
    bad = re.compile(CONTROL)

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(bad.sub("", str(v)))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(n)) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-3]}"><sheets>' + "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{k + 1}" r:id="s{k}"/>' for k, name in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="s{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(n)) + "</Relationships>")
        for k, (header, rows) in enumerate(sheets.values()):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                for row in [header, *rows] if isinstance(rows, list) else _chain(header, rows):
                    f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _chain(header, rows):
    yield header
    yield from rows


def write_sheets(df: DataFrame, path: str, sheet: str = "sheet") -> None:
    """One Parquet folder a sheet."""
    df.write.mode("overwrite").partitionBy(sheet).parquet(path)
