"""First sheet of .xlsx workbooks.

A workbook is a zip of XML parts. Each task unpacks one workbook and sends its rows on as
(kind, text) cells; header, types and casts are then ordinary DataFrame work.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import MISSING_TOKENS, _distinct_names

ROWS = "line bigint, kinds array<string>, texts array<string>"
# Built-in number formats of the workbook standard that show dates or times.
DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}
ROWS_PER_BATCH = 10_000


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Read the first sheet of one .xlsx file; the first row is the header."""
    binary = spark.read.format("binaryFile").load(path).select("content")
    rows = binary.mapInPandas(_sheet_rows, ROWS)
    header = rows.orderBy("line").first()
    if header is None:
        raise ValueError(f"no rows in {path}")
    width = rows.agg(F.max(F.size("texts"))).first()[0]
    titles = list(header["texts"]) + [None] * (width - len(header["texts"]))
    names = _distinct_names(titles)
    body = rows.where(F.col("line") > header["line"])
    kind = [F.get("kinds", F.lit(i)) for i in range(width)]
    text = [
        F.when(~F.get("texts", F.lit(i)).isin(MISSING_TOKENS), F.get("texts", F.lit(i)))
        for i in range(width)
    ]
    seen = body.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(t).alias(f"present_{i}") for i, t in enumerate(text)],
        *[
            F.count_if(t.isNotNull() & (k == letter)).alias(f"{letter}_{i}")
            for letter in "nbd"
            for i, (k, t) in enumerate(zip(kind, text))
        ],
        *[F.count_if((k == "n") & t.try_cast("bigint").isNull()).alias(f"f_{i}")
          for i, (k, t) in enumerate(zip(kind, text))],
    ).first()
    cells = []
    for i, t in enumerate(text):
        present = seen[f"present_{i}"]
        dtype: T.DataType = T.StringType()
        if present == seen[f"n_{i}"] and seen["rows"]:
            whole = present == seen["rows"] and not seen[f"f_{i}"]
            dtype = T.LongType() if whole else T.DoubleType()
        elif present == seen[f"b_{i}"]:
            dtype = T.BooleanType()
        elif present == seen[f"d_{i}"]:
            dtype = T.TimestampNTZType()
        cells.append(t.cast(dtype).alias(f"c{i}"))
    return body.select(*cells).toDF(*names)


def _sheet_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            lines, kinds, texts = [], [], []
            for line, cells in _cells_by_row(content):
                lines.append(line)
                kinds.append([k for k, _ in cells])
                texts.append([t for _, t in cells])
                if len(lines) == ROWS_PER_BATCH:
                    yield pd.DataFrame({"line": lines, "kinds": kinds, "texts": texts})
                    lines, kinds, texts = [], [], []
            if lines:
                yield pd.DataFrame({"line": lines, "kinds": kinds, "texts": texts})


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parts(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook = _parts(book, "xl/workbook.xml")
    links = _parts(book, "xl/_rels/workbook.xml.rels")
    sheet = next(e for e in workbook.iter() if _local(e.tag) == "sheet")
    wanted = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    target = next(e.get("Target") for e in links if e.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    styles = _parts(book, "xl/styles.xml")
    if styles is None:
        return set()
    custom = {
        int(e.get("numFmtId"))
        for e in styles.iter()
        if _local(e.tag) == "numFmt"
        and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower()))
    }
    cell_formats = next((e for e in styles if _local(e.tag) == "cellXfs"), ())
    return {
        i
        for i, xf in enumerate(cell_formats)
        if int(xf.get("numFmtId", 0)) in DATE_FORMATS | custom
    }


def _cells_by_row(content: bytes) -> Iterator[tuple[int, list[tuple[str, str | None]]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [
            "".join(t.text or "" for t in item.iter() if _local(t.tag) == "t")
            for item in (_parts(book, "xl/sharedStrings.xml") or ())
        ]
        dates = _date_styles(book)
        line = 0
        with book.open(_first_sheet(book)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if _local(element.tag) != "row":
                    continue
                line = int(element.get("r", line + 1))
                cells: list[tuple[str, str | None]] = []
                for cell in element:
                    column = _column_number(cell.get("r"), len(cells))
                    cells += [("e", None)] * (column - len(cells))
                    cells.append(_cell(cell, shared, dates))
                element.clear()
                if any(t is not None for _, t in cells):
                    yield line, cells


def _column_number(reference: str | None, following: int) -> int:
    if not reference:
        return following
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> tuple[str, str | None]:
    """Kind and text: n number, b boolean, d date, s text, e empty or error."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "s", "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((e.text for e in cell if _local(e.tag) == "v"), None)
    if value is None or kind == "e":
        return "e", None
    if kind == "s":
        return "s", shared[int(value)]
    if kind == "b":
        return "b", "true" if value == "1" else "false"
    if kind == "str":
        return "s", value
    if kind == "d":
        return "d", value
    if int(cell.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(value) * 86400))
        return "d", moment.isoformat(sep=" ")
    return "n", value[:-2] if value.endswith(".0") else value
