"""Spreadsheet files (.xlsx) as a cell table, with merged ranges and hidden rows and columns.

Spark lists and reads the files, on any store it knows; each file is unpacked inside one
task with the standard library.  A file that is no workbook gives no row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, sheet string, kind string, row int, col int, max_row int, max_col int, value string, type string"


def place(reference: str) -> tuple[int, int]:
    """Row and column, from 1, of a reference such as ``AB12``."""
    letters, digits = re.match(r"([A-Z]+)(\d+)", reference.replace("$", "")).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def tree(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """A part of the archive without name spaces, or None where it is missing."""
    if name not in archive.namelist():
        return None
    root = ElementTree.fromstring(archive.read(name))
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
        node.attrib = {k.rpartition("}")[2]: v for k, v in node.attrib.items()}
    return root


def shown(cell: ElementTree.Element, strings: list[str]) -> str | None:
    """The stored value of a cell as text."""
    kind, value = cell.get("t"), cell.findtext("v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter("t"))
    if value is not None and kind == "s":
        return strings[int(value)]
    return {"1": "true", "0": "false"}[value] if value is not None and kind == "b" else value


#: how a cell's type is stored, and what it is called here; none is a number
TYPES = {"s": "text", "inlineStr": "text", "str": "text", "e": "text", "b": "bool", "d": "date", "n": "number", None: "number"}


def rows_of(content: bytes) -> Iterator[tuple]:
    """(sheet, kind, row, col, max_row, max_col, value, type) of every sheet; kinds: cell, merge, hidden_row, hidden_col."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = tree(archive, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter("t")) for si in shared.iter("si")] if shared is not None else []
        targets = {r.get("Id"): r.get("Target") for r in tree(archive, "xl/_rels/workbook.xml.rels").iter("Relationship")}
        for sheet in tree(archive, "xl/workbook.xml").iter("sheet"):
            target, name = targets[sheet.get("id")], sheet.get("name")
            root = tree(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            if root is None:
                continue
            for row in root.iter("row"):
                if row.get("hidden") in ("1", "true") or float(row.get("ht", 1)) <= 0:
                    yield name, "hidden_row", int(row.get("r")), None, None, None, None, None
                for cell in row.iter("c"):
                    yield name, "cell", *place(cell.get("r")), None, None, shown(cell, strings), TYPES.get(cell.get("t"), "text")
            for merge in root.iter("mergeCell"):
                first, _, last = merge.get("ref").partition(":")
                yield name, "merge", *place(first), *place(last or first), None, None
            for col in root.iter("col"):
                if col.get("hidden") in ("1", "true") or float(col.get("width", 1)) <= 0:
                    yield name, "hidden_col", None, int(col.get("min")), None, int(col.get("max")), None, None


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the .xlsx files below ``path``; ``cells``, ``merges`` and the others pick from it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    frame = pd.DataFrame([(file, *r) for r in rows_of(content)], columns=names)
                    yield frame.astype({c: "Int32" for c in ("row", "col", "max_row", "max_col")})

    return files.mapInPandas(unpack, SCHEMA)


def sheet_key() -> list:
    return [F.concat_ws("#", "path", "sheet").alias("sheet")]


def cells(book: DataFrame) -> DataFrame:
    """(sheet, row, col, value); the sheet's name has its file before it."""
    return book.filter("kind = 'cell'").select(*sheet_key(), "row", "col", "value")


def typed_cells(book: DataFrame) -> DataFrame:
    """(sheet, row, col, value, type): type is number, text, bool or date, as it is stored."""
    return book.filter("kind = 'cell'").select(*sheet_key(), "row", "col", "value", "type")


def merges(book: DataFrame) -> DataFrame:
    return book.filter("kind = 'merge'").select(*sheet_key(), F.col("row").alias("min_row"), "max_row", F.col("col").alias("min_col"), "max_col")


def hidden_rows(book: DataFrame) -> DataFrame:
    return book.filter("kind = 'hidden_row'").select(*sheet_key(), "row")


def hidden_cols(book: DataFrame) -> DataFrame:
    return book.filter("kind = 'hidden_col'").select(*sheet_key(), F.explode(F.sequence("col", "max_col")).alias("col"))
