"""Containers that Spark has no reader for: workbooks and archives of CSV files.

Files are read as binaries by Spark's own reader, so any store will do, and unpacked
in the tasks; every cell arrives as text."""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(data: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet whose name begins with `sheet`, in either case."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    target = next(links[x.get(LINK)] for x in sheets if x.get("name").upper().startswith(sheet.upper()))
    for row in ElementTree.fromstring(book.read("xl/" + target.removeprefix("/xl/"))).iter(f"{MAIN}row"):
        cells: list[str | None] = []
        for c in row:
            column = 0
            for letter in re.match("[A-Z]+", c.get("r")).group():
                column = 26 * column + ord(letter) - 64
            cells += [None] * (column - 1 - len(cells))
            value = c.find(f"{MAIN}v")
            if c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
            else:
                text = value.text if value is not None else None
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
        yield cells


def archive_rows(data: bytes, pattern: str, encoding: str = "utf-8") -> Iterator[list[str | None]]:
    """Rows of all CSV members whose name fits, headers included once each; data that is no archive is a CSV file itself.
    Bytes that the encoding doesn't know are replaced."""
    read = lambda f: csv.reader(io.TextIOWrapper(f, encoding, errors="replace", newline=""))
    if not zipfile.is_zipfile(io.BytesIO(data)):
        yield from read(io.BytesIO(data))
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if re.search(pattern, n, re.IGNORECASE)):
            yield from read(z.open(name))


#: Record numbers of binary workbooks.
ROW, BLANK, RK, ERROR, BOOL, REAL, TEXT, SHARED, FORMULA_TEXT, FORMULA_REAL, FORMULA_BOOL, FORMULA_ERROR = range(12)
SHARED_ITEM, SHEET = 19, 156


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, body): numbers take one or two bytes, sizes up to four, of seven bits each."""
    at = 0
    while at < len(data):
        number = data[at]
        at += 1
        if number & 0x80:
            number |= data[at] << 8
            at += 1
        size = shift = 0
        while True:
            part = data[at]
            at, size, shift = at + 1, size | (part & 0x7F) << shift, shift + 7
            if not part & 0x80 or shift == 28:
                break
        yield number, data[at : at + size]
        at += size


def _wide(body: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", body, at)[0]
    if n == 0xFFFFFFFF:  # no text
        return "", at + 4
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def _small(packed: int) -> float:
    """A number of 30 bits: an integer or the upper part of a double, a hundredth of it if the first bit is set."""
    value = (packed - (1 << 32) if packed & 1 << 31 else packed) >> 2 if packed & 2 else struct.unpack("<d", struct.pack("<Q", (packed & ~3) << 32))[0]
    return value / 100 if packed & 1 else value


def _said(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


def binary_sheet_names(data: bytes) -> list[str]:
    book = zipfile.ZipFile(io.BytesIO(data))
    return [_wide(body, _wide(body, 8)[1])[0] for number, body in _records(book.read("xl/workbook.bin")) if number == SHEET]


def binary_workbook_rows(data: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet whose name begins with `sheet`, in either case, of a workbook of binary records."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.bin" in book.namelist():
        shared = [_wide(body, 1)[0] for number, body in _records(book.read("xl/sharedStrings.bin")) if number == SHARED_ITEM]
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.bin.rels"))}
    target = None
    for number, body in _records(book.read("xl/workbook.bin")):
        if number == SHEET and target is None:
            link, at = _wide(body, 8)
            if _wide(body, at)[0].upper().startswith(sheet.upper()):
                target = links[link]
    if target is None:
        raise ValueError(f"no sheet {sheet}")
    cells: list[str | None] | None = None
    last = -1
    for number, body in _records(book.read("xl/" + target.removeprefix("/xl/"))):
        if number == ROW:
            if cells is not None:
                yield cells
            row = struct.unpack_from("<I", body)[0]
            yield from ([] for _ in range(row - last - 1))  # rows that the file leaves out
            cells, last = [], row
        elif BLANK <= number <= FORMULA_ERROR and cells is not None:
            column = struct.unpack_from("<I", body)[0]
            cells += [None] * (column - len(cells))
            value = None
            if number == RK:
                value = _said(_small(struct.unpack_from("<I", body, 8)[0]))
            elif number in (REAL, FORMULA_REAL):
                value = _said(struct.unpack_from("<d", body, 8)[0])
            elif number in (TEXT, FORMULA_TEXT):
                value = _wide(body, 8)[0]
            elif number == SHARED:
                value = shared[struct.unpack_from("<I", body, 8)[0]]
            elif number in (BOOL, FORMULA_BOOL):
                value = str(bool(body[8]))
            cells.append(value)
    if cells is not None:
        yield cells


#: Rows that a task holds before it hands them on.
HELD = 20_000


def _unpacked(spark: SparkSession, path: str, rows_of, names: list[str], skip: int, rename, places: list[int] | None = None) -> DataFrame:
    """file and the named columns, by the header or, where places are told, by position (-1: the header's last column)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                header, out = None, []
                for k, cells in enumerate(rows_of(data)):
                    if k < skip:
                        continue
                    named = [rename(c or "") for c in cells]
                    if header is None or named == header:  # the header of the next member
                        header = named
                        continue
                    if places is None:
                        row = dict(zip(header, cells))
                        out.append([file, *[row.get(n) or None for n in names]])
                    else:
                        at = [p if p >= 0 else len(header) + p for p in places]
                        out.append([file, *[(cells[p] or None) if p < len(cells) else None for p in at]])
                    if len(out) >= HELD:
                        yield pd.DataFrame(out, columns=["file", *names])
                        out = []
                yield pd.DataFrame(out, columns=["file", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, ", ".join(f"`{n}` string" for n in ["file", *names]))


def binary_sheets(spark: SparkSession, path: str, pattern: str, names: list[str], rename=str.strip) -> DataFrame:
    """sheet and the named columns of all sheets of binary workbooks whose names fit, as text; sheets without one of the columns are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                for sheet in (x for x in binary_sheet_names(data) if re.search(pattern, x)):
                    rows = binary_workbook_rows(data, sheet)
                    header = [rename(c or "") for c in next(rows, [])]
                    if not set(names) <= set(header):
                        continue
                    at = [header.index(n) for n in names]
                    out = [[sheet, *[(cells[p] or None) if p < len(cells) else None for p in at]] for cells in rows]
                    yield pd.DataFrame(out, columns=["sheet", *names])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{n}` string" for n in ["sheet", *names]))


def binary_workbook(spark: SparkSession, path: str, sheet: str, columns: dict[str, int] | list[str], skip: int = 0, rename=str.strip) -> DataFrame:
    """file and columns of a sheet of binary workbooks, as text: by name, or name: position; skip: rows above the header."""
    places = list(columns.values()) if isinstance(columns, dict) else None
    return _unpacked(spark, path, lambda data: binary_workbook_rows(data, sheet), list(columns), skip, rename, places)


def workbook(spark: SparkSession, path: str, sheet: str, names: list[str], skip: int = 0, rename=str.strip) -> DataFrame:
    """file and the named columns of a sheet, as text; skip: rows above the header."""
    return _unpacked(spark, path, lambda data: workbook_rows(data, sheet), names, skip, rename)


def archive(spark: SparkSession, path: str, pattern: str, names: list[str], rename=lambda x: x.strip().lower()) -> DataFrame:
    """file and the named columns of all CSV members of archives, as text."""
    return _unpacked(spark, path, lambda data: archive_rows(data, pattern), names, 0, rename)


def number(name: str, kind: str = "double"):
    return F.expr(f"try_cast(trim(`{name}`) as {kind})").alias(name)
