"""Workbooks (.xlsx) as a Spark data source: a row per row of every sheet."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a part that are parsed before its finished rows are handed on, and rows of an Arrow batch.
CHUNK, BATCH = 1 << 18, 4_096
_SCHEMA = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])


class _Events:
    """Elements of one part as they end, by local name: on_end(name, attributes, text below it). Parts that declare a
    document type, wherever it stands, are refused, and with it all entities."""

    def __init__(self, on_end: Callable[[str, dict, str], None]):
        self.on_end, self.open = on_end, []
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartDoctypeDeclHandler = self._refuse
        self.parser.StartElementHandler = lambda name, attributes: self.open.append((name.rpartition("}")[2], {k.rpartition("}")[2]: v for k, v in attributes.items()}, []))
        self.parser.EndElementHandler = self._end
        self.parser.CharacterDataHandler = lambda data: self.open[-1][2].append(data)

    def _refuse(self, *_) -> None:
        raise ValueError("a document type in a workbook is refused")

    def _end(self, _) -> None:
        name, attributes, parts = self.open.pop()
        self.on_end(name, attributes, "".join(parts))

    def read(self, source: io.BufferedIOBase) -> Iterator[None]:
        while chunk := source.read(CHUNK):
            self.parser.Parse(chunk, False)
            yield
        self.parser.Parse(b"", True)
        yield


def _whole(book: zipfile.ZipFile, part: str, on_end: Callable[[str, dict, str], None]) -> None:
    if part in book.NameToInfo:
        with book.open(part) as source:
            for _ in _Events(on_end).read(source):
                pass


def _shared(book: zipfile.ZipFile) -> list[str]:
    """The strings that cells share; a string may be in several runs, and its phonetic runs are not part of it."""
    found, runs = [], []

    def end(name: str, _: dict, text: str) -> None:
        if name == "t":
            runs.append(text)
        elif name == "rPh":
            runs.pop()
        elif name == "si":
            found.append("".join(runs))
            runs.clear()

    _whole(book, "xl/sharedStrings.xml", end)
    return found


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, part) in the workbook's order, through its relationships; without any, by position."""
    targets, sheets = {}, []

    def relation(name: str, attributes: dict, _: str) -> None:
        if name == "Relationship":
            targets[attributes["Id"]] = posixpath.normpath(posixpath.join("/xl", attributes["Target"])).lstrip("/")

    def sheet(name: str, attributes: dict, _: str) -> None:
        if name == "sheet":
            sheets.append((attributes["name"], targets.get(attributes.get("id"), f"xl/worksheets/sheet{len(sheets) + 1}.xml")))

    _whole(book, "xl/_rels/workbook.xml.rels", relation)
    _whole(book, "xl/workbook.xml", sheet)
    return sheets


def _column(reference: str) -> int:
    """The number from 0 of a cell's column."""
    letters = reference.rstrip("0123456789")
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells as text), row by row, so that no sheet is held whole."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        for title, part in _sheets(book):
            if part not in book.NameToInfo:
                continue
            done: list[tuple[int, dict[int, str | None]]] = []
            row: dict[int, str | None] = {}
            held: dict[str, str] = {}

            def end(name: str, attributes: dict, text: str) -> None:
                if name in ("v", "t"):
                    held[name] = held.get(name, "") + text  # noqa: B023  emptied with every cell
                elif name == "c":
                    at = _column(attributes["r"]) if "r" in attributes else max(row, default=-1) + 1  # noqa: B023
                    kind, value = attributes.get("t"), held.get("v")  # noqa: B023
                    row[at] = held.get("t", "") if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value  # noqa: B023
                    held.clear()  # noqa: B023
                elif name == "row":
                    done.append((int(attributes.get("r", 0)), dict(row)))  # noqa: B023
                    row.clear()  # noqa: B023

            last = 0
            with book.open(part) as source:
                for _ in _Events(end).read(source):
                    for number, cells in done:
                        last = number or last + 1
                        yield title, last, [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                    done.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row and cells of all workbooks below a path; each file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part: list[tuple] = []
                for found in workbook_rows(content):
                    part.append((file, *found))
                    if len(part) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path, pathGlobFilter="*.xlsx").select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>")
