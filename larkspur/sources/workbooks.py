"""Workbooks (Office Open XML): a data source with a partition for each sheet, and a writer of small ones.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").load(path)                          # all sheets, with sheet_name
    spark.read.format("workbook").option("sheet", "Fees").load(path)

A sheet's first row names its columns; blank names become `column_n`, repeated ones get `_2` and so on. Cells are numbers,
booleans, texts or times (by their number format); a column of several kinds is text. Formulas give their last result, errors
null; rows without any cell are left out. Sheets are read as streams, row by row; a workbook's shared texts are held once a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType, TimestampNTZType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats of the standard that show a day or a time.
TIME_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = datetime(1899, 12, 30)
#: Rows of a batch that a task hands to Spark.
BATCH_ROWS = 4096
KINDS = {bool: BooleanType(), float: DoubleType(), str: StringType(), datetime: TimestampNTZType()}


def opened(path: str) -> zipfile.ZipFile:
    """A workbook of any store that pyarrow reads; parts are fetched as they are read."""
    store, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(store.open_input_file(at))


def files(path: str) -> list[str]:
    """A workbook, or the workbooks of a folder, by name."""
    store, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    return [head + f.path for f in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda f: f.path) if f.path.lower().endswith(".xlsx")]


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a part, one at a time; what was read is let go."""
    with book.open(part) as stream:
        parents = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == MAIN + tag:
                yield element
                element.clear()
                if parents:
                    parents[-1].remove(element)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = [(s.get("name"), targets[s.get(RELATED + "id")]) for s in root.iter(MAIN + "sheet")]
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in found]


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in _elements(book, "xl/sharedStrings.xml", "si")]


def time_styles(book: zipfile.ZipFile) -> set[str]:
    """Numbers of the cell styles that show a day or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(MAIN + "numFmt") if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
    formats = root.find(MAIN + "cellXfs")
    return {str(i) for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in TIME_FORMATS | custom}


def place_of(reference: str) -> int:
    """The column number, from 0, of a cell's reference."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


@dataclass
class Cells:
    """What the cells of a workbook mean."""

    texts: list[str]
    times: set[str]

    def value(self, cell: ElementTree.Element):
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(MAIN + "t"))
        raw = cell.findtext(MAIN + "v")
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(raw)]
        if kind == "b":
            return raw == "1"
        if kind == "d":
            return datetime.fromisoformat(raw)
        if kind == "str":
            return raw
        return EPOCH + timedelta(seconds=round(float(raw) * 86_400, 6)) if cell.get("s") in self.times else float(raw)

    def rows(self, book: zipfile.ZipFile, part: str) -> Iterator[list]:
        for row in _elements(book, part, "row"):
            cells = {}
            for n, cell in enumerate(row.iter(MAIN + "c")):
                value = self.value(cell)
                if value is not None and value != "":
                    cells[place_of(cell.get("r")) if cell.get("r") else n] = value
            if cells:
                yield [cells.get(i) for i in range(max(cells) + 1)]


def cells_of(book: zipfile.ZipFile) -> Cells:
    return Cells(shared_texts(book), time_styles(book))


def header(row: list) -> list[str]:
    names: list[str] = []
    for i, name in enumerate(row):
        base = shown(name).strip() if name is not None else ""
        base = base or f"column_{i + 1}"
        names.append(base if base not in names else next(f"{base}_{n}" for n in range(2, len(row) + 2) if f"{base}_{n}" not in names))
    return names


def shown(value) -> str | None:
    """A cell as text: whole numbers without a point, days without a time."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return value.date().isoformat() if value.time() == datetime.min.time() else value.isoformat(" ")


def fields(rows: Iterable[list]) -> dict[str, type]:
    """Kind of each column of a sheet: of its cells if they agree, else text."""
    rows = iter(rows)
    names = header(next(rows, []))
    kinds: dict[str, type | None] = dict.fromkeys(names)
    for row in rows:
        while len(names) < len(row):
            names.append(f"column_{len(names) + 1}")
            kinds[names[-1]] = None
        for name, value in zip(names, row, strict=False):
            if value is not None:
                kinds[name] = type(value) if kinds[name] in (None, type(value)) else str
    return {name: kind or str for name, kind in kinds.items()}


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    part: str


class WorkbookSource(DataSource):
    """The sheets of a workbook, or of the workbooks of a folder, united by name, with sheet_name."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def found(self) -> list[Sheet]:
        wanted = (self.options.get("sheet") or "").strip().lower()
        every = [Sheet(path, name, part) for path in files(self.options["path"]) for name, part in sheets(opened(path))]
        chosen = [s for s in every if not wanted or s.name.strip().lower() == wanted]
        if not chosen:
            raise ValueError(f"no sheet {self.options.get('sheet')!r}" if wanted else "no workbook")
        return chosen

    def schema(self) -> StructType:
        """Of each sheet its own columns and kinds, united; where sheets differ in a column's kind it is text. Give a schema to spare this reading."""
        united: dict[str, type] = {}
        for sheet in self.found():
            book = opened(sheet.path)
            for name, kind in fields(cells_of(book).rows(book, sheet.part)).items():
                united[name] = kind if united.get(name, kind) is kind else str
        return StructType([*(StructField(n, KINDS[k]) for n, k in united.items()), StructField("sheet_name", StringType())])

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], self.options["book"], self.options["sheet_column"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.found(), schema)


class SheetReader(DataSourceReader):
    def __init__(self, found: list[Sheet], schema: StructType):
        self.found, self.schema = found, schema

    def partitions(self) -> list[Sheet]:
        return self.found

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        book = opened(partition.path)
        rows = cells_of(book).rows(book, partition.part)
        names = header(next(rows, []))
        held: list[dict] = []
        for row in rows:
            names += [f"column_{i + 1}" for i in range(len(names), len(row))]
            held.append(dict(zip(names, row, strict=False)))
            if len(held) == BATCH_ROWS:
                yield self.batch(held, partition.name)
                held = []
        yield self.batch(held, partition.name)

    def batch(self, rows: list[dict], sheet: str) -> pa.RecordBatch:
        arrow = {"double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string()}
        columns = []
        for field in self.schema.fields:
            kind = field.dataType.simpleString()
            values = [sheet if field.name == "sheet_name" else r.get(field.name) for r in rows]
            columns.append(pa.array([shown(v) for v in values] if kind == "string" else values, arrow[kind]))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


def written(tables: dict[str, list[list]]) -> bytes:
    """A workbook of a few small sheets (name -> rows, the first of them names): what a report of one task's rows is published as."""
    kinds = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    start, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        pages = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(tables, 1))
        book.writestr("xl/workbook.xml", f"{start}<workbook {kinds}><sheets>{pages}</sheets></workbook>")
        related = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{start}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>')
        book.writestr("_rels/.rels", f'{start}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(tables) + 1))
        book.writestr("[Content_Types].xml", f'{start}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        for i, rows in enumerate(tables.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows)
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"{start}<worksheet {kinds}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


class WorkbookWriter(DataSourceArrowWriter):
    """A workbook a task: each task's rows belong to one book, their sheets as a column says."""

    def __init__(self, path: str, book: str, sheet: str):
        self.path, self.book, self.sheet = path, book, sheet

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, at = fs.FileSystem.from_uri(self.path) if re.match(r"\w+:", self.path) else (fs.LocalFileSystem(), self.path)
        books: dict[object, dict[str, list[list]]] = {}
        for batch in iterator:
            names = [n for n in batch.schema.names if n not in (self.book, self.sheet)]
            for row in batch.to_pylist():
                books.setdefault(row[self.book], {}).setdefault(row[self.sheet], [names]).append([row[n] for n in names])
        store.create_dir(at)
        for number, tables in books.items():
            with store.open_output_stream(f"{at}/{self.book}-{number}.xlsx") as out:
                out.write(written(dict(sorted(tables.items()))))
        return WriterCommitMessage()


def published(df: DataFrame, book: str, sheet: str, path: str) -> None:
    """Writes one workbook for each value of `book`, a sheet for each of `sheet`. A book is one task's work and is held whole; a repeated task writes the same file again."""
    df.sparkSession.dataSource.register(WorkbookSource)
    df.repartition(book).write.format("workbook").mode("append").option("book", book).option("sheet_column", sheet).save(path)
