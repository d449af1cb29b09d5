"""Workbooks (zipped XML) as a Spark data source, for reading a sheet and for writing several.

Reading: a file is a partition, its rows are parsed one by one and handed on as Arrow batches, so a sheet never is in memory
as a whole.  The first row names the columns; all cells are strings, missing ones null.  Columns are those of the first
file's sheet; other files give theirs by name.

Writing: rows (book, sheet, cells) are dealt to tasks by book and stream into its file, in their order.  A sheet holds 1,048,576 rows at most, so a
task's work is bounded; longer exports take several books.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MOST_ROWS = 1_048_576
BATCH = 2000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    files, root = _folder(path)
    info = files.get_file_info(root)
    found = [info] if info.is_file else [x for x in files.get_file_info(pafs.FileSelector(root)) if x.is_file and x.base_name.endswith(".xlsx")]
    return sorted(x.path for x in found)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _named(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_rows(book: zipfile.ZipFile, sheet: str | None) -> Iterator[list[str | None]]:
    """The cells of each row of a sheet, by its name or number from 0; the first, if none is named."""
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in listed]
    wanted = sheet or "0"
    hit = next((t for n, t in sheets if n == wanted), sheets[int(wanted)][1] if wanted.isdigit() and int(wanted) < len(sheets) else None)
    if hit is None:
        raise ValueError(f"no sheet {wanted!r} among {[n for n, _ in sheets]}")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_NS}t"))
    shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    with book.open(hit.lstrip("/") if hit.startswith("/") else f"xl/{hit}") as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_NS}row":
                continue
            cells: list[str | None] = []
            for k, c in enumerate(row):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t", "n"), c.find(f"{_NS}v")
                value = text(c) if kind == "inlineStr" else None if v is None else v.text
                cells[at] = shared[int(value)] if kind == "s" and value else {"1": "true", "0": "false"}.get(value) if kind == "b" else value
            yield cells
            row.clear()


@dataclass
class Book(InputPartition):
    path: str


@dataclass
class Done(WriterCommitMessage):
    paths: list[str]


class Workbook(DataSource):
    """format("workbook"): option sheet; columns are the strings of the first row."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        files, _ = _folder(self.options["path"])
        paths = _files(self.options["path"])
        if not paths:
            raise ValueError(f"no workbook at {self.options['path']}")
        with files.open_input_file(paths[0]) as f, zipfile.ZipFile(f) as book:
            head = next(sheet_rows(book, self.options.get("sheet")), [])
        return T.StructType([T.StructField(c or f"_c{k}", T.StringType()) for k, c in enumerate(head)])

    def reader(self, schema: T.StructType) -> BookReader:
        return BookReader(self.options, schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], overwrite)


class BookReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.sheet, self.names = options["path"], options.get("sheet"), names

    def partitions(self) -> list[Book]:
        return [Book(p) for p in _files(self.path)]

    def read(self, partition: Book) -> Iterator[pa.RecordBatch]:
        files, _ = _folder(self.path)
        with files.open_input_file(partition.path) as f, zipfile.ZipFile(f) as book:
            rows = sheet_rows(book, self.sheet)
            head = [c or f"_c{k}" for k, c in enumerate(next(rows, []))]
            place = [head.index(n) if n in head else None for n in self.names]
            held: list[list] = []
            for cells in rows:
                held.append([cells[p] if p is not None and p < len(cells) else None for p in place])
                if len(held) >= BATCH:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=self.names)


class BookWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path = path
        self.old = _files(path) if overwrite and _folder(path)[0].get_file_info(_folder(path)[1]).type != pafs.FileType.NotFound else []

    def write(self, iterator: Iterable) -> Done:
        done = Done([])
        try:
            for number, rows in groupby(iterator, key=lambda r: r.book):
                done.paths.append(f"{_folder(self.path)[1]}/book-{number:05d}-{uuid.uuid4().hex}.xlsx")
                self._book(done.paths[-1], rows)
        except BaseException:
            self.abort([done])
            raise
        return done

    def _book(self, path: str, rows: Iterable) -> None:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        names = []
        with files.open_output_stream(path) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as book:
            for sheet, own in groupby(rows, key=lambda r: r.sheet):
                names.append(sheet)
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
                    for count, row in enumerate(own, 1):
                        if count > MOST_ROWS:
                            raise ValueError(f"sheet {sheet} has more than {MOST_ROWS} rows: write more books")
                        out.write(self._row(row.cells, row.numbers, count).encode())
                    out.write(b"</sheetData></worksheet>")
            self._about(book, names)

    @staticmethod
    def _row(cells: list[str | None], numbers: list[bool], n: int) -> str:
        parts = []
        for k, (v, number) in enumerate(zip(cells, numbers)):
            if v is not None:
                ref = f"{_named(k)}{n}"
                parts.append(f'<c r="{ref}"><v>{v}</v></c>' if number else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNWRITABLE.sub("", v))}</t></is></c>')
        return f'<row r="{n}">{"".join(parts)}</row>'

    @staticmethod
    def _about(book: zipfile.ZipFile, names: list[str]) -> None:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        rel = _REL[1:-1]
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')

    def commit(self, messages: list[Done | None]) -> None:
        files, _ = _folder(self.path)
        for p in self.old:
            files.delete_file(p)

    def abort(self, messages: list[Done | None]) -> None:
        files, _ = _folder(self.path)
        for p in (p for m in messages if m for p in m.paths):
            if files.get_file_info(p).is_file:
                files.delete_file(p)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook, or of all workbooks of a folder, as strings."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


def write_workbook(sheets: dict[str, DataFrame], path: str, books: int = 1) -> None:
    """Frames as sheets, each with its columns' names first and its rows in their order.

    With more books than one, each holds a share of every sheet, in order and with the names.
    """
    spark = next(iter(sheets.values())).sparkSession
    spark.dataSource.register(Workbook)
    parts = []
    for k, (name, df) in enumerate(sheets.items()):
        numeric = [isinstance(f.dataType, T.NumericType) for f in df.schema]
        text = lambda f: F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string")
        cells = F.array(*(F.when(~F.isnan(f"`{f.name}`"), text(f)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else text(f) for f in df.schema))
        rows = df.select(F.lit(k).alias("no"), F.lit(name).alias("sheet"), F.monotonically_increasing_id().alias("pos"), cells.alias("cells"), F.array(*(F.lit(n) for n in numeric)).alias("numbers"))
        head = spark.range(books).select(F.lit(k).alias("no"), F.lit(name).alias("sheet"), F.lit(-1).cast("long").alias("pos"), F.array(*(F.lit(c) for c in df.columns)).alias("cells"), F.array(*(F.lit(False) for _ in numeric)).alias("numbers"), F.col("id").cast("int").alias("book"))
        share = _share(rows, books)
        parts.append(rows.withColumn("book", F.least(share, F.lit(books - 1)).cast("int")).unionByName(head))
    rows = reduce(DataFrame.unionByName, parts)
    dealt = rows.coalesce(1) if books == 1 else rows.repartition(books, "book")
    dealt.sortWithinPartitions("book", "no", "pos").select("book", "sheet", "cells", "numbers").write.format("workbook").mode("overwrite").option("path", path).save()


def _share(rows: DataFrame, books: int):
    """Which book a row goes to, so that books follow the order of the rows and hold about as many: by the quantiles of the
    positions, which are few and bounded by the number of books."""
    if books == 1:
        return F.lit(0)
    cuts = rows.select(F.percentile_approx("pos", F.array(*(F.lit(k / books) for k in range(1, books))), 10_000)).first()[0] or []
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("pos"))) if cuts else F.lit(0)
