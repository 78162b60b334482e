"""Spreadsheet files as numeric cells: CSV, XLSX/XLSM and XLS, read in partitions of a file or a sheet.

Every file gives cells and issues; a file that can't be read gives one issue of severity error and stops nothing else.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from echotrace.functions.rows import map_rows
from echotrace.model import CELLS
from echotrace.sources.xls import DATE_FORMATS, Workbook, shows_date

SUFFIXES = ("csv", "xlsx", "xlsm", "xls")
ROWS = f"kind string, {CELLS}, message string, severity string"


def canonical_text(value: object) -> str | None:
    """Plain decimal text without trailing zeros; any zero is 0; None for what is no finite number."""
    if isinstance(value, bool):
        return None
    try:
        d = Decimal(str(value))
    except InvalidOperation:
        return None
    if not d.is_finite():
        return None
    if d == 0:
        return "0"
    text = format(d, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def csv_number(raw: str) -> Decimal | None:
    """A number with thousands commas and one percent sign at the end allowed."""
    text = raw.strip()
    percent = text.endswith("%")
    text = text.removesuffix("%").strip().replace(",", "")
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return None
    d = Decimal(text)
    return d / 100 if percent else d


def header_of(text: str) -> str | None:
    return re.sub(r"\s+", " ", text).strip()[:160] or None


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(name: str) -> int:
    n = 0
    for ch in name.upper():
        n = 26 * n + ord(ch) - 64
    return n


def _cell(path: str, sheet: str, row: int, column: int, value: str, shown: str, hidden: bool, header: tuple | None, formula: str | None = None) -> dict:
    return {
        "kind": "cell", "source_path": path, "sheet": sheet, "row": row, "column": column, "coordinate": f"{letters(column)}{row}", "canonical_value": value, "display_value": shown,
        "hidden_sheet": hidden, "column_header": header[0] if header else None, "header_row": header[1] if header else None, "formula": formula,
    }


def _issue(path: str, message: str, severity: str = "warning") -> dict:
    return {"kind": "issue", "source_path": path, "message": message, "severity": severity}


def _encoding(file: BinaryIO) -> str:
    """UTF-8 if the whole file is, else GB18030; read in pieces."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while piece := file.read(1 << 20):
            decoder.decode(piece)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "gb18030"
    return "utf-8-sig"


def read_csv(path: str, file: BinaryIO) -> Iterator[dict]:
    """A line at a time."""
    encoding = _encoding(file)
    file.seek(0)
    head = file.read(1 << 15).decode(encoding, "ignore")[:8192]
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(head, delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    file.seek(0)
    headers: dict[int, tuple[str, int]] = {}
    for r, row in enumerate(csv.reader(io.TextIOWrapper(file, encoding, newline=""), dialect), 1):
        for c, raw in enumerate(row, 1):
            if not raw.strip():
                continue
            number = csv_number(raw)
            if number is None:
                if name := header_of(raw):
                    headers[c] = name, r
            else:
                yield _cell(path, "CSV", r, c, canonical_text(number), raw, False, headers.get(c))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode") or "" for x in root.iter(f"{_MAIN}numFmt")}
    dated = {k for k, v in own.items() if shows_date(v)} | DATE_FORMATS - set(own)
    found = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(found if found is not None else ()) if int(x.get("numFmtId") or 0) in dated}


def _xlsx_sheets(book: zipfile.ZipFile) -> list[ElementTree.Element]:
    return list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))


def read_xlsx(path: str, file: BinaryIO, only: str | None = None) -> Iterator[dict]:
    """A cell at a time; of one sheet, or of all."""
    with zipfile.ZipFile(file) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        dated = _date_styles(book)
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _xlsx_sheets(book):
            if only is not None and sheet.get("name") != only:
                continue
            target = (targets.get(sheet.get(f"{_REL}id")) or "").lstrip("/")
            name, hidden, without = sheet.get("name"), (sheet.get("state") or "visible") != "visible", 0
            member = target if target.startswith("xl/") else f"xl/{target}"
            if member not in book.namelist():
                continue
            headers: dict[int, tuple[str, int]] = {}
            row = column = 0  # rows and cells without a reference follow the one before them
            with book.open(member) as stream:
                for event, e in ElementTree.iterparse(stream, ("start", "end")):
                    if e.tag == f"{_MAIN}row":
                        if event == "start":
                            row, column = int(e.get("r") or row + 1), 0
                        else:
                            e.clear()
                        continue
                    if event == "start" or e.tag != f"{_MAIN}c":
                        continue
                    if at := re.fullmatch(r"([A-Z]+)(\d+)", e.get("r") or ""):
                        column, row = column_number(at[1]), int(at[2])
                    else:
                        column += 1
                    f, v, kind = e.find(f"{_MAIN}f"), e.findtext(f"{_MAIN}v"), e.get("t") or "n"
                    formula = None if f is None else "=" + (f.text or "")
                    if formula and not v:
                        without += 1
                        continue
                    if kind in ("s", "inlineStr", "str"):
                        text = shared[int(v)] if kind == "s" and v else "".join(t.text or "" for t in e.iter(f"{_MAIN}t")) or v or ""
                        if (h := header_of(text)) and not formula:
                            headers[column] = h, row
                    elif kind == "n" and v and int(e.get("s") or 0) not in dated and (value := canonical_text(v)) is not None:
                        yield _cell(path, name, row, column, value, v, hidden, headers.get(column), formula)
            if without:
                yield _issue(path, f"{name}: {without} formulas without a stored value were skipped")


def read_xls(path: str, file: BinaryIO, only: str | None = None) -> Iterator[dict]:
    """The cells of one sheet, or of all; a formula's stored value counts, its text isn't told."""
    book = Workbook(file.read())
    for sheet in book.sheets:
        if only is not None and sheet.name != only:
            continue
        headers: dict[int, tuple[str, int]] = {}
        for row, column, value in book.cells(sheet):
            if isinstance(value, str):
                if name := header_of(value):
                    headers[column] = name, row
            elif (text := canonical_text(value)) is not None:
                yield _cell(path, sheet.name, row, column, text, str(value), sheet.hidden, headers.get(column))


def sheet_names(path: str, file: BinaryIO) -> list[str | None]:
    """The sheets by which a file can be read in parts; [None] where it is read as a whole."""
    if _suffix(path) in ("xlsx", "xlsm"):
        with zipfile.ZipFile(file) as book:
            return [x.get("name") for x in _xlsx_sheets(book)] or [None]
    if _suffix(path) == "xls":
        return [x.name for x in Workbook(file.read()).sheets] or [None]
    return [None]


def _suffix(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def read_file(path: str, file: BinaryIO, only: str | None = None) -> Iterator[dict]:
    """The rows of a file or of one of its sheets, as they are read; what can't be read ends them with an error, and rows before it stay."""
    try:
        if _suffix(path) == "csv":
            yield from read_csv(path, file)
        elif _suffix(path) in ("xlsx", "xlsm"):
            yield from read_xlsx(path, file, only)
        elif _suffix(path) == "xls":
            yield from read_xls(path, file, only)
        else:
            raise ValueError(f"no reader for .{_suffix(path)}")
    except Exception as e:  # noqa: BLE001  a file of any kind becomes an issue
        yield _issue(path, f"{type(e).__name__}: {e}", "error")


def read_bytes(path: str, body: bytes) -> list[dict]:
    return list(read_file(path, io.BytesIO(body)))


# --- the data source -----------------------------------------------------------------------------------------------------

#: Bytes of files that a partition reads, about; workbooks over SHEET_BYTES are read sheet by sheet.
PARTITION_BYTES, SHEET_BYTES, OUT_ROWS = 32 << 20, 4 << 20, 5_000
FORMAT = "spreadsheets"


@dataclass
class _Part(InputPartition):
    pieces: list[tuple[str, str | None]]  #: path, and a sheet or all of them


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, its path there, and what makes one of its paths whole again."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path), "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


class SpreadsheetReader(DataSourceReader):
    """Partitions of small files together, large workbooks by sheet; filters on source_path and sheet leave files and sheets unread."""

    def __init__(self, schema: StructType, paths: list[str]) -> None:
        self.schema, self.paths = schema, paths
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("source_path",), ("sheet",)):
                self.tests.append(f)
            if not (isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("source_path",)):
                yield f  # rows are told by path alone; a whole file's sheets are left to Spark

    def _wanted(self, column: str, value: str) -> bool:
        for f in self.tests:
            if f.attribute == (column,) and not (value.startswith(f.value) if isinstance(f, StringStartsWith) else value in (f.value if isinstance(f, In) else (f.value,))):
                return False
        return True

    def _files(self) -> list[tuple[str, int]]:
        found: dict[str, int] = {}
        for path in self.paths:
            system, inner, head = _system(path)
            info = system.get_file_info(inner)
            some = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
            found |= {head + x.path: x.size for x in some if x.type == fs.FileType.File and _suffix(x.path) in SUFFIXES}
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
        return sorted((p, n) for p, n in found.items() if self._wanted("source_path", p))

    def partitions(self) -> list[_Part]:
        out, held, size = [], [], 0
        for path, n in self._files():
            if n > SHEET_BYTES and _suffix(path) != "csv":
                try:
                    with _opened(path) as file:
                        names = sheet_names(path, file)
                except Exception:  # noqa: BLE001  its reading will tell
                    names = [None]
                out += [_Part([(path, s)]) for s in names if s is None or self._wanted("sheet", s)]
                continue
            if held and size + n > PARTITION_BYTES:
                out.append(_Part(held))
                held, size = [], 0
            held.append((path, None))
            size += n
        return [*out, _Part(held)] if held or not out else out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        arrow, rows = to_arrow_schema(self.schema), []
        for path, sheet in partition.pieces:
            with _opened(path) as file:
                for row in read_file(path, file, sheet):
                    rows.append({n: row.get(n) for n in arrow.names})
                    if len(rows) >= OUT_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def _opened(path: str) -> BinaryIO:
    system, inner, _ = _system(path)
    return system.open_input_file(inner)


class Spreadsheets(DataSource):
    """spark.read.format("spreadsheets").load(folder or file); more paths as the option `paths`, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> SpreadsheetReader:
        return SpreadsheetReader(schema, json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Spreadsheets)


def _reachable(path: str) -> bool:
    try:
        system, inner, _ = _system(path)
        return not re.search(r"[*?\[{]", inner) and system.get_file_info(inner).type != fs.FileType.NotFound
    except Exception:  # noqa: BLE001  a store that Spark alone reads
        return False


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """ROWS of all spreadsheet files under the paths, each file once; cells() and issues() part them.

    Files are read by the data source; patterns, and stores that only Spark can read, by Spark's binaryFile source, a file a row.
    """
    if all(map(_reachable, paths)):
        register(spark)
        return spark.read.format(FORMAT).option("paths", json.dumps(paths)).load()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*SUFFIXES)).dropDuplicates(["path"]).select("path", "content")
    return map_rows(files, ROWS, lambda r: read_file(r["path"], io.BytesIO(r["content"])))


def cells(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'cell'").drop("kind", "message", "severity")


def issues(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'issue'").select("source_path", "message", "severity")


def preview(all_cells: DataFrame, source_path: str, sheet: str, coordinate: str, padding_rows: int = 1, padding_columns: int = 2, most_rows: int = 12, most_columns: int = 10) -> DataFrame:
    """row, column, display_value around a place: an A1 cell or range, or `row N`."""
    at = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", coordinate.strip())
    if at:
        left, top = column_number(at[1]), int(at[2])
        right, bottom = (column_number(at[3]), int(at[4])) if at[3] else (left, top)
    elif row := re.search(r"(\d+)", coordinate):
        left, right, top, bottom = 1, most_columns, int(row[1]), int(row[1])
    else:
        raise ValueError(f"no place: {coordinate}")
    top, left = max(1, min(top, bottom) - padding_rows), max(1, min(left, right) - padding_columns)
    bottom, right = min(max(top, bottom) + padding_rows, top + most_rows - 1), min(max(left, right) + padding_columns, left + most_columns - 1)
    here = (F.col("source_path") == source_path) & (F.col("sheet") == sheet) & F.col("row").between(top, bottom) & F.col("column").between(left, right)
    return all_cells.where(here).select("row", "column", "display_value").orderBy("row", "column")
