"""Files as tables: content hashes, spreadsheet cells, text lines, question banks, and the log."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.sources import shared

#: Log levels from the least to the gravest.
LEVELS = ("debug", "info", "warning", "error")
LOG = "exam_id long, stage string, level string, message string, detail string, duration_ms long, at timestamp"
FRAGMENTS = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, italic boolean"
CELLS = "path string, sheet string, row int, col int, value string, error string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, kind, sha256, archive_name, content) of files; archive names are addressed by content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    digest, name = F.sha2("content", 256), F.element_at(F.split("path", "/"), -1)
    return files.select("path", kind_of(F.col("path"), F.col("content")).alias("kind"), digest.alias("sha256"), T.safe_file_name(digest, name).alias("archive_name"), "content")


def kind_of(path: Column, content: Column) -> Column:
    """`pdf`, `sheet`, `text` or `binary`, by what a file begins with and holds. A file that has a
    spreadsheet's name is taken for one whatever it holds, since its reader tells what is wrong."""
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    named = F.lower(path).rlike(r"\.xls[xm]$")
    zero = F.contains(content, F.lit(b"\x00"))
    return F.when(starts(b"%PDF"), "pdf").when(named | starts(b"PK\x03\x04"), "sheet").when(zero, "binary").otherwise("text")


def decoded(content: Column) -> Column:
    """A file's text: UTF-8 without its mark, or Latin-1 where the bytes are not UTF-8."""
    text = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1")), "^\ufeff", "")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not known(sha256) yet, the first path of each content."""
    first = files.groupBy("sha256").agg(F.min("path").alias("path"))
    fresh = first.join(known.select("sha256").distinct(), "sha256", "left_anti").select(F.col("path").alias("__path"))
    return files.join(fresh, F.col("path") == F.col("__path"), "left_semi")


def text_lines(rows: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """(keys, line_no, line) of a text's lines."""
    return rows.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\R")).alias("line_no", "line"))


def _elements(file: IO[bytes], name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name, one at a time: what has been read of its surroundings is dropped, so that a sheet is
    never held whole."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == f"{_MAIN}{name}":
            yield element
            if above:
                above[-1].remove(element)


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the filled cells of a workbook, sheets by name; rows and columns
    from 0. Sheets are read row by row; the table of strings is held. Bad archives raise."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in _elements(f, "si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            sheet = name.rsplit("/", 1)[1][:-4]
            with z.open(name) as f:
                for row_no, row in enumerate(_elements(f, "row")):
                    at = int(row.get("r", row_no + 1)) - 1
                    for cell in row.iter(f"{_MAIN}c"):
                        letters = re.match(r"[A-Za-z]+", cell.get("r", ""))
                        col = 0
                        for c in (letters.group() if letters else "A").upper():
                            col = col * 26 + ord(c) - 64
                        kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
                        if kind == "inlineStr":
                            value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                        elif v is None or v.text is None:
                            continue
                        else:
                            value = shared[int(v.text)] if kind == "s" else v.text
                        if value:
                            yield sheet, at, col - 1, value


def read_cells(files: DataFrame, many: int = 10_000) -> DataFrame:
    """CELLS of spreadsheet files(path, content). A file that cannot be read gives one row with the
    error and no cell.

    A task holds one file and `many` of its cells. A file is read twice, first to see that all of it can be
    read, so that no cells of a bad file are put out.
    """
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("error", pa.string())])

    def of_file(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for _ in workbook_cells(content):
                pass
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
            yield path, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for cell in workbook_cells(content):
            yield path, *cell, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cells = of_file(b.column(0)[k].as_py(), b.column(1)[k].as_py() or b"")
                while some := list(islice(cells, many)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    shared.ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, CELLS)


def flatten_spans(spans: DataFrame) -> DataFrame:
    """FRAGMENTS from a decoder's spans(doc_id, page, block, line, kind, x0, y0, x1, y1, text, size,
    flags): text blocks only, lines with text only; the longest span gives a line its style. Bit 4 of
    flags is bold, bit 1 italic."""
    rows = spans.where((F.col("kind") == 0) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    style = F.max_by(F.struct("size", "flags"), F.struct(F.length("text"), -F.col("x0"), "size", "flags")).alias("style")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), "")
    lines = rows.groupBy("doc_id", "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), words.alias("text"), style)
    bit = lambda n: F.col("style.flags").bitwiseAND(1 << n) > 0
    return lines.select("doc_id", "page", "x0", "y0", "x1", "y1", "text", F.col("style.size").alias("size"), bit(4).alias("bold"), bit(1).alias("italic"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").parquet(path)


def at_least(level: Column, least: str) -> Column:
    """Whether a log level is the given one or graver."""
    return level.isin(*LEVELS[LEVELS.index(least) :])
