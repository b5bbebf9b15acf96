"""Documents from files: text, Markdown, CSV, Word, Excel, and plug-ins for PDF and images.

A file is the unit of reading; every file is parsed by itself on an executor. Formats
without a reader here are given one as a function from bytes to text.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.text import uuid5

# OCR language codes by ISO code.
OCR_LANGUAGES = {
    "en": "eng", "th": "tha", "zh": "chi_sim", "ja": "jpn", "ko": "kor", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "ru": "rus", "ar": "ara",
}
DEFAULT_EXTENSIONS = ("txt", "md", "pdf", "docx")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
PARSED = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType()),
    T.StructField("file_size", T.LongType()), T.StructField("modified_at", T.TimestampType()),
])
Reader = Callable[[bytes], tuple[str, dict[str, str]]]


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_plain(data: bytes) -> tuple[str, dict[str, str]]:
    return data.decode("utf-8", "replace"), {}


def read_markdown(data: bytes) -> tuple[str, dict[str, str]]:
    text = data.decode("utf-8", "replace")
    m = re.search(r"^#\s+(.+)$", text, re.MULTILINE)
    return text, {"title": m.group(1).strip()} if m else {}


def rendered(header: list[str], rows: list[list[str]]) -> list[str]:
    """Table rows as lines: the column names, a blank line, then ``Row i: column: value, ...``."""
    lines = ["# " + ", ".join(header), ""]
    for i, row in enumerate(rows, 1):
        lines.append(f"Row {i}: " + ", ".join(f"{c}: {v}" for c, v in zip(header, row, strict=False)))
    return lines


def read_csv(data: bytes) -> tuple[str, dict[str, str]]:
    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "replace"))))
    if not rows:
        return "", {"row_count": "0", "column_count": "0"}
    meta = {"row_count": str(len(rows) - 1), "column_count": str(len(rows[0])), "columns": ",".join(rows[0])}
    return "\n".join(rendered(rows[0], rows[1:])), meta


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def read_word(data: bytes) -> tuple[str, dict[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    paragraphs = ["".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in body.iter() if _local(p) == "p"]
    meta = {}
    names = {"title": "title", "creator": "author", "created": "doc_created_at", "modified": "doc_modified_at"}
    for e in core.iter() if core is not None else ():
        if _local(e) in names and e.text:
            meta[names[_local(e)]] = re.sub(r"(\d)T(\d)", r"\1 \2", e.text).rstrip("Z")
    return "\n\n".join(p for p in paragraphs if p.strip()), meta


def column_of(reference: str) -> int:
    """The column of a cell reference such as ``AB12``, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(root: ElementTree.Element, shared: list[str]) -> list[list[str]]:
    """The rows of a sheet; cells stand in the columns that they name, those that are left out are empty."""
    table = []
    for row in root.iter():
        if _local(row) != "row":
            continue
        cells: list[str] = []
        for c in row:
            if _local(c) != "c":
                continue
            at = column_of(c.get("r") or "")
            cells += [""] * ((at if at >= 0 else len(cells)) - len(cells))
            if c.get("t") == "inlineStr":
                v = "".join(x.text or "" for x in c.iter() if _local(x) == "t")
            else:
                v = next((x.text or "" for x in c if _local(x) == "v"), "")
            cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
        table.append(cells)
    width = max(map(len, table), default=0)
    return [cells + [""] * (width - len(cells)) for cells in table]


def read_excel(data: bytes) -> tuple[str, dict[str, str]]:
    """All sheets of a workbook (Office Open XML) in its own order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in root if _local(si) == "si"]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        files = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                target = e.get("Target") or ""
                files[e.get("Id")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
        out, sheets = [], [e for e in book.iter() if _local(e) == "sheet"]
        for n, sheet in enumerate(sheets, 1):
            link = next((v for k, v in sheet.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)
            table = sheet_rows(ElementTree.fromstring(z.read(files.get(link, f"xl/worksheets/sheet{n}.xml"))), shared)
            out += [f"## Sheet: {sheet.get('name') or ''}", *(rendered(table[0], table[1:]) if table else []), ""]
    return "\n".join(out).rstrip(), {"sheet_count": str(len(sheets)), "sheets": ",".join(s.get("name") or "" for s in sheets)}


READERS: dict[str, Reader] = {
    "txt": read_plain, "md": read_markdown, "csv": read_csv, "docx": read_word, "xlsx": read_excel,
}


def first_long(readers: list[Reader], least: int = 100) -> Reader:
    """A reader that takes the first text longer than ``least`` characters, else the last one tried."""

    def read(data: bytes) -> tuple[str, dict[str, str]]:
        text, meta = "", {}
        for r in readers:
            try:
                text, meta = r(data)
            except Exception:
                continue
            if len(text) > least:
                break
        return text, meta

    return read


def longer_of(first: Reader, second: Reader, enough: int = 50) -> Reader:
    """Image text from the first engine; if that is short also from the second, the longer one (ties: the second)."""

    def read(data: bytes) -> tuple[str, dict[str, str]]:
        a = first(data)
        if len(a[0]) >= enough:
            return a
        b = second(data)
        return a if len(a[0]) > len(b[0]) else b

    return read


def read_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, recursive: bool = True, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Parsed files under a path with document_id, text and metadata.

    Unsupported or broken files give an empty text and their error, never a failed job.
    """
    known = READERS | (readers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    files = files.where(kind.isin(*extensions)).select("path", "content", "length", "modificationTime")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data, n, at in zip(pdf["path"], pdf["content"], pdf["length"], pdf["modificationTime"], strict=True):
                text, meta, error = "", {}, None
                try:
                    text, meta = known[extension(p)](data)
                except KeyError:
                    error = "no reader for this type"
                except Exception as e:
                    error = str(e)[:500]
                out.append((p, extension(p), text, meta.get("title"), meta.get("author"), {k: str(v) for k, v in meta.items()}, error, n, at))
            yield pd.DataFrame(out, columns=PARSED.fieldNames())

    return files.mapInPandas(parse, PARSED).select(uuid5(F.col("path")).alias("document_id"), "*")


def extract_images(spark: SparkSession, path: str, split: Callable[[bytes], list[tuple[int, int, bytes]]], read: Reader) -> DataFrame:
    """(path, page_num, image_idx, extracted_text): text of the images that ``split`` finds inside files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, i, read(img)[0]) for p, data in zip(pdf["path"], pdf["content"], strict=True) for n, i, img in split(data)]
            yield pd.DataFrame(rows, columns=["path", "page_num", "image_idx", "extracted_text"])

    return files.mapInPandas(run, "path string, page_num int, image_idx int, extracted_text string")


def csv_rows_as_text(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, line): rows of any table rendered as ``column: value, ...``; null cells as empty text."""
    columns = columns or [c for c in df.columns if c != key]
    cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.select(key, F.concat_ws(", ", *cells).alias("line"))
