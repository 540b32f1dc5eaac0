"""Office documents as a distributed file job: one row per paragraph or sheet row."""

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

OUT_ROWS, OUT_CHARS = 10_000, 4_000_000  # of a batch of results


def docx_paragraphs(content: bytes) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    parts = {_W + "t": lambda e: e.text or "", _W + "tab": lambda e: "\t", _W + "br": lambda e: "\n"}
    for paragraph in root.iter(_W + "p"):
        yield "".join(parts[e.tag](e) for e in paragraph.iter() if e.tag in parts)


def xlsx_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as text; cells left out of the file are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            shared = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in item.iter(_S + "t")) for item in shared.iter(_S + "si")]
        sheet = "xl/worksheets/sheet1.xml"
        if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
            book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
            first = next(book.iter(_S + "sheet"), None)
            targets = {r.get("Id"): r.get("Target") for r in
                       ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
            if first is not None and first.get(_R + "id") in targets:
                target = targets[first.get(_R + "id")].lstrip("/")
                sheet = target if target.startswith("xl/") else "xl/" + target
        root = ElementTree.fromstring(archive.read(sheet))
    for row in root.iter(_S + "row"):
        cells: dict[int, str] = {}
        for i, cell in enumerate(row.iter(_S + "c")):
            letters = re.match(r"[A-Z]*", cell.get("r", "")).group()
            column = sum((ord(ch) - 64) * 26 ** p for p, ch in enumerate(reversed(letters))) - 1 if letters else i
            value = cell.find(_S + "v")
            if cell.get("t") == "s" and value is not None:
                cells[column] = strings[int(value.text)]
            elif cell.get("t") == "inlineStr":
                cells[column] = "".join(t.text or "" for t in cell.iter(_S + "t"))
            else:
                cells[column] = (value.text or "") if value is not None else ""
        yield [cells.get(c, "") for c in range(max(cells, default=-1) + 1)]


def docx_lines(content: bytes) -> Iterator[str]:
    """Trimmed non-empty lines over all paragraphs."""
    for paragraph in docx_paragraphs(content):
        yield from filter(None, (line.strip() for line in paragraph.split("\n")))


EXTRACTORS: dict[str, Callable[[bytes], Iterator]] = {
    "docx": lambda content: ([line] for line in docx_lines(content)), "xlsx": xlsx_rows}


def extract_binary_docs(files: DataFrame, path: str = "path", content: str = "content",
                        extractors: dict[str, Callable[[bytes], Iterator]] | None = None) -> DataFrame:
    """(path, row, cells, text) from (path, binary content) rows; the suffix picks the extractor.

    PDF and other formats need an extractor from the caller: bytes in, lists of cells out. A file
    that cannot be read gives one row with `error` set instead of failing the job.
    """
    known = {**EXTRACTORS, **(extractors or {})}

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "row", "cells", "error"]
        for batch in batches:
            out, size = [], 0
            for name, data in zip(batch["path"], batch["content"]):
                suffix = name.rsplit(".", 1)[-1].lower()
                try:
                    if suffix not in known:
                        raise ValueError(f"no extractor for .{suffix}")
                    rows = [(name, i, list(r), None) for i, r in enumerate(known[suffix](data), 1)]
                except Exception as problem:
                    rows = [(name, 0, [], str(problem))]
                out += rows
                size += sum(len(c or "") + 8 for r in rows for c in r[2])
                if size >= OUT_CHARS or len(out) >= OUT_ROWS:  # many files make one batch, large ones do not pile up
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    found = files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(
        extract, "path string, row bigint, cells array<string>, error string")
    return found.select("path", "row", "cells", F.array_join("cells", "\t").alias("text"), "error")


def read_binary_docs(spark: SparkSession, path: str, extractors: dict | None = None) -> DataFrame:
    return extract_binary_docs(spark.read.format("binaryFile").load(path), extractors=extractors)


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A minimal DOCX file, for tests and for round trips."""
    safe = [re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", p) for p in paragraphs]
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in safe)
    xml = (f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", xml)
    return out.getvalue()


def xlsx_bytes(rows: list[list[str]]) -> bytes:
    """A minimal XLSX file with inline strings."""
    body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in r)
                   + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
