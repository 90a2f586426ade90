"""Readers of files: separated text, workbooks, word-processor files, slides and e-books.

Each file is a row of Spark's binaryFile source and is parsed in one task by the standard library; the
result is rows (cells, paragraphs, slides, chapters). A file that can't be read gives a row with its error.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ",;\t|"
CELLS = "path string, sheet string, r int, c int, t string, value string, error string"
PARAGRAPHS = "path string, n int, style string, text string, error string"


def scan(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """parse: of a file's bytes, to rows without path and error."""
    width = len(schema.split(",")) - 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(",")]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(name, *row, None) for row in parse(bytes(content))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(name, *[None] * width, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def sniffed(line: str) -> str:
    """The delimiter that cuts the first line into most fields, the comma if none does."""
    return max(DELIMITERS, key=lambda d: len(next(csv.reader([line], delimiter=d), [])))


def csv_rows(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Quoted fields may hold delimiters, line feeds and doubled quotes; rows of blanks are dropped, ragged rows stay."""
    text = text.removeprefix("﻿")
    delimiter = delimiter or sniffed(text.split("\n", 1)[0].rstrip("\r"))
    return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(x.strip() for x in row)]


def csv_cells(content: bytes) -> Iterator[tuple]:
    for r, row in enumerate(csv_rows(content.decode("utf-8", "replace"))):
        for c, value in enumerate(row):
            yield "csv", r, c, "str", value


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, csv_cells, CELLS)


def bind_columns(names: list[str], wanted: dict[str, list[str]], required: list[str] = ()) -> dict[str, str]:
    """For each wanted field the first header that contains one of its keys, letters only and without case."""
    bare = {n: re.sub("[^a-z]", "", n.lower()) for n in names}
    out = {}
    for field, keys in wanted.items():
        found = next((n for n in names if any(k in bare[n] for k in keys)), None)
        if found:
            out[field] = found
        elif field in required:
            raise ValueError(f"no column for {field}")
    return out


def tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def relations(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    folder, _, base = name.rpartition("/")
    at = f"{folder}/_rels/{base}.rels".lstrip("/")
    if at not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in xml(z, at)}


def column_of(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    """Cells with a value: n numbers, s texts, b booleans, e errors. Formulas give what was saved with them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in xml(z, "xl/sharedStrings.xml")]
        targets = relations(z, "xl/workbook.xml")
        for sheet in (e for e in xml(z, "xl/workbook.xml").iter() if tag(e) == "sheet"):
            for c in (e for e in xml(z, targets[attribute(sheet, "id")]).iter() if tag(e) == "c"):
                kind, value = c.get("t", "n"), next((v.text for v in c if tag(v) == "v"), None)
                if kind == "inlineStr":
                    kind, value = "s", "".join(t.text or "" for t in c.iter() if tag(t) == "t")
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                if value is None:
                    continue
                ref = c.get("r")
                yield sheet.get("name"), int(re.search("[0-9]+", ref)[0]) - 1, column_of(ref), "s" if kind == "str" else kind, value


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, xlsx_cells, CELLS)


def docx_paragraphs(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for n, p in enumerate(e for e in xml(z, "word/document.xml").iter() if tag(e) == "p"):
            style = next((attribute(s, "val") for s in p.iter() if tag(s) == "pStyle"), None)
            parts = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n"}
            yield n, style, "".join(parts[tag(e)](e) for e in p.iter() if tag(e) in parts)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, docx_paragraphs, PARAGRAPHS)


def pptx_slides(content: bytes) -> Iterator[tuple]:
    """Slides in the order of the presentation; the style of a hidden one is hidden."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = relations(z, "ppt/presentation.xml")
        for n, s in enumerate(e for e in xml(z, "ppt/presentation.xml").iter() if tag(e) == "sldId"):
            slide = xml(z, targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))])
            lines = ["".join(t.text or "" for t in p.iter() if tag(t) == "t") for p in slide.iter() if tag(p) == "p"]
            yield n, "hidden" if slide.get("show") == "0" else None, "\n".join(x for x in lines if x)


def read_pptx(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, pptx_slides, PARAGRAPHS)


def epub_chapters(content: bytes) -> Iterator[tuple]:
    """Chapters in reading order, by the manifest; what isn't linear or isn't a page is left out, protected books are refused."""
    from leafline.sources.html_reader import plain_text

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names and any(tag(e) == "EncryptedData" and "font" not in ElementTree.tostring(e, "unicode").lower() for e in xml(z, "META-INF/encryption.xml").iter()):
            raise ValueError("the book is protected")
        book = next(e.get("full-path") for e in xml(z, "META-INF/container.xml").iter() if tag(e) == "rootfile")
        root, folder = xml(z, book), posixpath.dirname(book)
        items = {e.get("id"): (e.get("href"), e.get("media-type", "")) for e in root.iter() if tag(e) == "item"}
        n = 0
        for ref in (e for e in root.iter() if tag(e) == "itemref" and e.get("linear") != "no"):
            href, kind = items.get(ref.get("idref"), ("", ""))
            at = posixpath.normpath(posixpath.join(folder, unquote(href)))
            if "html" in kind and at in names:
                yield n, None, plain_text(z.read(at).decode("utf-8", "replace"))
                n += 1


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, epub_chapters, PARAGRAPHS)


def sniffed_type(content: Column) -> Column:
    """The type of a picture by its first bytes."""
    starts = (("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("474946", "image/gif"), ("424D", "image/bmp"))
    out = F.when((F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "image/webp")
    for head, kind in starts:
        out = out.when(F.hex(F.substring(content, 1, len(head) // 2)) == head, kind)
    return out
