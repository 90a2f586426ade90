from __future__ import annotations

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafline.operators.cell_rules import cell_is
from leafline.sources import files, html_reader, sinks
from leafline.streaming.meter import joined_parts, last_state, received_files


def archive(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return data.getvalue()


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


WORKBOOK = archive(
    {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(r1="worksheets/sheet1.xml"),
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><r><t>A</t></r><r><t>B</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c><c r="C3"><v>1.5</v></c><c r="C4"><f>1+1</f></c><c r="D4" t="inlineStr"><is><t>x</t></is></c><c r="D5" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
    }
)
BOOK = archive(
    {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>',
        "o/b.opf": '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b%20b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.png" media-type="image/png"/></manifest><spine><itemref idref="b"/><itemref idref="a" linear="no"/><itemref idref="c"/></spine></package>',
        "o/a.xhtml": "<p>aside</p>",
        "o/b b.xhtml": "<html><head><title>t</title></head><body><h1>One</h1><p>Two &amp; three</p></body></html>",
    }
)
SLIDES = archive(
    {
        "ppt/presentation.xml": '<p xmlns:r="http://x/r"><sldIdLst><sldId id="1" r:id="r2"/><sldId id="2" r:id="r1"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": rels(r1="slides/s1.xml", r2="slides/s2.xml"),
        "ppt/slides/s1.xml": '<sld show="0"><p><r><t>last</t></r></p></sld>',
        "ppt/slides/s2.xml": "<sld><p><r><t>fir</t></r><r><t>st</t></r></p><p><r><t>line</t></r></p></sld>",
    }
)
WORD = archive({"word/document.xml": '<d xmlns:w="w"><body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></body></d>'})


def test_readers_scan_folders(spark, tmp_path):
    for name, content in {"w.xlsx": WORKBOOK, "b.epub": BOOK, "s.pptx": SLIDES, "d.docx": WORD, "bad.xlsx": b"no archive", "t.csv": "﻿a;b\r\n\"x;\"\"y\"\"\nz\";2\r\n;\r\n1;2;3\r\n".encode()}.items():
        (tmp_path / name).write_bytes(content)
    cells = files.read_xlsx(spark, f"{tmp_path}/*.xlsx").toPandas()
    good = cells[cells.error.isna()]
    assert sorted(zip(good.r, good.c, good.t, good.value, strict=True)) == [(0, 0, "s", "Name"), (1, 27, "s", "AB"), (2, 2, "n", "1.5"), (3, 3, "s", "x"), (4, 3, "e", "#N/A")]
    assert cells.error.notna().sum() == 1
    assert [r["text"] for r in files.read_epub(spark, f"{tmp_path}/*.epub").collect()] == ["One\nTwo & three"]
    assert [(r["text"], r["style"]) for r in files.read_pptx(spark, f"{tmp_path}/*.pptx").orderBy("n").collect()] == [("first\nline", None), ("last", "hidden")]
    assert [(r["text"], r["style"]) for r in files.read_docx(spark, f"{tmp_path}/*.docx").orderBy("n").collect()] == [("Title", "Heading1"), ("a\tb", None)]
    csv = files.read_csv(spark, f"{tmp_path}/*.csv").orderBy("r", "c").collect()
    assert [(r["r"], r["c"], r["value"]) for r in csv] == [(0, 0, "a"), (0, 1, "b"), (1, 0, 'x;"y"\nz'), (1, 1, "2"), (2, 0, "1"), (2, 1, "2"), (2, 2, "3")]


def test_header_binding():
    wanted = {"invoice": ["invoice", "inv"], "taxable": ["taxable", "value"]}
    assert files.bind_columns(["Inv. No", "Taxable Value"], wanted) == {"invoice": "Inv. No", "taxable": "Taxable Value"}
    with pytest.raises(ValueError):
        files.bind_columns(["a"], wanted, ["taxable"])


def test_sniffed_types(spark):
    df = spark.createDataFrame([(bytearray(b"\x89PNG1234"),), (bytearray(b"RIFF0000WEBP"),), (bytearray(b"xx"),)], "b binary")
    assert [r[0] for r in df.select(files.sniffed_type(F.col("b"))).collect()] == ["image/png", "image/webp", None]


def test_html_spans():
    page = "<table><tr><th rowspan=5>a</th><td colspan=2>b</td></tr><tr><td>c<p>d</td><td>e</table>"
    assert html_reader.grid(html_reader.parsed(page).tables[0]) == [(0, 0, True, 2, 1, "a"), (0, 1, False, 1, 2, "b"), (1, 1, False, 1, 1, "c\nd"), (1, 2, False, 1, 1, "e")]
    assert html_reader.plain_text("<script>x</script><p>a<br>b<p>c &lt;") == "a b\nc <"


def test_archives(spark):
    df = spark.createDataFrame([(1, "a.txt", bytearray(b"a")), (1, "b.txt", bytearray(b"b")), (2, "c.txt", bytearray(b"c"))], "job int, filename string, bytes binary")
    got = {(r["job"], r["filename"]): bytes(r["bytes"]) for r in sinks.zipped(df, "job").collect()}
    assert sorted(got) == [(1, "a.txt"), (1, "b.txt"), (1, "files.zip"), (2, "c.txt")]
    assert zipfile.ZipFile(io.BytesIO(got[1, "files.zip"])).read("b.txt") == b"b"


def test_log_and_parts(spark):
    ops = spark.createDataFrame([("a", 1, "put", 1), ("a", 2, "put", 5), ("b", 1, "put", 2), ("b", 3, "remove", None)], "k string, seq int, op string, v int")
    assert [tuple(r) for r in last_state(ops, ["k"], ["seq"], "op", "v").collect()] == [("a", 5)]
    parts = spark.createDataFrame([(1, 1, 2, "b"), (1, 0, 2, "a"), (1, 1, 2, "b"), (2, 0, 2, "x")], "id int, i int, n int, data string")
    assert [tuple(r) for r in joined_parts(parts, "id", "i", "n", "data").collect()] == [(1, "ab")]


def test_received_files_stream(spark, tmp_path):
    rows = [("f", "file", 5, 0), ("f", "chunk", 0, 3), ("g", "file", 4, 0), ("g", "chunk", 0, 3), ("f", "chunk", 0, 2), ("f", "end", 0, 0), ("g", "end", 0, 0), ("h", "chunk", 0, 1)]
    pd.DataFrame(rows, columns=["file", "kind", "announced", "size"]).to_parquet(tmp_path / "p.parquet")
    schema = "file string, kind string, announced long, size long"
    query = received_files(spark.readStream.schema(schema).parquet(str(tmp_path))).writeStream.format("memory").queryName("received").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "progress")).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("received").collect()] == [("f", 5)]


def test_cell_is_needs_an_operator():
    with pytest.raises(ValueError):
        cell_is(None, "like", None)
