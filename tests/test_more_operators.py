"""Operators whose results depend on what came before, against plain loops; formats and names against known values."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from leafline.functions import formats, references
from leafline.operators import answers, plans_of_pages, positions
from leafline.plans import steps

TEXT = """ANNUAL REPORT
Revenue grew by 12 percent in the year. Costs fell for the second time. The board
expects more of the same in the coming year.

• First point of the list, which is long enough
2) Second point of the list, which is long enough
Outlook for the years ahead
We will hire many people. Short. 12345678901234567890123."""


def test_sentences(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "x" * 700), (5, "no stop at the end of this\nline that goes on")], "k long, t string")
    got = {r["k"]: r["s"] for r in df.select("k", answers.sentences(F.col("t")).alias("s")).collect()}
    assert got[1] == [
        "Revenue grew by 12 percent in the year.", "Costs fell for the second time.", "The board expects more of the same in the coming year.",
        "First point of the list, which is long enough", "Second point of the list, which is long enough Outlook for the years ahead", "We will hire many people.",
    ]
    assert got[2] == got[3] == got[4] == [] and got[5] == ["no stop at the end of this line that goes on"]


def packed(sents, target=90):
    out, now, n = [], [], 0
    for s in sents:
        size = len(re.split(r"\s+", s))
        if n + size > target and n > 0.4 * target:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += size
    return [*out, " ".join(now)] if now else out


def test_passages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = {r["doc_id"]: r["s"] for r in docs.select("doc_id", answers.sentences(F.col("text")).alias("s")).collect()}
    got = {}
    for r in answers.passages(docs, ["doc_id"], "text").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["passage"])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for k, s in own.items():
        assert got.get(k, []) == packed(s or [b for b in re.split("\n{2,}", texts[k]) if b.strip(" ")]), k


def test_answers(spark):
    pages = spark.createDataFrame([(1, TEXT), (2, "The cat sat on a very old mat. Dogs and horses run over the wide green field. Nobody counted the 42 horses there.")], "page long, t string")
    asked = spark.createDataFrame([(1, "How many horses run over the field?"), (2, "the of and"), (3, "What does the board expect in the coming year?"), (4, "zebra")], "q long, t string")
    got = {r["q"]: r for r in answers.answers(pages, ["page"], "t", asked, "q", "t").collect()}
    assert set(got) == {1, 3}
    # the second sentence shares three terms of five, the third one of three and has a number
    assert got[1]["answer"] == "Dogs and horses run over the wide green field." and got[1]["page"] == 2
    assert got[3]["answer"].startswith("The board expects") and got[3]["page"] == 1 and got[3]["confident"]


def test_heading_terms_count_more(spark):
    body = "\n".join(f"Sentence about {w} and nothing else at all here." for w in ("apples", "pears", "plums", "grapes", "melons", "cherries", "berries", "quinces"))
    df = spark.createDataFrame([(1, body, ["Plums"]), (2, None, None)], "k long, t string, h array<string>")
    plain = {r["line"] for r in answers.summary(df, "k", "t").collect()}
    boosted = {r["line"] for r in answers.summary(df, "k", "t", "h").collect()}
    assert len(boosted) <= 4 and any("plums" in x for x in boosted) and not any("plums" in x for x in plain) and plain <= {*body.split("\n")}


FORMATS = [
    (1234567.891, "#,##0.00", "1,234,567.89"), (-5.5, "0.0", "-5.5"), (0.256, "0%", "26%"), (0.256, "0.0%", "25.6%"), (1234567, "#,##0,", "1,235"), (1234567, "0.0,,\"M\"", "1.2M"),
    (12345678, "[>=10000000]##\\,##\\,##\\,##0;[>=100000]##\\,##\\,##0;##,##0", "1,23,45,678"), (-1234.5, "#,##0.00;(#,##0.00)", "(1,234.50)"), (0, "0;-0;\"nil\"", "nil"), (5, "000", "005"), (3.10, "0.##", "3.1"), (3, "0.##", "3."),
    (2.5, "?.??", "2.5 "), (7, "\"No. \"0", "No. 7"), (1234567, "##,##,##0", "12,34,567"), (9876543210, "(000) 000-0000", "(987) 654-3210"), (12345678.0, "#,##,##0", "1,23,45,678"), (42, "General", "42"), (1e-7, "General", "0.0000001"), (123456789012345, "General", "1.23457E+14"), (1 / 3, "General", "0.333333333"),
    (12345.678, "0.00E+00", "1.23E+04"), (0.00012, "0.0E+0", "1.2E-4"), (2.25, "# ?/?", "2 1/4"), (0.5, "?/?", "1/2"), (45292, "yyyy-mm-dd", "2024-01-01"), (45292.75, "d mmm yy h:mm AM/PM", "1 Jan 24 6:00 PM"), (45292, "dddd", "Monday"), (1.5, "[h]:mm", "36:00"),
    (0.000011574, "h:mm:ss", "0:00:01"), (60, "d/m/yyyy", "29/2/1900"), (-3, "yyyy", "########"), (5, ";;;", ""), (5, "[Red]0.0", "5.0"), (1234.5, "[$₹-4009] #,##0.00", "₹ 1,234.50"), (8, "", "8"), (None, "0", ""), ("text", "0;0;0;\"<\"@\">\"", "<text>"), (True, "0", "TRUE"),
]


@pytest.mark.parametrize(("value", "code", "want"), FORMATS)
def test_formats(value, code, want):
    assert formats.format_value(value, code) == want


def test_formats_of_a_table(spark):
    df = spark.createDataFrame([(1234.5, "#,##0.0"), (None, "0"), (45292.0, "yyyy"), (-2.0, None)], "v double, code string")
    assert [r["t"] for r in df.select(formats.formatted("v", "code").alias("t")).collect()] == ["1,234.5", None, "2024", "-2"]
    assert formats.is_date_format("d/m/yy") and formats.is_date_format("[h]:mm") and not formats.is_date_format('0.0 "days"') and not formats.is_date_format("General") and not formats.is_date_format("0.0E+0")
    assert formats.sections('0;"a;b";[$;]0;@') == ("0", '"a;b"', "[$;]0", "@")


def test_lines_by_a_plain_loop(spark):
    rows = [(1, 1, 10.0, 0.0, 20.0, 10.0, 9.0, 10.0, "Hello"), (1, 2, 35.0, 0.5, 20.0, 10.0, 9.5, 10.0, "world"), (1, 3, 55.5, 0.0, 3.0, 10.0, 9.0, 10.0, "!"), (1, 4, 10.0, 30.0, 30.0, 10.0, 39.0, 10.0, "Next"), (1, 5, 60.0, 2.0, 8.0, 4.0, 6.5, 4.0, "1"), (2, 6, 0.0, 0.0, 5.0, 10.0, 9.0, 10.0, "  ")]
    items = spark.createDataFrame(rows, "page long, i long, x double, y double, w double, h double, base double, size double, text string")
    lines = positions.lines_of(items, ["page"])
    assert [(r["line"], r["text"], r["x"], r["w"]) for r in lines.orderBy("line").collect()] == [(0, "Hello world!", 10.0, 48.5), (1, "1", 60.0, 8.0), (2, "Next", 10.0, 30.0)]
    assert positions.page_text(lines, ["page"]).first()["text"] == "Hello world!\n1\n\nNext"
    grid = {r["page"]: r["text"] for r in positions.layout_text(items, ["page"]).collect()}
    assert grid[1].split("\n")[0] == "  Hello world !"


def tiers(sizes):
    out, first, tier = {}, None, 0
    for s in sorted(set(sizes), reverse=True):
        if first is None or first - s > max(0.75, first * 0.06):
            first, tier = s, min(3, tier + 1)
        out[s] = tier
    return out


def test_heading_tiers(spark, sf_dir):
    got = {}
    for r in positions.heading_tiers_query(spark, sf_dir).collect():
        got.setdefault(r["doc"], {})[r["size"]] = r["tier"]
    assert got and all(own == tiers(own) for own in got.values())


def test_names_and_references(spark):
    df = spark.createDataFrame([("Résumé (final)  v2.pdf", "$B$3", "C4:a1"), ("///", "AA10", "2:$1"), (None, "1A", "$B:A")], "n string, c string, r string")
    got = df.select(references.safe_file_name("n").alias("n"), references.parse_cell(F.col("c")).alias("c"), references.parse_range(F.col("r")).alias("r"), references.graphemes(F.lit("é🇮🇳x")).alias("g")).collect()
    assert [r["n"] for r in got] == ["Resume-final-v2.pdf", "untitled", None]
    assert [tuple(r["c"]) if r["c"] else None for r in got] == [(2, 1), (9, 26), None]
    assert [tuple(r["r"]) for r in got] == [(0, 0, 3, 2), (1, 0, 0, 16383), (0, 1, 1048575, 0)]
    assert got[0]["g"] == ["é", "🇮🇳", "x"]
    at = spark.range(1).select(references.operand(F.lit("=$B3"), F.struct(F.lit(2).alias("r0"), F.lit(0).alias("c0")), F.lit(5), F.lit(4)).alias("o"), references.operand(F.lit('"a""b"'), F.struct(F.lit(0).alias("r0"), F.lit(0).alias("c0")), F.lit(0), F.lit(0)).alias("q")).first()
    assert (at["o"]["r"], at["o"]["c"]) == (5, 1) and at["q"]["text"] == 'a"b'
    key = spark.range(1).select(references.derived_key(F.lit("pw"), F.lit(b"salt"), F.lit(1)).alias("k")).first()["k"]
    import hashlib

    assert bytes(key) == hashlib.pbkdf2_hmac("sha256", b"pw", b"salt", 100_000)


def test_tools_and_chains(spark):
    df = spark.createDataFrame([(1, 1, "Write to A.b@example.com"), (1, 2, "Two")], "conv_id long, page long, text string")
    out = steps.run_steps(df, [{"slug": "mask", "values": {"kinds": "email"}}, {"slug": "keep-pages", "values": {"pages_": "2,1,1"}}])
    assert [(r["page"], r["text"]) for r in out.orderBy("page").collect()] == [(1, "Two"), (2, "Write to A.•••••••••••om"), (3, "Write to A.•••••••••••om")]
    for bad in ([], [{"slug": "nothing"}], [{"slug": "lower", "values": {"size": 3}}]):
        with pytest.raises(ValueError):
            steps.run_steps(df, bad)
    saved = steps.saved_steps(spark, {"mine": [{"slug": "lower", "values": {"text": "text", "file": object()}}]})
    assert steps.load_steps(saved, "mine") == [{"slug": "lower", "values": {"text": "text"}}]
    with pytest.raises(ValueError):
        steps.load_steps(saved, "yours")
    assert [r["slug"] for r in steps.search_tools(spark, "mask personal").collect()] == ["mask"] and steps.search_tools(spark, "zzz").count() == 0


def test_axis_and_paper(spark):
    df = spark.createDataFrame([(0.0, 97.0), (90.0, 100.0), (-5.0, 5.0), (3.0, 3.0), (0.0, 0.0)], "a double, b double")
    got = [tuple(round(v, 9) for v in r["s"]) for r in df.select(plans_of_pages.axis_scale(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [(0, 120, 20), (88, 102, 2), (-6, 6, 2), (0, 3.5, 0.5), (0, 1.2, 0.2)]
    assert all(math.isclose((hi - lo) / step, round((hi - lo) / step)) and (hi - lo) / step <= 10 for lo, hi, step in got)
