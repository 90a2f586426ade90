"""HTML to blocks and table cells, by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.plans.registry import register
from leafline.plans.tables import load

HIDDEN = frozenset("script style noscript template head title".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th section article header footer nav aside main blockquote pre form figure".split())
NEW_LINE = frozenset("br hr".split())


class Blocks(HTMLParser):
    """Gathers (kind, text) of blocks and (table, row, column, header, rows, columns, text) of cells."""

    def __init__(self) -> None:
        super().__init__()
        self.hidden = 0
        self.kinds = ["p"]
        self.text: list[str] = []
        self.blocks: list[tuple[str, str]] = []
        self.tables: list[list[list[tuple]]] = []
        self.cell: list | None = None

    def close_block(self) -> None:
        if text := " ".join("".join(self.text).split()):
            if self.cell is not None:
                self.cell[-1].append(text)
            self.blocks.append((self.kinds[-1], text))
        self.text = []

    def close_cell(self) -> None:
        if self.cell is not None:
            self.close_block()
            header, rows, columns, parts = self.cell
            self.tables[-1][-1].append((header, rows, columns, "\n".join(parts)))
            self.cell = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in NEW_LINE:
            self.text.append(" ")
        elif tag in BLOCKS:
            self.close_block()
            self.kinds.append(tag)
            if tag == "table":
                self.tables.append([])
            elif tag == "tr" and self.tables:
                self.close_cell()
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables and self.tables[-1]:
                self.close_cell()
                span = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and (v or "").isdigit()}
                self.cell = [tag == "th", max(1, span.get("rowspan", 1)), max(1, span.get("colspan", 1)), []]

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.close_block()
            if tag in ("td", "th", "tr", "table"):
                self.close_cell()
            if tag in self.kinds[1:]:
                while self.kinds.pop() != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self.close_cell()
        self.close_block()


def parsed(page: str) -> Blocks:
    out = Blocks()
    out.feed(page)
    out.close()
    return out


def plain_text(page: str) -> str:
    return "\n".join(t for _, t in parsed(page).blocks)


def grid(table: list[list[tuple]]) -> list[tuple[int, int, bool, int, int, str]]:
    """Cells with their places, spans respected and cut at the table's end."""
    taken, out = set(), []
    for r, row in enumerate(table):
        c = 0
        for header, rows, columns, text in row:
            while (r, c) in taken:
                c += 1
            rows = min(rows, len(table) - r)
            taken |= {(r + i, c + j) for i in range(rows) for j in range(columns)}
            out.append((r, c, header, rows, columns, text))
            c += columns
    return out


def html_blocks(df: DataFrame, key: str, page: str) -> DataFrame:
    """key, pos, kind and text of each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, kind, text) for k, p in zip(frame["k"], frame["p"], strict=True) for i, (kind, text) in enumerate(parsed(p or "").blocks)]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "text"])

    return df.select(F.col(key).alias("k"), F.col(page).alias("p")).mapInPandas(run, f"{key} long, pos int, kind string, text string")


def html_tables(df: DataFrame, key: str, page: str) -> DataFrame:
    """key, table, r, c, header, rowspan, colspan and text of each cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, t, *cell) for k, p in zip(frame["k"], frame["p"], strict=True) for t, table in enumerate(parsed(p or "").tables) for cell in grid(table)]
            yield pd.DataFrame(rows, columns=[key, "table", "r", "c", "header", "rowspan", "colspan", "text"])

    return df.select(F.col(key).alias("k"), F.col(page).alias("p")).mapInPandas(run, f"{key} long, table int, r int, c int, header boolean, rowspan int, colspan int, text string")


@register("html_lists", "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<h1>')) AS headings FROM pages")
def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html_blocks(load(spark, sf_dir, "pages"), "page_id", "html")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return blocks.groupBy("page_id").agg(count("li").alias("items"), count("h1").alias("headings"))


TABLE = "'<table><tr><th>Key</th><th>Name</th></tr><tr><td>' || n_nationkey || '</td><td>' || n_name || ' &amp; Co</td></tr></table>'"


@register("html_table_cells", "SELECT CAST(n_nationkey AS BIGINT) AS k, r, c, CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'Key' ELSE 'Name' END WHEN c = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name || ' & Co' END AS text FROM nation, (SELECT unnest([0, 0, 1, 1]) AS r, unnest([0, 1, 0, 1]) AS c)")
def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.expr(TABLE).alias("page"))
    return html_tables(df, "key", "page").select(F.col("key").alias("k"), "r", "c", "text")
