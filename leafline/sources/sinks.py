"""Writers: pages as text, rows as separated text, cells as Markdown or HTML tables, and archives of files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions.text import escape_html
from leafline.plans.registry import register
from leafline.plans.tables import load


def pages_text(df: DataFrame, key: str, page: str, text: str, marks: bool = True) -> DataFrame:
    """One text for each document, with a line above each page or blank lines between."""
    ordered = F.sort_array(F.collect_list(F.struct(page, text)))
    one = (lambda x: F.concat(F.lit("--- Page "), x[page].cast("string"), F.lit(" ---\n"), x[text])) if marks else (lambda x: x[text])
    return df.groupBy(key).agg(ordered.alias("__all")).select(key, F.array_join(F.transform("__all", one), "\n\n").alias("content"))


@register("text_export", "SELECT conv_id, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1")
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    return pages_text(df, "conv_id", "page", "text")


def csv_line(columns: list[Column]) -> Column:
    """Quotes only where they are needed; nulls are empty; empty fields at the end stay away."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts]
    return F.regexp_replace(F.concat_ws(",", *quoted), ",+$", "")


@register("csv_export", '''SELECT c_custkey, c_custkey || ',"' || c_name || ', ""Ltd""",' || CAST(c_acctbal AS DECIMAL(18,2)) AS line FROM customer''')
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.lit(', "Ltd"'))
    return load(spark, sf_dir, "customer").select("c_custkey", csv_line([F.col("c_custkey"), name, F.col("c_acctbal").cast("decimal(18,2)"), F.lit(None)]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header, CR LF line ends and quotes where needed."""
    df.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def markdown_row(cells: list[Column]) -> Column:
    parts = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


@register("markdown_rows", "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", markdown_row([F.col("n_nationkey"), F.col("n_name")]).alias("line"))


NUMERIC = r"^\(?[-+]?\s*(?:₹|\$|€|£)?\s*[0-9][0-9,.\s]*%?\)?$"


def html_row(cells: Column, width: Column) -> Column:
    """A table row of an array of texts, filled up to a width; numbers to the right."""
    full = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    one = lambda x: F.concat(F.when(x.rlike(NUMERIC), '<td style="text-align:right">').otherwise("<td>"), escape_html(x), F.lit("</td>"))
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(full, one), ""), F.lit("</tr>"))


@register("html_rows", """SELECT n_nationkey, '<tr><td style="text-align:right">' || n_nationkey || '</td><td>' || n_name || '</td><td></td></tr>' AS line FROM nation""")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))
    return load(spark, sf_dir, "nation").select("n_nationkey", html_row(cells, F.lit(3)).alias("line"))


def zipped(files: DataFrame, job: str) -> DataFrame:
    """files: job, filename, bytes. Of a job with several files an archive comes first; a single file stays alone."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("filename")
        if len(frame) < 2:
            return frame[[job, "filename", "bytes"]]
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in zip(frame["filename"], frame["bytes"], strict=True):
                z.writestr(zipfile.ZipInfo(name), bytes(content))
        first = pd.DataFrame({job: [frame[job].iloc[0]], "filename": ["files.zip"], "bytes": [data.getvalue()]})
        return pd.concat([first, frame[[job, "filename", "bytes"]]])

    kind = dict(files.dtypes)[job]
    return files.groupBy(job).applyInPandas(pack, f"{job} {kind}, filename string, bytes binary")


@register("file_stats", "SELECT source, count(*) AS files, sum(n_chars) AS chars, max(n_chars) AS largest FROM documents GROUP BY source")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("largest"))
