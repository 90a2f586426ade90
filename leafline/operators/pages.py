"""Page algebra: pages are rows, selections are joins, splits are running sums.

Functions take a table with a document key and a page number from 1; queries use conversations, whose
turns are the pages. Windows are by document, so documents are the unit of parallel work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.plans.registry import register
from leafline.plans.tables import load


def page_list(spec: str, last: int) -> list[int]:
    """The pages a spec names, in order and with repeats: all, odd, even, n, a-b (also downwards), last or z, open ends.

    Pages that aren't there are left out; a part that can't be read raises.
    """
    out: list[int] = []
    for part in re.split(r"[,;]", spec.lower()):
        part = part.strip()
        if not part:
            continue
        if part in ("all", "odd", "even"):
            out += range(2 if part == "even" else 1, last + 1, 1 if part == "all" else 2)
            continue
        m = re.fullmatch(r"(\d+|last|z)?\s*(-)?\s*(\d+|last|z)?", part)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"not a page range: {part}")
        number = lambda x, other: other if x is None else last if x in ("last", "z") else int(x)
        a = number(m[1], 1)
        b = number(m[3], last) if m[2] else a
        out += [p for p in (range(a, b + 1) if a <= b else range(a, b - 1, -1)) if 1 <= p <= last]
    return out


def range_groups(spec: str, last: int) -> list[list[int]]:
    """One list of pages for each part of a spec."""
    return [g for part in re.split(r"[,;]", spec) if part.strip() and (g := page_list(part, last))]


def keep_pages(df: DataFrame, key: str, page: str, spec: str, last: int) -> DataFrame:
    """The pages of a spec, in its order; adds position. Fails if the spec names none."""
    pages = page_list(spec, last)
    if not pages:
        raise ValueError("no page is left")
    plan = df.sparkSession.createDataFrame(list(enumerate(pages, 1)), f"position int, {page} long")
    return df.join(F.broadcast(plan), page)  # as long as the spec


def drop_pages(df: DataFrame, page: str, spec: str, last: int) -> DataFrame:
    gone = set(page_list(spec, last))
    if len(gone) == last:
        raise ValueError("no page is left")
    return df.where(~F.col(page).isin(*gone)) if gone else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text", "role")


P = "p AS (SELECT conv_id, turn + 1 AS page, text, role FROM conversations)"


@register("keep_pages", f"WITH {P}, s AS (SELECT unnest([3, 1, 2, 2]) AS page, unnest([1, 2, 3, 4]) AS position) SELECT conv_id, page, position, role FROM p JOIN s USING (page)")
def keep_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_pages(pages(spark, sf_dir), "conv_id", "page", "3,1,2,2", 3).select("conv_id", "page", F.col("position").cast("int"), "role")


@register("drop_pages", f"WITH {P} SELECT conv_id, page, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS new_page FROM p WHERE page NOT IN (2, 4)")
def drop_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = drop_pages(pages(spark, sf_dir), "page", "2,4", 9)
    return df.select("conv_id", "page", F.row_number().over(Window.partitionBy("conv_id").orderBy("page")).alias("new_page"))


@register("range_groups", f"WITH {P}, s AS (SELECT unnest([1, 2, 4, 3, 2]) AS page, unnest([1, 1, 2, 2, 2]) AS part, unnest([1, 2, 1, 2, 3]) AS position) SELECT conv_id, page, part, position FROM p JOIN s USING (page)")
def groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = range_groups("1-2;4-2", 4)
    rows = [(p, g, i) for g, members in enumerate(groups, 1) for i, p in enumerate(members, 1)]
    plan = spark.createDataFrame(rows, "page long, part int, position int")
    return pages(spark, sf_dir).join(F.broadcast(plan), "page").select("conv_id", "page", "part", "position")


def split_every(page: Column, n: int) -> Column:
    return F.floor((page - 1) / n).cast("long")


@register("split_every_n", f"WITH {P} SELECT conv_id, (page - 1) // 2 AS part, count(*) AS pages, string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page) AS text FROM p GROUP BY 1, 2")
def split_every_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size parts, each with its text, a form feed between pages."""
    df = pages(spark, sf_dir).withColumn("part", split_every(F.col("page"), 2)).groupBy("conv_id", "part")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\f\n")
    return df.agg(F.count(F.lit(1)).alias("pages"), text.alias("text"))


def split_on_marker(df: DataFrame, key: str, page: str, starts: Column) -> DataFrame:
    """Adds part: a new one wherever starts holds, but the first page never starts a second part."""
    order = Window.partitionBy(key).orderBy(page)
    first = F.row_number().over(order) == 1
    return df.withColumn("__start", F.when(~first & starts, 1).otherwise(0)).withColumn("part", F.sum("__start").over(order)).drop("__start")


@register(
    "split_on_marker",
    f"WITH {P}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY page) > 1 AND role = 'user' THEN 1 ELSE 0 END AS st FROM p) SELECT conv_id, page, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY page) AS BIGINT) AS part FROM s",
)
def split_marker_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_on_marker(pages(spark, sf_dir), "conv_id", "page", F.col("role") == "user").select("conv_id", "page", "part")


@register(
    "bookmark_carry",
    f"WITH {P} SELECT conv_id, page, coalesce(last_value(CASE WHEN role = 'user' THEN text[1:20] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY page ROWS UNBOUNDED PRECEDING), 'Front matter') AS title FROM p",
)
def bookmark_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bookmark at or before each page; what comes before the first is front matter."""
    title = F.last(F.when(F.col("role") == "user", F.substring("text", 1, 20)), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return pages(spark, sf_dir).select("conv_id", "page", F.coalesce(title, F.lit("Front matter")).alias("title"))


@register(
    "interleave",
    f"WITH {P}, s AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END AS src, conv_id // 2 AS pair, page FROM p) SELECT pair, src, page, row_number() OVER (PARTITION BY pair ORDER BY page, src) AS position FROM s",
)
def interleave_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two sources in turn; the longer one goes on alone."""
    df = pages(spark, sf_dir).select(F.expr("cast(if(conv_id % 2 = 0, 0, 1) as int)").alias("src"), F.expr("conv_id div 2").alias("pair"), "page")
    return df.withColumn("position", F.row_number().over(Window.partitionBy("pair").orderBy("page", "src")))


@register(
    "merge_offsets",
    "WITH c AS (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY 1) SELECT conv_id, pages, CAST(coalesce(sum(pages) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_pages FROM c",
)
def merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source starts in the merged document, by prefix sums over ranges of sources.

    A running sum in one task would not scale: ranges are summed first, then each range on its own.
    """
    counts = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.withColumn("block", F.expr("conv_id div 4096"))
    blocks = counts.groupBy("block").agg(F.sum("pages").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    inner = F.coalesce(F.sum("pages").over(Window.partitionBy("block").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(blocks.select("block", before), "block").select("conv_id", "pages", (F.col("base") + inner).cast("long").alias("offset_pages"))


@register("bates_numbers", f"WITH {P} SELECT conv_id, page, 'DOC-' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page) + 99 AS VARCHAR), 6, '0') || '-X' AS stamp FROM p")
def bates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A padded running number with prefix and suffix."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("page")) + 99
    return pages(spark, sf_dir).select("conv_id", "page", F.concat(F.lit("DOC-"), F.lpad(n.cast("string"), 6, "0"), F.lit("-X")).alias("stamp"))


@register(
    "page_templates",
    f"WITH {P} SELECT conv_id, page, replace(replace('Page {{page}} of {{pages}}', '{{pages}}', CAST(count(*) OVER (PARTITION BY conv_id) AS VARCHAR)), '{{page}}', CAST(page AS VARCHAR)) AS footer FROM p",
)
def template_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.count(F.lit(1)).over(Window.partitionBy("conv_id")).cast("string")
    footer = F.replace(F.replace(F.lit("Page {page} of {pages}"), F.lit("{pages}"), total), F.lit("{page}"), F.col("page").cast("string"))
    return pages(spark, sf_dir).select("conv_id", "page", footer.alias("footer"))


@register("reverse_pages", f"WITH {P} SELECT conv_id, page, row_number() OVER (PARTITION BY conv_id ORDER BY page DESC) AS new_page FROM p")
def reverse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("conv_id", "page", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("page"))).alias("new_page"))


@register("rotate_pages", f"WITH {P} SELECT conv_id, page, CAST((((page * 90 - 180) % 360) + 360) % 360 AS BIGINT) AS angle FROM p")
def rotate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("conv_id", "page", F.pmod(F.col("page") * 90 - 180, F.lit(360)).cast("long").alias("angle"))


@register(
    "sheets_of_pages",
    f"WITH {P} SELECT conv_id, page, (page - 1) // 4 AS sheet, ((page - 1) % 4) // 2 AS slot_row, ((page - 1) % 4) % 2 AS slot_col, least(297.5 / 595, 421.0 / 842) AS scale FROM p",
)
def sheets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages on a sheet, by rows."""
    i = F.col("page") - 1
    return pages(spark, sf_dir).select("conv_id", "page", F.floor(i / 4).alias("sheet"), F.floor(i % 4 / 2).alias("slot_row"), (i % 4 % 2).alias("slot_col"), F.least(F.lit(297.5) / 595, F.lit(421.0) / 842).alias("scale"))


@register(
    "insert_blanks",
    f"WITH {P} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page, b) AS position, CASE WHEN b = 0 THEN page END AS page FROM p, (SELECT unnest([0, 1]) AS b)",
)
def blanks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank page behind each."""
    df = pages(spark, sf_dir).select("conv_id", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("page", "b"))
    return df.select("conv_id", position.alias("position"), F.when(F.col("b") == 0, F.col("page")).alias("page"))


@register("page_files", f"WITH {P} SELECT conv_id, page, 'conv-' || conv_id || '-' || lpad(CAST(page AS VARCHAR), CAST(length(CAST(max(page) OVER (PARTITION BY conv_id) AS VARCHAR)) AS INTEGER), '0') AS name FROM p")
def files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each page, numbers padded to the width of the last."""
    width = F.length(F.max("page").over(Window.partitionBy("conv_id")).cast("string"))
    df = pages(spark, sf_dir).withColumn("w", width)
    return df.select("conv_id", "page", F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.expr("lpad(cast(page as string), w, '0')")).alias("name"))


@register(
    "edge_lines",
    r"""WITH l AS (SELECT source, doc_id, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '[ \t]+', ' ', 'g'))) AS k
      FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
    n AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1)
    SELECT source, k AS line, count(DISTINCT doc_id) AS docs FROM l JOIN n USING (source) WHERE k <> '' GROUP BY source, k, total HAVING count(DISTINCT doc_id) >= greatest(3, total / 10.0)""",
)
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that come again on many pages of a source: page furniture."""
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", "text")
    line = F.lower(F.trim(F.regexp_replace(F.regexp_replace("line", "[0-9]+", "#"), "[ \t]+", " ")))
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", line.alias("line")).where("line <> ''")
    # distinct pairs first, so that a line of a large source is counted in parts
    counts = lines.distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs"))
    totals = docs.groupBy("source").agg(F.count_distinct("doc_id").alias("total"))
    return counts.join(totals, "source").where(F.col("docs") >= F.greatest(F.lit(3), F.col("total") / 10)).select("source", "line", "docs")


@register("unique_names", "SELECT p_partkey, p_brand || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that collide get a number."""
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    df = load(spark, sf_dir, "part").select("p_partkey", "p_brand", r.alias("r"))
    return df.select("p_partkey", F.concat("p_brand", F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("name"))


@register(
    "natural_sort",
    r"SELECT p_partkey, p_name || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS place FROM part",
)
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in natural order: digits compare as numbers, by a key with padded digit runs."""
    df = load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(natural_key(F.col("name"))))).select("p_partkey", "name", "place")


def natural_key(name: Column, width: int = 20) -> Column:
    """Lower case, every run of digits padded: compares as people sort names."""
    texts, numbers = F.split(F.lower(name), "[0-9]+"), F.regexp_extract_all(name, F.lit("([0-9]+)"))
    padded = F.zip_with(texts, numbers, lambda t, n: F.concat(F.coalesce(t, F.lit("")), F.coalesce(F.lpad(n, width, "0"), F.lit(""))))
    return F.array_join(padded, "")
