"""Positioned text: gaps, segments, bands, column starts, outline trees and heading tiers.

Items are rows (page, x, w, size, text). Everything that only looks back along one line or page is a
window; bands are the union of intervals by a running maximum. Queries use the lines of an order as items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.plans.registry import register
from leafline.plans.tables import load


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines side by side: x, width and size are whole numbers, so both engines agree to the digit."""
    df = load(spark, sf_dir, "lineitem")
    return df.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 400).cast("int").alias("x"), F.col("l_quantity").cast("int").alias("w"), (8 + F.col("l_suppkey") % 6).cast("int").alias("size"))


ITEMS = "it AS (SELECT l_orderkey AS page, l_linenumber AS i, CAST(l_partkey % 400 AS INT) AS x, CAST(l_quantity AS INT) AS w, CAST(8 + l_suppkey % 6 AS INT) AS size FROM lineitem)"


def islands(df: DataFrame, key: list[str], start: str, end: Column, gap: Column | float, out: str) -> DataFrame:
    """Adds out: a new number wherever an item starts more than gap behind everything before it."""
    order = Window.partitionBy(*key).orderBy(start, "i", "w", "size")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    return df.withColumn(out, F.sum("__new").over(order).cast("long")).drop("__new")


def islands_sql(gap: str) -> str:
    return f"""WITH {ITEMS}, r AS (SELECT *, max(x + w) OVER (PARTITION BY page ORDER BY x, i, w, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM it),
    k AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR x > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x, i, w, size) AS BIGINT) AS n FROM r)"""


@register("cell_segments", f"{islands_sql('greatest(1.3 * size, 9)')} SELECT page, n AS segment, min(x) AS x, max(x + w) AS x2, count(*) AS items FROM k GROUP BY 1, 2")
def cell_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's items fall into cells where the gap is wide for the text's size."""
    df = islands(items(spark, sf_dir), ["page"], "x", F.col("x") + F.col("w"), F.greatest(1.3 * F.col("size"), F.lit(9)), "segment")
    return df.groupBy("page", "segment").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x2"), F.count(F.lit(1)).alias("items"))


@register("column_bands", f"{islands_sql('3')} SELECT page, n AS band, min(x) AS x, max(x + w) AS x2 FROM k GROUP BY 1, 2")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the intervals of text, up to three points apart."""
    df = islands(items(spark, sf_dir), ["page"], "x", F.col("x") + F.col("w"), F.lit(3), "band")
    return df.groupBy("page", "band").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x2"))


@register("item_spacing", f"WITH {ITEMS} SELECT page, i, coalesce(x - lag(x + w) OVER (PARTITION BY page ORDER BY x, i, w, size) > 0.18 * size, false) AS space_before FROM it")
def item_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space stands before an item if the gap is more than a part of its size."""
    before = F.lag(F.col("x") + F.col("w")).over(Window.partitionBy("page").orderBy("x", "i", "w", "size"))
    return items(spark, sf_dir).select("page", "i", F.coalesce(F.col("x") - before > 0.18 * F.col("size"), F.lit(False)).alias("space_before"))


@register("paragraph_breaks", f"WITH {ITEMS} SELECT page, i, coalesce(x - lag(x) OVER (PARTITION BY page ORDER BY x, i, w, size) > 0.9 * greatest(size, lag(size) OVER (PARTITION BY page ORDER BY x, i, w, size)), false) AS new_paragraph FROM it")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page").orderBy("x", "i", "w", "size")
    gap = F.col("x") - F.lag("x").over(w)
    return items(spark, sf_dir).select("page", "i", F.coalesce(gap > 0.9 * F.greatest("size", F.lag("size").over(w)), F.lit(False)).alias("new_paragraph"))


@register("shared_starts", f"WITH {ITEMS} SELECT x // 10 AS start, count(DISTINCT page) AS pages FROM it GROUP BY 1 HAVING count(DISTINCT page) >= 5")
def shared_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that many pages have in common: distinct pairs first, so that no page is counted in one place."""
    pairs = items(spark, sf_dir).select(F.floor(F.col("x") / 10).cast("int").alias("start"), "page").distinct()
    return pairs.groupBy("start").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 5")


@register("overlapping_boxes", f"WITH {ITEMS} SELECT a.page, a.i AS a, b.i AS b FROM it a JOIN it b ON a.page = b.page AND a.i < b.i AND a.x < b.x + b.w AND b.x < a.x + a.w")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict intersection of boxes on one page."""
    a = items(spark, sf_dir).select("page", F.col("i").alias("a"), F.col("x").alias("ax"), F.col("w").alias("aw"))
    b = items(spark, sf_dir).select("page", F.col("i").alias("b"), F.col("x").alias("bx"), F.col("w").alias("bw"))
    return a.join(b, "page").where((F.col("a") < F.col("b")) & (F.col("ax") < F.col("bx") + F.col("bw")) & (F.col("bx") < F.col("ax") + F.col("aw"))).select("page", "a", "b")


def clusters(xs: Column, tolerance: float) -> Column:
    """Greedy clusters of sorted numbers: a number joins the last cluster if it is within tolerance of its running mean."""
    start = F.array().cast("array<struct<mean:double,n:int>>")

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joined = F.struct(((last["mean"] * last["n"] + x) / (last["n"] + 1)).alias("mean"), (last["n"] + 1).alias("n"))
        near = (F.size(a) > 0) & (F.abs(x - last["mean"]) <= tolerance)
        return F.when(near, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(F.struct(x.cast("double").alias("mean"), F.lit(1).alias("n")))))

    return F.aggregate(F.array_sort(xs), start, step)


@register("start_clusters")
def start_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of starts of each page; the running mean depends on what came before, so tests/ compares a plain loop."""
    xs = items(spark, sf_dir).groupBy("page").agg(F.collect_list("x").alias("xs"))
    return xs.select("page", F.explode(clusters(F.col("xs"), 10.0)).alias("c")).select("page", F.round("c.mean", 6).alias("mean"), F.col("c.n").alias("n"))


def parents(df: DataFrame, key: str, seq: str, level: str, depth: int) -> DataFrame:
    """Adds parent: the place of the last entry before with a smaller level, null at the top."""
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(seq))).over(before) for k in range(1, depth + 1)]
    parent = F.lit(None)
    for k in range(depth, 1, -1):
        nearest = F.greatest(*last[: k - 1]) if k > 2 else last[0]
        parent = F.when(F.col(level) == k, nearest).otherwise(parent)
    return df.withColumn("parent", parent)


@register(
    "outline_tree",
    """WITH o AS (SELECT conv_id, turn, turn % 3 + 1 AS level FROM conversations)
    SELECT o.conv_id, o.turn, o.level, max(p.turn) AS parent FROM o LEFT JOIN o p ON p.conv_id = o.conv_id AND p.turn < o.turn AND p.level < o.level GROUP BY 1, 2, 3""",
)
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat levels to a tree."""
    df = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3 + 1).alias("level"))
    return parents(df, "conv_id", "turn", "level", 3)


@register("heading_ranks", "WITH s AS (SELECT DISTINCT l_orderkey % 50 AS doc, CAST(8 + l_suppkey % 6 AS INT) AS size FROM lineitem) SELECT doc, size, least(3, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC)) AS tier FROM s")
def heading_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of headings in tiers, three at most; sizes are whole points here, so each is a tier."""
    sizes = items(spark, sf_dir).select((F.col("page") % 50).alias("doc"), "size").distinct()
    return sizes.select("doc", "size", F.least(F.lit(3), F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size")))).alias("tier"))


@register(
    "answers",
    """SELECT b.item_id, min(d.doc_id) AS first_doc, count(*) AS docs FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1""",
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a query word for word: candidates by its rarest inner words first, then the exact test."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    items_ = load(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("q"))
    post = docs.select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    asked = items_.select("item_id", F.explode(words(F.col("q"))).alias("w"), F.size(F.split("q", r"\s+")).alias("n"))
    # the first and last word of a query may be cut by other letters, so inner words decide
    inner = asked.join(items_.select("item_id", F.element_at(F.split("q", r"\s+"), 1).alias("a"), F.element_at(F.split("q", r"\s+"), -1).alias("z")), "item_id").where("w <> a and w <> z")
    df = post.join(F.broadcast(inner.select("w").distinct()) if inner.count() < 100_000 else inner.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = inner.join(df, "w").groupBy("item_id").agg(F.min(F.struct("df", "w"))["w"].alias("w"))
    met = post.join(rarest, "w").join(items_, "item_id").join(docs, "doc_id").where(F.contains(F.lower("text"), F.col("q")))
    # a query without inner words has none to look up: it is tested against every text
    others = items_.join(inner.select("item_id").distinct(), "item_id", "left_anti")
    met = met.select("item_id", "doc_id").unionByName(docs.join(others, F.contains(F.lower("text"), F.col("q"))).select("item_id", "doc_id"))
    return met.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs"))


@register("numeric_texts", r"SELECT o_orderkey, regexp_matches(t, '^\(?[-+]?\s*(?:₹|\$|€|£)?\s*[0-9][0-9,.\s]*%?\)?$') AS numeric FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '(' || o_orderkey || ')' WHEN 1 THEN '$ ' || o_orderkey || '.5' WHEN 2 THEN o_orderkey || '%' ELSE 'no ' || o_orderkey END AS t FROM orders)")
def numeric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafline.sources.sinks import NUMERIC

    t = F.expr("case o_orderkey % 4 when 0 then concat('(', o_orderkey, ')') when 1 then concat('$ ', o_orderkey, '.5') when 2 then concat(o_orderkey, '%') else concat('no ', o_orderkey) end")
    return load(spark, sf_dir, "orders").select("o_orderkey", t.rlike(NUMERIC).alias("numeric"))


@register("mixed_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 2 = 1 THEN lower(p_name) END, p_partkey) AS place FROM part")
def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of mixed kinds in order: numbers before texts, texts without case."""
    even = F.col("p_size") % 2 == 0
    w = Window.partitionBy("p_brand").orderBy(F.when(even, 0).otherwise(1), F.when(even, F.col("p_size")).asc_nulls_last(), F.when(~even, F.lower("p_name")).asc_nulls_last(), "p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).alias("place"))


@register("checksums", "SELECT n_nationkey, length(n_name) AS n FROM nation")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths beside a 32-bit FNV-1a hash, which is only checked by tests/."""
    return load(spark, sf_dir, "nation").where(fnv1a(F.col("n_name")) >= 0).select("n_nationkey", F.length("n_name").cast("long").alias("n"))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as a long."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("([0-9A-F]{2})"))
    codes = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)


@register("name_hashes", "SELECT n_nationkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(n_name[i]) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS hash FROM nation")
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", fnv1a(F.col("n_name")).alias("hash"))
