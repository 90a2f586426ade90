"""Plans of pages over several sources, merges, splits by size, paper; and tables' scales and bounds.

Greedy packing looks at what was packed before, so it is a fold over one document's pages in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions import references as R
from leafline.plans.columns import let
from leafline.plans.registry import register
from leafline.plans.tables import load

# Points of a sheet of paper and of a millimetre, the smallest size limit in bytes.
A4 = (595.28, 841.89)
MM = 72 / 25.4
LEAST_BYTES = 20_000


def greedy_parts(sizes: Column, cap: Column) -> Column:
    """For each size its part, from 0: sizes are added until the next would go beyond cap; one alone may."""
    start = F.struct(F.array().cast("array<int>").alias("parts"), F.lit(0).cast("double").alias("used"), F.lit(0).alias("part"))

    def step(a: Column, x: Column) -> Column:
        new = (a["used"] > 0) & (a["used"] + x > cap)
        part = a["part"] + F.when(new, 1).otherwise(0)
        return F.struct(F.concat(a["parts"], F.array(part)).alias("parts"), (F.when(new, 0.0).otherwise(a["used"]) + x).alias("used"), part.alias("part"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("double")), start, step, lambda a: a["parts"])


def split_by_size(pages: DataFrame, key: list[str], page: str, size: str, cap: float) -> DataFrame:
    """key, page and part. Sizes of pages are taken as they are; what a file shares among its pages isn't counted."""
    rows = pages.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(size).alias("s")))).alias("all"))
    parts = greedy_parts(F.transform("all", lambda x: x["s"]), F.lit(float(max(LEAST_BYTES, cap))))
    return rows.select(*key, F.inline(F.zip_with("all", parts, lambda x, p: F.struct(x["p"].alias(page), p.alias("part")))))


def page_plan(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """pages: source, page, width, height, rotation; plan: position, source and page (null: a blank), rotate. The new document's pages.

    A blank has the size of the page before it, or of a sheet of paper at the beginning.
    """
    rows = plan.join(pages, ["source", "page"], "left")
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # a plan is a list that a person made
    size = F.last(F.when(F.col("width").isNotNull(), F.struct("width", "height")), ignorenulls=True).over(before)
    turned = F.pmod(F.coalesce("rotation", F.lit(0)) + F.coalesce("rotate", F.lit(0)), F.lit(360))
    return rows.select("position", "source", "page", F.coalesce(size["width"], F.lit(A4[0])).alias("width"), F.coalesce(size["height"], F.lit(A4[1])).alias("height"), turned.alias("rotation"))


def merged_pages(pages: DataFrame, order: list[str], page: str, title: Column) -> DataFrame:
    """All pages of all sources in order: position in the merged document, and title on each source's first page.

    Positions come from sums over sources, which are joined back, so that no task holds all pages.
    """
    counts = pages.groupBy(*order).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*order).orderBy(page))
    rows = pages.withColumn("__place", place).join(offsets.drop("__n"), order)
    return rows.withColumns({"position": (F.col("__before") + F.col("__place")).cast("long"), "title": F.when(F.col("__place") == 1, title)}).drop("__place", "__before")


def fit_to_paper(width: Column, height: Column, paper: tuple[float, float] = A4, orientation: str = "auto", margin_mm: float = 0.0) -> Column:
    """Scale and place of a page on a sheet: sides kept in proportion, centred; auto lays wide pages across."""
    wide = width > height if orientation == "auto" else F.lit(orientation == "landscape")
    w, h = F.when(wide, max(paper)).otherwise(min(paper)), F.when(wide, min(paper)).otherwise(max(paper))
    edge = 2 * margin_mm * MM
    return let(F.least((w - edge) / width, (h - edge) / height), lambda s: F.struct(s.alias("scale"), ((w - width * s) / 2).alias("x"), ((h - height * s) / 2).alias("y"), w.alias("paper_width"), h.alias("paper_height")))


def print_bands(sizes: Column, available: float, breaks: Column | None = None) -> Column:
    """Rows (or columns) packed to bands of the available extent: first and last of each; a band never crosses a manual break. Hidden ones have size 0."""
    none = F.array().cast("array<struct<first:int,last:int,used:double>>")
    cut = breaks if breaks is not None else F.array().cast("array<int>")

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joins = (F.size(a) > 0) & ~F.array_contains(cut, x["i"]) & (last["used"] + x["s"] <= available + 0.01)
        more = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["first"].alias("first"), x["i"].alias("last"), (last["used"] + x["s"]).alias("used"))))
        return F.when(joins, more).otherwise(F.concat(a, F.array(F.struct(x["i"].alias("first"), x["i"].alias("last"), x["s"].alias("used")))))

    numbered = F.transform(sizes, lambda s, i: F.struct(i.alias("i"), s.cast("double").alias("s")))
    return F.filter(F.aggregate(numbered, none, step), lambda b: b["used"] > 0)


def axis_scale(low: Column, high: Column, most: int = 10) -> Column:
    """lo, hi and step of an axis: from zero unless the values are all within the top sixth, a twentieth of headroom, the finest step of 1, 2 or 5 with at most `most` parts."""
    a0, b0 = F.least(low, high).cast("double"), F.greatest(low, high).cast("double")
    same = a0 == b0
    a, b = F.when(same & (a0 > 0), 0.0).otherwise(a0), F.when(same & (b0 < 0), 0.0).when(same & (b0 == 0), 1.0).otherwise(b0)

    def scaled(v: Column) -> Column:
        span = v["b"] - v["a"]
        lo = F.when((v["a"] >= 0) & (v["a"] < v["b"] * 5 / 6), 0.0).otherwise(v["a"] - span / 20)
        hi = F.when((v["b"] <= 0) & (-v["b"] < -v["a"] * 5 / 6), 0.0).otherwise(v["b"] + span / 20)
        down, up = (lambda x, u: F.floor(x / u + 1e-9) * u), (lambda x, u: F.ceil(x / u - 1e-9) * u)

        def stepped(e: Column) -> Column:
            power = F.pow(F.lit(10.0), F.floor(F.log10((e["hi"] - e["lo"]) / most)))
            tried = F.transform(F.array(*(F.lit(float(m)) for m in (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000))), lambda m: m * power)
            right = F.filter(tried, lambda u: F.round((up(e["hi"], u) - down(e["lo"], u)) / u) <= most)
            return let(F.get(right, 0), lambda u: F.struct(down(e["lo"], u).alias("lo"), up(e["hi"], u).alias("hi"), u.alias("step")))

        return let(F.struct(lo.alias("lo"), hi.alias("hi")), stepped)

    return let(F.struct(a.alias("a"), b.alias("b")), scaled)


@register(
    "size_parts",
    """WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn + 1 AS page, CAST(length(text) * 100 AS DOUBLE) AS s FROM conversations),
    r AS (SELECT conv_id, k, page, s AS used, 0 AS part FROM p WHERE k = 1 UNION ALL
      SELECT p.conv_id, p.k, p.page, CASE WHEN r.used + p.s > 20000 THEN p.s ELSE r.used + p.s END, r.part + CASE WHEN r.used + p.s > 20000 THEN 1 ELSE 0 END FROM r JOIN p ON p.conv_id = r.conv_id AND p.k = r.k + 1)
    SELECT conv_id, page, part FROM r""",
)
def size_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages of a hundred bytes a character."""
    df = load(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), (F.length("text") * 100).alias("size"))
    return split_by_size(df, ["conv_id"], "page", "size", 1000)


@register(
    "page_plans",
    """WITH s AS (SELECT o_orderkey AS page, o_custkey % 3 AS source, CAST(100.0 + o_orderkey % 7 AS DOUBLE) AS w, CAST(200.0 + o_orderkey % 5 AS DOUBLE) AS h, o_orderkey % 4 * 90 AS rot FROM orders WHERE o_orderkey < 400),
    p AS (SELECT page * 2 AS position, source, page, 90 AS rotate FROM s WHERE page % 3 = 0 UNION ALL SELECT page * 2 + 1, NULL, NULL, NULL FROM s WHERE page % 3 = 0 UNION ALL SELECT -1, NULL, NULL, NULL),
    j AS (SELECT p.position, p.source, p.page, s.w, s.h, (coalesce(rot, 0) + coalesce(rotate, 0)) % 360 AS rotation FROM p LEFT JOIN s ON s.page = p.page AND s.source = p.source)
    SELECT position, source, page, coalesce(last_value(w IGNORE NULLS) OVER o, CAST(595.28 AS DOUBLE)) AS width, coalesce(last_value(h IGNORE NULLS) OVER o, CAST(841.89 AS DOUBLE)) AS height, CAST(rotation AS BIGINT) AS rotation FROM j WINDOW o AS (ORDER BY position ROWS UNBOUNDED PRECEDING)""",
)
def page_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page turned, a blank behind each and one at the beginning."""
    k = F.col("o_orderkey")
    pages = load(spark, sf_dir, "orders").where(k < 400).select(k.alias("page"), (F.col("o_custkey") % 3).alias("source"), (100.0 + k % 7).alias("width"), (200.0 + k % 5).alias("height"), (k % 4 * 90).alias("rotation"))
    some = pages.where("page % 3 = 0")
    none = F.lit(None).cast("long")
    plan = some.select((F.col("page") * 2).alias("position"), "source", "page", F.lit(90).alias("rotate"))
    plan = plan.union(some.select((F.col("page") * 2 + 1).alias("position"), none, none, F.lit(None).cast("int")))
    plan = plan.union(spark.range(1).select(F.lit(-1).cast("long"), none, none, F.lit(None).cast("int")))
    return page_plan(pages, plan).withColumn("rotation", F.col("rotation").cast("long"))


@register("merged_pages", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS position, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'conversation ' || conv_id END AS title FROM conversations")
def merged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    return merged_pages(df, ["conv_id"], "turn", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))


@register(
    "paper_fits",
    """WITH p AS (SELECT p_partkey, 100.0 + p_size * 20 AS w, 300.0 + p_partkey % 500 AS h FROM part), q AS (SELECT *, CASE WHEN w > h THEN 841.89 ELSE 595.28 END AS pw, CASE WHEN w > h THEN 595.28 ELSE 841.89 END AS ph FROM p),
    s AS (SELECT *, least((pw - 20 * 72 / 25.4) / w, (ph - 20 * 72 / 25.4) / h) AS s FROM q) SELECT p_partkey, round(s, 6) AS scale, round((pw - w * s) / 2, 4) AS x, round((ph - h * s) / 2, 4) AS y FROM s""",
)
def paper_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "part").select("p_partkey", fit_to_paper(100.0 + F.col("p_size") * 20, 300.0 + F.col("p_partkey") % 500, margin_mm=10.0).alias("f"))
    return df.select("p_partkey", F.round("f.scale", 6).alias("scale"), F.round("f.x", 4).alias("x"), F.round("f.y", 4).alias("y"))


@register(
    "print_bands",
    """WITH RECURSIVE p AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INT) AS i, CAST(l_quantity AS DOUBLE) AS s FROM lineitem),
    r AS (SELECT l_orderkey, i, i AS first, s AS used FROM p WHERE i = 0 UNION ALL
      SELECT p.l_orderkey, p.i, CASE WHEN p.i <> 4 AND r.used + p.s <= 60.01 THEN r.first ELSE p.i END, CASE WHEN p.i <> 4 AND r.used + p.s <= 60.01 THEN r.used + p.s ELSE p.s END FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.i = r.i + 1)
    SELECT l_orderkey, first, max(i) AS last, max(used) AS used FROM r GROUP BY 1, 2""",
)
def bands_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows as high as their quantity, on pages of 60, with a break before the fifth."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("s"))
    return rows.select("l_orderkey", F.inline(print_bands(F.col("s"), 60.0, F.array(F.lit(4)))))


@register(
    "axis_scales",
    """WITH v AS (SELECT o_custkey, CAST(min(o_totalprice) AS DOUBLE) AS a, CAST(max(o_totalprice) AS DOUBLE) AS b FROM orders GROUP BY 1), w AS (SELECT o_custkey, CASE WHEN a = b AND a > 0 THEN 0 ELSE a END AS a, b FROM v),
    e AS (SELECT *, CASE WHEN a < b * 5 / 6 THEN 0 ELSE a - (b - a) / 20 END AS lo, b + (b - a) / 20 AS hi FROM w), t AS (SELECT *, unnest([1, 2, 5, 10, 20, 50]) * pow(10, floor(log10((hi - lo) / 10))) AS u FROM e),
    k AS (SELECT *, floor(lo / u + 1e-9) * u AS l, ceil(hi / u - 1e-9) * u AS h FROM t), g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY u) AS r FROM k WHERE round((h - l) / u) <= 10)
    SELECT o_custkey, l AS lo, h AS hi, u AS step FROM g WHERE r = 1""",
)
def axis_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    return ends.select("o_custkey", axis_scale(F.col("a"), F.col("b")).alias("s")).select("o_custkey", "s.*")


@register(
    "parsed_references",
    """SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS r0, CAST(0 AS INT) AS c0, CAST(least(l_linenumber + 9, 1048576) - 1 AS INT) AS r1, CAST(l_suppkey % 26 AS INT) AS c1,
    l_linenumber + 3 BETWEEN l_linenumber - 1 AND l_linenumber + 8 AND 5 BETWEEN 0 AND l_suppkey % 26 AS inside FROM lineitem""",
)
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges written with dollar signs and corners in any order, read back."""
    letter = F.char((65 + F.col("l_suppkey") % 26).cast("long"))
    text = F.concat(F.lit("$"), letter, F.lit("$"), F.col("l_linenumber").cast("string"), F.lit(":a"), (F.col("l_linenumber") + 9).cast("string"))
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.parse_range(text).alias("g"))
    inside = R.in_range(F.col("g"), F.col("l_linenumber") + 3, F.lit(5))
    return df.select("l_orderkey", "l_linenumber", "g.r0", "g.c0", "g.r1", "g.c1", inside.alias("inside"))


@register("used_ranges", "SELECT l_orderkey, CAST(max(l_linenumber) AS INT) AS r1, CAST(max(l_suppkey % 10) AS INT) AS c1 FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def used_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row and column of each sheet that have something to show."""
    cells = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("r"), (F.col("l_suppkey") % 10).alias("c"), F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("v"))
    return cells.where(F.coalesce("v", F.lit("")) != "").groupBy("l_orderkey").agg(F.max("r").cast("int").alias("r1"), F.max("c").cast("int").alias("c1"))


@register("sealed_bytes", "SELECT n_nationkey, n_name AS opened, CAST(NULL AS VARCHAR) AS wrong_key, 28 + length(n_name) AS size FROM nation")
def sealed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed and opened again: nonce and tag take 28 bytes, another key opens nothing."""
    key, other = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit(b"f123456789abcdef0123456789abcdef")
    df = load(spark, sf_dir, "nation").select("n_nationkey", R.sealed(key, F.col("n_name").cast("binary")).alias("s"))
    return df.select("n_nationkey", R.opened(key, F.col("s")).cast("string").alias("opened"), R.opened(other, F.col("s")).cast("string").alias("wrong_key"), F.length("s").alias("size"))


@register("byte_checksums", "WITH b AS (SELECT n_nationkey, list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i])) AS v FROM nation) SELECT n_nationkey, CAST((1 + list_sum(v)) % 65521 + 65536 * ((len(v) + list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * (len(v) - i + 1)))) % 65521) AS BIGINT) AS adler FROM b")
def byte_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", R.adler32(F.col("n_name").cast("binary")).alias("adler"))
