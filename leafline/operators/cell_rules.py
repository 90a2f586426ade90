"""Conditional-format rules over cells, as windows and predicates.

A block is the set of cells that a rule ranks and averages over; cells are rows (block, r, c, num, str, t).
Rules that only look at one cell are predicates; the others need one pass of windows by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.plans.registry import register
from leafline.plans.tables import load

OPERATORS = ("lessThan", "lessThanOrEqual", "greaterThan", "greaterThanOrEqual", "equal", "notEqual", "between", "notBetween")


def cell_is(v: Column, operator: str, a: Column, b: Column | None = None) -> Column:
    """One of eight comparisons; between doesn't mind the order of its ends. Blank cells match none."""
    if operator not in OPERATORS:
        raise ValueError(f"no such operator: {operator}")
    if operator in ("between", "notBetween"):
        inside = (v >= F.least(a, b)) & (v <= F.greatest(a, b))
        out = inside if operator == "between" else ~inside
    else:
        out = {"lessThan": v < a, "lessThanOrEqual": v <= a, "greaterThan": v > a, "greaterThanOrEqual": v >= a, "equal": v == a, "notEqual": v != a}[operator]
    return F.coalesce(out, F.lit(False))


def text_rule(s: Column, kind: str, needle: str) -> Column:
    """contains, notContains, begins or ends, without case; an empty text only matches notContains."""
    low, n = F.lower(F.coalesce(s, F.lit(""))), needle.lower()
    rules = {"contains": F.contains(low, F.lit(n)), "notContains": ~F.contains(low, F.lit(n)), "begins": low.startswith(n), "ends": low.endswith(n)}
    return rules[kind] & (F.lit(kind == "notContains") | (low != ""))


def blank_rule(s: Column) -> Column:
    return F.trim(F.coalesce(s, F.lit(""))) == ""


def top_n(v: Column, block: list[str], n: int, percent: bool = False, bottom: bool = False) -> Column:
    """The n best with ties, or n percent of the block, at least one."""
    w = Window.partitionBy(*block)
    count = F.greatest(F.lit(1), F.floor(F.count(v).over(w) * n / 100)) if percent else F.lit(n)
    return v.isNotNull() & (F.rank().over(w.orderBy(v.asc_nulls_last() if bottom else v.desc_nulls_last())) <= count)


def above_average(v: Column, block: list[str], above: bool = True, equal: bool = False) -> Column:
    mean = F.avg(v).over(Window.partitionBy(*block))
    out = (v > mean) if above else (v < mean)
    return F.coalesce(out | (F.lit(equal) & (v == mean)), F.lit(False))


def repeated_values(s: Column, block: list[str], unique: bool = False) -> Column:
    """Texts that come more than once in the block, without case, or once; blanks are neither."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*block, F.lower(s)))
    return (F.coalesce(s, F.lit("")) != "") & ((n == 1) if unique else (n > 1))


def hex_mix(a: str, b: str, f: Column) -> Column:
    """The colour at fraction f between two of rrggbb."""
    parts = [F.round(int(a[i : i + 2], 16) + (int(b[i : i + 2], 16) - int(a[i : i + 2], 16)) * f).cast("int") for i in (0, 2, 4)]
    return F.format_string("%02x%02x%02x", *parts)


def fraction(v: Column, low: Column, high: Column, same: float) -> Column:
    return F.when(high == low, F.lit(same)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low))))


def colour_scale(v: Column, block: list[str], colours: list[str], middle: float = 50) -> Column:
    """Two or three colours from the smallest to the largest value of a block, the middle one at a percentile."""
    w = Window.partitionBy(*block)
    low, high = F.min(v).over(w), F.max(v).over(w)
    if len(colours) == 2:
        return F.when(v.isNotNull(), hex_mix(colours[0], colours[1], fraction(v, low, high, 0.0)))
    mid = F.percentile(v, F.lit(middle / 100)).over(w)
    return F.when(v.isNull(), F.lit(None)).when(v <= mid, hex_mix(colours[0], colours[1], fraction(v, low, mid, 1.0))).otherwise(hex_mix(colours[1], colours[2], fraction(v, mid, high, 1.0)))


def data_bar(v: Column, block: list[str]) -> Column:
    """A tenth for the smallest value, whole for the largest."""
    w = Window.partitionBy(*block)
    return 0.1 + 0.9 * fraction(v, F.min(v).over(w), F.max(v).over(w), 1.0)


def resolved_looks(hits: DataFrame, cell: list[str]) -> DataFrame:
    """hits: cell keys, prop, value, priority, stop. The winning value of each property: the lowest priority, none behind a rule that stops."""
    stop = F.min(F.when(F.col("stop"), F.col("priority"))).over(Window.partitionBy(*cell))
    live = hits.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("priority") <= F.col("__stop")))
    return live.groupBy(*cell, "prop").agg(F.min_by("value", "priority").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("block"), F.col("p_retailprice").alias("num"), F.col("p_name").alias("str"), "p_size")


@register("cell_is", "SELECT p_partkey, p_size < 10 AS lt, p_size >= 40 AS ge, p_size = 7 AS eq, p_size BETWEEN 5 AND 20 AS btw, p_size NOT BETWEEN 5 AND 20 AS nbtw FROM part")
def cell_is_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, rule = F.col("p_size"), cell_is
    return cells(spark, sf_dir).select(
        "p_partkey", rule(v, "lessThan", F.lit(10)).alias("lt"), rule(v, "greaterThanOrEqual", F.lit(40)).alias("ge"), rule(v, "equal", F.lit(7)).alias("eq"),
        rule(v, "between", F.lit(20), F.lit(5)).alias("btw"), rule(v, "notBetween", F.lit(20), F.lit(5)).alias("nbtw"),
    )


@register("text_rules", "SELECT p_partkey, contains(lower(p_name), 'an') AS has, NOT contains(lower(p_name), 'an') AS hasnt, lower(p_name) LIKE 'p%' AS begins, lower(p_name) LIKE '%e' AS ends, trim(coalesce(p_name, '')) = '' AS blank FROM part")
def text_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("str")
    return cells(spark, sf_dir).select("p_partkey", text_rule(s, "contains", "AN").alias("has"), text_rule(s, "notContains", "AN").alias("hasnt"), text_rule(s, "begins", "P").alias("begins"), text_rule(s, "ends", "E").alias("ends"), blank_rule(s).alias("blank"))


@register(
    "top_rules",
    """SELECT p_partkey, r <= 10 AS top, rb <= 10 AS bottom, r <= greatest(1, n * 5 // 100) AS top_percent FROM (
    SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS rb, count(*) OVER (PARTITION BY p_brand) AS n FROM part)""",
)
def top_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("num")
    return cells(spark, sf_dir).select("p_partkey", top_n(v, ["block"], 10).alias("top"), top_n(v, ["block"], 10, bottom=True).alias("bottom"), top_n(v, ["block"], 5, percent=True).alias("top_percent"))


@register("average_rules", "SELECT p_partkey, p_size > m AS above, p_size < m AS below, p_size >= m AS above_or_equal FROM (SELECT p_partkey, p_size, avg(p_size) OVER (PARTITION BY p_brand) AS m FROM part)")
def average_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size")
    return cells(spark, sf_dir).select("p_partkey", above_average(v, ["block"]).alias("above"), above_average(v, ["block"], above=False).alias("below"), above_average(v, ["block"], equal=True).alias("above_or_equal"))


@register("repeat_rules", "SELECT p_partkey, n > 1 AS repeated, n = 1 AS once FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, lower(p_name)) AS n FROM part)")
def repeat_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("p_partkey", repeated_values(F.col("str"), ["block"]).alias("repeated"), repeated_values(F.col("str"), ["block"], unique=True).alias("once"))


@register(
    "scale_rules",
    """SELECT p_partkey, printf('%02x%02x%02x', CAST(round(248 + (99 - 248) * f) AS INT), CAST(round(105 + (190 - 105) * f) AS INT), CAST(round(107 + (123 - 107) * f) AS INT)) AS colour, round(0.1 + 0.9 * f, 9) AS bar
    FROM (SELECT p_partkey, CASE WHEN hi = lo THEN 0.0 ELSE (p_size - lo) / CAST(hi - lo AS DOUBLE) END AS f FROM (SELECT p_partkey, p_size, min(p_size) OVER (PARTITION BY p_brand) AS lo, max(p_size) OVER (PARTITION BY p_brand) AS hi FROM part))""",
)
def scale_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size")
    return cells(spark, sf_dir).select("p_partkey", colour_scale(v, ["block"], ["f8696b", "63be7b"]).alias("colour"), F.round(data_bar(v, ["block"]), 9).alias("bar"))


@register("percentile_rule", "SELECT p_brand AS block, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY 1")
def percentile_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by percentile interpolate between values."""
    return cells(spark, sf_dir).groupBy("block").agg(F.round(F.percentile("num", 0.9), 6).alias("p90"))


@register(
    "rule_priorities",
    """WITH h AS (SELECT p_partkey, unnest(['fill', 'fill', 'font']) AS prop, unnest(['red', 'green', 'bold']) AS value, unnest([1, 2, 3]) AS priority, unnest([p_size > 25, false, false]) AS stop FROM part),
    s AS (SELECT *, min(CASE WHEN stop THEN priority END) OVER (PARTITION BY p_partkey) AS s FROM h)
    SELECT p_partkey, prop, min_by(value, priority) AS value FROM s WHERE s IS NULL OR priority <= s GROUP BY 1, 2""",
)
def priorities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = F.col("p_size") > 25
    rules = F.array(*(F.struct(F.lit(p).alias("prop"), F.lit(v).alias("value"), F.lit(n).alias("priority"), s.alias("stop")) for p, v, n, s in (("fill", "red", 1, stops), ("fill", "green", 2, F.lit(False)), ("font", "bold", 3, F.lit(False)))))
    return resolved_looks(cells(spark, sf_dir).select("p_partkey", F.inline(rules)), ["p_partkey"])


@register("table_stripes", "SELECT l_orderkey, l_linenumber, (l_linenumber - 1) // 2 % 2 AS band FROM lineitem")
def table_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.floor((F.col("l_linenumber") - 1) / 2) % 2).cast("int").alias("band"))


@register("upper_median", "SELECT p_brand, list_sort(list(p_retailprice))[len(list(p_retailprice)) // 2 + 1] AS middle FROM part GROUP BY p_brand")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in the middle, the upper one of two; by ranks, so a block needn't fit an array."""
    w = Window.partitionBy("p_brand")
    df = load(spark, sf_dir, "part").select("p_brand", "p_retailprice")
    df = df.withColumns({"r": F.row_number().over(w.orderBy("p_retailprice")), "n": F.count(F.lit(1)).over(w)})
    return df.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("p_brand", F.col("p_retailprice").alias("middle"))


@register("weighted_mode", "SELECT p_brand, min_by(p_type, struct_pack(a := -s, b := p_type)) AS kind FROM (SELECT p_brand, p_type, sum(p_size) AS s FROM part GROUP BY 1, 2) GROUP BY 1")
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value with the largest sum of weights; ties go by the alphabet."""
    sums = load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("s"))
    return sums.groupBy("p_brand").agg(F.min(F.struct((-F.col("s")).alias("o"), "p_type"))["p_type"].alias("kind"))
