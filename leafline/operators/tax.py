"""Tax and invoice aggregates over line items, in exact decimals.

Amounts are rounded per line before they are summed. Each query joins on keys only, so facts shuffle
at most once per join and dimensions go to all tasks where their size lets Spark do so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.plans.registry import register
from leafline.plans.tables import load

MONEY = "decimal(18,2)"


def money(x: Column) -> Column:
    return x.cast(MONEY)


def with_tax(df: DataFrame, taxable: str, rate: str, interstate: str) -> DataFrame:
    """Adds tax, igst, cgst and sgst: all of it IGST across states, else halves that add up."""
    tax = money(F.round(F.col(taxable).cast(MONEY) * F.col(rate).cast("decimal(6,4)"), 2))
    df = df.withColumn("tax", tax)
    half = money(F.round(F.col("tax") * F.lit(0.5).cast("decimal(2,1)"), 2))
    inside = ~F.col(interstate)
    zero = F.lit(0).cast(MONEY)
    return df.withColumns(
        {
            "igst": F.when(inside, zero).otherwise(F.col("tax")),
            "cgst": F.when(inside, half).otherwise(zero),
            "sgst": F.when(inside, money(F.col("tax") - half)).otherwise(zero),
        }
    )


def tax_summary(df: DataFrame, *by: str) -> DataFrame:
    """Sums of taxable and the taxes, and how many lines, for each value of by; ordered by it."""
    sums = [F.sum(c).cast("decimal(28,2)").alias(c) for c in ("taxable", "igst", "cgst", "sgst")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"), *sums)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sold line: rate, taxable, interstate and the keys around it."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    out = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    out = out.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", F.col("l_tax").cast("decimal(6,4)").alias("rate"), money(F.col("l_extendedprice")).alias("taxable"),
        (F.col("c_nationkey") != F.col("s_nationkey")).alias("interstate"), "c_nationkey", "s_nationkey",
    )


FACTS = """
f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, CAST(l_tax AS DECIMAL(6,4)) AS rate, CAST(l_extendedprice AS DECIMAL(18,2)) AS taxable,
    c_nationkey <> s_nationkey AS interstate, c_nationkey, s_nationkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
t0 AS (SELECT *, CAST(round(taxable * rate, 2) AS DECIMAL(18,2)) AS tax FROM f),
t1 AS (SELECT *, CAST(round(tax * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS half FROM t0),
t AS (SELECT *, CASE WHEN interstate THEN tax ELSE 0 END AS igst, CASE WHEN interstate THEN 0 ELSE half END AS cgst, CASE WHEN interstate THEN 0 ELSE tax - half END AS sgst FROM t1)
"""
SUMS = "count(*) AS lines, CAST(sum(taxable) AS DECIMAL(28,2)) AS taxable, CAST(sum(igst) AS DECIMAL(28,2)) AS igst, CAST(sum(cgst) AS DECIMAL(28,2)) AS cgst, CAST(sum(sgst) AS DECIMAL(28,2)) AS sgst"


@register("tax_by_rate", f"WITH {FACTS} SELECT rate, {SUMS} FROM t GROUP BY rate ORDER BY rate")
def tax_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tax_summary(with_tax(facts(spark, sf_dir), "taxable", "rate", "interstate"), "rate").orderBy("rate")


@register("tax_by_rate_with_total", f"WITH {FACTS} SELECT rate, grouping(rate) = 1 AS is_total, {SUMS} FROM t GROUP BY ROLLUP (rate)")
def tax_by_rate_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grand total beside the groups."""
    df = with_tax(facts(spark, sf_dir), "taxable", "rate", "interstate")
    sums = [F.sum(c).cast("decimal(28,2)").alias(c) for c in ("taxable", "igst", "cgst", "sgst")]
    return df.rollup("rate").agg((F.grouping("rate") == 1).alias("is_total"), F.count(F.lit(1)).alias("lines"), *sums)


@register(
    "invoice_totals",
    f"""WITH {FACTS},
    l AS (SELECT *, CAST(round(taxable * (1 - CAST(l_discount AS DECIMAL(6,4))), 2) AS DECIMAL(18,2)) AS net FROM f),
    x AS (SELECT *, CAST(round(net * rate, 2) AS DECIMAL(18,2)) AS tax FROM l),
    s AS (SELECT l_orderkey, sum(net) AS taxable, sum(tax) AS tax FROM x GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(taxable AS DECIMAL(28,2)) AS taxable, CAST(tax AS DECIMAL(28,2)) AS tax, CAST(round(taxable + tax, 0) AS DECIMAL(28,0)) AS total,
      CAST(round(taxable + tax, 0) - (taxable + tax) AS DECIMAL(28,2)) AS round_off FROM s""",
)
def invoice_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = facts(spark, sf_dir).select(F.col("l_orderkey"), F.col("taxable").alias("gross"), F.col("l_discount").cast("decimal(6,4)").alias("discount"), "rate")
    return invoice_totals(lines, "l_orderkey")


def invoice_totals(lines: DataFrame, key: str) -> DataFrame:
    """lines: key, gross, discount and rate (fractions). Totals in whole units and what rounding added."""
    lines = lines.withColumn("net", money(F.round(F.col("gross") * (F.lit(1).cast("decimal(6,4)") - F.col("discount")), 2)))
    lines = lines.withColumn("tax", money(F.round(F.col("net") * F.col("rate"), 2)))
    out = lines.groupBy(key).agg(F.sum("net").cast("decimal(28,2)").alias("taxable"), F.sum("tax").cast("decimal(28,2)").alias("tax"))
    exact = (F.col("taxable") + F.col("tax")).cast("decimal(28,2)")
    return out.withColumn("total", F.round(exact, 0).cast("decimal(28,0)")).withColumn("round_off", (F.col("total") - exact).cast("decimal(28,2)"))


@register("code_summary", f"WITH {FACTS} SELECT coalesce(nullif(p_type, ''), '-') AS code, rate, {SUMS} FROM t JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-key summary: commodity code (- where there is none) and rate."""
    df = with_tax(facts(spark, sf_dir), "taxable", "rate", "interstate")
    parts = load(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif("p_type", F.lit("")), F.lit("-")).alias("code"))
    return tax_summary(df.join(parts, F.col("l_partkey") == F.col("p_partkey")), "code", "rate")


def bill_totals(items: DataFrame, key: str, discount: Column, rate: Column, inclusive: bool) -> DataFrame:
    """items: key, amount. Flat discount up to the subtotal; the tax is within the price or on top of it."""
    out = items.groupBy(key).agg(F.sum(money(F.col("amount"))).cast(MONEY).alias("subtotal"))
    out = out.withColumn("discount", F.least("subtotal", discount.cast(MONEY)))
    base = (F.col("subtotal") - F.col("discount")).cast(MONEY)
    rate = rate.cast("decimal(6,4)")
    if inclusive:
        tax = money(F.round(base - base / (F.lit(1).cast("decimal(6,4)") + rate), 2))
        return out.withColumn("tax", tax).withColumn("total", F.round(base, 0).cast("decimal(18,0)"))
    return out.withColumn("tax", money(F.round(base * rate, 2))).withColumn("total", F.round(base + F.col("tax"), 0).cast("decimal(18,0)"))


@register(
    "till_bills",
    """WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS subtotal FROM lineitem GROUP BY 1),
    d AS (SELECT *, least(subtotal, CAST(5000 AS DECIMAL(18,2))) AS discount FROM s),
    x AS (SELECT *, CAST(round((subtotal - discount) * CAST(0.05 AS DECIMAL(6,4)), 2) AS DECIMAL(18,2)) AS tax FROM d)
    SELECT l_orderkey, subtotal, discount, tax, CAST(round(subtotal - discount + tax, 0) AS DECIMAL(18,0)) AS total FROM x""",
)
def till_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("amount"))
    return bill_totals(items, "l_orderkey", F.lit(5000), F.lit(0.05), False)


@register(
    "supply_kind",
    """SELECT c_custkey, CASE WHEN length(g) = 15 THEN 'B2B' ELSE 'B2C' END AS kind, c_nationkey IS NOT NULL AND c_nationkey <> 7 AS interstate
    FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 15, '0') ELSE CAST(c_custkey AS VARCHAR) END AS g FROM customer)
    WHERE trim(c_name) <> '' OR c_acctbal <> 0""",
)
def supply_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row validity, business or consumer by the tax number's length, and the inter-state flag against a home state."""
    g = F.when(F.col("c_custkey") % 3 == 0, F.lpad(F.col("c_custkey").cast("string"), 15, "0")).otherwise(F.col("c_custkey").cast("string"))
    df = load(spark, sf_dir, "customer").where((F.trim("c_name") != "") | (F.col("c_acctbal") != 0))
    return df.select("c_custkey", F.when(F.length(g) == 15, "B2B").otherwise("B2C").alias("kind"), (F.col("c_nationkey").isNotNull() & (F.col("c_nationkey") != 7)).alias("interstate"))


@register(
    "place_of_supply",
    """SELECT s_suppkey, coalesce(n_name, '') AS place FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20""",
)
def place_of_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State lookup; an unknown code gives an empty name."""
    nation = load(spark, sf_dir, "nation").where("n_nationkey < 20")
    return load(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("place"))


@register(
    "prefix_lookup",
    """SELECT c_custkey, min(n_name) AS state FROM customer LEFT JOIN nation ON lower(c_mktsegment[1:2]) = lower(n_name[1:2]) GROUP BY c_custkey""",
)
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup by a case-insensitive prefix, as an equality join on the prefix."""
    nation = load(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("k"), "n_name")
    firsts = nation.groupBy("k").agg(F.min("n_name").alias("state"))
    return load(spark, sf_dir, "customer").withColumn("k", F.lower(F.substring("c_mktsegment", 1, 2))).join(firsts, "k", "left").select("c_custkey", "state")
