from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from leafline.operators import tax


def test_summary_of_three_rows(spark):
    rows = [(D("100000.00"), 0.18, True), (D("50000.00"), 0.18, False), (D("10000.00"), 0.05, False)]
    df = tax.with_tax(spark.createDataFrame(rows, "taxable decimal(18,2), rate double, interstate boolean"), "taxable", "rate", "interstate")
    got = {r["rate"]: (r["igst"], r["cgst"], r["sgst"]) for r in tax.tax_summary(df, "rate").collect()}
    assert got == {0.18: (D("18000.00"), D("4500.00"), D("4500.00")), 0.05: (D("0.00"), D("250.00"), D("250.00"))}


def test_halves_add_up(spark, sf_dir):
    df = tax.with_tax(tax.facts(spark, sf_dir), "taxable", "rate", "interstate")
    assert df.where("tax <> igst + cgst + sgst").count() == 0


def test_inclusive_bill(spark):
    items = spark.createDataFrame([(1, 80.0), (1, 75.0)], "bill int, amount double")
    row = tax.bill_totals(items, "bill", F.lit(0), F.lit(0.05), True).first()
    assert (row["total"], row["tax"]) == (D("155"), D("7.38"))
    row = tax.bill_totals(items, "bill", F.lit(500), F.lit(0.05), False).first()
    assert (row["discount"], row["total"]) == (D("155.00"), D("0"))


def test_codes_and_totals(spark):
    lines = spark.createDataFrame([(1, D("10.00"), 0.1, 0.18), (1, D("0.55"), 0.0, 0.05)], "k int, gross decimal(18,2), discount double, rate double")
    lines = lines.withColumn("discount", F.col("discount").cast("decimal(6,4)")).withColumn("rate", F.col("rate").cast("decimal(6,4)"))
    row = tax.invoice_totals(lines, "k").first()
    assert (row["taxable"], row["tax"], row["total"], row["round_off"]) == (D("9.55"), D("1.65"), D("11"), D("-0.20"))
