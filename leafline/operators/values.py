"""Typing of recovered table values: the document's way with numbers and dates, then each cell; and identifiers' checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import numbers as N
from leafline.functions import text as T
from leafline.functions import validators as V
from leafline.plans.registry import register
from leafline.plans.tables import load


def locale_vote(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """For each key: decimal (a point, or a comma where such numbers are more) and dates (dmy or mdy at five to one, else null)."""
    t = F.col(text)
    us = F.regexp_count(t, F.lit(r"[0-9],[0-9]{3}\.[0-9]|(?:^|[^0-9.,])[0-9]+\.[0-9]{2}(?![0-9.,])"))
    eu = F.regexp_count(t, F.lit(r"[0-9]\.[0-9]{3},[0-9]|(?:^|[^0-9.,])[0-9]+,[0-9]{2}(?![0-9.,])"))
    date = r"(?:^|[^0-9/.-])([0-9]{1,2})([/.-])([0-9]{1,2})\2(?:[0-9]{2}|[0-9]{4})(?![0-9/.-])"
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(date), 1).alias("a"), F.regexp_extract_all(t, F.lit(date), 3).alias("b"))
    day = lambda x: (x.cast("int") > 12) & (x.cast("int") <= 31)
    low = lambda x: x.cast("int") <= 12
    dmy = F.size(F.filter(pairs, lambda p: day(p["a"]) & low(p["b"])))
    mdy = F.size(F.filter(pairs, lambda p: day(p["b"]) & low(p["a"])))
    sums = df.groupBy(*key).agg(F.sum(us).alias("us"), F.sum(eu).alias("eu"), F.sum(dmy).alias("d"), F.sum(mdy).alias("m"))
    dates = F.when((F.col("d") > 0) & (F.col("d") >= 5 * F.col("m")), "dmy").when((F.col("m") > 0) & (F.col("m") >= 5 * F.col("d")), "mdy")
    return sums.select(*key, F.when(F.col("eu") > F.col("us"), ",").otherwise(".").alias("decimal"), dates.alias("dates"))


def typed(raw: Column, decimal: Column, order: Column) -> list[Column]:
    """A cell as date, number or text, the first that fits."""
    date = N.parse_date(raw, order)
    number = F.when(decimal == ",", N.parse_number(raw, ",")).otherwise(N.parse_number(raw, "."))
    return [date.alias("date"), F.when(date.isNull(), number).alias("number"), F.when(date.isNull() & number.isNull(), raw).alias("text")]


#: Amounts of orders as people write them, by order number.
WRITTEN = (
    """case o_orderkey % 8
    when 0 then format_number(o_totalprice, 2) when 1 then concat('(', cast(cast(o_totalprice as decimal(18,2)) as string), ')')
    when 2 then concat('₹ ', format_number(o_totalprice, 2)) when 3 then concat(cast(o_orderkey % 100 as string), '.5%')
    when 4 then concat('000', cast(o_orderkey as string)) when 5 then concat(cast(cast(o_totalprice as decimal(18,2)) as string), ' Dr')
    when 6 then concat(cast(cast(o_totalprice as decimal(18,2)) as string), '-') else concat('item ', cast(o_orderkey as string)) end"""
)


@register(
    "typed_numbers",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN -round(o_totalprice, 2) WHEN 2 THEN round(o_totalprice, 2) WHEN 3 THEN round((o_orderkey % 100 + 0.5) / 100, 6)
    WHEN 5 THEN -round(o_totalprice, 2) WHEN 6 THEN -round(o_totalprice, 2) END AS number FROM orders""",
)
def typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in eight ways and read back; SQL takes them from the column."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(WRITTEN).alias("raw"))
    return df.select("o_orderkey", N.parse_number(F.col("raw")).alias("number"))


@register("typed_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways, and none; SQL takes them from the column."""
    raw = F.expr(
        """case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd/MM/yyyy') when 2 then date_format(o_orderdate, 'd MMM yyyy')
        when 3 then date_format(o_orderdate, 'MMMM d, yyyy') else concat('no date ', o_orderkey) end"""
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", N.parse_date(raw, F.lit("dmy")).alias("date"))


@register(
    "locale_vote",
    """SELECT o_orderpriority, '.' AS "decimal", 'dmy' AS dates FROM orders GROUP BY 1""",
)
def locale_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("concat('on ', date_format(o_orderdate, 'dd/MM/yyyy'), ' paid ', format_number(o_totalprice, 2))")
    return locale_vote(load(spark, sf_dir, "orders").select("o_orderpriority", raw.alias("t")), ["o_orderpriority"], "t")


@register("excel_serials", "SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial FROM orders")
def excel_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", N.excel_serial(F.to_date("o_orderdate")).alias("serial"))


@register("card_checks", """WITH c AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS body FROM orders),
    d AS (SELECT o_orderkey, body, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(body[-i] AS INT) * 2 > 9 THEN CAST(body[-i] AS INT) * 2 - 9 ELSE CAST(body[-i] AS INT) * 2 END ELSE CAST(body[-i] AS INT) END)) AS s FROM c)
    SELECT o_orderkey, (10 - s % 10) % 10 = o_orderkey % 10 AS ok FROM d""")
def card_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers whose last digit is a guess: the check must agree with the digit computed in SQL."""
    number = F.expr("concat('4', lpad(cast(o_orderkey as string), 14, '0'), cast(o_orderkey % 10 as string))")
    return load(spark, sf_dir, "orders").select("o_orderkey", V.luhn(number).alias("ok"))


@register("iban_checks", """SELECT s_suppkey, CAST(lpad(CAST(s_suppkey AS VARCHAR), 18, '0') || '131400' AS HUGEINT) % 97 = (98 - 50) % 97 AS ok FROM supplier""")
def iban_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers under check digits 50: right where the remainder modulo 97 is what these digits stand for."""
    code = F.concat(F.lit("DE50"), F.lpad(F.col("s_suppkey").cast("string"), 18, "0"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", V.iban(code).alias("ok"))


@register("verhoeff_checks")
def verhoeff_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of permutations have no short SQL; tests/ compares with a plain loop."""
    return load(spark, sf_dir, "orders").select("o_orderkey", V.verhoeff(F.concat(F.lit("23"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))).alias("ok"))


@register("tax_number_checks")
def tax_number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lpad((F.col("c_custkey") % 38 + 1).cast("string"), 2, "0"), F.lit("AAPFU"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z"), F.upper(F.conv(F.col("c_custkey") % 36, 10, 36)))
    return load(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), V.gstin(number).alias("ok"))


@register("indian_amounts", r"""WITH s AS (SELECT o_orderkey, printf('%.2f', round(o_totalprice * 100, 2)) AS s FROM orders), p AS (SELECT o_orderkey, split_part(s, '.', 1) AS w, split_part(s, '.', 2) AS d FROM s),
    r AS (SELECT *, CASE WHEN length(w) > 3 THEN w[1:length(w) - 3] ELSE '' END AS rest, right(w, 3) AS last FROM p)
    SELECT o_orderkey, CASE WHEN rest = '' THEN last ELSE trim(reverse(regexp_replace(reverse(rest), '(..)', '\1,', 'g')), ',') || ',' || last END || '.' || d AS amount FROM r""")
def indian_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", N.indian_grouping(F.round(F.col("o_totalprice") * 100, 2)).alias("amount"))


@register("amounts_in_words")
def amounts_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", N.amount_in_words(F.col("o_totalprice")).alias("said"))


@register("roman_round_trip", "SELECT p_partkey, true AS same FROM part")
def roman_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 3999 + 1).cast("int")
    return load(spark, sf_dir, "part").select("p_partkey", (N.roman_value(N.roman(n)) == n).alias("same"))


@register("cell_references", "SELECT p_partkey, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INT)) WHEN i < 702 THEN chr(CAST(65 + (i - 26) // 26 AS INT)) || chr(CAST(65 + (i - 26) % 26 AS INT)) ELSE chr(CAST(65 + (i - 702) // 676 AS INT)) || chr(CAST(65 + (i - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (i - 702) % 26 AS INT)) END || p_size AS ref, true AS same FROM (SELECT p_partkey, p_size, p_partkey % 16000 AS i FROM part)")
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey") % 16000
    return load(spark, sf_dir, "part").select("p_partkey", N.cell_reference(F.col("p_size") - 1, i).alias("ref"), (N.column_index(N.column_letters(i)) == i).alias("same"))


SIZED = "CASE WHEN n / {0} < 10 THEN printf('%.1f', floor(n / {0} * 10 + 0.5) / 10) ELSE CAST(CAST(floor(n / {0} + 0.5) AS BIGINT) AS VARCHAR) END"


@register("byte_sizes", f"SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {SIZED.format('1024.0')} || ' KB' ELSE {SIZED.format('1048576.0')} || ' MB' END AS size FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders)")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", N.byte_size(F.col("o_orderkey") * 37).alias("size"))


@register("small_strings", r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(p_name || '.v' || p_size || '.pdf', '[.][^.]*$', '') AS stem,
    replace(replace(replace('<' || p_name || ' & "x">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, trim(regexp_replace(p_brand || ':' || p_name, '[\[\]:*?/\\]', ' ', 'g'))[1:31] AS sheet FROM part""")
def small_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    escaped = F.replace(T.escape_html(F.concat(F.lit("<"), name, F.lit(' & "x">'))), F.lit("&quot;"), F.lit('"'))
    stem = T.file_stem(F.concat(name, F.lit(".v"), F.col("p_size").cast("string"), F.lit(".pdf")))
    return load(spark, sf_dir, "part").select("p_partkey", T.slugify(name).alias("slug"), stem.alias("stem"), escaped.alias("escaped"), T.sheet_name(F.concat("p_brand", F.lit(":"), name)).alias("sheet"))


@register("file_kinds", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'word' WHEN 3 THEN 'excel' ELSE 'other' END AS kind FROM documents")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.element_at(F.array(*map(F.lit, (".PDF", ".jpeg", ".docx", ".xlsx", ".bin"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return load(spark, sf_dir, "documents").select("doc_id", file_kind(name).alias("kind"))


# The kinds of files by extension, the first that fits.
FILE_KINDS = [
    ("pdf", "pdf"),
    ("image", "png|jpe?g|webp|gif|bmp|tiff?|heic|avif|svg"),
    ("word", "docx?|odt|rtf"),
    ("excel", "xlsx?|xlsm|ods"),
    ("powerpoint", "pptx?|odp"),
    ("html", "html?"),
    ("markdown", "md|markdown"),
    ("csv", "csv|tsv"),
    ("text", "txt"),
    ("epub", "epub"),
    ("audio", "mp3|wav|m4a|ogg|webm"),
]


def file_kind(name: Column) -> Column:
    out = F.lit("other")
    for kind, ends in reversed(FILE_KINDS):
        out = F.when(F.lower(name).rlike(rf"\.(?:{ends})$"), kind).otherwise(out)
    return out


@register("roman_numerals", "WITH RECURSIVE r AS (SELECT p_partkey, CAST(p_partkey % 3999 + 1 AS INT) AS n, '' AS s, 1 AS k FROM part UNION ALL SELECT p_partkey, n % v[k], s || repeat(t[k], n // v[k]), k + 1 FROM r, (SELECT [1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1] AS v, ['M', 'CM', 'D', 'CD', 'C', 'XC', 'L', 'XL', 'X', 'IX', 'V', 'IV', 'I'] AS t) WHERE k <= 13) SELECT p_partkey, s AS roman, CAST(p_partkey % 3999 + 1 AS INT) AS value FROM r WHERE k = 14")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in roman numerals, and read back."""
    df = load(spark, sf_dir, "part").select("p_partkey", N.roman((F.col("p_partkey") % 3999 + 1).cast("int")).alias("roman"))
    return df.select("p_partkey", "roman", N.roman_value(F.col("roman")).alias("value"))
