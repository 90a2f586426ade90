"""Numbers, dates and references read from and written as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
TENS = "Zero Ten Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
MONTHS = "january february march april may june july august september october november december".split()
CURRENCY = r"(?:₹|Rs\.?|INR|\$|US\$|USD|€|EUR|£|GBP)"


def excel_serial(d: Column) -> Column:
    return F.datediff(d, F.lit("1899-12-30").cast("date"))


def indian_grouping(x: Column) -> Column:
    """12,34,567.80"""
    s = F.format_string("%.2f", F.abs(x).cast("double"))
    whole, part = F.substring_index(s, ".", 1), F.substring_index(s, ".", -1)
    last, rest = F.right(whole, F.lit(3)), F.left(whole, F.greatest(F.length(whole) - 3, F.lit(0)))
    grouped = F.regexp_replace(rest, r"\B(?=(\d{2})+(?!\d))", ",")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(rest == "", last).otherwise(F.concat(grouped, F.lit(","), last)), F.lit("."), part)


def word_of(words: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def below_hundred(n: Column) -> Column:
    tens, ones = F.floor(n / 10), n % 10
    return F.when(n < 20, word_of(ONES, n)).otherwise(F.concat(word_of(TENS, tens), F.when(ones > 0, F.concat(F.lit(" "), word_of(ONES, ones))).otherwise("")))


def amount_in_words(x: Column) -> Column:
    """Rupees and paise by crore, lakh, thousand and hundred; below a hundred crore."""
    cents = F.round(F.abs(x).cast("decimal(18,2)") * 100, 0).cast("long")
    n, paise = F.floor(cents / 100), cents % 100
    part = lambda v, name: F.when(v > 0, F.concat(below_hundred(v), F.lit(f" {name}")))
    rest = n % 100
    said = F.concat_ws(" ", part(F.floor(n / 10_000_000), "Crore"), part(F.floor(n % 10_000_000 / 100_000), "Lakh"), part(F.floor(n % 100_000 / 1000), "Thousand"), part(F.floor(n % 1000 / 100), "Hundred"), F.when(rest > 0, below_hundred(rest)))
    said = F.when(n == 0, "Zero").otherwise(said)
    cents_said = F.when(paise > 0, F.concat(F.lit(" and "), below_hundred(paise), F.lit(" Paise"))).otherwise("")
    return F.concat(F.when(x < 0, "Minus ").otherwise(""), said, F.when(n == 1, " Rupee").otherwise(" Rupees"), cents_said, F.lit(" Only"))


def roman(n: Column) -> Column:
    """1 to 3999 in roman numerals, others in digits."""
    pairs = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN))
    start = F.struct(n.cast("int").alias("n"), F.lit("").alias("s"))
    step = lambda a, p: F.struct((a["n"] % p["v"]).alias("n"), F.concat(a["s"], F.repeat(p["s"], F.floor(a["n"] / p["v"]).cast("int"))).alias("s"))
    return F.when(n.between(1, 3999), F.aggregate(pairs, start, step, lambda a: a["s"])).otherwise(n.cast("string"))


def roman_value(x: Column) -> Column:
    """The number that a roman numeral stands for."""
    digit = lambda c: F.element_at(F.create_map(*(y for v, s in ROMAN if len(s) == 1 for y in (F.lit(s), F.lit(v)))), c)
    values = F.transform(F.filter(F.split(F.upper(x), ""), lambda c: c != ""), digit)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum"))
    step = lambda a, v: F.struct(v.alias("last"), (a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"))
    return F.aggregate(values, start, step, lambda a: a["sum"])


def column_letters(i: Column) -> Column:
    """0 is A, 26 is AA; for sheets' columns, so three letters are enough."""
    letter = lambda v: F.char((v + 65).cast("long"))
    one, two = i - 26, i - 702
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor(one / 26)), letter(one % 26))).otherwise(F.concat(letter(F.floor(two / 676)), letter(F.floor(two / 26) % 26), letter(two % 26)))


def column_index(x: Column) -> Column:
    return F.aggregate(F.filter(F.split(F.upper(x), ""), lambda c: c != ""), F.lit(0), lambda t, c: t * 26 + F.ascii(c) - 64) - 1


def cell_reference(row: Column, column: Column) -> Column:
    """0-based places to A1."""
    return F.concat(column_letters(column), (row + 1).cast("string"))


def byte_size(n: Column) -> Column:
    """B, KB, MB or GB; one decimal below ten of a unit."""
    unit = lambda k, name: F.concat(F.when(n / k < 10, F.format_string("%.1f", n / k)).otherwise(F.format_string("%.0f", n / k)), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, "KB")).when(n < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))


def parse_number(raw: Column, decimal: str = ".") -> Column:
    """The value of a number as people write it, null for what isn't one.

    Signs, brackets, a trailing minus, Cr and Dr, currency and percent in any order around digits with
    or without grouping. Codes (a leading zero, twelve digits and more without decimals) stay text.
    """
    s = F.translate(F.trim(raw), "    −‒–", "    ---")
    ok = F.length(s).between(1, 40) & s.rlike("[0-9]")
    debit = s.rlike(r"(?i)[0-9)%\s]\s*dr\.?$")
    s = F.regexp_replace(s, r"(?i)(?<![A-Za-z])\s*(?:cr|dr)\.?$", "")
    bracket = s.rlike(r"^\(.*\)$")
    s = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    bare = F.regexp_replace(s, rf"(?i)^[\s]*(?:[-+]?\s*{CURRENCY}\s*[-+]?|[-+])\s*", "")
    minus = s.rlike(rf"(?i)^\s*(?:{CURRENCY}\s*)?-") | s.rlike(r"-\s*%?$")
    percent = bare.rlike(r"%\s*-?$")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s*[%-]+\s*$", "")), rf"(?i)\s*{CURRENCY}$", "")
    group, point = (",", r"\.") if decimal == "." else ("[. ]", ",")
    lakhs = r"|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}" if decimal == "." else ""
    shape = rf"^(?:[0-9]{{1,3}}(?:{group}[0-9]{{3}})+{lakhs}|[0-9]+)?(?:{point}[0-9]+)?$"
    whole = F.regexp_extract(bare, r"^([0-9., ]*?)(?:" + point + r"[0-9]+)?$", 1)
    digits = F.regexp_replace(whole, "[^0-9]", "")
    fraction = F.regexp_extract(bare, point + r"([0-9]+)$", 1)
    fraction = F.when(bare.rlike(rf"^[0-9]{{1,3}}(?:{group}[0-9]{{3}})+$") & (F.lit(decimal) == ","), "").otherwise(fraction)
    code = (whole == digits) & ((F.length(digits) > 1) & digits.startswith("0") | (F.length(digits) >= 12) & (fraction == ""))
    text = F.concat(F.when(digits == "", "0").otherwise(digits), F.lit("."), F.when(fraction == "", "0").otherwise(fraction), F.when(percent, "e-2").otherwise(""))
    value = F.when(bracket | minus | debit, -text.cast("double")).otherwise(text.cast("double"))
    both = percent & s.rlike(rf"(?i){CURRENCY}")  # an amount of money is no percentage
    return F.when(ok & bare.rlike(shape) & bare.rlike("[0-9]") & ~code & ~both, value)


def month_number(name: Column) -> Column:
    """Of a month's name or the first letters of one, three at least; null if it isn't one."""
    k = F.regexp_replace(F.lower(name), r"\.$", "")
    k = F.when(k == "sept", "sep").otherwise(k)
    found = F.coalesce(*(F.when(F.lit(m).startswith(k), i) for i, m in enumerate(MONTHS, 1)))
    return F.when(F.length(k) >= 3, found)


def parse_date(raw: Column, order: Column) -> Column:
    """The date that a text is: ISO, numeric in the given order (dmy or mdy; null leaves it text), or with a month's name. 1900 to 2200."""
    s = F.regexp_replace(F.trim(raw), r"\s+", " ")
    take = lambda p, i: F.regexp_extract(s, p, i)
    number = lambda p, i: take(p, i).try_cast("int")
    full = lambda y: F.when(F.length(y) == 2, F.when(y.try_cast("int") < 50, 2000).otherwise(1900) + y.try_cast("int")).otherwise(y.try_cast("int"))
    iso, numeric = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})$"
    day_first, month_first = r"^([0-9]{1,2})([ -])([A-Za-z]{3,9})\.?\2([0-9]{4}|[0-9]{2})$", r"^([A-Za-z]{3,9})\.? ([0-9]{1,2}),? ([0-9]{4})$"
    a, b = number(numeric, 1), number(numeric, 3)
    dmy = order == "dmy"
    y = F.when(s.rlike(iso), number(iso, 1)).when(s.rlike(numeric), full(take(numeric, 4))).when(s.rlike(day_first), full(take(day_first, 4))).when(s.rlike(month_first), number(month_first, 3))
    m = F.when(s.rlike(iso), number(iso, 2)).when(s.rlike(numeric), F.when(dmy, b).when(order == "mdy", a)).when(s.rlike(day_first), month_number(take(day_first, 3))).when(s.rlike(month_first), month_number(take(month_first, 1)))
    d = F.when(s.rlike(iso), number(iso, 3)).when(s.rlike(numeric), F.when(dmy, a).when(order == "mdy", b)).when(s.rlike(day_first), number(day_first, 1)).when(s.rlike(month_first), number(month_first, 2))
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when((F.length(s) <= 24) & y.between(1900, 2200) & m.between(1, 12) & d.between(1, 31), text.try_cast("date"))
