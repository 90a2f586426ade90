"""Checksums of identifiers as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplication and permutation tables of Verhoeff's scheme (dihedral group of order ten).
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_FIRST = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def verhoeff_p() -> list[list[int]]:
    """Each row applies the first permutation once more."""
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_FIRST[x] for x in rows[-1]])
    return rows


def ints(table: list[list[int]]) -> Column:
    return F.array(*(F.lit(x) for row in table for x in row))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", digits_of(x))


def verhoeff(x: Column) -> Column:
    d, p = ints(VERHOEFF_D), ints(verhoeff_p())
    digits = F.transform(F.filter(F.split(F.reverse(digits_of(x)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    steps = F.transform(digits, lambda c, i: F.get(p, (i % 8) * 10 + c))
    return F.aggregate(steps, F.lit(0), lambda c, v: F.get(d, c * 10 + v)) == 0


def iban(x: Column) -> Column:
    """Length 15 to 34 and remainder 1 modulo 97 of the number that the moved letters make."""
    s = F.upper(F.regexp_replace(x, r"\s+", ""))
    moved = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0).cast("long"), lambda r, c: F.when(c.rlike("[A-Z]"), (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97))
    return F.length(s).between(15, 34) & s.rlike("^[A-Z0-9]+$") & (rest == 1)


def gstin(x: Column) -> Column:
    """Shape and the base-36 check character of a tax number of 15 characters."""
    s = F.upper(F.trim(x))
    value = lambda i: (F.instr(F.lit(BASE36), F.substr(s, i, F.lit(1))) - 1) * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda t, i: t + F.floor(value(i) / 36).cast("int") + value(i) % 36)
    check = F.substr(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1))
    return s.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$") & (check == F.substr(s, F.lit(15), F.lit(1)))
