"""Cell references, ranges, operands of rules, and names of sheets and files, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType

from leafline.functions.numbers import column_index

CELL, ROW, COLUMN = r"^\$?([A-Za-z]{1,3})\$?([0-9]+)$", r"^\$?([0-9]+)$", r"^\$?([A-Za-z]{1,3})$"
OPERAND = r"^(?:'?[^!']*'?!)?(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)$"
LAST_ROW, LAST_COLUMN = 1_048_575, 16_383


def parse_cell(x: Column) -> Column:
    """A1 or $A$1 to 0-based r and c; null for what isn't a cell."""
    s = F.trim(x)
    return F.when(s.rlike(CELL), F.struct((F.regexp_extract(s, CELL, 2).cast("int") - 1).alias("r"), column_index(F.regexp_extract(s, CELL, 1)).alias("c")))


def parse_range(x: Column) -> Column:
    """A1:C4, A1, $1:$2 (whole rows) or $A:$B (whole columns) to r0, c0, r1, c1, smaller ones first; null for what isn't a range."""
    s = F.trim(x)
    a = F.substring_index(s, ":", 1)
    b = F.when(F.contains(s, F.lit(":")), F.get(F.split(s, ":"), 1)).otherwise(a)
    ca, cb = parse_cell(a), parse_cell(b)
    four = lambda r0, c0, r1, c1: F.struct(r0.cast("int").alias("r0"), c0.cast("int").alias("c0"), r1.cast("int").alias("r1"), c1.cast("int").alias("c1"))
    rows = [F.regexp_extract(v, ROW, 1).cast("int") - 1 for v in (a, b)]
    columns = [column_index(F.regexp_extract(v, COLUMN, 1)) for v in (a, b)]
    return (
        F.when(a.rlike(CELL) & b.rlike(CELL), four(F.least(ca["r"], cb["r"]), F.least(ca["c"], cb["c"]), F.greatest(ca["r"], cb["r"]), F.greatest(ca["c"], cb["c"])))
        .when(a.rlike(ROW) & b.rlike(ROW), four(rows[0], F.lit(0), rows[1], F.lit(LAST_COLUMN)))
        .when(a.rlike(COLUMN) & b.rlike(COLUMN), four(F.lit(0), columns[0], F.lit(LAST_ROW), columns[1]))
    )


def in_range(range_: Column, r: Column, c: Column) -> Column:
    """Whether a cell lies within a range, its edges included."""
    return r.between(range_["r0"], range_["r1"]) & c.between(range_["c0"], range_["c1"])


def operand(formula: Column, range_: Column, r: Column, c: Column) -> Column:
    """A rule's operand: number, text (quoted), or row and column of the cell it refers to from cell r, c of the range; all null for anything else."""
    s = F.regexp_replace(F.trim(formula), "^=", "")
    number, quoted = s.rlike(r"(?i)^-?[0-9]+(\.[0-9]+)?(E[-+]?[0-9]+)?$"), s.rlike('^".*"$')
    cell = parse_cell(F.concat(F.regexp_extract(s, OPERAND, 2), F.regexp_extract(s, OPERAND, 4)))
    refers = ~number & ~quoted & s.rlike(OPERAND)
    down = F.when(F.regexp_extract(s, OPERAND, 3) == "", r - range_["r0"]).otherwise(0)
    right = F.when(F.regexp_extract(s, OPERAND, 1) == "", c - range_["c0"]).otherwise(0)
    return F.struct(
        F.when(number, s.try_cast("double")).alias("number"),
        F.when(quoted, F.replace(F.regexp_extract(s, '^"(.*)"$', 1), F.lit('""'), F.lit('"'))).alias("text"),
        F.when(refers, cell["r"] + down).alias("r"),
        F.when(refers, cell["c"] + right).alias("c"),
    )


@F.pandas_udf(StringType())
def safe_file_name(x: pd.Series) -> pd.Series:
    """Letters without accents, digits, underscores, dots and hyphens, hyphens for white space, at most 60 characters; Spark has no normal forms, so this is by Arrow batches."""
    import re

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        bare = re.sub(r"[^A-Za-z0-9_\s.-]+", "", unicodedata.normalize("NFKD", s)).strip()
        return re.sub(r"\s+", "-", bare)[:60] or "untitled"

    return x.map(one)


@F.pandas_udf(ArrayType(StringType()))
def graphemes(x: pd.Series) -> pd.Series:
    """What people see as single characters: letters with their marks, joined emoji, flags."""
    import regex

    return x.map(lambda s: None if s is None else regex.findall(r"\X", s))


@F.pandas_udf(LongType())
def adler32(x: pd.Series) -> pd.Series:
    """The Adler-32 checksum of bytes (unsigned)."""
    import zlib

    return x.map(lambda b: None if b is None else zlib.adler32(b))


@F.pandas_udf(BinaryType())
def derived_key(password: pd.Series, salt: pd.Series, rounds: pd.Series) -> pd.Series:
    """A key of 32 bytes by PBKDF2 with SHA-256, of 100,000 to 5,000,000 rounds."""
    import hashlib

    # fixed values: the fewest and most rounds
    clamp = lambda n: min(5_000_000, max(100_000, int(n)))
    return pd.Series([hashlib.pbkdf2_hmac("sha256", p.encode(), bytes(s), clamp(n)) for p, s, n in zip(password, salt, rounds, strict=True)])


def sealed(key: Column, data: Column) -> Column:
    """Bytes under AES-GCM: the nonce of 12 bytes, the text, the tag."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def opened(key: Column, data: Column) -> Column:
    """What was sealed; null if the key or the bytes are others."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"))
