"""Numbers as sheets show them: format codes with sections, conditions, placeholders, grouping and dates.

A code is parsed once and kept; values go by in Arrow batches, as the code is a column like the value is.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GENERAL_ROOM = 11
CONDITION = re.compile(r"\[(<=|>=|<>|<|>|=)\s*(-?[0-9.]+)\]")
BRACKETS = re.compile(r"\[[^\]]*\]")
TESTS = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__, "<>": float.__ne__}
PIECE = re.compile(r'"([^"]*)"?|\\(.)|(_.)|(\*.)|\[([^\]]*)\]?|([0#?][0#?.,]*|\.[0#?]+)|(%)|(.)', re.DOTALL)
DATE_PIECE = re.compile(r'"([^"]*)"?|\\(.)|_(.)|\*(.)|\[(h+|m+|s+)\]|\[[^\]]*\]|(AM/PM|A/P)|(y+|m+|d+|h+|s+(?:\.0+)?)|(.)', re.IGNORECASE | re.DOTALL)
DAY_ZERO, DAY_ZERO_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
LAST_SERIAL = 2_958_466
NAMES = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


@lru_cache(4096)
def sections(code: str) -> tuple[str, ...]:
    """A code's sections: cut at semicolons outside of quotes, brackets and escapes."""
    out, now = [], ""
    for m in re.finditer(r'\\.|"[^"]*"?|\[[^\]]*\]?|.', code, re.DOTALL):
        if m[0] == ";":
            out.append(now)
            now = ""
        else:
            now += m[0]
    return (*out, now)


def holds(section: str, v: float) -> bool | None:
    """Whether a section's condition holds; None if it has none."""
    m = CONDITION.search(section)
    return None if m is None else TESTS[m[1]](float(v), float(m[2]))


def pick(parts: tuple[str, ...], v: float) -> tuple[str, float]:
    """The section that shows a number, and the number it shows: a section for negatives carries the sign itself."""
    if any(CONDITION.search(s) for s in parts):
        if holds(parts[0], v):
            return parts[0], v
        if len(parts) > 1 and holds(parts[1], v):
            return parts[1], abs(v)
        if len(parts) > 2:
            return parts[2], abs(v)
        return (parts[1], abs(v)) if len(parts) == 2 and holds(parts[1], v) is None else (parts[0], v)
    if len(parts) == 1 or v > 0 or (v == 0 and len(parts) < 3):
        return parts[0], v
    return (parts[1], -v) if v < 0 else (parts[2], v)


def fixed(v: float, places: int) -> str:
    """Half away from zero on the exact binary value."""
    return format(Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP), "f")


def without_zeros(s: str) -> str:
    return s.rstrip("0").rstrip(".") if "." in s else s


def general(v: float, room: int = GENERAL_ROOM) -> str:
    """A number without a format, in at most room characters: plain, or with an exponent where that shows more."""
    if not math.isfinite(v):
        return "#NUM!"
    if v == 0:
        return "0"
    sign, a = "-" * (v < 0), abs(v)
    space = max(1, room - len(sign))
    whole = max(1, math.floor(math.log10(a)) + 1)
    plain = power = None
    if whole <= space:
        s = without_zeros(fixed(a, max(0, space - whole - 1)))
        plain = s if len(s) <= space and float(s) else None
    for places in range(max(0, space - 6), -1, -1):
        mantissa, exponent = f"{a:.{places}e}".split("e")
        s = f"{without_zeros(mantissa)}E{'-' if int(exponent) < 0 else '+'}{abs(int(exponent)):02}"
        if len(s) <= space:
            power = s
            break
    shown = lambda s: len(s.replace(".", "").strip("0"))
    if plain is not None and (a >= 1 or power is None or shown(plain) >= shown(power.split("E")[0])):
        return sign + plain
    return sign + power if power else "#" * max(1, room)


def grouped(digits: str, indian: bool) -> str:
    if indian and len(digits) > 3:
        return re.sub(r"\B(?=([0-9]{2})+$)", ",", digits[:-3]) + "," + digits[-3:]
    return digits if indian else re.sub(r"\B(?=([0-9]{3})+$)", ",", digits)


def placeholders(pattern: str, v: float) -> str:
    """The digits of v (0 or more) under one block of 0, #, ?, commas and a point."""
    whole, point, part = pattern.partition(".")
    marks, decimals = re.sub("[^0#?]", "", whole), re.sub("[^0#?]", "", part)
    text, _, after = fixed(v, len(decimals)).partition(".")
    shown = list(after)
    for k in range(len(decimals) - 1, -1, -1):
        if shown[k] != "0" or decimals[k] == "0":
            break
        if decimals[k] == "#":
            shown.pop()
        else:
            shown[k] = " "
    least, spaces = marks.count("0"), marks.count("?")
    text = "" if text == "0" and not least else text.rjust(least, "0")
    if re.search("[0#?],[0#?]", whole):
        text = grouped(text, bool(re.search("[0#?],[0#?]{2},[0#?]{3}$", whole)))
    return text.rjust(least + spaces) + point + "".join(shown)


def plain_number(section: str, v: float) -> str | None:
    """A number under literals around one block of digit placeholders; None for codes of another kind (dates, text, fractions, exponents)."""
    out: list[str | None] = []
    block, percents = None, 0
    for quoted, escaped, pad, fill, bracket, digits, percent, other in PIECE.findall(section):
        if digits:
            if block is not None:
                return None
            block = digits
            out.append(None)
        elif percent:
            percents += 1
            out.append("%")
        elif bracket:
            if re.fullmatch("h+|m+|s+", bracket, re.IGNORECASE):
                return None
            if bracket.startswith("$"):
                out.append(bracket[1:].split("-")[0])
        elif pad:
            out.append(" ")
        elif fill:
            continue
        elif other and other in "ymdhsEe/@AaGg":
            return None
        else:
            out.append(quoted or escaped or other)
    if block is None:
        return None
    pattern = block.rstrip(",")
    x = abs(v) / 1000 ** (len(block) - len(pattern)) * 100**percents
    if pattern.count(".") > 1:
        return None
    text = placeholders(pattern, x)
    return ("-" if v < 0 else "") + "".join(text if p is None else p for p in out)


def spread(section: str, v: float) -> str | None:
    """A whole number dealt out from the right over several blocks of placeholders with literals between, as telephone numbers have them."""
    if re.search(r"[.%]", re.sub(r'"[^"]*"?|\\.|\[[^\]]*\]?', "", section)):
        return None
    out, digits = [], list(fixed(abs(v), 0).lstrip("0"))
    pieces = [(c, True) if d else (c, False) for q, e, pad, fill, b, d, _, o in PIECE.findall(section) for c in (d.replace(",", "") if d else [" " if pad else "" if fill or b else q or e or o])]
    first = next((k for k, (_, mark) in enumerate(pieces) if mark), None)
    if first is None:
        return None
    for k in range(len(pieces) - 1, -1, -1):
        c, mark = pieces[k]
        if not mark:
            out.append(c)
        elif k == first and digits:
            out.append("".join(digits))
        else:
            out.append(digits.pop() if digits else {"0": "0", "?": " "}.get(c, ""))
    return ("-" if v < 0 else "") + "".join(reversed(out))


def scientific(section: str, v: float) -> str | None:
    m = re.search(r"([0#?.,]+)[Ee]([+-])([0#?]+)", section)
    if not m:
        return None
    whole, _, part = m[1].partition(".")
    step = max(1, len(re.sub("[^0#?]", "", whole)))
    power = math.floor(math.log10(abs(v)) / step) * step if v else 0
    mantissa = placeholders(m[1], abs(v) / 10.0**power)
    if float(mantissa or 0) >= 10**step:
        power += step
        mantissa = placeholders(m[1], abs(v) / 10.0**power)
    sign = "-" if power < 0 else "+" if m[2] == "+" else ""
    shown = f"{mantissa}E{sign}{str(abs(power)).rjust(m[3].count('0'), '0')}"
    return ("-" if v < 0 else "") + literal(section[: m.start()]) + shown + literal(section[m.end() :])


def literal(code: str) -> str:
    return "".join(q or e or o for q, e, _, _, _, _, _, o in PIECE.findall(code))


def fraction(section: str, v: float) -> str | None:
    m = re.search(r"(?:([0#?]+)(\s+))?([0#?]+)/([0#?]+|[0-9]+)", section)
    if not m:
        return None
    whole, rest = divmod(abs(v), 1) if m[1] else (0, abs(v))
    if m[4].isdigit() and int(m[4]):
        below = int(m[4])
        above = round(rest * below)
    else:
        above, below = best_fraction(rest, 10 ** len(m[4]) - 1)
    if m[1] and above == below:
        whole, above = whole + 1, 0
    width = len(m[4])
    part = f"{str(above).rjust(len(m[3]) if '?' in m[3] else 0)}/{str(below).ljust(width if '?' in m[4] else 0)}"
    if m[1]:
        part = " " * len(part) if not above else part
        part = (str(int(whole)) if whole or not above else "") + m[2] + part
    return ("-" if v < 0 else "") + part


def best_fraction(x: float, most: int) -> tuple[int, int]:
    """The nearest fraction with a denominator up to most."""
    from fractions import Fraction

    f = Fraction(x).limit_denominator(most)
    return f.numerator, f.denominator


def is_date_format(code: str) -> bool:
    """Whether a code shows dates or times: one of their letters outside of quotes, escapes and brackets of other kinds."""
    bare = re.sub(r'"[^"]*"?|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]?', "", sections(code)[0], flags=re.IGNORECASE)
    return not re.search("general", bare, re.IGNORECASE) and bool(re.search(r"[ymdhs]|AM/PM", bare, re.IGNORECASE)) and not re.search(r"[0#?][eE][+-]", bare)


def date_text(section: str, serial: float, from_1904: bool) -> str:
    if serial < 0 or serial >= LAST_SERIAL:
        return "#" * 8
    pieces = DATE_PIECE.findall(section)
    units = [p[6].lower() for p in pieces]
    digits = max((len(u.split(".")[1]) for u in units if u.startswith("s") and "." in u), default=0)
    tick = 86400 * 10**digits
    whole, part = divmod(round(serial * tick), tick)  # days, parts of a second
    # sheets count a 29 February 1900 that was not, and begin with a day 0
    day = (DAY_ZERO_1904 if from_1904 else DAY_ZERO) + timedelta(days=whole + (not from_1904 and 1 <= whole < 60) + (not from_1904 and whole == 0))
    y, mo, d = day.year, day.month, day.day
    if not from_1904 and whole == 60:
        y, mo, d = 1900, 2, 29
    if not from_1904 and whole == 0:
        y, mo, d = 1900, 1, 0
    second, split = divmod(part, 10**digits)
    h, mi, s = second // 3600, second // 60 % 60, second % 60
    half = any(p[5] for p in pieces)
    out = []
    for k, (quoted, escaped, pad, _, elapsed, noon, unit, other) in enumerate(pieces):
        u = unit.lower()
        if elapsed:
            total = whole * 24 + h if elapsed[0] in "hH" else (whole * 24 + h) * 60 + mi if elapsed[0] in "mM" else ((whole * 24 + h) * 60 + mi) * 60 + s
            out.append(str(total).rjust(len(elapsed), "0"))
        elif noon:
            out.append(("AM", "PM")[h >= 12] if len(noon) > 3 else ("A", "P")[h >= 12])
        elif u.startswith("y"):
            out.append(f"{y % 100:02}" if len(u) <= 2 else f"{y:04}")
        elif u.startswith("m"):
            earlier = next((x for x in reversed([units[i] or pieces[i][4].lower() for i in range(k)]) if x), "")
            later = next((x for x in units[k + 1 :] if x), "")
            if earlier.startswith("h") or later.startswith("s"):
                out.append(str(mi).rjust(min(len(u), 2), "0"))
            else:
                out.append({1: str(mo), 2: f"{mo:02}", 3: NAMES[mo - 1][:3], 5: NAMES[mo - 1][0]}.get(len(u), NAMES[mo - 1]))
        elif u.startswith("d"):
            name = DAYS[(whole - 2) % 7] if not from_1904 else DAYS[day.weekday()]
            out.append({1: str(d), 2: f"{d:02}", 3: name[:3]}.get(len(u), name))
        elif u.startswith("h"):
            shown = (h % 12 or 12) if half else h
            out.append(str(shown).rjust(min(len(u), 2), "0"))
        elif u.startswith("s"):
            base = u.split(".")[0]
            out.append(str(s).rjust(min(len(base), 2), "0") + (f".{split:0{digits}}" if "." in u else ""))
        else:
            out.append(" " if pad else quoted or escaped or other)
    return "".join(out)


def format_value(v: object, code: str | None, from_1904: bool = False) -> str:
    """What a sheet shows for a number, a text or a truth value; an empty text for none."""
    if v is None or v == "":
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    parts = sections(code or "General")
    if isinstance(v, str):
        section = parts[3] if len(parts) >= 4 else parts[0] if len(parts) == 1 and "@" in parts[0] else None
        return v if section is None else "".join(v if o == "@" else q or e or o for q, e, _, _, _, _, _, o in PIECE.findall(section))
    section, shown = pick(parts, float(v))
    bare = BRACKETS.sub("", section).strip()
    if bare.lower() == "general":
        return general(shown)
    if not bare:
        return ""
    if (plain := plain_number(section, shown)) is not None:
        return plain
    if is_date_format(section):
        return date_text(section, shown, from_1904)
    for way in (scientific, fraction, spread):
        if (text := way(section, shown)) is not None:
            return text
    return literal(section)


@F.pandas_udf(StringType())
def formatted(value: pd.Series, code: pd.Series) -> pd.Series:
    """Numbers as their codes show them; null stays null."""
    return pd.Series([None if pd.isna(v) else format_value(float(v), c) for v, c in zip(value, code, strict=True)], dtype=object)
