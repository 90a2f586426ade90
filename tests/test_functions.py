from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafline.functions import numbers as N
from leafline.functions import text as T
from leafline.functions import validators as V
from leafline.operators import pages, pii, search, values


def column(spark, rows, kind, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def verhoeff(number):
    d, p, c = V.VERHOEFF_D, V.verhoeff_p(), 0
    for i, x in enumerate(reversed(number)):
        c = d[c][p[i % 8][int(x)]]
    return c == 0


def test_checksums(spark):
    numbers = [str(234100000000 + 7 * i) for i in range(200)] + ["236", "2363"]
    assert column(spark, numbers, "string", V.verhoeff) == [verhoeff(n) for n in numbers]
    assert column(spark, ["DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "GB82WEST12345698765432", "DE8"], "string", V.iban) == [True, False, True, False]
    assert column(spark, ["27AAPFU0939F1ZV", "27AAPFU0939F1ZW", "x"], "string", V.gstin) == [True, False, False]
    assert column(spark, ["4111 1111 1111 1111", "4111111111111112"], "string", V.luhn) == [True, False]


def test_amounts_in_words(spark):
    said = {
        123456.5: "One Lakh Twenty Three Thousand Four Hundred Fifty Six Rupees and Fifty Paise Only",
        0.0: "Zero Rupees Only",
        1.0: "One Rupee Only",
        -20.05: "Minus Twenty Rupees and Five Paise Only",
        218890.0: "Two Lakh Eighteen Thousand Eight Hundred Ninety Rupees Only",
    }
    assert column(spark, list(said), "double", N.amount_in_words) == list(said.values())
    assert column(spark, [1234567.8, -5.0, 123.0, 100000.0], "double", N.indian_grouping) == ["12,34,567.80", "-5.00", "123.00", "1,00,000.00"]


def test_parse_number(spark):
    cases = {
        "1,234.50": 1234.5, "(251,032)": -251032.0, "5.6%": 0.056, "000142": None, "12,34,567.80": 1234567.8, "₹ 1,500.00": 1500.0, "45-": -45.0, "-3": -3.0, "100.00 Dr": -100.0,
        "100.00 Cr": 100.0, "123456789012": None, "abc": None, "": None, "1.2.3": None, ".5": 0.5, "+7": 7.0, "1,23": None, "-$5": -5.0, "20 EUR": 20.0,
    }
    assert column(spark, list(cases), "string", N.parse_number) == list(cases.values())
    comma = {"1.234,50": 1234.5, "12,5": 12.5, "1 234,5": 1234.5, "1,234.5": None}
    assert column(spark, list(comma), "string", lambda x: N.parse_number(x, ",")) == list(comma.values())


def test_parse_date(spark):
    cases = {"2024-03-05": "2024-03-05", "05/03/2024": "2024-03-05", "5 Mar 24": "2024-03-05", "March 5, 2024": "2024-03-05", "5-Sept-1999": "1999-09-05", "31/02/2024": None, "5 Foo 2024": None, "05/03/49": "2049-03-05", "05.03.50": "1950-03-05"}
    got = column(spark, list(cases), "string", lambda x: N.parse_date(x, F.lit("dmy")))
    assert [d and d.isoformat() for d in got] == list(cases.values())
    assert column(spark, ["05/03/2024"], "string", lambda x: N.parse_date(x, F.lit(None).cast("string"))) == [None]


def test_locale_vote(spark):
    df = spark.createDataFrame([(1, "1.234,50 am 25.12.2023"), (2, "3,456.70 on 03/04/2024"), (2, "12/25/2023")], "k int, t string")
    got = {r["k"]: (r["decimal"], r["dates"]) for r in values.locale_vote(df, ["k"], "t").collect()}
    assert got == {1: (",", "dmy"), 2: (".", "mdy")}


def test_references_and_roman(spark):
    assert column(spark, [0, 25, 26, 701, 702, 16383], "int", N.column_letters) == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert column(spark, [1, 4, 1994, 3999, 4000, 0], "int", N.roman) == ["I", "IV", "MCMXCIV", "MMMCMXCIX", "4000", "0"]
    assert column(spark, ["IV", "mcmxciv"], "string", N.roman_value) == [4, 1994]


def test_text(spark):
    assert column(spark, ["abcd", "abcdef", "a"], "string", T.mask) == ["••••", "ab••ef", "•"]
    stems = {"ponies": "pony", "boxes": "box", "cats": "cat", "glass": "glass", "running": "runn", "jumped": "jump", "ing": "ing"}
    assert column(spark, list(stems), "string", T.stem) == list(stems.values())
    assert column(spark, ["The running dogs, and A dog's 2 tails"], "string", T.terms) == [["runn", "dog", "dog'", "tail"]]
    assert column(spark, ["  A b!C "], "string", T.slugify) == ["a-b-c"]
    assert column(spark, ["a.b.pdf", ".pdf"], "string", T.file_stem) == ["a.b", "document"]


def test_page_list():
    assert pages.page_list("3,1-2, last", 5) == [3, 1, 2, 5]
    assert pages.page_list("5-3", 5) == [5, 4, 3]
    assert pages.page_list("4-", 5) == [4, 5] and pages.page_list("-2", 5) == [1, 2]
    assert pages.page_list("odd", 5) == [1, 3, 5] and pages.page_list("7,2", 5) == [2]
    assert pages.range_groups("1-2;5", 5) == [[1, 2], [5]]
    with pytest.raises(ValueError):
        pages.page_list("x", 3)


def test_page_errors(spark):
    df = spark.range(3).select(F.lit(1).alias("d"), (F.col("id") + 1).alias("page"))
    with pytest.raises(ValueError):
        pages.drop_pages(df, "page", "all", 3)
    with pytest.raises(ValueError):
        pages.keep_pages(df, "d", "page", "9", 3)


def found(spark, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    return [tuple(r) for r in pii.findings(df, "text", **options).select("kind", "value", "start", "confidence").collect()]


def test_pii_kinds(spark):
    text = (
        "Mail a.b@hdfcbank.com or xy@ybl; card 4111 1111 1111 1111, id 2341 2341 2346, GSTIN 27AAPFU0939F1ZV, PAN ABCPE1234F, IFSC HDFC0001234, passport no: A1234567, "
        "voter ABC1234567, SSN 123-45-6789, IBAN GB82WEST12345698765432, a/c no: 123456789012, +91 98765 43210, 192.168.0.1, DOB: 12 March 1990, born 12 Marks 90"
    )
    got = found(spark, text)
    assert [g[0] for g in got] == ["email", "upi", "card", "aadhaar", "gstin", "pan", "ifsc", "passport", "voterid", "ssn", "iban", "bank", "phone", "ip", "dob"]
    assert all(text[at : at + len(value)] == value for _, value, at, _ in got)
    assert got[3][3] == ("high" if verhoeff("234123412346") else "medium")


def test_pii_rejections(spark):
    assert found(spark, "card 4111 1111 1111 1112 and 000-45-6789", kinds=["card", "ssn"]) == []
    assert found(spark, "a@b.co", kinds=[]) == []
    assert found(spark, "The Blue  Falcon flies", terms=["blue falcon"], kinds=[]) == [("custom", "Blue  Falcon", 4, "high")]
    assert found(spark, "x7 y8", pattern="y[0-9]", kinds=[]) == [("custom", "y8", 3, "high")]


def test_redacted_text_has_no_hits(spark):
    df = spark.createDataFrame([("write to some.one@mail.example or 10.0.0.1 now",), ("none",)], "text string")
    out = [r[0] for r in pii.with_hits(df, "text").select(pii.redacted(F.col("text"), F.col("hits"))).collect()]
    assert out == ["write to so" + "•" * 17 + "le or 10••••.1 now", "none"]


def test_passages_pack_like_a_loop(spark):
    lines = ["w " * n for n in (50, 30, 20, 80, 5, 95, 3)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "k int, text string")
    got = [len(r["passage"].split()) for r in search.passages(df, "k", "text").orderBy("pos").collect()]
    out, now = [], 0
    for n in (50, 30, 20, 80, 5, 95, 3):
        if now + n > 90 and now > 36:
            out, now = [*out, now], 0
        now += n
    assert got == [*out, now]


def test_summary_picks_do_not_repeat(spark):
    text = "\n".join(["alpha beta gamma delta", "alpha beta gamma delta epsilon", "zeta eta theta iota", "kappa lambda sigma tau", "omega psi chi rho"])
    df = spark.createDataFrame([(1, text)], "k int, text string")
    rows = search.summary_points(df, "k", "text").collect()
    assert len(rows) == 4 and sum(r["pos"] in (0, 1) for r in rows) == 1


def test_query_of_stop_words_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "quick brown fox"), (2, "lazy dog")], "d int, text string")
    ask = spark.createDataFrame([(1, "the and of"), (2, "brown foxes?")], "q int, text string")
    assert [(r["q"], r["d"]) for r in search.bm25(docs, "d", "text", ask, "q", "text").collect()] == [(2, 1)]
