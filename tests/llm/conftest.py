from __future__ import annotations

import pytest

#: Null, empty, blank, short, repeated and very long texts, with ties; columns whose names clash with results.
TEXTS = [
    None, "", " \n\t", "one", "a b", "Hello world. This is a fine text with more than ten words in it, I say.", "Hello world. This is a fine text with more than ten words in it, I say.",
    "x|y | z | w | home | about | contact | more | help", "A B C\nA B C\n\nA B C", "é ü 漢字　ok\x1c end", "word " * 20000, "spam " * 30, "<|endoftext|> it's 'tis we'll", "0 " * 3,
]
CLASH = "n_words n_hit n_items items contaminated score predicted n_bytes n_tokens over_limit shard slot target taken kept n_chars clean_text n_removed component_id copies words places hit names m weight name key k at item"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case; one repeated row and one without doc_id."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id but some words here, enough to be counted as a text of its own.", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'clash' as {c}" for c in CLASH.split() if c not in ("n_chars",)))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
