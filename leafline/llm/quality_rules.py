"""Line-first cleaning, in DataFrame functions only.

Each line is judged alone by punctuation, navigation and boilerplate rules; lines that fail are
removed, and a document that loses too much of its text this way is rejected.

Defined results: a null text counts as empty. An empty text has no words, fails the base rules and
is not kept. Blank lines are neither judged nor counted; they stay in the cleaned text. Repeated
rows are judged one by one. Columns of the input whose names are those of results are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import WHITE, let, table, words_of

SYMBOLS = "#*$%&|<>"
#: Marks that prose hardly has. A line fails with more than one per MARKS_PER_WORD words.
MARKS = "#*$%&|<>{}[]~^=\\_@"
MARKS_PER_WORD = 0.3
#: Doubled exclamation marks, as a share of the line's words.
SHOUTS = 0.3
#: A line all in upper case fails from so many words on.
CAPITALS_WORDS = 5
#: Separators of navigation lines, the fewest items that make one, and the most words of an item on average.
SEPARATORS, NAV_ITEMS, NAV_ITEM_WORDS = ("|", "»", "›", "•", "·"), 3, 3
#: Words equal to the one before, as a share of the line's words, over lines of some words.
STUTTER, STUTTER_WORDS = 0.3, 8
BOILERPLATE = (
    "javascript is disabled", "enable javascript", "accept cookies", "accept all cookies", "cookie policy", "privacy policy",
    "terms of use", "terms of service", "terms and conditions", "all rights reserved", "lorem ipsum", "click here",
    "sign in to", "sign up now", "subscribe to our", "share on facebook", "share on twitter", "powered by", "skip to main content", "back to top",
)
#: A document is rejected if its removed lines hold more than this share of its words.
MOST_LOST = 0.5
FEWEST_WORDS, REPEAT_PERCENT = 10, 20


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(parts: Column) -> Column:
    """True for a line with words that one of the rules removes; parts: one of __lines."""
    line, words, low = parts["line"], parts["words"], parts["low"]
    n = F.size(words)
    marks = count_of(line, MARKS)
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    capitals = (n >= CAPITALS_WORDS) & (low != line) & (F.upper(line) == line)
    punctuation = (marks > MARKS_PER_WORD * n) | (shouts > SHOUTS * n) | capitals
    items = count_of(line, "".join(SEPARATORS)) + 1
    navigation = (items >= NAV_ITEMS) & (n <= (NAV_ITEM_WORDS + 1) * items)
    # few lines repeat enough words to be looked at pair by pair
    stutters = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n - 1, F.lit(1))), lambda x, y: x == y), lambda x: x))
    stutter = F.when((n >= STUTTER_WORDS) & (F.size(F.array_distinct(words)) <= (1 - STUTTER) * n), stutters >= STUTTER * n).otherwise(F.lit(False))
    boilerplate = reduce(or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE))
    return punctuation | navigation | stutter | boilerplate


def parts_of(text: Column) -> Column:
    """The lines of a text: line, words and low (its lower case)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: F.struct(x.alias("line"), words_of(x).alias("words"), F.lower(x).alias("low")))


def repeated_words(words: Column) -> Column:
    """How many words lie in 5-word windows that come twice or more."""

    def windows(h: Column) -> Column:
        made = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
        return F.when(F.size(h) >= 5, made).otherwise(F.array().cast("array<long>"))

    def places(s: Column) -> Column:
        again = lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])
        return F.sort_array(F.filter(F.transform(s, again), lambda p: p.isNotNull()))

    def covered(a: Column) -> Column:
        gaps = F.transform(a, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(a, i + 1) - p, F.lit(5))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)

    # only texts in which some window comes again are sorted
    count = lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), lambda s: let(places(s), covered))
    ).otherwise(F.lit(0).cast("long"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def base_of(text: Column, parts: Column) -> Column:
    full = F.filter(parts, lambda x: F.size(x["words"]) > 0)["line"]

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
            count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(F.flatten(parts["words"]), counts)


def cleaned_of(text: Column, parts: Column) -> Column:
    judged = F.transform(parts, lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"), ((F.size(x["words"]) > 0) & line_fails(x)).alias("bad")))
    total = lambda j, n: F.aggregate(j, F.lit(0).cast("long"), lambda t, x: t + n(x))
    return let(
        judged,
        lambda j: F.struct(
            F.when(text.isNotNull(), F.array_join(F.filter(j, lambda x: ~x["bad"])["line"], "\n")).alias("clean_text"),
            F.size(F.filter(j, lambda x: x["n"] > 0)).cast("long").alias("n_lines"),
            F.size(F.filter(j, lambda x: x["bad"])).cast("long").alias("n_lines_removed"),
            total(j, lambda x: F.when(x["bad"], x["n"]).otherwise(0)).alias("words_removed"),
            total(j, lambda x: x["n"]).alias("total"),
        ),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CLEANED = ("clean_text", "n_lines", "n_lines_removed", "words_removed")


def with_base(df: DataFrame) -> DataFrame:
    df = df.withColumns({c: F.col(f"__q.base.{c}") for c in BASE})
    return df.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def with_cleaned(df: DataFrame, most_lost: float) -> DataFrame:
    kept = (F.col("__q.cleaned.total") > 0) & (F.col("__q.cleaned.words_removed") <= most_lost * F.col("__q.cleaned.total"))
    return df.withColumns({c: F.col(f"__q.cleaned.{c}") for c in CLEANED} | {"kept_lines": kept})


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return with_base(df.withColumn("__q", let(parts_of(text), lambda p: F.struct(base_of(text, p).alias("base"))))).drop("__q")


def clean_lines(df: DataFrame, text_col: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """Adds clean_text (null where the text is), n_lines, n_lines_removed, words_removed and kept_lines.

    kept_lines is the method's verdict: the removed lines hold at most most_lost of the words.
    """
    text = F.col(text_col)
    return with_cleaned(df.withColumn("__q", let(parts_of(text), lambda p: F.struct(cleaned_of(text, p).alias("cleaned")))), most_lost).drop("__q")


def quality_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Both of the above, and kept: neither the base rules nor the line rules reject the document."""
    text = F.col(text_col)
    whole = F.coalesce(text, F.lit(""))
    both = let(parts_of(text), lambda p: F.struct(base_of(whole, p).alias("base"), cleaned_of(text, p).alias("cleaned")))
    out = with_cleaned(with_base(df.withColumn("__q", both)), MOST_LOST)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("kept_lines")).drop("__q")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "words_removed")


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql() -> str:
    """The same rows in DuckDB, by lists of lines and words."""
    words = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
    fewer = lambda x, chars: f"(length({x}) - length(translate({x}, {sql_text(chars)}, '')))"
    phrases = " OR ".join(f"contains(low, {sql_text(p)})" for p in BOILERPLATE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
five AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM five) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1),
lines AS (SELECT doc_id, line, lower(line) AS low, {words.format("line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
full_lines AS (SELECT *, len(w) AS n, {fewer("line", "".join(SEPARATORS))} + 1 AS items FROM lines WHERE len(w) > 0),
judged AS (SELECT doc_id, n, {fewer("line", MARKS)} > {MARKS_PER_WORD} * n OR (length(line) - length(replace(line, '!!', ''))) / 2.0 > {SHOUTS} * n
  OR (n >= {CAPITALS_WORDS} AND low <> line AND upper(line) = line) OR (items >= {NAV_ITEMS} AND n <= {NAV_ITEM_WORDS + 1} * items)
  OR (n >= {STUTTER_WORDS} AND len(list_distinct(w)) <= {1 - STUTTER} * n AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) >= {STUTTER} * n) OR {phrases} AS bad FROM full_lines),
sums AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_lines_removed, coalesce(sum(n) FILTER (bad), 0) AS words_removed, sum(n) AS total FROM judged GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY 1),
b AS (SELECT d.doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, {fewer("d.text", SYMBOLS)} AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(words_removed, 0) AS words_removed, coalesce(total, 0) AS total
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN sums USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
  n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND total > 0 AND words_removed <= {MOST_LOST} * total AS kept,
  n_lines, n_lines_removed, CAST(words_removed AS BIGINT) AS words_removed FROM b
"""


SQL = sql()
