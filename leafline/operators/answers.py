"""Sentences, passages made of them, and answers: the best sentence of the best passages.

Sentences come from column expressions: whether a line begins a unit depends on the line before and the one
behind it only, so units are marked in place and cut apart, without a fold. Passages are a fold over each
page's sentences; answers read the passages that ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators import search
from leafline.plans.columns import let
from leafline.plans.registry import register
from leafline.plans.scratch import materialize
from leafline.plans.tables import load

WHITE = " \t\r\f\x0b 　﻿"
# What marks list items, ends and begins of sentences, and the lengths that sentences have.
BULLET = r"(?i)^(?:[-–•*·▪◦]|\(?[0-9]{1,3}[.)]|\(?[a-z][.)])[ \t]+"
OPEN_END, STOPS, NEXT_START = r"[.,;:!?)\]-]$", "[.!?:]$", r"^[\p{Lu}0-9•\-–*]"
SENTENCE = r"([.!?।])[ \t]+([A-Z0-9“\"(\p{Lu}])"
SHORTEST, LONGEST, STANDALONE = 20, 600, 70
TARGET, FULL = 90, 0.4
NUMBER_QUESTION = r"(?i)how (much|many)|when|what (date|year|amount|price)|cost|total"
CONFIDENT, COVERED = 2.0, 0.5


def sentences(text: Column) -> Column:
    """The sentences of a text, in order: headings and list items are their own, lines of a paragraph are joined first.

    Those of 20 characters and less, of 600 and more, or without a letter are left out. A null text has none.
    """

    def marked(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, behind = F.coalesce(F.get(lines, i - 1), F.lit("")), F.coalesce(F.get(lines, i + 1), F.lit(""))
            alone = lambda line, after: (F.length(line) < STANDALONE) & ~line.rlike(OPEN_END) & ((after == "") | after.rlike(NEXT_START))
            item, own = x.rlike(BULLET), alone(x, behind)
            # nothing is open behind a blank line, or behind one that stands alone and is no list item
            closed = (before == "") | (alone(before, x) & ~before.rlike(BULLET))
            whole = ~item & own & (closed | before.rlike(STOPS))
            return F.when(x == "", "").when(item, F.concat(F.lit("\x01"), F.regexp_replace(x, BULLET, ""))).when(whole, F.concat(F.lit("\x01\x02"), x)).when(closed, F.concat(F.lit("\x01"), x)).otherwise(F.concat(F.lit(" "), x))

        return F.array_join(F.transform(lines, one), "")

    lines = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), "\x01\x02", ""), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    units = F.split(let(lines, marked), "\x01")
    cut = lambda u: F.split(F.regexp_replace(F.regexp_replace(u, f"[{WHITE}]+", " "), SENTENCE, "$1\x01$2"), "\x01")
    parts = F.flatten(F.transform(units, lambda u: F.when(u.startswith("\x02"), F.array(F.substring(u, 2, 1 << 30))).otherwise(cut(u))))
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(WHITE))), lambda x: (F.length(x) > SHORTEST) & (F.length(x) < LONGEST) & x.rlike(r"\p{L}"))


def passages(df: DataFrame, key: list[str], text: str, target: int = TARGET) -> DataFrame:
    """key, pos and passage: sentences packed to about target words, never across rows; blank-line parts where there are no sentences."""
    none = F.array().cast("array<string>")
    count = lambda x: F.size(F.split(x, r"\s+"))
    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        full = (a["n"] + count(s) > target) & (a["n"] > FULL * target)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.concat(a["now"], F.array(s))).alias("now"),
            (F.when(full, 0).otherwise(a["n"]) + count(s)).alias("n"),
        )

    end = lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"])
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n{2,}"), lambda x: F.trim(x) != "")
    units = let(sentences(F.col(text)), lambda s: F.when(F.size(s) > 0, s).otherwise(blocks))
    packed = F.aggregate(units, start, step, end)
    return df.select(*key, F.posexplode_outer(packed).alias("pos", "passage")).where("passage is not null")


def answers(pages: DataFrame, key: list[str], text: str, questions: DataFrame, question_key: str, question: str) -> DataFrame:
    """question_key, answer, key of its passage, pos, score and confident; questions that find nothing have no row.

    Of the sentences of a question's three best passages the one with the largest share of its terms is the answer.
    """
    all_ = materialize(passages(pages, key, text).withColumn("__id", F.concat_ws("\x1f", *key, F.lpad(F.col("pos").cast("string"), 9, "0"))), "passages")
    hits = materialize(search.bm25(all_, "__id", "passage", questions, question_key, question), "hits")
    asked = questions.select(question_key, F.col(question).alias("__q"), F.array_distinct(T.terms(F.col(question))).alias("__terms"))
    rows = all_.join(hits, "__id").join(asked, question_key)
    found = sentences(F.col("passage"))
    own = rows.where("rank <= 3").select("*", F.posexplode_outer(found).alias("__place", "sentence"))
    of = T.terms(F.col("sentence"))
    own = own.withColumn("__st", F.coalesce(of, F.array().cast("array<string>")))
    shared = F.size(F.filter("__st", lambda w: F.array_contains(F.col("__terms"), w)))
    number = F.when(F.col("sentence").rlike("[0-9]") & F.col("__q").rlike(NUMBER_QUESTION), 0.3).otherwise(0.0)
    value = F.round(shared / F.sqrt(F.size("__st") + 1) + F.col("score") * 0.05 + number, 9)
    order = F.struct((-value).alias("o"), "rank", "__place", F.col("sentence").alias("s"), *key, "pos")
    best = own.where("sentence is not null").groupBy(question_key).agg(F.min(order).alias("b"))
    first = F.struct("rank", F.col("passage").alias("p"), F.col("score").alias("top"), *key, "pos")
    top = rows.groupBy(question_key, "__terms").agg(F.min(first).alias("f"))
    answer = F.coalesce(F.col("b.s"), F.substring(F.col("f.p"), 1, 400))
    out = top.join(best, question_key, "left").withColumn("answer", answer)
    covered = F.size(F.filter(T.terms(F.col("answer")), lambda w: F.array_contains(F.col("__terms"), w))) / F.greatest(F.size("__terms"), F.lit(1))
    place = [F.coalesce(F.col(f"b.{c}"), F.col(f"f.{c}")).alias(c) for c in (*key, "pos")]
    return out.select(question_key, "answer", *place, F.round("f.top", 6).alias("score"), ((F.col("f.top") > CONFIDENT) | (covered >= COVERED)).alias("confident"))


def summary(docs: DataFrame, key: str, text: str, headings: str | None = None) -> DataFrame:
    """key, pos (of the sentence), line: the best sentences of each document that don't say the same, in order; terms of headings count 1.4 times."""
    split = lambda t: F.transform(sentences(t), lambda x, i: F.struct(i.alias("pos"), x.alias("line"), T.terms(x).alias("terms")))
    boost = F.array().cast("array<string>") if headings is None else T.terms(F.array_join(F.col(headings), "\n"))
    return search.summary_points(docs, key, text, lines=F.filter(split(F.col(text)), lambda x: F.size(x["terms"]) > 0), boost=boost)


TRIMMED = "trim({0}, ' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(160) || chr(12288) || chr(65279))"
ALONE = "length({0}) < 70 AND NOT regexp_matches({0}, '[.,;:!?)\\]-]$') AND ({1} = '' OR regexp_matches({1}, '^[\\p{{Lu}}0-9•\\-–*]'))"
ITEM = r"regexp_matches({0}, '(?i)^(?:[-–•*·▪◦]|\(?[0-9]{{1,3}}[.)]|\(?[a-z][.)])[ \t]+')"
SENTENCES_SQL = rf"""
WITH raw AS (SELECT doc_id, string_split(translate(text, chr(1) || chr(2), ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, {TRIMMED.format('l[i]')} AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM raw)),
n AS (SELECT *, coalesce(lag(x) OVER w, '') AS before, coalesce(lead(x) OVER w, '') AS behind FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, {ITEM.format('x')} AS item, {ALONE.format('x', 'behind')} AS own, before = '' OR ({ALONE.format('before', 'x')} AND NOT {ITEM.format('before')}) AS closed FROM n),
k AS (SELECT *, NOT item AND own AND (closed OR regexp_matches(before, '[.!?:]$')) AS whole FROM c WHERE x <> ''),
g AS (SELECT *, sum(CASE WHEN item OR whole OR closed THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM k),
u AS (SELECT doc_id, unit, bool_or(whole) AS whole, string_agg(CASE WHEN item THEN regexp_replace(x, '(?i)^(?:[-–•*·▪◦]|\(?[0-9]{{1,3}}[.)]|\(?[a-z][.)])[ \t]+', '') ELSE x END, ' ' ORDER BY i) AS t FROM g GROUP BY 1, 2),
p AS (SELECT doc_id, unit, CASE WHEN whole THEN [t] ELSE string_split(regexp_replace(regexp_replace(t, '[ \t\r\f\v\x{{A0}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'), '([.!?।])[ \t]+([A-Z0-9“"(\p{{Lu}}])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS s FROM u),
q AS (SELECT doc_id, unit, j, {TRIMMED.format('s[j]')} AS sentence FROM (SELECT doc_id, unit, s, unnest(range(1, len(s) + 1)) AS j FROM p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit, j) - 1 AS INT) AS pos, sentence FROM q WHERE length(sentence) > 20 AND length(sentence) < 600 AND regexp_matches(sentence, '\p{{L}}')
"""


@register("sentences", SENTENCES_SQL)
def sentences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode_outer(sentences(F.col("text"))).alias("pos", "sentence")).where("sentence is not null")


@register("sentence_passages")
def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing has no SQL; tests/ compares it with a plain loop."""
    return passages(load(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text")


@register("question_answers")
def answers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions to all documents; tests/ compares it with a plain loop."""
    docs, items = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text")
    return answers(docs, ["doc_id"], "text", items, "item_id", "text")


@register("summaries")
def summaries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pick depends on what was picked before, which SQL can't say; tests/ compares it with a plain loop."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.slice(F.split("text", "\n"), 1, 1).alias("headings"))
    return summary(docs, "doc_id", "text", "headings")


def reading_batches(df: DataFrame, key: list[str], text: str, size: int) -> DataFrame:
    """key, batch and units: sentences read aloud together, packed to at most size characters, a longer one alone."""
    units = F.filter(F.flatten(F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(\p{L})-\n(\p{Ll})", "$1$2"), r"\n\s*\n|\f"), lambda p: F.split(F.regexp_replace(F.regexp_replace(p, r"\s+", " "), SENTENCE, "$1\x01$2"), "\x01"))), lambda x: F.length(F.trim(x)) > 1)
    rows = df.select(*key, F.posexplode_outer(F.transform(units, lambda x: F.trim(x))).alias("pos", "unit")).where("unit is not null")
    # where a running length crosses a multiple of size a new batch begins
    before = F.coalesce(F.sum(F.length("unit") + 1).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("batch", F.floor(before / size).cast("long"))
    return rows.groupBy(*key, "batch").agg(F.count(F.lit(1)).alias("units"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]), " ").alias("spoken"))


@register(
    "reading_units",
    r"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '\n\s*\n|\f') AS l FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(l[i], '\s+', ' ', 'g'), '([.!?।])[ \t]+([A-Z0-9“"(\p{Lu}])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)),
    u AS (SELECT doc_id, trim(unnest(s)) AS u FROM s) SELECT doc_id, count(*) AS units, CAST(sum(length(u)) AS BIGINT) AS chars FROM u WHERE length(u) > 1 GROUP BY 1""",
)
def reading_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read aloud: broken words are joined, parts end at blank lines and sentences."""
    out = reading_batches(load(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", 1 << 30)
    return out.select("doc_id", "units", (F.length("spoken") - F.col("units") + 1).cast("long").alias("chars"))
