"""Substring dedup by sliding sentence spans, in DataFrame functions.

A text is cut behind line feeds and behind a full stop, exclamation or question mark with a blank.
Every run of n consecutive sentences with enough words is hashed, for each (n, words) of the operator's
runs: RUN sentences of FEWEST words, and one or two of LONG words, so passages of few long sentences are
seen as well. Spans are joined over all documents; sentences covered by a span that is not its hash's first
(by doc_id, then place) are removed.

Spans are counted with map-side sums; only hashes that occur again are joined back to their spans,
so a passage in a third of all documents is one row of the smaller side, and Spark can split the larger one.

Defined results: a null text stays null and has no sentences. A row without doc_id keeps its text whole.
Letters A to Z compare without case, blanks around a sentence don't count. The character U+0001 ends a
sentence and is dropped. Rows that share a doc_id count as one document. A text of any length is cut in one
row, and its sentences are left out in one pass. An empty table gives an empty table. Columns of the input
are carried through, whatever their names, and those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import LOWER, UPPER, WHITE, WHITE_RUN, let, materialize, table

RUN, FEWEST, LONG = 3, 8, 50
#: Sentences of a span and the words that it must have.
RUNS = ((RUN, FEWEST), (1, LONG), (2, LONG))


def spans_of(df: DataFrame, runs: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """df: id, text. Gives hash, id, i (the first sentence's place), n (sentences)."""
    pieces = F.split(F.regexp_replace("text", "(\n|[.!?] )", "$1\u0001"), "\u0001")
    bare = F.transform(pieces, lambda x: F.btrim(F.translate(x, UPPER, LOWER), F.lit(WHITE)))
    df = df.select("id", bare.alias("s"))
    df = df.select("id", F.transform("s", lambda x: F.xxhash64(x)).alias("h"), F.transform("s", lambda x: F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, WHITE_RUN)))).alias("w"))
    h, w = F.col("h"), F.col("w")

    def run(n: int, fewest: int):  # noqa: ANN202
        words = lambda i: sum((F.get(w, i + k) for k in range(1, n)), F.get(w, i))
        made = F.transform(h, lambda x, i: F.struct(F.xxhash64(F.lit(n), *(F.get(h, i + k) for k in range(n))).alias("hash"), i.alias("i"), F.lit(n).alias("n"), words(i).alias("words")))
        return F.filter(made, lambda x: x["words"] >= fewest)

    # past the end of a text the sum of words is null, which leaves a run out
    none = F.array().cast("array<struct<hash:long,i:int,n:int,words:int>>")
    # of n sentences with so many words one has an n-th of them: most texts have none for the larger numbers
    made = [F.when(F.array_max(w) >= fewest // n, run(n, fewest)).otherwise(none) for n, fewest in runs]
    return df.select("id", F.inline(F.concat(*made))).select("hash", "id", "i", "n")


def repeated_sentences(spans: DataFrame) -> DataFrame:
    """Gives id and places (of sentences covered by a span that isn't its hash's first), sorted."""
    again = spans.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")).where("c > 1").select("hash", "first")
    met = spans.join(again, "hash")
    # the first place within the first document: few rows, as each document counts once per place
    place = met.where("id = first").groupBy("hash").agg(F.min("i").alias("place")).withColumnRenamed("hash", "h")
    later = met.join(place, F.col("hash") == F.col("h")).where("id <> first or i <> place")
    covered = later.select("id", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("place")).distinct()
    return covered.groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("places"))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """df with clean_text, n_sentences, n_removed and words_removed (long). runs: sentences and fewest words of the spans that are hashed."""
    df = df.drop("clean_text", "n_sentences", "n_removed", "words_removed")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    spans = materialize(spans_of(texts, runs), "spans")
    gone = repeated_sentences(spans).select(F.col("id").alias("__id"), F.col("places").alias("__places"))
    out = df.join(gone, F.col(id_col) == F.col("__id"), "left").drop("__id")
    pieces = F.split(F.regexp_replace(text_col, "(\n|[.!?] )", "$1\u0001"), "\u0001")
    out = out.withColumn("__pieces", pieces).withColumn("__places", F.coalesce("__places", F.array().cast("array<int>")))
    p, places = F.col("__pieces"), F.col("__places")
    left = lambda all_: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), places), lambda i: F.get(all_, i))
    n_words = lambda x: F.when(F.btrim(x, F.lit(WHITE)) == "", F.lit(0)).otherwise(F.size(F.split(F.btrim(x, F.lit(WHITE)), WHITE_RUN)))
    return out.withColumns(
        {
            "clean_text": F.when(F.size(places) == 0, F.translate(text_col, "\u0001", "")).otherwise(let(p, lambda all_: F.array_join(left(all_), ""))),
            "n_sentences": F.coalesce(F.size(p), F.lit(0)).cast("long"),
            "n_removed": F.size(places).cast("long"),
            "words_removed": let(p, lambda all_: F.aggregate(F.transform(places, lambda i: n_words(F.get(all_, i))), F.lit(0), lambda t, x: t + x)).cast("long"),
        }
    ).drop("__pieces", "__places")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "words_removed", (F.col("n_removed") > 0).alias("changed"), "clean_text")


SQL = r"""
WITH p AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1))) AS piece,
    unnest(range(0, len(string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1))))) AS i
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, i, piece, trim(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS w FROM p),
l AS (
  SELECT *, lead(bare, 1) OVER d AS b1, lead(bare, 2) OVER d AS b2, lead(w, 1) OVER d AS w1, lead(w, 2) OVER d AS w2
  FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
spans AS (
  SELECT doc_id, i, 3 AS n, bare || chr(1) || b1 || chr(1) || b2 AS k FROM l WHERE w + w1 + w2 >= 8
  UNION ALL SELECT doc_id, i, 2, bare || chr(1) || b1 FROM l WHERE w + w1 >= 50
  UNION ALL SELECT doc_id, i, 1, bare FROM l WHERE w >= 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS r FROM spans),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM ranked WHERE r > 1)
SELECT d.doc_id, count(s.i) AS n_sentences, count(g.i) AS n_removed, CAST(coalesce(sum(CASE WHEN g.i IS NOT NULL THEN s.w END), 0) AS BIGINT) AS words_removed,
  count(g.i) > 0 AS changed,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(CASE WHEN g.i IS NULL THEN s.piece END, '' ORDER BY s.i), '') END AS clean_text
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY d.doc_id
"""
