"""Retrieval and extractive summaries: postings, BM25, keywords, facts, sentence scores and summaries.

Postings are rows, so ranking is an equality join on terms; per-query tops go through Spark's window
group limit, which cuts rows in every task before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.plans.columns import let
from leafline.plans.registry import register
from leafline.plans.scratch import materialize
from leafline.plans.tables import load

K1, B = 1.4, 0.75
TOP, BONUS, HEADING = 4, 1.5, 1.4
#: Terms of queries, and pairs of query and passage, that are sent to all tasks; more are shuffled.
FEW_TERMS, FEW_PAIRS = 10_000, 500_000
#: Characters of a context, and ids of a block that is summed at once.
BUDGET, BLOCK = 60_000, 1024


def postings(passages: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf and n (terms of the passage)."""
    pairs = let(T.terms(F.col(text)), lambda ts: F.transform(ts, lambda t: F.struct(F.size(ts).alias("n"), t.alias("term"))))
    return passages.select(key, F.explode_outer(pairs).alias("x")).where("x is not null").select(key, "x.*").groupBy(key, "n", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(passages: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = TOP) -> DataFrame:
    """query_key, rank, key and score of the k best passages of each query; ties go by key. Queries of stop words only find nothing.

    Passages are cut into terms once; only terms that are asked for leave their task, beside one row a passage
    with its length. The phrase bonus reads the texts of those pairs again that it could lift among the k best.
    """
    asked = materialize(queries.select(query_key, F.explode(F.array_distinct(T.terms(F.col(query_text)))).alias("term")), "asked")
    wanted = materialize(asked.select("term").distinct(), "wanted")
    few = [r["term"] for r in wanted.limit(FEW_TERMS + 1).collect()]
    own = (lambda all_: F.filter(all_, lambda t: t.isin(*few))) if len(few) <= FEW_TERMS else (lambda all_: all_)
    # a row without term carries each passage's length, which stands in every struct, so that no row drags the whole array along
    marked = let(T.terms(F.col(text)), lambda all_: F.transform(F.concat(F.array(F.lit(None).cast("string")), own(all_)), lambda t: F.struct(F.size(all_).alias("n"), t.alias("term"))))
    found = passages.select(key, F.explode_outer(marked).alias("x")).select(key, "x.*")
    if len(few) > FEW_TERMS:
        found = found.join(wanted, "term").select(key, "n", "term").unionByName(found.where("term is null"))
    post = materialize(found.groupBy(key, "n", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    stats = post.where("term is null").agg(F.sum("tf").alias("total"), (F.sum(F.col("n") * F.col("tf")) / F.sum("tf")).alias("mean"))
    post = post.where("term is not null")
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = materialize(post.join(known, "term").groupBy(query_key, key).agg(F.sum(part).alias("score")), "scored")
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    least = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy(query_key).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("r"))
    # a bonus of half the score lifts nothing else among the best
    near = scored.join(least, query_key).where((F.col("r") < k) | (F.col("score") * BONUS >= F.col("least") - 1e-6)).drop("least", "r")
    asking = queries.select(query_key, F.trim(F.regexp_replace(F.lower(F.col(query_text)), "[?.!]+$", "")).alias("__q")).where(F.length(F.col(query_text)) > 8)
    near = materialize(near, "near")
    pairs = near.join(asking.select(query_key), query_key, "left_semi").select(query_key, key)
    sent = F.broadcast(pairs) if pairs.count() <= FEW_PAIRS else pairs
    pairs = passages.select(key, F.lower(F.col(text)).alias("__p")).join(sent, key).join(asking, query_key)
    lifted = pairs.where(F.contains("__p", "__q")).select(query_key, key, F.lit(BONUS).alias("__bonus"))
    out = near.join(lifted, [query_key, key], "left").select(query_key, key, F.round(F.col("score") * F.coalesce("__bonus", F.lit(1.0)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


TERMS_SQL = T.TOKENS_SQL.format("text")


def stemmed(source: str, key: str) -> str:
    """DuckDB rows (key, term) of all terms of source's texts."""
    return f"SELECT {key}, {T.TWICE_SQL.format('once')} AS term FROM (SELECT {key}, {T.ONCE_SQL.format('w')} AS once FROM (SELECT {key}, unnest({TERMS_SQL}) AS w FROM {source}))"


BM25_SQL = f"""
WITH t AS ({stemmed('documents', 'doc_id')}), post AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT d.doc_id, count(t.term) AS n FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1), stats AS (SELECT count(*) AS total, avg(n) AS mean FROM n),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), q AS (SELECT DISTINCT * FROM ({stemmed('benchmark', 'item_id')})),
s AS (SELECT item_id, doc_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * n / mean))) AS score
  FROM post JOIN q USING (term) JOIN df USING (term) JOIN n USING (doc_id), stats GROUP BY 1, 2),
b AS (SELECT item_id, doc_id, round(score * CASE WHEN length(b.text) > 8 AND contains(lower(d.text), trim(regexp_replace(lower(b.text), '[?.!]+$', ''))) THEN 1.5 ELSE 1 END, 6) AS score
  FROM s JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""


@register("bm25_search", BM25_SQL)
def bm25_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    return bm25(docs.select("doc_id", "text"), "doc_id", "text", items, "item_id", "text").select("item_id", "rank", "doc_id", "score")


@register("term_postings", f"WITH t AS ({stemmed('documents', 'doc_id')}) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and document frequencies of the corpus."""
    post = postings(load(spark, sf_dir, "documents"), "doc_id", "text")
    return post.groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), F.count(F.lit(1)).alias("df"))


def runs_of(s: Column, key: Callable[[Column], Column]) -> Column:
    """Where the runs of equal keys in a sorted list begin (a, from 0) and how long they are (n)."""
    starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (key(F.get(s, i - 1)) != key(x)), i)), lambda i: i.isNotNull())
    return let(starts, lambda at: F.transform(at, lambda a, k: F.struct(a.alias("a"), (F.coalesce(F.get(at, k + 1), F.size(s)) - a).alias("n"))))


def units(text: Column) -> Column:
    """Lines with terms as sentences: pos, line and terms of each."""
    cut = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"), T.terms(x).alias("terms")))
    return F.filter(F.coalesce(cut, F.array().cast("array<struct<pos:int,line:string,terms:array<string>>>")), lambda x: F.size(x["terms"]) > 0)


def entries(lines: Column) -> Column:
    """term, place (of its line in lines) and c (how often it is there), in order of terms."""
    count = lambda s, i: F.transform(runs_of(s, lambda t: t), lambda r: F.struct(F.get(s, r["a"]).alias("term"), i.alias("place"), r["n"].alias("c")))
    return F.sort_array(F.flatten(F.transform(lines, lambda x, i: let(F.sort_array(x["terms"]), lambda s: count(s, i)))))


def term_weights(all_: Column, total: Column) -> Column:
    """all_: entries. a, n (the run of a term's entries), idf and weight (its centroid weight within the document)."""
    idf = lambda r: F.log(1 + total / (1 + r["n"]))
    tf = lambda r: F.aggregate(F.slice(all_, r["a"] + 1, r["n"]), F.lit(0), lambda t, e: t + e["c"])
    return F.transform(runs_of(all_, lambda e: e["term"]), lambda r: F.struct(r["a"].alias("a"), r["n"].alias("n"), idf(r).alias("idf"), (idf(r) * tf(r)).alias("weight")))


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)"
WEIGHTS_SQL = f"""{LINES_SQL}, k AS (SELECT doc_id, pos, doc_id || ':' || pos AS k, text FROM l),
lt AS (SELECT CAST(split_part(k, ':', 1) AS BIGINT) AS doc_id, CAST(split_part(k, ':', 2) AS BIGINT) AS pos, term FROM ({stemmed('k', 'k')})),
tot AS (SELECT doc_id, count(DISTINCT pos) AS total FROM lt GROUP BY 1), tw AS (SELECT doc_id, term, count(*) AS tf, count(DISTINCT pos) AS df FROM lt GROUP BY 1, 2),
w AS (SELECT doc_id, term, tf, ln(1 + total / (1 + df)) AS idf, ln(1 + total / (1 + df)) * tf AS weight FROM tw JOIN tot USING (doc_id))"""


@register("keywords", f"WITH {WEIGHTS_SQL} SELECT doc_id, rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM w WHERE length(term) > 3 AND NOT regexp_matches(term, '^[0-9]+$')) WHERE rank <= 12")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve heaviest terms of each document, found within its row."""

    def best(lines: Column) -> Column:
        heavy = lambda all_: F.transform(term_weights(all_, F.size(lines)), lambda w: F.struct((-F.round(w["weight"], 6)).alias("o"), F.get(all_, w["a"])["term"].alias("term")))
        right = lambda x: (F.length(x["term"]) > 3) & ~x["term"].rlike("^[0-9]+$")
        return let(entries(lines), lambda all_: F.slice(F.sort_array(F.filter(heavy(all_), right)), 1, 12))

    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(let(units(F.col("text")), best)).alias("rank", "x")).where("x is not null")
    return rows.select("doc_id", (F.col("rank") + 1).alias("rank"), "x.term", (-F.col("x.o")).alias("weight"))


def scored_lines(units_: Column, boost: Column | None = None) -> Column:
    """units_: as units gives them; boost: terms that count 1.4 times. pos, line, terms and score of each: centroid times idf over distinct terms, by length, early and numeric sentences raised.

    Sums over terms and lines are runs of sorted lists within the document's row, so nothing is exchanged.
    """

    def sums(all_: Column, total: Column) -> Column:
        lift = lambda w: F.lit(1.0) if boost is None else F.when(F.array_contains(boost, F.get(all_, w["a"])["term"]), HEADING).otherwise(1.0)
        shares = lambda w: F.transform(F.slice(all_, w["a"] + 1, w["n"]), lambda e: F.struct(e["place"].alias("place"), (w["idf"] * w["weight"] * w["lift"]).alias("w")))
        lifted = F.transform(term_weights(all_, total), lambda w: F.struct(w["a"].alias("a"), w["n"].alias("n"), w["idf"].alias("idf"), w["weight"].alias("weight"), lift(w).alias("lift")))
        by_place = F.sort_array(F.flatten(F.transform(lifted, shares)))
        add = lambda s, r: F.aggregate(F.slice(s, r["a"] + 1, r["n"]), F.lit(0.0), lambda t, x: t + x["w"])
        return let(by_place, lambda s: F.transform(runs_of(s, lambda x: x["place"]), lambda r: add(s, r)))

    def scores(lines: Column) -> Column:
        raised = lambda x, i: F.when(i < 3, 1.25).otherwise(1) * F.when(x["line"].rlike("[0-9]"), 1.08).otherwise(1)
        score = lambda x, i, by: F.get(by, i) / F.pow(F.size(x["terms"]), F.lit(0.6)) * raised(x, i)
        one = lambda x, i, by: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), x["terms"].alias("terms"), score(x, i, by).alias("score"))
        return let(let(entries(lines), lambda all_: sums(all_, F.size(lines))), lambda by: F.transform(lines, lambda x, i: one(x, i, by)))

    return let(units_, scores)


def sentence_scores(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line, terms and score of all lines with terms."""
    return docs.select(key, F.explode_outer(scored_lines(units(F.col(text)))).alias("x")).where("x is not null").select(key, "x.*")


@register(
    "sentence_scores",
    f"""WITH {WEIGHTS_SQL}, s AS (SELECT doc_id, pos, sum(weight * idf) AS s FROM (SELECT DISTINCT * FROM lt) JOIN w USING (doc_id, term) GROUP BY 1, 2), c AS (SELECT doc_id, pos, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM lt GROUP BY 1, 2)
    SELECT doc_id, CAST(pos AS INT) AS pos, round(s / pow(n, 0.6) * CASE WHEN place <= 3 THEN 1.25 ELSE 1 END * CASE WHEN regexp_matches(l.text, '[0-9]') THEN 1.08 ELSE 1 END, 4) AS score FROM s JOIN c USING (doc_id, pos) JOIN l USING (doc_id, pos)""",
)
def sentence_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_scores(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", F.round("score", 4).alias("score"))


def summary_points(docs: DataFrame, key: str, text: str, lines: Column | None = None, boost: Column | None = None) -> DataFrame:
    """The best sentences that don't say the same: a greedy pick, as a fold over each document's sentences in order of score.

    lines: the units that are picked from, as units gives them, which are a text's lines if none are given.
    """
    kept = "array<struct<o:double,pos:int,line:string,terms:array<string>>>"
    same = lambda a, b: F.size(F.array_intersect(a["terms"], b["terms"])) > 0.6 * F.greatest(F.lit(1), F.least(F.size(a["terms"]), F.size(b["terms"])))

    def pick(scored: Column) -> Column:
        ordered = F.sort_array(F.transform(scored, lambda x: F.struct((-F.round(x["score"], 6)).alias("o"), x["pos"].alias("pos"), x["line"].alias("line"), F.array_distinct(x["terms"]).alias("terms"))))
        want = F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.sqrt(F.size(scored)) * 1.3 + 0.5)))
        step = lambda acc, x: F.when((F.size(acc) >= want) | F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x)))
        return F.aggregate(ordered, F.array().cast(kept), step)

    picked = let(scored_lines(units(F.col(text)) if lines is None else lines, boost), pick)
    return docs.select(key, F.explode_outer(picked).alias("p")).where("p is not null").select(key, "p.pos", "p.line")


@register("summary_points")
def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pick depends on what was picked before, which SQL can't say; tests/ compares it with a plain loop."""
    return summary_points(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def facts(text: Column) -> list[Column]:
    """Distinct dates, amounts, percentages, e-mail addresses and links in order; 8 of each, 5 links."""
    month = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
    date = rf"(?i)(?<![A-Za-z0-9_])(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-](?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?:st|nd|rd|th)?\s+{month},?\s+[0-9]{{4}}|{month}\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}|Q[1-4]\s+(?:FY\s?)?[0-9]{{2,4}})(?![A-Za-z0-9_])"
    unit = r"(?:crore|lakh|million|billion)"
    amount = rf"(?i)(?:₹|(?<![A-Za-z0-9_])Rs\.?|(?<![A-Za-z0-9_])INR|\$|(?<![A-Za-z0-9_])USD|€|£)\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:crore|lakh|million|billion|k|cr|L)(?![A-Za-z0-9_]))?|(?<![A-Za-z0-9_])[0-9][0-9,]*(?:\.[0-9]+)?\s?{unit}(?![A-Za-z0-9_])"
    rules = [("dates", date, 8), ("amounts", amount, 8), ("percentages", r"(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)?\s?%", 8), ("emails", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 8), ("links", r"(?i)https?://[^\s)>\]]+", 5)]
    return [F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 0)), 1, n).alias(name) for name, p, n in rules]


ORDER_TEXT = ("concat('Order ', o_orderkey, ' of ', date_format(o_orderdate, 'yyyy-MM-dd'), ' cost $', cast(o_totalprice as decimal(18,2)), ' with ', o_orderkey % 30, '% off, see https://shop.example/', o_orderkey, ' or a', o_orderkey, '@mail.example')")
ORDER_SQL = "'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ' cost $' || CAST(o_totalprice AS DECIMAL(18,2)) || ' with ' || o_orderkey % 30 || '% off, see https://shop.example/' || o_orderkey || ' or a' || o_orderkey || '@mail.example'"


@register(
    "facts",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, '$' || CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderkey % 30 || '%' AS percentage, 'a' || o_orderkey || '@mail.example' AS email, 'https://shop.example/' || o_orderkey AS link FROM orders",
)
def facts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in a text made of order rows; SQL takes them from the columns."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(ORDER_TEXT).alias("t")).select("o_orderkey", *facts(F.col("t")))
    return df.select("o_orderkey", F.get("dates", 0).alias("date"), F.get("amounts", 0).alias("amount"), F.get("percentages", 0).alias("percentage"), F.get("emails", 0).alias("email"), F.get("links", 0).alias("link"))


@register("reading_stats", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS words, CAST(greatest(1, floor(len(regexp_extract_all(text, '\S+')) / 230.0 + 0.5)) AS INT) AS minutes FROM documents")
def reading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "documents").select("doc_id", T.words_count(F.col("text")).alias("words"))
    return df.select("doc_id", "words", T.reading_minutes(F.col("words")).alias("minutes"))


@register(
    "surface_forms",
    f"""WITH t AS (SELECT doc_id, w, {T.TWICE_SQL.format('once')} AS stem FROM (SELECT doc_id, w, {T.ONCE_SQL.format('w')} AS once FROM (SELECT doc_id, unnest({TERMS_SQL}) AS w FROM documents))),
    c AS (SELECT stem, w, count(*) AS n FROM t GROUP BY 1, 2) SELECT stem, w AS form FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, w) AS r FROM c) WHERE r = 1""",
)
def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest spelling behind each stem; ties go by the alphabet."""
    words = load(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    best = words.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.min(F.struct((-F.col("n")).alias("o"), "w"))["w"].alias("form"))
    return best


def passages(docs: DataFrame, key: str, text: str, target: int = 90) -> DataFrame:
    """Lines packed to passages of about target words, never across documents: a fold over each document's lines."""
    acc = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, line: Column) -> Column:
        n = T.words_count(line)
        full = (a["n"] + n > target) & (a["n"] > 0.4 * target)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["now"] == ""), line).otherwise(F.concat(a["now"], F.lit(" "), line)).alias("now"),
            F.when(full, n).otherwise(a["n"] + n).alias("n"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    packed = F.aggregate(lines, acc, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return docs.select(key, F.posexplode(packed).alias("pos", "passage"))


@register("passages")
def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing has no SQL; tests/ compares it with a plain loop."""
    return passages(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@register(
    "context_budget",
    "SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents) WHERE spent < 60000",
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in order until a budget of characters is spent; the one that crosses it stays."""
    df = load(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    # sums of blocks first, so that only the block in which a source's budget ends is summed row by row
    df = df.withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    blocks = df.groupBy("source", "block").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = blocks.select("source", "block", before.alias("before")).where(F.col("before") < BUDGET)
    spent = F.coalesce(F.sum("n").over(Window.partitionBy("source", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(open_, ["source", "block"]).withColumn("spent", F.col("before") + spent).where(F.col("spent") < BUDGET).select("doc_id", "source")


@register("chat_route", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)summar|overview|about this') THEN 'summary' ELSE 'retrieval' END AS route FROM conversations")
def chat_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(F.col("text").rlike("(?i)summar|overview|about this"), "summary").otherwise("retrieval")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", route.alias("route"))
