"""Comparisons of texts and files: multisets of words, duplicates, fingerprints and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions.text import TOKENS_SQL, tokens
from leafline.plans.registry import register
from leafline.plans.tables import load


def word_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def compare(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """For each key: words of b that a hasn't (added), of a that b hasn't (removed), as multisets, and whether they are the same."""
    both = word_rows(a, [key], text).withColumnRenamed("n", "x").join(word_rows(b, [key], text).withColumnRenamed("n", "y"), [key, "word"], "full")
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return both.groupBy(key).agg(F.sum(F.greatest(y - x, F.lit(0))).alias("added"), F.sum(F.greatest(x - y, F.lit(0))).alias("removed"))


TURNS = "SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word FROM conversations"


@register(
    "compare_texts",
    f"""WITH w AS ({TURNS}), a AS (SELECT conv_id, word, count(*) AS x FROM w WHERE turn = 0 GROUP BY 1, 2), b AS (SELECT conv_id, word, count(*) AS y FROM w WHERE turn = 2 GROUP BY 1, 2)
    SELECT conv_id, CAST(sum(greatest(coalesce(y, 0) - coalesce(x, 0), 0)) AS BIGINT) AS added, CAST(sum(greatest(coalesce(x, 0) - coalesce(y, 0), 0)) AS BIGINT) AS removed FROM a FULL JOIN b USING (conv_id, word) GROUP BY 1""",
)
def compare_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return compare(turns.where("turn = 0"), turns.where("turn = 2"), "conv_id", "text")


@register("multiset_difference", "SELECT p_type AS v FROM part WHERE p_size > 20 EXCEPT ALL SELECT p_type FROM part WHERE p_size <= 20")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return part.where("p_size > 20").select(F.col("p_type").alias("v")).exceptAll(part.where("p_size <= 20").select("p_type"))


@register("duplicate_files", "SELECT count(*) AS copies, min(doc_id) AS first_id, length(text) AS chars FROM documents GROUP BY sha256(text), length(text) HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal content by an exact hash; sums are combined before they shuffle."""
    df = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("chars"))
    return df.groupBy("h", "chars").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1").select("copies", "first_id", "chars")


def fingerprint(content: Column) -> list[Column]:
    """Bytes and four hashes."""
    data = content.cast("binary")
    return [F.octet_length(content).alias("bytes"), F.sha2(data, 256).alias("sha256"), F.sha2(data, 512).alias("sha512"), F.sha1(data).alias("sha1"), F.md5(data).alias("md5")]


@register("fingerprints", "SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", *fingerprint(F.col("text"))).drop("sha512")


def verified(given: Column, content: Column) -> Column:
    """Whether a hash as people paste it is one of the content's four."""
    bare = F.lower(F.regexp_replace(given, r"[\s:-]", ""))
    return bare.isin(*[c for c in fingerprint(content)[1:]])


@register("verified_hashes", "SELECT doc_id, doc_id % 3 <> 2 AS ok FROM documents")
def verified_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes in upper case, with colons, and wrong ones."""
    t = F.col("text")
    given = F.when(F.col("doc_id") % 3 == 0, F.upper(F.sha2(t, 256))).when(F.col("doc_id") % 3 == 1, F.regexp_replace(F.md5(t), "(..)(?=.)", "$1:")).otherwise(F.sha2(F.concat(t, F.lit("x")), 256))
    return load(spark, sf_dir, "documents").select("doc_id", verified(given, t).alias("ok"))


@register(
    "term_overlap",
    f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOKENS_SQL.format('text')}) AS ts FROM conversations)
    SELECT a.conv_id, a.turn, round(len(list_intersect(a.ts, b.ts)) / greatest(1.0, least(len(a.ts), len(b.ts))), 6) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the smaller set of terms that neighbouring turns have in common."""
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(tokens(F.col("text"))).alias("ts"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ts").alias("other"))
    share = F.size(F.array_intersect("ts", "other")) / F.greatest(F.lit(1.0), F.least(F.size("ts"), F.size("other")))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(share, 6).alias("overlap"))


@register("related_items", "SELECT a.p_partkey AS id, count(*) AS near FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 1 GROUP BY 1")
def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Others that share tags and are near in size: counts by size bands, so no group is paired with itself."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    sizes = part.groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.select("p_brand", "p_type", F.explode(F.array(F.col("p_size") - 1, F.col("p_size"), F.col("p_size") + 1)).alias("p_size"), "n")
    near = spread.groupBy("p_brand", "p_type", "p_size").agg((F.sum("n") - 1).alias("near"))
    return part.join(near, ["p_brand", "p_type", "p_size"]).where("near > 0").select(F.col("p_partkey").alias("id"), "near")
