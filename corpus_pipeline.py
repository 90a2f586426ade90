"""From raw documents to token files: quality, near-duplicates, contamination, mixture, tokens.

Each stage takes (spark, docs, sf_dir), where docs has the columns of the documents table, and works
on every row its predecessor kept. All but the last return the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import materialize, n_words_of, table
from leafline.llm.decontaminate import decontaminate
from leafline.llm.mixing import pareto_mix
from leafline.llm.near_dedup import near_duplicates
from leafline.llm.quality_classifier import score, train
from leafline.llm.token_files import VOCABULARY, token_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    field = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, field).where("predicted = 1").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates; rows without doc_id stay, whole repeated rows become one."""
    repeated = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and doc_id is not null").select("doc_id"), "repeated")
    rows, row = docs, "doc_id"
    if not repeated.isEmpty():
        # a doc_id of several rows doesn't tell them apart: number the rows in order of doc_id
        again = docs.join(repeated, "doc_id", "left_semi").dropDuplicates()
        rows = docs.join(repeated, "doc_id", "left_anti").unionByName(again)
        rows = materialize(rows.orderBy("doc_id", *(c for c in docs.columns if c != "doc_id")).withColumn("__row", F.monotonically_increasing_id()), "rows")
        rows, row = rows.withColumn("__row", F.when(F.col("doc_id").isNotNull(), F.col("__row"))), "__row"
    others = near_duplicates(rows, id_col=row).where("not kept").select(row).distinct()
    return rows.join(others, row, "left_anti").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mixture takes copies."""
    sizes = materialize(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size")), "sizes")
    copies = pareto_mix(sizes, "size", "source", "doc_id").select(F.col("doc_id").alias("__id"), "copies").groupBy("__id").agg(F.max("copies").alias("copies"))
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id"))).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; what is read back from them."""
    import public_tokenizers

    return token_digest(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality classifier", quality), ("near-dedup", dedup), ("decontamination", clean), ("mixing", mix), ("token files", tokens)]
#: The classifier, the hashes and the tokenizer aren't SQL's; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
