from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from leafline.llm import mixing, quality_rules, sharding
from leafline.llm.common import n_words_of


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts, hit = Counter(runs), set()
    for k, r in enumerate(runs):
        if counts[r] > 1:
            hit.update(range(k, k + 5))
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    for r in quality_rules.base_counts(docs).collect():
        assert tuple(r[n] for n in NAMES) == brute(r["text"]), r["doc_id"]


def test_verdicts(spark, sf_dir):
    out = quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() == good.count()
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_lines_are_removed(spark):
    text = "A fine first line, which stays.\nHome | News | About | Contact\nPlease enable JavaScript to go on\nBUY NOW THIS IS GREAT STUFF\nand a last one."
    row = quality_rules.clean_lines(spark.createDataFrame([(text,)], "text string")).first()
    assert row["clean_text"] == "A fine first line, which stays.\nand a last one."
    assert (row["n_lines"], row["n_lines_removed"], row["kept_lines"]) == (5, 3, False)


def test_rules_on_odd_rows(odd_docs, no_docs):
    out = quality_rules.quality_rules(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r["kept"] is not None for r in out)
    assert [r["clean_text"] for r in out if r["text"] is None] == [None]
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_hypergeometric_law():
    import random

    rng = random.Random(3)
    draws = [sharding.hypergeometric(rng, 30, 50, 20) for _ in range(20000)]
    assert abs(sum(draws) / 20000 - 7.5) < 0.05
    mean = sum(draws) / 20000
    assert abs(sum((d - mean) ** 2 for d in draws) / 20000 - 20 * 3 / 8 * 5 / 8 * 60 / 79) < 0.12
    assert sharding.hypergeometric(rng, 10**12, 10**12, 10**6) > 490_000 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    matrix = sharding.communication_matrix([5, 0, 7], [4, 4, 4], 1)
    assert [sum(r) for r in matrix] == [5, 0, 7] and [sum(c) for c in zip(*matrix, strict=True)] == [4, 4, 4]


def test_shards(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sharding.hypergeometric_shuffle(docs, ["doc_id"], 7, 1, 16).toPandas()
    sizes = out.groupby("shard").slot.agg(["count", "nunique", "min", "max"])
    assert len(sizes) == 7 and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["count"] == sizes["nunique"]).all() and (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all()
    again = sharding.hypergeometric_shuffle(docs.repartition(3), ["doc_id"], 7, 1, 16).toPandas()
    assert sorted(zip(out.doc_id, out.shard, out.slot, strict=True)) == sorted(zip(again.doc_id, again.shard, again.slot, strict=True))
    odd = sharding.hypergeometric_shuffle(odd_docs, ["doc_id", "text"], 4)
    assert odd.count() == odd_docs.count() and dict(odd.dtypes)["shard"] == "int"
    assert sharding.hypergeometric_shuffle(no_docs, ["doc_id"]).count() == 0


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights 1, 2, 3, 1: b and c stop at 30 and 300, the empty source at 0
    assert got == {"a": 780.0, "b": 30.0, "c": 300.0, None: 0.0}
    # sources that stop alike
    alike = spark.createDataFrame([(f"s{i:02}", 60) for i in range(30)], "source string, source_size long")
    assert sorted({(r["weight"], round(r["target"], 9)) for r in mixing.source_targets(alike).collect()}) == [(1, 30.0), (2, 60.0), (3, 90.0)]


def test_mixture(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
    out = mixing.pareto_mix(docs, "size", "source", "doc_id")
    rows = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("got"), F.first("source_size").alias("s"), F.max("size").alias("m")).collect()
    assert abs(sum(r["t"] for r in rows) - sum(r["s"] for r in rows)) < 1e-6 * sum(r["s"] for r in rows)
    assert all(abs(r["got"] - r["t"]) <= r["m"] for r in rows)
    assert out.where("taken > 3 * size or taken % greatest(size, 1) <> 0").count() == 0
    again = mixing.pareto_mix(docs.repartition(5), "size", "source", "doc_id", ranges=64)
    assert out.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).count() == 0
    odd = mixing.pareto_mix(odd_docs.withColumn("size", n_words_of(F.col("text"))), "size", "source", "doc_id")
    assert odd.count() == odd_docs.count() and odd.where("taken is null or target is null").count() == 0
    assert mixing.pareto_mix(no_docs.withColumn("size", F.lit(0)), "size", "source", "doc_id").count() == 0


def test_one_of_repeated_rows_closes_the_gap(spark):
    # target 110 of 210 words: the words are shared 1 : 2 : 3 by a, b and c
    rows = [("a", i, n) for i, n in ((1, 10), (1, 10), (2, 100), (3, 90))] + [("b", 10, 220), ("c", 11, 230)]
    df = spark.createDataFrame(rows, "source string, doc_id long, size long").withColumn("weight", F.lit("own"))
    out = mixing.pareto_mix(df, "size", "source", "doc_id").collect()
    assert {r["weight"] for r in out} == {"own"} and all(r["target"] == 110 for r in out if r["source"] == "a")
    # by its random numbers document 3 is taken, document 2 would go beyond the target, and of the rows of document 1 a single one comes nearer
    assert sorted((r["doc_id"], r["taken"]) for r in out if r["source"] == "a") == [(1, 0), (1, 10), (2, 0), (3, 90)]
    many = spark.createDataFrame([("a", 1, 10)] * 30 + [("b", 2, 1000)], "source string, doc_id long, size long")
    total = {r["source"]: r["s"] for r in mixing.pareto_mix(many, "size", "source", "doc_id").groupBy("source").agg(F.sum("taken").alias("s")).collect()}
    assert abs(total["a"] - 1300 / 3) <= 10


def test_tiers_are_included_by_their_weights(spark):
    # 300 sources of 40 documents of 10 words; weights 4, 2, 1 and 0 by turns
    rows = [(f"s{s:03}", s * 100 + i, 10, (4.0, 2.0, 1.0, 0.0)[i % 4]) for s in range(300) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, doc_id long, size long, tier double")
    out = mixing.pareto_mix(df, "size", "source", "doc_id", tier_col="tier").toPandas()
    assert len(out) == len(rows) and (out.copies <= 3).all() and (out[out.tier == 0].copies == 0).all()
    sums = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(sums.taken - sums.target) <= 10).all()
    # targets are 200, 400 and 600 of 400 words: 1.5 copies a document at the level of 6 weights in 12 is a third of it a weight
    for target, level in ((200.0, 0.5 / 7 * 4), (400.0, 1.0 / 7 * 4), (600.0, None)):
        own = out[(out.target - target).abs() < 1e-6]
        means = own.groupby("tier").copies.mean()
        if level is not None:
            assert all(abs(means[t] - level * t) < 0.06 for t in (1.0, 2.0, 4.0)), means
        else:  # the heaviest tier stops at three copies
            assert abs(means[4.0] - 3) < 0.02 and abs(means[2.0] - 2 * means[1.0]) < 0.1
    odd = spark.createDataFrame([("a", 1, 10, None), ("a", 2, 10, -1.0), (None, 3, 0, 1.0)], df.schema)
    assert [r["taken"] for r in mixing.pareto_mix(odd, "size", "source", "doc_id", tier_col="tier").orderBy("doc_id").collect()] == [0, 0, 0]
    assert mixing.pareto_mix(df.where("false"), "size", "source", "doc_id", tier_col="tier").count() == 0


def test_shard_query_columns(spark, sf_dir):
    import zlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = sharding.query(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "rows", None)
    for s in range(16):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(len(out) // 16 + (s < len(out) % 16)))


def test_every_shard_is_as_likely(spark):
    """Over many seeds every document is in every shard about as often."""
    df = spark.range(24).withColumnRenamed("id", "doc_id")
    seen = Counter((r["doc_id"], r["shard"]) for seed in range(40) for r in sharding.hypergeometric_shuffle(df, ["doc_id"], 4, seed, 4).select("doc_id", "shard").collect())
    odd = sum((seen[i, s] - 10) ** 2 / 10 for i in range(24) for s in range(4))
    assert odd < 125  # of about 72 on average; more than 125 once in ten thousand
