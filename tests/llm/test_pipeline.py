from __future__ import annotations

import corpus_pipeline


def test_stages_one_by_one(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.materialize(stage(spark, kept[-1], sf_dir), name.replace(" ", "-")))
    raw, good, single, clean, mixed, done = kept
    assert all(k.columns == raw.columns for k in kept[:-1])
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    gone = ids(raw) - ids(good)
    assert sum(labels.get(i) == 1 for i in gone) <= 1 and sum(labels.get(i) == 0 for i in ids(good)) <= 2
    groups = corpus_pipeline.near_duplicates(good)
    assert ids(single) == {r["doc_id"] for r in groups.where("kept").collect()} and single.count() == groups.select("component_id").distinct().count()
    judged = corpus_pipeline.decontaminate(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids(clean) == {r["doc_id"] for r in judged.where("not contaminated").collect()}
    assert ids(mixed) <= ids(clean) and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    assert done.count() == mixed.count()


def test_run_and_odd_rows(spark, sf_dir, odd_docs):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "odd")
        assert out.count() <= 3 * docs.count()
    single = corpus_pipeline.dedup(spark, docs, sf_dir)
    assert single.where("doc_id = 5").count() == 1 and single.where("doc_id = 6").count() == 0 and single.where("doc_id is null").count() == 1


def test_rows_of_one_doc_id_are_judged_apart(spark, sf_dir):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(7, a, "s"), (7, b, "s"), (7, a, "s"), (3, b, "s"), (8, c, "s"), (8, d, "s"), (9, d, "s"), (None, a, "s"), (4, "", "s"), (4, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.dedup(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(7, a, "s"), (3, b, "s"), (8, c, "s"), (8, d, "s"), (None, a, "s"), (4, "", "s"), (4, "", "t")], key=str)
