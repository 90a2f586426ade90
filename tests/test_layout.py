from __future__ import annotations

from pyspark.sql import functions as F

from leafline.operators import layout
from tests.compare import connect, spark_rows, sql_rows


def test_clusters_follow_a_loop(spark):
    xs = [3, 5, 40, 44, 60, 61, 100, 12]
    got = spark.createDataFrame([(xs,)], "xs array<int>").select(layout.clusters(F.col("xs"), 10.0).alias("c")).first()["c"]
    out = []
    for x in sorted(xs):
        if out and abs(x - out[-1][0]) <= 10:
            m, n = out[-1]
            out[-1] = ((m * n + x) / (n + 1), n + 1)
        else:
            out.append((float(x), 1))
    assert [(r["mean"], r["n"]) for r in got] == out


def test_fnv1a(spark):
    def plain(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    texts = ["", "a", "foobar", "é漢"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(layout.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == [plain(t) for t in texts]


def test_islands_merge_touching_intervals(spark):
    df = spark.createDataFrame([(1, 0, 0, 10, 8), (1, 1, 2, 3, 8), (1, 2, 12, 2, 8), (1, 3, 30, 1, 8)], "page int, i int, x int, w int, size int")
    got = layout.islands(df, ["page"], "x", F.col("x") + F.col("w"), F.lit(3), "band").orderBy("i").collect()
    assert [r["band"] for r in got] == [1, 1, 1, 2]


def test_answers_to_queries_of_few_words(spark, sf_dir, tmp_path):
    from pathlib import Path

    from leafline import catalog

    for t in Path(sf_dir).glob("*.parquet"):
        (tmp_path / t.name).symlink_to(t)
    for name in ("documents", "benchmark"):
        (tmp_path / f"{name}.parquet").unlink()
    docs = [(1, "One fine day"), (2, "a b a b a b"), (3, "b\na"), (4, ""), (5, None), (6, "phone, a fine day it was")]
    items = [(1, "one"), (2, "Fine day"), (3, "a b a b"), (4, ""), (5, None), (6, "zzz"), (7, "a fine day it"), (8, "y i"), (9, " b a")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(tmp_path / "docs"), tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(tmp_path / "items"), tmp_path / "benchmark.parquet")
    got = spark_rows(layout.answers(spark, str(tmp_path)))
    assert got == sql_rows(connect(str(tmp_path)), catalog.ORACLES["answers"])
    assert {r[2] for r in got[1]} == {"1", "2", "3", "4", "7", "8", "9"}
