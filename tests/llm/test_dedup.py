from __future__ import annotations

import random

import pyarrow as pa
import pytest

from leafline.llm import decontaminate, near_dedup, registry, substring_dedup
from tests.compare import connect, spark_rows, sql_rows


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def brute(rows, k):
    own = {i: sets_of(t, k) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(own[a] & own[b])
            if own[a] and own[b] and 100 * common >= 80 * (len(own[a]) + len(own[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i), find(i) == i) for i in ids}


def family(rng, words, n, changes):
    """A text and n copies of it with some words replaced."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(n):
        t = list(base)
        for at in rng.sample(range(words), rng.randint(0, changes)):
            t[at] = f"z{rng.randint(0, 10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("k", [2, 5])
def test_components(spark, sf_dir, k):
    rng = random.Random(k)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(120).collect()]
    texts += family(rng, 120, 70, 14) + family(rng, 30, 25, 3) + family(rng, 6, 5, 1) + ["Same Words", "same words", "", None, " ", "one", "ONE"] + ["copy of it all"] * 30
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute(rows, k)


def test_blocks_lose_no_link():
    sets = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5, 6], 3: [10, 11, 12, 13], 4: [10, 11, 12, 13, 14], 5: [20]}
    rows = [(i, True, s) for i, s in sets.items() if i in (2, 4)] + [(i, False, s) for i, s in sets.items()]
    table = pa.table({"id": [r[0] for r in rows], "label": [r[0] for r in rows], "outer": [r[1] for r in rows], "items": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})
    assert sorted(zip(*near_dedup.links_in_block(table, 80).to_pydict().values(), strict=True)) == [(1, 2), (3, 4)]


def test_near_on_odd_rows(odd_docs, no_docs):
    out = near_dedup.near_duplicates(odd_docs, words=2).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[0]["n_shingles"] == 0 and by[0]["kept"] and by[None]["component_id"] is None
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_contamination_is_the_sql_s(spark, sf_dir):
    from leafline.llm.decontaminate import SQL, query

    assert spark_rows(query(spark, sf_dir)) == sql_rows(connect(sf_dir), SQL)


def test_large_benchmarks_go_by_a_join(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    long = odd_docs.where("doc_id = 5").first()["text"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, "one", "a b", "zzz", long, long, "fine text with more"], 900)], "item_id long, text string")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(items)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    a = decontaminate.decontaminate(docs, bench).select(*names)
    b = decontaminate.decontaminate(docs, bench, most_index_bytes=0).select(*names)
    assert spark_rows(a) == spark_rows(b)
    hit = {r["doc_id"]: r for r in a.collect()}
    assert hit[5]["items"] == ["905", "906", "907"] and hit[3]["items"] == ["902"] and hit[0]["n_words"] == 0


def test_short_items_of_every_length_go_by_a_join(spark, odd_docs):
    words = odd_docs.where("doc_id = 5").first()["text"].replace(".", "").replace(",", "").split()
    rows = [(n, " ".join(words[1 : 1 + n])) for n in range(1, len(words))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    whole = decontaminate.decontaminate(odd_docs, bench, most_index_bytes=0).select(*names)
    assert spark_rows(whole) == spark_rows(decontaminate.decontaminate(odd_docs, bench).select(*names))
    assert whole.where("doc_id = 5").first()["items"] == sorted(str(n) for n, _ in rows)
    five = decontaminate.decontaminate(odd_docs, bench.where(f"item_id = {decontaminate.K}"), most_index_bytes=0)
    assert five.where("doc_id = 5").first()["n_hit"] == decontaminate.K


def test_contamination_on_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "hello world this is a fine text with more than ten words in it")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(odd_docs, bench).collect()}
    assert out[5]["contaminated"] and not out[10]["contaminated"] and out[0]["n_items"] == 0 and out[5]["score"] == "clash"
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.where("false")).where("contaminated").count() == 0


def test_sentence_spans_are_the_sql_s(spark, sf_dir):
    assert spark_rows(substring_dedup.query(spark, sf_dir)) == sql_rows(connect(sf_dir), substring_dedup.SQL)


def test_repeated_passages_go(spark, odd_docs, no_docs):
    passage = "The first sentence of it stands here. A second one follows it at once. And then a third one ends it all."
    long = " ".join(f"n{i}" for i in range(60))
    rows = [(1, f"Own start of this. {passage} Own end."), (2, f"Other words before it.\n{passage}\nOther end."), (3, f"x\n{long}\ny"), (4, f"{long}\nz"), (5, "Yes. No. Yes. No. Yes. No.")]
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["clean_text"] == rows[0][1] and out[3]["n_removed"] == 0 and out[5]["n_removed"] == 0
    assert out[2]["clean_text"] == "Other words before it.\nOther end." and out[4]["clean_text"] == "z"
    odd = substring_dedup.substring_dedup(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("text is null").first()["clean_text"] is None
    assert substring_dedup.substring_dedup(no_docs).count() == 0


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_passages_across_sentence_edges(spark):
    """Passages whose first and last sentence are cut: the runs that are hashed decide; short common sentences stay."""
    say = lambda k, n: " ".join(f"{k}{i}" for i in range(n)) + "."
    inner = [say("p", 24), say("q", 9), say("r", 9)]
    common = "Thanks for reading. See you soon."
    texts = {
        1: f"{say('a', 30)} {say('x', 20)} {inner[0]} {say('y', 20)} {say('b', 12)} {common}",  # one whole sentence of 24 words between cut ones
        2: f"{say('c', 30)} {say('z', 8)} {inner[0]} {say('w', 9)} {say('d', 12)} {common}",
        3: f"{say('e', 12)} {inner[1]} {inner[2]} {say('f', 12)} {common}",  # two whole ones of 18 words
        4: f"{say('g', 12)} {inner[1]} {inner[2]} {say('h', 12)} {common}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    removed = lambda **o: {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df, **o).collect()}
    assert removed() == {1: 0, 2: 0, 3: 0, 4: 0}
    assert removed(runs=((3, 16), (2, 16), (1, 20))) == {1: 0, 2: 1, 3: 0, 4: 2}
    assert removed(runs=((1, 3),)) == {1: 0, 2: 3, 3: 2, 4: 4}


def test_long_texts_and_repeated_rows_are_cut_in_one_pass(spark):
    text = " ".join(f"Sentence number {i} of this very long text has its words." for i in range(20000))
    rows = [(1, text), (2, text), (2, text), (None, text), (3, "")]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = [(r["doc_id"], r["n_sentences"], r["n_removed"], len(r["clean_text"])) for r in out]
    assert sorted(by, key=str) == sorted([(1, 20000, 0, len(text)), (2, 20000, 20000, 0), (2, 20000, 20000, 0), (None, 20000, 0, len(text)), (3, 1, 0, 0)], key=str)
