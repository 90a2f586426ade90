"""Near-duplicate groups by MinHash bands and odd sketches.

A document's set holds the hashes of its distinct shingles. Documents with equal sets form a class;
one row for each class goes on. A class's MinHash values are cut into bands; classes that share a band
are candidates. The values are also folded into an odd sketch, a bitmap of parities: the population
count of two sketches' XOR estimates the similarity and drops all but the likely pairs, which are
confirmed on the full sets.

Buckets of a few classes give their pairs. A large bucket doesn't: its members are compared with its
pivot, the member that is in most large buckets, which in a family of copies is the one nearest to
all. Buckets of one pivot make a cluster; when those links are joined, only members
that are still outside their cluster's largest component meet the members of other components, in
blocks of bounded size, which count common shingles by an inverted index and give a link for each two
components at most. No pair of a bucket is left out but those whose ends are connected already, and no
task holds a group. Components come from label propagation with pointer jumping on written tables;
nothing but counts reaches the driver.

Chance: a pair at 0.8 misses all BANDS bands of ROWS values with probability 5e-6, less above.

Defined results: texts that are null, empty or all white space have an empty set and are components of
their own. Repeated rows and equal sets share a component, and the rows with the smallest doc_id are
kept. Rows that share a doc_id are one node. A row without doc_id links nothing; its component is its
class's smallest doc_id, null if there is none. A text of any length is one row of hashes. An empty table
gives an empty table. Of the input only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import forget, join_split, materialize, table, trimmed
from leafline.llm.shingles import mix, shingle_sets, slices

BANDS, ROWS, SEED = 40, 6, 11
SKETCH_BITS = 512
#: Sketches that differ in more bits belong to a pair at 0.8 with a probability of about 1e-5.
MOST_BITS = 128
#: Buckets of more classes go by pivots.
SMALL_BUCKET = 8
SIMILARITY, WORDS = 0.8, 5
#: Shingles in a block of members outside the largest component, and of members they meet.
OUTER_ITEMS, INNER_ITEMS = 400_000, 1_000_000
#: Ids up to this number (16 bytes each) are broadcast to fetch texts; more go by a shuffle.
FEW_IDS = 2_000_000


class Hasher:
    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        k = BANDS * ROWS
        self.factor = rng.integers(0, 1 << 32, k, np.uint32) | np.uint32(1)
        self.term = rng.integers(0, 1 << 32, k, np.uint32)
        self.salt = rng.integers(0, 1 << 63, k, np.uint64)
        self.band = np.arange(BANDS, dtype=np.uint64)

    def minima(self, values: np.ndarray) -> np.ndarray:
        v = (values >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(v), 512):
            best = np.minimum(best, (v[at : at + 512, None] * self.factor + self.term).min(axis=0))
        return best

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Band keys (sets x BANDS) and odd sketches (sets x 8 longs)."""
        low = np.array([self.minima(s) for s in sets], np.uint32).reshape(len(sets), -1).astype(np.uint64)
        keys = np.broadcast_to(mix(self.band + np.uint64(1)), (len(sets), BANDS))
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + low[:, r::ROWS])
        spots = (mix(low ^ self.salt) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(sets))[:, None] * SKETCH_BITS
        odd = np.bincount(spots.ravel(), minlength=len(sets) * SKETCH_BITS) & 1
        return keys, np.packbits(odd.astype(np.uint8).reshape(len(sets), -1), axis=1).view(np.int64)


def lowered(column: pa.Array) -> list[bytes]:
    return [t.lower() for t in column.cast(pa.binary()).to_pylist()]  # of bytes: A to Z only


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts are copied at a time."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def signatures(df: DataFrame, words: int) -> DataFrame:
    """df: id, text. Gives id, n (set size), k1, k2 (the set's key), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in in_parts(batches):
            texts = lowered(batch.column("text"))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], words)
                keys, sketches = hasher.of(sets)
                k1 = [int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                k2 = [int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                flat = pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat)
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 8), pa.array(sketches.ravel()))
                columns = [batch.column("id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), bands, marks]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "k1", "k2", "bands", "sketch"])

    return df.mapInArrow(trimmed(run), "id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def full_sets(df: DataFrame, words: int) -> DataFrame:
    """df: id, text. Gives id, items (the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = lowered(batch.column("text"))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], words)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), items], names=["id", "items"])

    return df.mapInArrow(trimmed(run), "id long, items array<long>")


def bits_apart(a: Column, b: Column) -> Column:
    return reduce(add, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)))


def likely(na: Column, sa: Column, nb: Column, sb: Column, similarity: float) -> Column:
    """Whether sizes and sketches let two sets be similar."""
    return (F.least(na, nb) >= similarity * F.greatest(na, nb)) & (bits_apart(sa, sb) <= MOST_BITS)


def side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(name if c == "id" else f"{c}_{name}") for c in df.columns))


def sets_of(ids: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """ids: id, distinct and written. Gives id and items as a written table."""
    few = ids.count() <= FEW_IDS
    return materialize(full_sets(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), words), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, as a written table."""
    both = pairs.join(side(sets, "b"), "b").join(side(sets, "a"), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    percent = round(100 * similarity)
    return materialize(both.where(100 * common >= percent * (F.size("items_a") + F.size("items_b") - common)).select("a", "b"), "links")


def links_in_block(block: pa.Table, percent: int) -> pa.Table:
    """Similar pairs of an outer and an inner member of different components, one for each two components that they join."""
    outer = np.array(block["outer"])
    ids, labels = np.array(block["id"]), block["label"].to_pylist()
    items = [np.asarray(x.values) for x in block["items"]]
    inner = np.flatnonzero(~outer)
    sizes = np.array([len(x) for x in items])
    flat = np.concatenate([items[i] for i in inner]) if len(inner) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(inner)), sizes[inner])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in np.flatnonzero(outer).tolist():
        low, high = np.searchsorted(flat, items[i], "left"), np.searchsorted(flat, items[i], "right")
        counts = high - low
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - counts), counts)
        common = np.bincount(owner[places], minlength=len(inner))
        for k in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes[inner] - common)).tolist():
            j = int(inner[k])
            a, b = root(labels[i]), root(labels[j])
            if a != b:
                parent[a] = b
                found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def links_outside(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members: cluster, id (distinct), n. Links between components of a cluster, but those that are known, as a written table.

    Each cluster is dealt into blocks by sums over its components; only then sets are attached, to places in blocks.
    """
    tagged = materialize(members.join(labels, "id", "left").select("cluster", "id", "n", F.coalesce("label", "id").alias("label")), "clusters")
    sizes = tagged.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"))
    plan = sizes.groupBy("cluster").agg(F.max(F.struct("m", "label", "items")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("items").alias("items")).where("parts > 1")
    blocks_of = lambda items, most: F.ceil(items / most).cast("int")
    plan = materialize(plan.select("cluster", F.col("main.label").alias("main"), blocks_of(F.col("items") - F.col("main.items"), OUTER_ITEMS).alias("outers"), blocks_of(F.col("items"), INNER_ITEMS).alias("inners")), "plan")
    rows = join_split(tagged, plan, ["cluster"], F.col("id"))
    at = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.where("label <> main").select("cluster", at("outers", 1).alias("i"), every("inners").alias("j"), "id", "label", F.lit(True).alias("outer"))
    inner = rows.select("cluster", every("outers").alias("i"), at("inners", 2).alias("j"), "id", "label", F.lit(False).alias("outer"))
    percent = round(100 * similarity)
    blocks = outer.unionByName(inner).join(sets, "id").groupBy("cluster", "i", "j")
    out = materialize(blocks.applyInArrow(lambda t: links_in_block(t, percent), "a long, b long"), "links")
    forget(tagged, plan)
    return out


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Gives id, label (the smallest id reachable) for every id in a link, as a written table."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    before = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            forget(edges)
            return labels
        before = now
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        # pointer jumping: the label's label
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialize(lower.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        forget(labels)
        labels = new


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of df, named id_col and so on."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(signatures(texts, words), "signatures")
    classes = materialize(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    reps = signed.join(classes, ["k1", "k2"]).where("id = rep").select("id", "n", "sketch", "bands")
    reps = materialize(reps, "representatives")
    traits = reps.select("id", "n", "sketch")
    banded = reps.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = materialize(buckets, "buckets")

    members = materialize(join_split(banded, buckets, ["band"], F.col("id")).select("band", "c", "id"), "banded")
    large = members.where(F.col("c") > SMALL_BUCKET)
    score = large.groupBy("id").agg(F.sum("c").alias("score"))
    pivots = materialize(large.join(score, "id").groupBy("band").agg(F.max(F.struct("score", "id"))["id"].alias("pivot")), "pivots")
    clusters = materialize(join_split(large, pivots, ["band"], F.col("id")).select(F.col("pivot").alias("cluster"), "id").distinct(), "members")
    stars = clusters.where("id <> cluster").select(F.least("id", "cluster").alias("a"), F.greatest("id", "cluster").alias("b"))
    # two that share a cluster meet there, so small buckets leave them out
    own = clusters.groupBy("id").agg(F.collect_set("cluster").alias("in"))
    small = members.where(F.col("c") <= SMALL_BUCKET).join(own, "id", "left").select("band", F.struct("id", F.coalesce("in", F.array().cast("array<long>")).alias("in")).alias("x"))
    small = small.groupBy("band").agg(F.collect_list("x").alias("all")).select(F.explode("all").alias("x"), "all")
    others = F.transform(F.filter("all", lambda y: (y["id"] > F.col("x.id")) & ~F.arrays_overlap(y["in"], F.col("x.in"))), lambda y: y["id"])
    few = small.select(F.col("x.id").alias("a"), F.explode(others).alias("b"))

    def sifted(pairs: DataFrame) -> DataFrame:
        both = pairs.where("a <> b").distinct().join(side(traits, "a"), "a").join(side(traits, "b"), "b")
        return both.where(likely(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"), similarity)).select("a", "b")

    pairs = materialize(sifted(few.union(stars)), "pairs")
    ids = materialize(pairs.select("a").union(pairs.select("b")).union(clusters.select("id")).distinct().toDF("id"), "ids")
    sets = sets_of(ids, texts, words)
    links = confirmed(pairs, sets, similarity)
    labels = components(links)
    more = links_outside(clusters.join(traits.select("id", "n"), "id"), labels, sets, similarity)
    if not more.isEmpty():
        forget(labels)
        labels = components(links.union(more))
    forget(sets, links, more, reps, buckets, members, pivots, clusters, pairs, ids)
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("found"))
    out = signed.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


#: The same rows by counting the common shingles of all documents that share one.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(id, node) AS (SELECT DISTINCT x, x FROM e UNION SELECT reach.id, e.y FROM reach JOIN e ON e.x = reach.node),
m AS (SELECT id, min(node) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id
"""
