"""Benchmark decontamination by winnowing.

Of the hashes of all K-word grams the smallest in each sliding window is kept (the rightmost of equal
ones), so every shared span of at least K + window - 1 words leaves a common fingerprint in document
and benchmark. Fingerprints of items and documents are joined, and each meeting is extended word by
word in both directions; spans of at least SPAN words (or a whole shorter item) count as hits.

Items shorter than SPAN words are whole grams of their own length, looked up at every place.

The benchmark's index goes to every task if its measured size is at most MOST_INDEX_BYTES. A larger one stays
a table: fingerprints that documents and items share are joined as rows, each is extended to the SPAN words
around it, and these windows, by hashes of 128 bits, are joined again. No text is paired with another.

Defined results: null texts and items have no words. Words are runs of digits, letters and everything
beyond ASCII, A to Z lowered. Items of equal text all count. Repeated rows of documents are judged
one by one. A text of any length is one row, whose fingerprints are found in one pass. Empty tables give no hits.
Columns of the input are carried through by `decontaminate`, whatever their names, and those named as results replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.llm.common import forget, join_split, materialize, table, trimmed
from leafline.llm.shingles import MASK, mix

SPAN, K = 13, 5
WINDOW = SPAN - K + 1
#: A document is contaminated if this share of its words is hit: one in SHARE.
SHARE = 20
MOST_INDEX_BYTES = 64 << 20
#: Turns the words of the first hash into those of the second.
SECOND = 0xC2B2AE3D27D4EB4F
#: Lowers A to Z and turns whatever parts words into a blank.
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words_in(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes (uint64)."""
    n = len(codes) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + codes[i : i + n]) if n > 0 else out
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of the fingerprints; of fewer hashes than a window the smallest."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    # the rightmost minimum of each window
    places = window - 1 - np.argmin(views[:, ::-1], axis=1) + np.arange(len(views))
    return np.unique(places)


class Index:
    """The benchmark: words by number, items as numbers, fingerprints to places."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.codes: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []
        self.names: list[str] = []
        longer: dict[int, list] = defaultdict(list)
        short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            found = words_in(text)
            if not found:
                continue
            codes = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in found], np.uint64)
            i = len(self.items)
            self.items.append(codes)
            self.names.append(name)
            if len(codes) < SPAN:
                short[len(codes)][int(grams(codes, len(codes))[0])].append((i, 0))
            else:
                hashes = grams(codes, K)
                for at in winnow(hashes).tolist():
                    longer[int(hashes[at])].append((i, at))
        self.tables = [(K, WINDOW, dict(longer))] if longer else []
        self.tables += [(k, 1, dict(x)) for k, x in sorted(short.items())]
        self.sorted = [np.sort(np.fromiter(x, np.uint64, len(x))) for _, _, x in self.tables]

    def hits(self, text: bytes | None) -> tuple[int, np.ndarray, list[str]]:
        """How many words the text has, which of them are hit, and the names of the items found."""
        found = words_in(text)
        codes = np.fromiter((self.codes.get(w, 0) for w in found), np.uint64, len(found))
        hit, items = np.zeros(len(found), bool), set()
        for (k, window, places), known in zip(self.tables, self.sorted, strict=True):
            if len(codes) < k:
                continue
            hashes = grams(codes, k)
            prints = winnow(hashes, window) if window > 1 else np.arange(len(hashes))
            own = hashes[prints]
            at = np.searchsorted(known, own)
            met = prints[known[np.minimum(at, len(known) - 1)] == own]
            done: dict[tuple[int, int], int] = {}  # item and offset: where its last span ended
            for p in met.tolist():
                for item, q in places[int(hashes[p])]:
                    if done.get((item, p - q), -1) > p:
                        continue
                    there = self.items[item]
                    a, b = p, q
                    while a > 0 and b > 0 and codes[a - 1] == there[b - 1]:
                        a, b = a - 1, b - 1
                    e, f = p, q
                    while e < len(codes) and f < len(there) and codes[e] == there[f]:
                        e, f = e + 1, f + 1
                    done[item, p - q] = e
                    if e - a >= min(SPAN, len(there)):
                        hit[a:e] = True
                        items.add(self.names[item])
        return len(found), hit, sorted(items)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


NEW = "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"


def verdict(n: int, hit: int) -> bool:
    return hit > 0 and SHARE * hit >= n


def with_index(df: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
    """df: the carried columns and __text. The index goes along with the function."""
    fields = [f.name for f in df.schema if f.name != "__text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != "__text") + NEW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            found = [index.hits(t) for t in batch.column("__text").cast(pa.binary()).to_pylist()]
            n, hit = [f[0] for f in found], [int(f[1].sum()) for f in found]
            columns = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f[2]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.string())), pa.array(map(verdict, n, hit), pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in fields] + columns, names=[*fields, "n_words", "n_hit", "n_items", "items", "contaminated"])

    return df.mapInArrow(trimmed(run), schema)


def text_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") & MASK


def prints_of(df: DataFrame, lengths: list[int], every: bool) -> DataFrame:
    """df: key, text. Gives key, k, at and print: fingerprints by hashes of words that need no common numbering.

    k: K for fingerprints of long items, -n for whole short items of n words, so that items of K words stay apart.
    lengths: of short items. every: of short ones the grams at every place (documents), else of items of that length only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            keys: list[int] = []
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = words_in(text)
                if len(known) > 500_000:
                    known.clear()
                codes = np.fromiter((known[w] if w in known else known.setdefault(w, text_hash(w)) for w in found), np.uint64, len(found))
                for k, whole in [(K, False), *((n, True) for n in lengths)]:
                    if len(codes) < k or (not every and (len(codes) != k if whole else len(codes) < SPAN)):
                        continue
                    hashes = grams(codes, k)
                    at = np.arange(len(hashes)) if whole else winnow(hashes)
                    out.append((-k if whole else k, at, hashes[at]))
                    keys += [key] * len(at)
            if out:
                k = np.concatenate([np.full(len(a), k) for k, a, _ in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(k, pa.int32()), pa.array(np.concatenate([a for _, a, _ in out]), pa.int64()), pa.array(np.concatenate([h for _, _, h in out]).view(np.int64))],
                    names=["key", "k", "at", "print"],
                )

    return df.mapInArrow(trimmed(run), "key long, k int, at long, print long")


def windows_of(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df: key, text and prints (array of k, at; null: whatever the text has). Gives key, k, at, h1 and h2 of every window around a fingerprint.

    k: words of the window. Around a fingerprint of a long item lie all windows of SPAN words that hold it; a whole short item is its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, prints in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("prints").to_pylist(), strict=True):
                found = words_in(text)
                codes = np.fromiter((text_hash(w) for w in found), np.uint64, len(found))
                n = len(codes)
                if prints is None:  # an item
                    spots = {n: np.arange(1)} if 0 < n < SPAN else {SPAN: np.arange(n - SPAN + 1)} if n else {}
                else:
                    long = np.array(sorted({p["at"] for p in prints if p["k"] == K}), np.int64)
                    around = np.unique((long[:, None] - np.arange(WINDOW)).ravel())
                    spots = {SPAN: around[(around >= 0) & (around <= n - SPAN)]}
                    spots |= {k: np.array(sorted({p["at"] for p in prints if p["k"] == -k}), np.int64) for k in lengths}
                for k, at in spots.items():
                    if len(at):
                        h1, h2 = grams(codes, k)[at], grams(mix(codes ^ np.uint64(SECOND)), k)[at]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["key", "k", "at", "h1", "h2"])

    return df.mapInArrow(trimmed(run), "key long, k int, at long, h1 long, h2 long")


def by_join(df: DataFrame, bench: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows with the benchmark as a table of any size. df: the carried columns and __text; bench: name, text."""
    numbered = materialize(df.withColumn("__key", F.monotonically_increasing_id()), "documents")
    bench = materialize(bench.withColumn("key", F.monotonically_increasing_id()), "items")
    n_words = lambda c: F.coalesce(F.regexp_count(c, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    short = bench.select(n_words(F.col("text")).alias("n")).where(f"n > 0 and n < {SPAN}").distinct()
    lengths = sorted(r["n"] for r in short.collect())  # fewer than SPAN
    texts = numbered.select(F.col("__key").alias("key"), F.col("__text").alias("text"))
    own = materialize(prints_of(texts, lengths, True), "prints")
    asked = prints_of(bench.select("key", "text"), lengths, False).select("k", "print").distinct()
    # each print once on either side, so that one of a third of all documents is a single row here
    shared = materialize(own.select("k", "print").distinct().join(asked, ["k", "print"]), "shared")
    met = join_split(own, shared, ["k", "print"], F.col("key")).groupBy("key").agg(F.collect_set(F.struct("k", "at")).alias("prints"))
    windows = materialize(windows_of(met.join(texts, "key"), lengths), "windows")
    none = F.lit(None).cast("array<struct<k:int,at:long>>").alias("prints")
    held = windows_of(bench.select("key", "text", none), lengths).select("k", "h1", "h2", F.col("key").alias("item")).distinct()
    place = ["k", "h1", "h2"]
    held = materialize(held.join(windows.select(place).distinct(), place), "held")
    hits = materialize(join_split(windows, materialize(held.select(place).distinct(), "hit-windows"), place, F.col("key")), "hits")
    # the words covered: windows in order of their starts, each counted from where those before it end
    end = F.col("at") + F.col("k")
    before = F.max(end).over(Window.partitionBy("key").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1))
    pieces = hits.select("key", "at", "k").distinct().withColumn("before", before)
    covered = pieces.groupBy("key").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("at", F.coalesce("before", "at")))).alias("__hit"))
    items = hits.select("key", *place).distinct().join(held, place).join(bench.select(F.col("key").alias("item"), "name"), "item")
    named = items.select("key", "name").distinct().groupBy("key").agg(F.sort_array(F.collect_list("name")).alias("__names"))
    out = numbered.join(covered.join(named, "key").withColumnRenamed("key", "__key"), "__key", "left").withColumn("__n", n_words(F.col("__text")))
    forget(own, shared, windows)
    hit, names = F.coalesce("__hit", F.lit(0)), F.coalesce("__names", F.array().cast("array<string>"))
    return out.select(*keys, F.col("__n").alias("n_words"), hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"), ((hit > 0) & (SHARE * hit >= F.col("__n"))).alias("contaminated"))


def decontaminate(df: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, most_index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """The columns in keep (all of df if not given), n_words, n_hit, n_items, items (their names, sorted as strings) and contaminated."""
    new = [x.split()[0] for x in NEW.split(", ")]
    keys = [c for c in (df.columns if keep is None else keep) if c not in new]
    df = df.select(*keys, F.col(text_col).alias("__text"))
    bench = bench.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).alias("text")).where("name is not null")
    size = bench.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    if size > most_index_bytes // 8:  # an index takes about eight times its text
        return by_join(df, bench, keys)
    items = [(r["name"], (r["text"] or "").encode()) for r in bench.collect()]  # its size is checked above
    return with_index(df, items)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same rows by joining all windows.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
