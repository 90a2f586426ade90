"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in partitions; how many rows of each partition go to each shard is drawn from the exact
multivariate hypergeometric law, every partition permutes its rows and deals them out by those
counts, and every shard permutes what it got. Shard sizes differ by one row at most.

A partition is a hash class of the row's key, not a file split, so that a recomputed task or another
run draws the same result. Only the count of each partition reaches the driver, and at most
MOST_PARTITIONS of them; rows never do. Shards are permuted in ranges of their random keys, so no
task holds a whole shard.

Defined results: null keys and texts are ordinary values. Rows that are equal in all key columns are
interchangeable, and share a partition. Texts count by what keys are made of them, whatever their length. An
empty table gives an empty table. Columns shard and slot of the input are replaced, others carried through.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.llm.common import materialize, n_bytes_of, table

SHARDS, SEED = 16, 20240229
ROWS_PER_PARTITION, MOST_PARTITIONS = 16384, 65536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among draws out of good + bad, exactly distributed, for numbers of any size.

    Inversion outwards from the mode; weights follow from their ratios, so nothing overflows.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    weights = [(mode, 1.0)]
    for step, end in ((1, high), (-1, low)):
        k, w = mode, 1.0
        while k != end and w > 1e-18:
            if step > 0:
                w *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
            else:
                w *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
            k += step
            weights.append((k, w))
    at = rng.random() * math.fsum(w for _, w in weights)
    for k, w in weights:
        at -= w
        if at <= 0:
            return k
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """One row for each partition, one column for each shard; rows sum to counts, columns to sizes."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest, draws = [], sum(left), n
        for have in left:
            k = hypergeometric(rng, have, rest - have, draws)
            row.append(k)
            rest -= have
            draws -= k
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def hypergeometric_shuffle(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """df with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard)."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    n = df.select(*keys[:1]).count()
    parts = min(MOST_PARTITIONS, max(8, -(-n // rows_per_partition)))
    first, second = F.xxhash64(F.lit(seed), *keys), F.xxhash64(F.lit(seed + 1), *keys)
    rows = df.withColumns({"__first": first, "__part": F.pmod(F.xxhash64(F.lit(seed + 2), *keys), F.lit(parts)).cast("int")})
    counts = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    order = sorted(counts)
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[p] for p in order], sizes, seed)
    ends = [(p, [sum(row[: s + 1]) for s in range(shards)]) for p, row in zip(order, matrix, strict=True)]
    dealt = spark.createDataFrame(ends, "__part int, __ends array<long>")
    if parts * shards * 8 <= 8 << 20:  # the matrix's own size is known here
        dealt = F.broadcast(dealt)
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__first", *keys)) - 1
    rows = rows.withColumn("__place", place).join(dealt, "__part")
    rows = rows.withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__place"))).cast("int")).drop("__ends", "__place", "__part", "__first")
    ranges = max(1, -(-n // (shards * rows_per_partition)))
    # the upper 31 bits of the second key, cut into ranges of equal width
    upper = F.shiftrightunsigned(second, 33)
    rows = materialize(rows.withColumns({"__second": second, "__range": F.floor(upper * ranges / F.lit(2.0**31)).cast("int")}), "dealt")
    # a negative long's upper bits are the larger ones; order within a range follows them as well
    sums = rows.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__range")) - F.col("__n")
    offsets = sums.select("shard", "__range", before.alias("__before"))
    slot = F.col("__before") + F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__second", *keys)) - 1
    return rows.join(offsets, ["shard", "__range"]).withColumn("slot", slot.cast("long")).drop("__range", "__second", "__before")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (n_bytes_of(text) + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    # texts are read and hashed once; the shuffle goes over these three numbers
    out = hypergeometric_shuffle(materialize(docs, "sizes"), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
