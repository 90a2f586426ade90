"""What the corpus operators share: tables, scratch tables, joins with hot keys, words and names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.plans.columns import let
from leafline.plans.scratch import forget, materialize

__all__ = ["LOWER", "UPPER", "WHITE", "WHITE_RUN", "forget", "join_split", "kept", "let", "materialize", "n_bytes_of", "n_words_of", "table", "trimmed", "words_of"]

#: White space between words: tab, line feed, vertical tab, form feed, carriage return, blank.
WHITE = "\t\n\x0b\x0c\r "
WHITE_RUN = "[\\x09-\\x0D\\x20]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a side that is broadcast, at most; and parts that a key falls into where it isn't.
FEW_ROWS, SALTS = 100_000, 8


#: What a Python worker keeps between the tasks of one operator, by name: compiled tokenizers and their tables.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is the one that knows it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow in little memory: Python workers live on from one operator to the next, idle while others need the memory.

    What is kept by other names than those that begin with `uses` is dropped first, and freed memory is given back at the end.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [name for name in _kept if not uses or not name.startswith(uses)]
        for name in others:
            del _kept[name]
        if others:
            give_back()
        yield from run(batches)
        give_back()

    return out


def join_split(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, few: int = FEW_ROWS) -> DataFrame:
    """big joined to small, a written table with one row for each key, so that no key of big lands in one task.

    small goes to all tasks if its rows, counted here, are few; else both sides are dealt by key and by the salt
    that the hash of spread gives.
    """
    if small.count() <= few:
        return big.join(F.broadcast(small), keys)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def words_of(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def n_words_of(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WHITE_RUN))).cast("long")


def n_bytes_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
