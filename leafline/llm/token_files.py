"""Token-ID files in patched frame-of-reference blocks.

Documents are dealt out by ranges of their ids and ordered within each; every range is encoded and
packed into segments, each one complete file image of the format below, kept as a row of a Parquet
table in the shared folder, so any store Spark writes to can hold them and a lost executor only
repeats its ranges. A segment holds whole documents, SEGMENT_IDS ids or the one document that has more.

Segment: header (magic, version, documents, ids, blocks), doc_ids and end offsets of the documents as
64-bit integers, block starts as 64-bit integers, then the blocks. Block: BLOCK ids (the last may be
shorter), from which the block's minimum is taken; the rest is packed at the width that holds
PERCENTILE of them, and what does not fit stands in full in a list of exceptions.

`documents_at` reads single documents: segments are chosen by their smallest and largest id, and of an image
only the blocks that hold the document are unpacked, found through the block starts.

Defined results: null and empty texts are one end id. Repeated doc_ids stay apart, ordered by the
hashes of their texts; a null doc_id comes first. A text of any length is one document of one segment. An
empty table gives an empty table. Of the input only the two named columns are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import kept, materialize, table, trimmed

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
BLOCK, PERCENTILE = 128, 0.9
SEGMENT_IDS = 1 << 20
MAGIC, VERSION = b"PFOR", 1
HEAD, BLOCK_HEAD = struct.Struct("<4sIQQQ"), struct.Struct("<IHBB")  # block: minimum, ids, width, exceptions
NO_ID = -(1 << 63)
#: Text pieces whose ids a worker keeps, in each of two generations.
PIECES = 400_000
#: Characters of texts that are cut at once, pieces that the library sees in one call, and endings of pieces whose ids a worker keeps.
GROUP, AT_ONCE, ENDINGS = 4_000_000, 256, 10_000
#: Marks that end pieces, each run of them a pre-token of its own behind a letter or digit; the apostrophe is none, as it may begin a pre-token of letters.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Letters and digits in any edition of Unicode.
PLAIN = frozenset("0123456789" + "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha()))
#: White space besides the blank and the line feed.
OTHER_WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the blocks of ids (uint32), and where each block starts."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = int(BLOCK * PERCENTILE)
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    unfit = (rest >> np.minimum(width, 31).astype(np.uint32)[:, None] != 0) & (width < 32)[:, None]
    block, place = np.nonzero(unfit)
    odd = np.bincount(block, minlength=n)
    sizes = BLOCK_HEAD.size + BLOCK // 8 * width + 5 * odd
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = np.zeros((n, BLOCK_HEAD.size), np.uint8)
    heads[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    heads[:, 4:6] = np.append(np.full(n - 1, BLOCK), len(ids) - (n - 1) * BLOCK).astype("<u2").view(np.uint8).reshape(n, 2)
    heads[:, 6], heads[:, 7] = width, odd
    out[starts[:, None] + np.arange(BLOCK_HEAD.size)] = heads
    fits = np.where(unfit, 0, rest)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        values = fits[own].reshape(-1, 32, 4)  # four values side by side, as bit-packing by words has them
        words = np.zeros((len(own), w, 4), np.uint32)
        for i in range(32):
            word, off = divmod(i * w, 32)
            words[:, word] |= values[:, i] << np.uint32(off)
            if off + w > 32:
                words[:, word + 1] |= values[:, i] >> np.uint32(32 - off)
        out[(starts[own] + BLOCK_HEAD.size)[:, None] + np.arange(16 * w)] = words.astype("<u4").view(np.uint8).reshape(len(own), -1)
    after = starts + BLOCK_HEAD.size + 16 * width
    out[places(after, odd)] = place
    out[places(after + odd, 4 * odd)] = rest[block, place].astype("<u4").view(np.uint8)
    return out, starts


def unpack(raw: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """The ids of all blocks; raw: their bytes."""
    n = len(starts)
    out = np.zeros((n, BLOCK), np.uint32)
    heads = raw[starts[:, None] + np.arange(BLOCK_HEAD.size)]
    low = heads[:, :4].copy().view("<u4").reshape(-1)
    width, odd = heads[:, 6].astype(np.int64), heads[:, 7].astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        words = raw[(starts[own] + BLOCK_HEAD.size)[:, None] + np.arange(16 * w)].view("<u4").reshape(-1, w, 4)
        values = np.zeros((len(own), 32, 4), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for i in range(32):
            word, off = divmod(i * w, 32)
            values[:, i] = words[:, word] >> np.uint32(off)
            if off + w > 32:
                values[:, i] |= words[:, word + 1] << np.uint32(32 - off)
            values[:, i] &= mask
        out[own] = values.reshape(-1, BLOCK)
    after = starts + BLOCK_HEAD.size + 16 * width
    out[np.repeat(np.arange(n), odd), raw[places(after, odd)]] = raw[places(after + odd, 4 * odd)].view("<u4")
    return (out + low[:, None]).reshape(-1)[:total]


def segment(doc_ids: list[int | None], parts: list[bytes]) -> bytes:
    """One file image; parts: each document's ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends = np.cumsum([len(p) // 4 for p in parts]).astype("<u8")
    blocks, starts = pack(ids)
    names = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, VERSION, len(names), len(ids), len(starts)), names.tobytes(), ends.tobytes(), starts.astype("<u8").tobytes(), blocks.tobytes()])


def read_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids, the end offsets and all ids of a file image."""
    magic, version, docs, ids, blocks = HEAD.unpack_from(image)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file of this version")
    at = HEAD.size
    names = np.frombuffer(image, "<i8", docs, at)
    ends = np.frombuffer(image, "<u8", docs, at + 8 * docs).astype(np.int64)
    starts = np.frombuffer(image, "<u8", blocks, at + 16 * docs).astype(np.int64)
    return [None if d == NO_ID else d for d in names.tolist()], ends, unpack(np.frombuffer(image, np.uint8, -1, at + 16 * docs + 8 * blocks), starts, ids)


def read_document(image: bytes, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the documents of this doc_id in a file image, from their blocks alone."""
    magic, version, docs, ids, blocks = HEAD.unpack_from(image)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file of this version")
    at = HEAD.size
    names = np.frombuffer(image, "<i8", docs, at)
    ends = np.frombuffer(image, "<u8", docs, at + 8 * docs).astype(np.int64)
    starts = np.frombuffer(image, "<u8", blocks, at + 16 * docs).astype(np.int64)
    raw = np.frombuffer(image, np.uint8, -1, at + 16 * docs + 8 * blocks)
    wanted = NO_ID if doc_id is None else doc_id
    out = []
    for i in range(*np.searchsorted(names, [wanted, wanted + 1]).tolist()):
        a, b = int(ends[i - 1]) if i else 0, int(ends[i])
        first, last = a // BLOCK, -(-b // BLOCK)
        own = unpack(raw, starts[first:last], min(last * BLOCK, ids) - first * BLOCK)
        out.append(own[a - first * BLOCK : b - first * BLOCK])
    return out


def can_cut(path: str) -> bool:
    """Whether a tokenizer file has what Encoder's cuts rest on: bytes as they are, the usual byte-level pattern, no added token with white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(" \n" + OTHER_WHITE)) for t in spec.get("added_tokens") or [])
    model = spec["model"]
    return bool(spec.get("normalizer") is None and plain and added and model.get("type") == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix"))


class Encoder:
    """The library's ids of whole texts.

    With tokenizers that don't allow cuts (see can_cut) every text goes through the library whole. With others a text is cut before every blank and line feed, if no white space stands before one of these and
    there is no other white space; byte-level pre-tokens and added tokens never reach across such a
    place, so the ids of the pieces are the ids of the text. Each piece goes through the library once,
    many in one call, and its ids are kept; marks at the end of a piece, behind a letter or digit, are a pre-token
    too, so with the marks it is put together of the ids of both. Texts with other white space go through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library, self.cuts = Tokenizer.from_file(path), can_cut(path)
        names = self.library.get_vocab(with_added_tokens=True)
        # a byte-level token has a letter for each of its bytes
        self.length = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.length[i] = len(name)
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}
        added = {c for t in self.library.get_added_tokens_decoder().values() for c in t.content}
        self.marks = "".join(c for c in MARKS if c not in added)
        self.model = None if any(t.content.isalpha() for t in self.library.get_added_tokens_decoder().values()) else self.library.model

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str) -> bool:
        """Whether it can be cut."""
        if not self.cuts or not text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
            return False
        return not any(c in text for c in (OTHER_WHITE[:8] if text.isascii() else OTHER_WHITE))

    def learn(self, pieces: list[str]) -> None:
        """By one call on all of them; the blank before a piece is left out, the line feed not. The first pieces of texts get a line feed as well, a pre-token that is taken off in encode."""
        whole = [p if p[0] == "\n" else " " + p for p in pieces]
        ids = np.frombuffer(self.direct(["".join(whole)])[0], "<u4")
        ends = np.cumsum(self.length[ids])
        stop = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in whole])
        until = np.searchsorted(ends, stop) + 1
        if (ends[until - 1] != stop).any():
            raise AssertionError("a token reaches across a cut")
        self.kept.update((p, ids[a:b].tobytes()) for p, a, b in zip(pieces, [0, *until.tolist()], until.tolist(), strict=False))

    def ending(self, marks: str) -> bytes:
        if marks not in self.endings:
            if len(self.endings) >= ENDINGS:
                self.endings.clear()
            self.endings[marks] = self.direct([marks])[0]
        return self.endings[marks]

    def find(self, pieces: set[str]) -> None:
        """Puts the ids of pieces, none of which is among the kept ones, there."""
        kept, older, marks = self.kept, self.older, self.marks
        todo, ended = set(), []
        for p in pieces:
            ids = older.get(p)
            if ids:
                kept[p] = ids
                continue
            bare = p.rstrip(marks)
            if len(bare) == len(p) or not bare or bare[-1] not in PLAIN:
                todo.add(p)
                continue
            ended.append((p, bare))
            if bare not in kept:
                if bare in older:
                    kept[bare] = older[bare]
                else:
                    todo.add(bare)
        if self.model:  # letters alone are one pre-token, whose bytes have themselves as letters
            words = [p for p in todo if p.isalpha() and p.isascii()]
            todo.difference_update(words)
            for p in words:
                kept[p] = array("I", [t.id for t in self.model.tokenize("\u0120" + p)]).tobytes()
        new = list(todo)
        for k in range(0, len(new), AT_ONCE):
            self.learn(new[k : k + AT_ONCE])
        for p, bare in ended:
            kept[p] = kept[bare] + self.ending(p[len(bare) :])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        ends = np.cumsum([len(text) for text in texts]) // GROUP
        for a, b in zip(*(x.tolist() for x in (np.searchsorted(ends, np.unique(ends)), np.searchsorted(ends, np.unique(ends), "right"))), strict=True):
            yield from self.group(texts[a:b])

    def group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.kept) > PIECES:
            self.older, self.kept = self.kept, {"": b""}
        kept, feed = self.kept, len(self.direct(["\n"])[0]) // 4 if self.cuts else 0
        cut = [self.cut(text) for text in texts]
        lines = pa.array(["\n" + text if c else "" for text, c in zip(texts, cut, strict=True)], pa.large_string())
        pieces = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")  # the first of each text is empty
        coded = pieces.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = list(map(kept.get, names))
        missing = [i for i, ids in enumerate(own) if ids is None]
        self.find({names[i] for i in missing})
        for i in missing:
            own[i] = kept[names[i]]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        each = sizes[codes]
        ids = np.frombuffer(b"".join(own), "<u4")[places(starts[codes], each)]
        ends = np.append(0, np.cumsum(each))[pieces.offsets.to_numpy()].tolist()
        for text, c, start, end in zip(texts, cut, ends[:-1], ends[1:], strict=True):
            yield ids[start + feed : end].tobytes() if c else self.direct([text])[0]


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(f"encoder {path}", lambda: Encoder(path))


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """The table of segments: part, seq, before (ids before it in its part), n_ids, low, high (its smallest and largest doc_id, null if it has none), image."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        engine, part = encoder(path), TaskContext.get().partitionId()
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = seq = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, seq, before
            known = [i for i in ids if i is not None] or [None]  # in order
            columns = [pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (seq, before, size, known[0], known[-1])), pa.array([segment(ids, parts)], pa.binary())]
            seq, before, size = seq + 1, before + size, 0
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "before", "n_ids", "low", "high", "image"])

        for batch in batches:
            for i, one in zip(batch.column("id").to_pylist(), engine.encode(batch.column("text").to_pylist()), strict=True):
                ids.append(i)
                parts.append(one + end)
                size += len(one) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield flush()
        if ids:
            yield flush()

    return materialize(df.mapInArrow(trimmed(run, "encoder"), "part int, seq long, before long, n_ids long, low long, high long, image binary"), "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    return read_back(files, True)


def read_back(files: DataFrame, with_ids: bool) -> DataFrame:
    # one row for each part, which is a task of the writer
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    first, at = {}, 0
    for part, n in totals:
        first[part] = at
        at += n
    last = "ids" if with_ids else "ids_crc32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "image")), strict=True):
                names, ends, ids = read_segment(image)
                data = ids.astype("<u4").tobytes()
                starts = np.append(0, ends[:-1])
                own = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(starts + first[part] + before), pa.array(ends - starts), pa.array(own, pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", last])

    return files.select("part", "before", "image").mapInArrow(trimmed(run), f"doc_id long, start long, n_tokens long, {last} {'binary' if with_ids else 'long'}")


def documents_at(files: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and ids (binary, as above) of the documents wanted, a short list; those that aren't there have no row."""
    wanted = sorted(set(wanted))
    ranges = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda w: F.col("low").isNotNull() & (F.col("low") <= w) & (w <= F.col("high")))
    near = files.where(F.col("high") >= wanted[0]).where(F.col("low") <= wanted[-1]).where(ranges) if wanted else files.where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column("image").to_pylist():
                found = [(w, own.astype("<u4").tobytes()) for w in wanted for own in read_document(image, w)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["doc_id", "ids"])

    return near.select("image").mapInArrow(trimmed(run), "doc_id long, ids binary")


def token_digest(df: DataFrame, path: str) -> DataFrame:
    return read_back(write_token_files(df, path), False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
