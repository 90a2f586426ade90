"""Token counts by a compiled finite-state transducer, without building token lists.

A byte-level BPE tokenizer is compiled to a deterministic transducer over bytes. Its state holds the
part of the pre-token that can still be inside a token (the longest suffix that begins some token)
and the last token and relative count at each position of it; a step finds the one token that may end
there (the token before it must be a valid neighbour) and is annotated with the change of the count.
States and transitions are made when first met and kept in a table of bounded size, as lazy DFA
matchers do; a full table is started anew.

Texts are cut into chunks that run side by side. A chunk's state map is constant from its first
synchronising point on (a place where a pre-token starts whatever came before), so the map is: the
bytes before that point, the count behind it, the state at the end. Maps compose associatively: the
state at one chunk's end runs over the bytes up to the next synchronising point, which a reverse
running minimum (a parallel prefix scan) finds for all chunks at once. What a lane runs in sequence is bound
by the distance of synchronising points plus CHUNK; a text that is one run of letters has one lane.

Defined results: null and empty texts count 0 tokens. The tokenizer's added tokens count one wherever
they occur, as the library has it by default. Repeated rows are counted one by one. A text of any length is counted
as a whole. An empty table gives an empty table. Other columns are carried along by name; n_bytes, n_tokens and
over_limit of the input are replaced. A tokenizer file of another kind than the one compiled here raises.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import kept, table, trimmed

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
CHUNK, AT_ONCE = 512, 3 << 20
SLOTS = 1 << 21
L, N, O, S = 0, 1, 2, 3  # letters, numbers, others, white space


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, O, np.int8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = L
        elif kind == "N":
            out[i] = N
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = S
    return out


class Transducer:
    """The compiled tokenizer. Symbols are byte * 4 + class of the byte's character."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split, own = model.get("pre_tokenizer") or {}, model["model"]
        if model.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True) or own.get("type") != "BPE" or own.get("end_of_word_suffix"):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {raw(s) for s in model["model"]["vocab"]}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.special = [t["content"].encode() for t in model["added_tokens"]]
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.classes = classes()
        self.start_over()

    def start_over(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.keys = np.full(SLOTS, -1, np.int64)
        self.next = np.zeros(SLOTS, np.int32)
        self.emit = np.zeros(SLOTS, np.int16)
        self.flat: dict[int, tuple[int, int]] = {}
        self.fresh = self.id_of(("fresh", (), b""))

    def id_of(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def bpe(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, a: bytes, b: bytes) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[a, b] = self.bpe(a + b) == [a, b]
        return self.pairs[a, b]

    def advance(self, window: tuple, byte: int) -> tuple[tuple, int]:
        """window: () or (bytes, ((last token, relative count), ...)), an entry for each place between its bytes.

        Gives the window after another byte and the change of the count.
        """
        text, places = window or (b"", ((b"", 0),))
        text += bytes([byte])
        for k in range(len(text)):  # the longest token first
            token, (before, count) = text[k:], places[k]
            if token in self.tokens and (not before or self.neighbours(before, token)):
                break
        change = count + 1 - places[-1][1]
        places = (*places, (token, count + 1))
        k = next(k for k in range(len(text) + 1) if text[k:] in self.prefixes or k == len(text))
        return (text[k:], tuple((t, c - count - 1) for t, c in places[k:])), change

    def run(self, window: tuple, text: bytes) -> tuple[tuple, int]:
        total = 0
        for b in text:
            window, change = self.advance(window, b)
            total += change
        return window, total

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The pre-token rules. state: (kind, window, pending bytes); the count leaves pending bytes out."""
        byte, kind = symbol >> 2, symbol & 3
        was, window, pending = state
        own = bytes([byte])
        if 0x80 <= byte < 0xC0:  # inside a character
            if was == S:
                return (S, window, pending + own), 0
            after, change = self.advance(window, byte)
            return (was, after, b""), change
        if kind == S:
            if was == S:
                after, change = self.run(window, pending)
                return (S, after, own), change
            return (S, (), own), 0
        if was == S:
            if pending == b" ":
                after, change = self.run((), pending + own)
                return (kind, after, b""), change
            _, alone = self.run((), pending)
            after, change = self.step(("fresh", (), b""), symbol)
            return after, alone + change
        if was == "'" and kind == L:
            if own in b"stmd":
                _, change = self.run((), b"'" + own)
                return ("fresh", (), b""), change - 1
            after, change = self.run((), own)
            return ("'" + chr(byte) if own in b"rvl" else L, after, b""), change
        if was in ("'r", "'v", "'l") and own == {"r": b"e", "v": b"e", "l": b"l"}[was[1]]:
            _, change = self.run((), was.encode() + own)
            return ("fresh", (), b""), change - 2
        if byte == 39 and was not in ("'", O):
            return ("'", self.run((), own)[0], b""), 1
        if kind == {"'": O, "'r": L, "'v": L, "'l": L}.get(was, was):
            after, change = self.advance(window, byte)
            return (kind, after, b""), change
        after, change = self.run((), own)
        return (kind, after, b""), change

    def last(self, state: int) -> int:
        """What the end of a text adds."""
        was, window, pending = self.states[state]
        return self.run(window, pending)[1] if was == S else 0

    def make(self, key: int) -> tuple[int, int]:
        if key not in self.flat:
            after, change = self.step(self.states[key >> 10], key & 1023)
            self.flat[key] = self.id_of(after), change
            at = self.place(np.array([key]))[0]
            self.keys[at], (self.next[at], self.emit[at]) = key, self.flat[key]
        return self.flat[key]

    def room(self, more: int, state: np.ndarray) -> bool:
        """Starts the table anew if `more` transitions would fill it too much; renumbers the states in use."""
        if len(self.flat) + more <= SLOTS * 2 // 3:
            return False
        used = [self.states[s] for s in state.tolist()]
        self.start_over()
        state[:] = [self.id_of(s) for s in used]
        return True

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it would go."""
        at = ((keys * 0x9E3779B97F4A7C1) >> 20) & (SLOTS - 1)
        off = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (SLOTS - 1)
            there = self.keys[at[off]]
            off = off[(there != keys[off]) & (there >= 0)]
        return at

    def lanes(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs every range of symbols from its own state; gives the states and counts at the ends."""
        state, total = state.astype(np.int64), np.zeros(len(begin), np.int64)
        order = np.argsort(begin - end, kind="stable")  # the longest first
        length = (end - begin)[order]
        t = 0
        while True:
            live = order[: np.searchsorted(-length, -t, "left")]
            if not len(live):
                return state, total
            if len(live) < 24:
                for k in live:
                    s, n, flat = int(state[k]), 0, self.flat
                    for c in symbols[begin[k] + t : end[k]].tolist():
                        known = flat.get(s << 10 | c)
                        if known is None:
                            state[k] = s
                            if self.room(1, state):
                                s, flat = int(state[k]), self.flat
                            known = self.make(s << 10 | c)
                        s, e = known
                        n += e
                    state[k], total[k] = s, total[k] + n
                return state, total
            keys = state[live] << 10 | symbols[begin[live] + t]
            at = self.place(keys)
            if len(missing := np.flatnonzero(self.keys[at] < 0)):
                new = np.unique(keys[missing])
                if self.room(len(new), state):
                    keys = state[live] << 10 | symbols[begin[live] + t]
                    new = np.unique(keys)
                for key in new.tolist():
                    self.make(key)
                at = self.place(keys)
            state[live] = self.next[at]
            total[live] += self.emit[at]
            t += 1

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text, none of which holds an added token."""
        out = np.zeros(len(texts), np.int64)
        if len(self.flat) > SLOTS // 3:
            self.start_over()
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return out
        data = b"".join(texts)
        raw = np.frombuffer(data, np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        leads = (raw & 0xC0) != 0x80
        if len(points) < len(raw):
            kind = kind[np.cumsum(leads) - 1]
        symbols = raw.astype(np.int64) << 2 | kind
        # where a pre-token starts whatever came before, and where a text does
        before, odd = np.roll(kind, 1), np.roll(raw == 39, 1)
        sync = leads & (kind != before) & (before != S) & ~((before == O) & odd & (kind == L))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sync[starts[sizes > 0]] = True
        # chunks: the texts' own starts, and every CHUNK bytes the next character
        cuts = np.arange(0, len(raw), CHUNK)
        cuts = np.unique(np.concatenate([cuts, starts[sizes > 0]]))
        points_of = np.where(sync, np.arange(len(raw)), len(raw))
        nearest = np.minimum.accumulate(points_of[::-1])[::-1]  # the next synchronising point from each byte on
        first = np.unique(nearest[cuts])
        first = first[first < len(raw)]
        stop = np.append(cuts, len(raw))[np.searchsorted(cuts, first, "right")]
        after, total = self.lanes(symbols, first, stop, np.full(len(first), self.fresh))
        # each chunk's last state goes on to the next chunk's synchronising point
        goal = np.append(first[1:], len(raw))
        after, rest = self.lanes(symbols, stop, goal, after)
        owner = np.searchsorted(ends, first, "right")
        np.add.at(out, owner, total + rest)
        final = np.isin(goal, ends[sizes > 0])
        for k in np.flatnonzero(final):
            if self.states[after[k]][0] == S:
                out[owner[k]] += self.last(int(after[k]))
        return out

    def tokens_of(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text, added tokens counting one each."""
        parts, owner, out = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for mark in self.special:
                pieces = [p for piece in pieces for p in piece.split(mark)]
            out[i] += len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= AT_ONCE):
                size += len(parts[end])
                end += 1
            np.add.at(out, owner[at:end], self.count(parts[at:end]))
            at = end
        return out


def transducer(path: str) -> Transducer:
    """One for each worker process and vocabulary."""
    return kept(f"transducer {path}", lambda: Transducer(path))


def count_tokens(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """The columns in keep (all others if not given), n_bytes, n_tokens (long) and over_limit (more than limit tokens).

    path: a tokenizers JSON file of byte-level BPE, at the same place on every machine.
    """
    named = [c for c in (df.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens", "over_limit")]
    df = df.select(*named, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = transducer(path)
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            tokens = engine.tokens_of(texts)
            columns = [batch.column(c) for c in named] + [pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[*named, "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(trimmed(run, "transducer"), f"{schema}{', ' * bool(schema)}n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep=["doc_id"])
