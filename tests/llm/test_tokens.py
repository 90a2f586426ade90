from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from leafline.llm import token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"aB1 's'\n\t é漢字!?.,relvtdm　😀½_\r", "<|endoftext|>", "'re", "'ll", " the", "ing", "     ", "====", "\n\n", " "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 80))) for _ in range(3000)]
    return [*made, "a" * 5000, " " * 5000, "'" * 999, "漢" * 700, "ab" * 3000, "", "x" * 511 + " y", "thereation " * 400]


def test_counts_are_the_library_s(library, texts):
    engine = token_counts.Transducer(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert engine.tokens_of([t.encode() for t in texts]).tolist() == want
    assert [int(engine.tokens_of([t.encode()])[0]) for t in texts[:200]] == want[:200]


def test_a_full_table_starts_anew(library, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "SLOTS", 1 << 14)
    engine = token_counts.Transducer(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts[:600], add_special_tokens=False)]
    got = [int(x) for k in range(0, 600, 100) for x in engine.tokens_of([t.encode() for t in texts[k : k + 100]])]
    assert got == want


def test_ids_of_pieces_are_ids_of_texts(library, texts):
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(token_files.Encoder(PATH).encode(texts)) == want


@pytest.mark.parametrize("ids", [[], [7], [0, 50256], list(range(129)), [5] * 128 + [4_000_000_000], [2**32 - 1, 0] * 300])
def test_blocks_round_trip(ids):
    own = np.array(ids, np.uint32)
    data, starts = token_files.pack(own)
    assert token_files.unpack(data, starts, len(own)).tolist() == ids


def test_random_blocks_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 700))
        own = (rng.integers(0, 1 << int(rng.integers(1, 33)), n) * (rng.random(n) < 0.8) + rng.integers(0, 50, n)).astype(np.uint32)
        data, starts = token_files.pack(own)
        assert (token_files.unpack(data, starts, n) == own).all()


def check_digest(spark, docs, library):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(docs, PATH).collect())
    rows = docs.select("doc_id", "text").collect()
    at = 0
    want = {}
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for (start, doc_id, n, crc), expect in zip(got, sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows), strict=True):
        assert (-1 if doc_id is None else doc_id) == expect and start == at
        want[doc_id].remove((n, crc))
        at += n


def test_files_round_trip(spark, sf_dir, odd_docs, no_docs, library):
    check_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), library)
    check_digest(spark, odd_docs, library)
    assert token_files.token_digest(no_docs, PATH).count() == 0


def test_stored_ids(spark, odd_docs, library):
    files = token_files.write_token_files(odd_docs, PATH)
    rows = {r["doc_id"]: r for r in token_files.read_token_files(files).collect()}
    text = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 12)
    assert np.frombuffer(rows[12]["ids"], "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_counts_on_odd_rows(odd_docs, no_docs, library):
    out = token_counts.count_tokens(odd_docs, PATH).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


def test_documents_are_read_through_block_starts(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    files = token_files.write_token_files(docs, PATH)
    some = sorted(texts)[::17]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.documents_at(files, [*some, 10**12]).collect()}
    assert got == {i: [*library.encode(texts[i], add_special_tokens=False).ids, 2] for i in some}
    assert token_files.documents_at(files, []).count() == 0
    parts = [np.arange(k, k + 300, dtype="<u4").tobytes() for k in range(20)]
    image = bytearray(token_files.segment([None, *range(1, 20)], parts))
    blocks = token_files.HEAD.unpack_from(image)[4]
    at = token_files.HEAD.size + 16 * 20
    starts = np.frombuffer(bytes(image), "<u8", blocks, at).astype(int)
    first, last = 7 * 300 // token_files.BLOCK, -(-8 * 300 // token_files.BLOCK)
    for k in range(blocks):  # all blocks but those of document 7 are spoilt
        if not first <= k < last:
            a = at + 8 * blocks + starts[k]
            image[a : at + 8 * blocks + starts[k + 1] if k + 1 < blocks else len(image)] = bytes(len(image[a : at + 8 * blocks + starts[k + 1] if k + 1 < blocks else len(image)]))
    assert token_files.read_document(bytes(image), 7)[0].tolist() == list(range(7, 307))
    assert token_files.read_document(bytes(token_files.segment([None, None, 3], parts[:3])), None)[1].tolist() == list(range(1, 301))


def test_other_tokenizers_see_whole_texts(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not token_files.can_cut(path) and token_files.can_cut(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts[:300], add_special_tokens=False)]
    assert list(token_files.Encoder(path).encode(texts[:300])) == want
    with pytest.raises(ValueError):
        token_counts.Transducer(path)


def test_workers_keep_only_what_an_operator_uses():
    from leafline.llm import common

    common._kept.clear()
    assert common.kept("a 1", lambda: 5) == 5 and common.kept("a 1", lambda: 6) == 5
    assert list(common.trimmed(iter, "a")([1, 2])) == [1, 2] and "a 1" in common._kept
    assert list(common.trimmed(iter)([3])) == [3] and not common._kept
