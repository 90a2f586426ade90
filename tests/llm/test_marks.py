"""The library is asked for a word once, not for each of the marks that may follow it."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from leafline.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Word, word. word; word!! word's, 7, 7.\nword, 'll, été, été... मा, मा. x<|endoftext|>, <|endoftext|>. a|>, (b), \",", "word?! word-- word) 中, 中. ñ$$$ ñ%%% 3.5, ...", "", "two  blanks, here."]


def test_words_are_asked_for_once(monkeypatch):
    engine = token_files.Encoder(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in engine.library.encode_batch(TEXTS, add_special_tokens=False)]
    seen = []
    learn = engine.learn
    monkeypatch.setattr(engine, "learn", lambda pieces: (seen.extend(pieces), learn(pieces))[1])
    assert list(engine.encode(TEXTS)) == want == list(engine.encode(TEXTS))
    assert not [p for p in seen if p.rstrip(",.;!?-$%)") in ("word", "été", "ñ", "7") and p[-1] in ",.;!?-$%)"] and len(seen) == len(set(seen))


def test_groups_and_generations(monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 30)
    monkeypatch.setattr(token_files, "PIECES", 5)
    engine = token_files.Encoder(PATH)
    texts = [*TEXTS, *(f"w{k}, word, no{k}. word{k}" for k in range(60)), "long " * 50 + "end", ""]
    want = [np.array(e.ids, "<u4").tobytes() for e in engine.library.encode_batch(texts, add_special_tokens=False)]
    assert list(engine.encode(texts)) == want and list(engine.encode([])) == []
