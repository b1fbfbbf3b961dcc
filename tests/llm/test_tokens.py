import gc
import random
import tracemalloc

import numpy as np
import pytest

from contestflow.llm import tokens


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_what_is_known_takes_few_bytes(name):
    draw, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    words = sorted({"".join(draw.choices(letters, k=draw.randint(5, 12))) for _ in range(40_000)})
    enc = tokens.Encoder(tokens.vocabulary(name))
    enc.encode([" ".join(words[:500])], 0)
    tracemalloc.start()
    try:
        for k in range(0, len(words), 4000):
            enc.encode([" ".join(words[k : k + 4000])], 0)
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] / len(words) < 80
    finally:
        tracemalloc.stop()


def test_pieces_of_one_hash_keep_their_own_ids():
    known, data = tokens.Known("<u2"), np.frombuffer(b"onetwoten", np.uint8)
    key, at, size = np.array([7], np.uint64), np.arange(9), np.array([3])
    for start, ids in ((0, [1, 2]), (3, [3])):
        assert known.find(key, data, at[start : start + 1], size).tolist() == [-1]
        slot = known.add(key, data, at[start : start + 1], size, [np.array(ids, "<u2").tobytes()])
        assert known.ids[known.id_ends[slot[0]] : known.id_ends[slot[0] + 1]].tolist() == ids
    assert known.find(key, data, at[:1], size).tolist() == [0]
    assert known.find(key, data, at[6:7], size).tolist() == [-1]


def test_pieces_found_again_are_kept():
    known, data = tokens.Known("<u2"), np.frombuffer(b"abcdef", np.uint8)
    at, size = np.arange(6), np.ones(6, np.int64)
    known.add(at.astype(np.uint64) + 1, data, at, size, [np.array([k] * (k + 1), "<u2").tobytes() for k in range(6)])
    known.find(np.array([2, 5], np.uint64), data, at[[1, 4]], size[:2])
    known.trim(3)
    slots = known.find(at.astype(np.uint64) + 1, data, at, size)
    assert (slots >= 0).tolist() == [False, True, False, False, True, False]
    assert [known.ids[known.id_ends[s] : known.id_ends[s + 1]].tolist() for s in slots[[1, 4]]] == [[1] * 2, [4] * 5]
    known.trim(1)
    assert not known.keys.size and not known.ids.size


def test_byte_words_go_to_the_model_together(monkeypatch):
    class Counting:
        calls = 0

        def __init__(self, model):
            self.model = model

        def tokenize(self, text):
            Counting.calls += 1
            return self.model.tokenize(text)

    enc = tokens.Encoder(tokens.vocabulary(tokens.BYTE_BPE))
    monkeypatch.setattr(enc, "model", Counting(enc.model))
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}{'.' * (k % 2)} \xe9t\xe9{chr(97 + k % 26)}" for k in range(600))
    (got,) = enc.encode([text], 0)
    assert Counting.calls == 0
    assert np.frombuffer(got, enc.dtype).tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 0]
