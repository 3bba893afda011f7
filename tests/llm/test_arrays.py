import random

import numpy as np
import pyarrow as pa

from glyphmill.llm.arrays import Hasher, text_bytes, windows, words_of


def hashed(texts, seed=1):
    data, offsets = text_bytes(pa.array(texts))
    words = words_of(data, offsets)
    return words, Hasher(seed).spans(words.data, words.start, words.end)


def thue_morse(order, a, b):
    out, other = a, b
    for _ in range(order):
        out, other = out + other, other + out
    return out, other


def test_equal_words_and_only_these_hash_alike():
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("ab\0é") for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["", None]
    words, hashes = hashed(texts)
    own = [words.data[s:e].tobytes() for s, e in zip(words.start, words.end)]
    assert len(set(zip(own, hashes.tolist()))) == len(set(own)) == len(set(hashes.tolist()))
    alone = np.concatenate([hashed([t])[1] for t in texts])
    assert alone.tolist() == hashes.tolist()


def test_sequences_and_runs():
    r = random.Random(3)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(400)]
    words, hashes = hashed(texts)
    whole = Hasher(1).sequences(hashes, words.first[:-1], words.first[1:])
    assert len(set(zip(texts, whole.tolist()))) == len(set(texts)) == len(set(whole.tolist()))
    start, doc = windows(words, 5)
    runs = Hasher(1).runs(hashes, start, 5).tolist()
    own = [tuple(texts[d].split()[s - words.first[d] : s - words.first[d] + 5]) for s, d in zip(start, doc)]
    assert len(set(zip(own, runs))) == len(set(own)) == len(set(runs))
    assert not len(Hasher(1).runs(hashes, start[:0], 5)) and not len(Hasher(1).spans(words.data, words.start[:0], words.end[:0]))


def test_patterns_that_powers_of_an_odd_base_confuse():
    for seed in (1, 21, 22, 31):
        for order in (11, 12, 14):
            _, hashes = hashed(list(thue_morse(order, "a", "b")), seed)
            assert hashes[0] != hashes[1]
            words, hashes = hashed(list(thue_morse(order, "a ", "b ")), seed)
            assert len(set(Hasher(seed).sequences(hashes, words.first[:-1], words.first[1:]).tolist())) == 2


def test_one_very_long_word():
    text = "x" * 3_000_001
    words, hashes = hashed([text, text[:-1] + "y", text])
    assert hashes[0] == hashes[2] != hashes[1]
