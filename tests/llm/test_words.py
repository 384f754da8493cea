"""Pieces that are words go to a tokenizer's merges without being matched again."""

from __future__ import annotations

import random

import numpy as np

from quarrylight.llm import tokenizers_io as T

_ODD = ["a", "Z", "é", "ÿ", "ö", "×", "÷", "ſ", "ɏ", "ß", "0", "²", "'s", "'", ".", ",", "$", "%%%", "_", "`", "<|", "|>", "<|endoftext|>", "'ll", "ж", "漢", "́", "­", "😀"]


def test_words_as_the_tokenizer_has_them():
    rng, path = random.Random(5), T.vocabulary(T.BYTE_JSON)
    parts = [rng.choice(["", " "]) + "".join(rng.choices(_ODD, k=rng.randint(1, 5))) for _ in range(4000)] + [" the", "the", " the.", "the.", " ", "\n", "\t", "a\x00"]
    got = T.json_coder(path).make(parts)
    want = [T.json_tokenizer(path).encode(p, add_special_tokens=False).ids for p in parts]
    assert [got[i].tolist() for i in range(len(parts))] == want
    assert len(T.json_coder(path).make([])) == 0 and len(T.json_coder(path).make(["é漢"])) == 1


def test_a_word_is_coded_once():
    met: list[str] = []
    rest = lambda parts: T.Ragged.of([met.append(p) or [1] for p in parts], np.uint32)
    token = type("Token", (), {"id": 7})
    merged: list[str] = []
    make = T._by_words(lambda text: merged.append(text) or [token], rest)
    got = make([" word", " word.", " word,", " word$$", "1", " word's"])
    assert merged == ["Ġword", ".", ",", "$$"] and met == ["1", " word's"]
    assert [got[i].tolist() for i in range(6)] == [[7], [7, 7], [7, 7], [7, 7], [1], [1]]
