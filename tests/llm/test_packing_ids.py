"""Ids by word against the tokenizer over whole texts, with generations small enough to turn over."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataline.llm import packing


@pytest.mark.parametrize("most", [250_000, 40])
def test_ids_equal_the_tokenizer(monkeypatch, most):
    monkeypatch.setattr(packing, "REMEMBERED", most)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, ids, rng = Tokenizer.from_file(path), packing.Ids(path), random.Random(3)
    whole.encode_special_tokens = True
    signs = ["a", "A", "b", " ", " ", "é", "É", "'", "s", "\x1c", "\x00", "\x7f", "\n", "\t", ".", ",", "!", "0", "19", "<|endoftext|>", "ß", "İ", "中", "🙂"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(500)] + ["it's", "don't'll x'S", "", " "]
    texts.append(" ".join("".join(rng.choices("abcde.1", k=6)) for _ in range(3000)))
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == want.ids


def test_words_of_latin_letters_are_looked_up_by_their_runs(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, ids, rng = Tokenizer.from_file(path), packing.Ids(path), random.Random(4)
    whole.encode_special_tokens = True
    asked = []
    each = packing.Ids._each
    monkeypatch.setattr(packing.Ids, "_each", staticmethod(lambda tokenizer, words: asked.extend(words) or each(tokenizer, words)))
    latin = [chr(c) for c in range(0xA1, 0x100)]
    texts = [a + b for a in latin for b in ("", "e", "E", ".", "7", "\u0301")] + [f"x{a}Y" for a in latin]
    texts += ["".join(rng.choices([*latin, *"abcXYZ019.,-%"], k=rng.randrange(1, 15))) for _ in range(3000)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == want.ids
    before = len(asked)
    ids.encode("Reonier Éèpa. oucheaué %%%lesenèanier, Straße-12")
    assert len(asked) == before
