"""Packing texts without words, and the empty words that white space at the ends of a text makes."""

from __future__ import annotations

import pyarrow as pa
import pytest

from quantloom.llm import packing


@pytest.mark.parametrize("texts", [[None], [""], [" \t\n\x0b "], [None, "", "  "]])
def test_texts_without_words(texts):
    ids, tokens, place, kinds = packing.encode(pa.array(texts, pa.string()), packing.WordIds(packing.tokenizer_path()))
    assert ids.tolist() == [packing.END_ID] * len(texts) and tokens.tolist() == [1] * len(texts)
    assert place.tolist() == list(range(1, len(texts) + 1)) and kinds.tolist() == [2] * len(texts)


@pytest.mark.parametrize("words", [["", "end."], ["end.", ""], ["", "why?", "no"], [""]])
def test_an_empty_word_ends_no_sentence(words):
    vocabulary = packing.WordIds(packing.tokenizer_path())
    for turn in (words, words[::-1]):
        rows = vocabulary.of(turn)
        assert vocabulary.ends[rows].tolist() == [w[-1:] in (".", "!", "?") for w in turn]
        assert [int(n) for n in vocabulary.length[rows]] == [len(vocabulary.tokenizer.encode(w, add_special_tokens=False).ids) for w in turn]
