"""What a worker holds at a time does not swell with unlike words."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from quantloom.llm import jaccard, langid, packing


def test_language_of_many_distinct_words():
    words = [f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) + "aternoon" for i in range(100_000)]
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(0, 1, (1 << langid.BITS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = pa.array([" ".join(words[:60_000]), " ".join(words[60_000:]), None, ""])
    tracemalloc.start()
    got = model.probabilities(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for row, part in enumerate((words[:60_000], words[60_000:])):
        buckets, _ = langid.subwords(pa.array(part))
        np.testing.assert_allclose(got[row], langid.softmax(model.scores[buckets].astype(float).mean(0, keepdims=True))[0], rtol=1e-9)


def test_tokenizer_gets_one_text_at_a_time():
    vocabulary = packing.WordIds(packing.tokenizer_path())
    whole, sizes = vocabulary.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            sizes.append(len(texts))
            return whole.encode_batch_fast(texts, **more)

    vocabulary.tokenizer = Counted()
    words = [f"w{i}" for i in range(9_000)]
    rows = vocabulary.of(words)
    assert max(sizes) == 1 and len(sizes) == 5
    for i in (0, 1_999, 2_000, 8_999):
        first, n = int(vocabulary.first[rows[i]]), int(vocabulary.length[rows[i]])
        assert vocabulary.flat[first : first + n].tolist() == whole.encode(words[i], add_special_tokens=False).ids


def test_cached_words_take_few_bytes():
    vocabulary = packing.WordIds(packing.tokenizer_path())
    words = [f"{i * 7919:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(60_000)]
    tracemalloc.start()
    for at in range(0, len(words), 10_000):
        vocabulary.of(words[at : at + 10_000])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 75 * len(words)
    rows = vocabulary.of(words[5:50_000:997])
    for w, row in zip(words[5:50_000:997], rows.tolist(), strict=True):
        first, n = int(vocabulary.first[row]), int(vocabulary.length[row])
        assert vocabulary.flat[first : first + n].tolist() == vocabulary.tokenizer.encode(w, add_special_tokens=False).ids


def test_words_of_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(packing, "word_hashes", lambda data, offsets: np.diff(offsets).astype(np.uint64) % np.uint64(2))
    vocabulary = packing.WordIds(packing.tokenizer_path())
    words = ["one", "two", "end.", "three", "four", "why?", "zebra", "one.", "éé", "x" * 3_000]
    for turn in (words, words[::-1], ["new", *words[3:], "two"]):
        for w, row in zip(turn, vocabulary.of(turn).tolist(), strict=True):
            first, n = int(vocabulary.first[row]), int(vocabulary.length[row])
            assert vocabulary.flat[first : first + n].tolist() == vocabulary.tokenizer.encode(w, add_special_tokens=False).ids
            assert vocabulary.ends[row] == (w[-1] in ".!?")


def test_sets_of_many_texts_are_made_in_small_slices():
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(texts), pa.array(range(1_000))], names=["doc_id", "text", "text_hash"])
    list(jaccard._describe(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    got = sum(part.num_rows for part in jaccard._describe(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 1_000
    assert peak < 15_000_000
