"""What op3 sends around must not grow with unlike texts: its lists, sketches and families."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quantloom.llm import jaccard
from quantloom.llm.textbytes import U64


def test_sets_of_unlike_sizes_are_no_family():
    """A large set's bitmap folded to a small one's places says nothing; their sizes tell that they can't link."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64)) for n in (98, 140, 9_000, 6_000, 500)]
    sets.append(sets[2][100:])
    family = jaccard.may_link(np.arange(6), np.array([len(s) for s in sets]), [jaccard.parity_bits(s) for s in sets])
    assert family[2] == family[5] >= 0
    assert (family[[0, 1, 3, 4]] == -1).all()


def test_bitmaps_tell_unlike_sets_of_one_size_apart():
    rng = np.random.default_rng(2)
    for n in (100, 333, 641, 853, 1_500, 5_200):
        sets = [np.unique(rng.integers(0, 1 << 63, k, dtype=np.int64).astype(U64)) for k in (n, n, n * 4 // 5)]
        assert len(jaccard.parity_bits(sets[0])) * 8 <= max(128, 1.6 * n)
        family = jaccard.may_link(np.arange(3), np.array([len(s) for s in sets]), [jaccard.parity_bits(s) for s in sets])
        assert (family == -1).all(), n


def test_rare_words_stand_first_in_the_lists():
    """Two texts that share a phrase of frequent words, which no sample knows, meet in no list."""
    frequent = [f"w{i}" for i in range(20)]
    often = np.zeros(jaccard.WORD_SLOTS, np.uint8)
    often[jaccard.word_slots(jaccard.Words(pa.array([" ".join(frequent)]), jaccard.NOT_SPACE).hashes())] = 90
    none = np.zeros(0, U64), np.zeros(0, np.int64)
    texts = pa.array([" ".join([f"{c}{i}" for i in range(100)] + frequent) for c in "xy"])
    first = []
    for s, weights in jaccard.weighted_sets(texts, often):
        assert (s == np.sort(s)).all() and len(s) == len(weights) == 116
        first.append(set(jaccard.in_order(s, weights, none)[: len(s) - jaccard.least_overlap(len(s)) + 1].tolist()))
    both = set.intersection(*(set(s.tolist()) for s in jaccard.shingle_sets(texts)))
    assert len(both) == 16 and not first[0] & both and not first[0] & first[1]
