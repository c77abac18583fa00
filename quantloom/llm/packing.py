"""Order-preserving packing by dynamic programming.

The documents of a task form one stream of tokens. Windows of at most ``LENGTH`` tokens
are cut from it in order; a cut costs nothing at a document's end, ``SENTENCE_CUT`` at a
sentence's end and ``WORD_CUT`` elsewhere, and every token of padding costs one. With
cost(j) the least cost of a stream that ends at boundary j,

    cost(j) = cut(j) + LENGTH - p(j) + min over i of (cost(i) + p(i)),  p(j) - p(i) <= LENGTH,

and since p grows, the minimum over the sliding range comes from a monotone queue: each
boundary enters and leaves it once.

A task keeps one slice of text and the tokens of the window that is still open; nothing is
shuffled. The tokens that remain at its end fill windows whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..shipping import ship
from .textbytes import LOWER, U64, mix, raw, slices

LENGTH = 2048
END_ID = 1
SENTENCE_CUT = 4
WORD_CUT = 12
#: a word's end is a boundary about every so many tokens
STEP = 48
#: words whose ids a worker keeps; it holds them, some 50 bytes each, also between tasks
CACHED_WORDS = 300_000
#: bytes of text that are encoded at a time
SLICE_BYTES = 1 << 20
MARK = "\x7f"
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_PUNCTUATION = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])
_SENTENCE_ENDS = np.frombuffer(b".!?", np.uint8)
TOKENIZER = "word_bpe_49k.json"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of those of its bytes with their places."""
    length = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], length)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(mix((place << 8 | data).astype(U64) + U64(1)), out=total[1:])
    return mix(np.diff(total[offsets]) + length.astype(U64))


class WordIds:
    """Token ids of words. The tokenizer drops white space and never joins over it, so a
    text's ids are those of its words; each distinct word is encoded once. Words are kept as bytes in a row, and
    found by their hashes, in order; bytes tell apart two words of one hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, U64)
        self.row = np.zeros(0, np.int32)
        self.data = np.zeros(0, np.uint8)
        self.begin = np.array([0, 0], np.int64)
        self.flat = np.array([END_ID], "<u4")
        self.first = np.array([0], np.int64)
        self.length = np.array([1], np.int32)
        self.ends = np.array([2], np.int8)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words are encoded together, kept
        apart by a word whose only id no other word has."""
        if any(MARK in w for w in words):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], "<u4"), np.array(list(map(len, ids)), np.int64)
        texts = (f" {MARK} ".join(words[at : at + 2000]) + f" {MARK}" for at in range(0, len(words), 2000))
        # One at a time: what the tokenizer says of a text is many times as large as its ids.
        ids = np.concatenate([np.array(x.ids, "<u4") for text in texts for x in self.tokenizer.encode_batch_fast([text], add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _find(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Row of each word, 0 where it is not kept."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        row = np.where(self.hashes[at] == hashes, self.row[at], 0).astype(np.int64)
        length = np.diff(offsets)
        row[self.begin[row + 1] - self.begin[row] != length] = 0
        found = np.flatnonzero(row)
        n = length[found]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = self.data[np.repeat(self.begin[row[found]], n) + step] == data[np.repeat(offsets[found], n) + step]
        row[np.repeat(found, n)[~same]] = 0
        return row

    def of(self, words: pa.Array | list[str]) -> np.ndarray:
        """Row of each word, of distinct ones, in first, length and ends; row 0 is the end of a document."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        if len(self.length) + len(words) > CACHED_WORDS:
            self._reset()
        data, offsets = raw(words)
        hashes = word_hashes(data, offsets)
        rows = self._find(data, offsets, hashes)
        new = np.flatnonzero(rows == 0)
        if len(new):
            rows[new] = np.arange(len(self.length), len(self.length) + len(new))
            added = words.take(pa.array(new))
            flat, length = self._encoded(added.to_pylist())
            data, offsets = raw(added)
            order = new[np.argsort(hashes[new])]
            at = np.searchsorted(self.hashes, hashes[order])
            self.hashes, self.row = np.insert(self.hashes, at, hashes[order]), np.insert(self.row, at, rows[order])
            self.begin = np.concatenate([self.begin, len(self.data) + offsets[1:]])
            self.data = np.concatenate([self.data, data])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length.astype(np.int32)])
            self.flat = np.concatenate([self.flat, flat])
            # White space at the ends of a text makes an empty word, which has no last byte.
            some, ends = np.flatnonzero(np.diff(offsets)), np.zeros(len(new), np.int8)
            ends[some] = np.isin(data[offsets[some + 1] - 1], _SENTENCE_ENDS)
            self.ends = np.concatenate([self.ends, ends])
        return rows


def separated(texts: pa.Array) -> pa.Array:
    """Texts of the same ids with fewer distinct words: the tokenizer lower-cases, and always
    cuts between a letter or digit and a punctuation mark. Slices that may spell a special token stay as they are."""
    data, offsets = raw(texts)
    if b"<|" in data.tobytes():
        return texts
    data = LOWER[data]
    at = np.flatnonzero(_ALNUM[data[:-1]] & _PUNCTUATION[data[1:]]) + 1
    offsets = (offsets + np.searchsorted(at, offsets)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.insert(data, at, 0x20)))


_known: WordIds | None = None


def word_ids(path: str) -> WordIds:
    global _known
    if _known is None or _known.path != path:
        _known = WordIds(path)
    return _known


def encode(texts: pa.Array, vocabulary: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, each with its end id; tokens of each text; and where a word, sentence
    or document ends after some tokens (positions, kinds 0, 1 and 2)."""
    lists = pc.ascii_split_whitespace(separated(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    rows = vocabulary.of(coded.dictionary if len(coded) else [])
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    per_word = rows[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    n = len(texts)
    stream = np.zeros(len(per_word) + n, np.int64)
    stream[np.arange(len(per_word)) + np.repeat(np.arange(n), counts)] = per_word
    length = vocabulary.length[stream]
    end = np.cumsum(length)
    total = int(end[-1]) if n else 0
    ids = vocabulary.flat[np.repeat(vocabulary.first[stream] - (end - length), length) + np.arange(total)]
    doc_end = end[np.cumsum(counts + 1) - 1] if n else np.zeros(0, np.int64)
    kinds = vocabulary.ends[stream]
    cut = (kinds > 0) | (np.diff(end // STEP, prepend=0) > 0)
    return ids, np.diff(doc_end, prepend=0), end[cut], kinds[cut]


def with_steps(place: np.ndarray, cost: np.ndarray, most: int, word_cut: int = WORD_CUT) -> tuple[np.ndarray, np.ndarray]:
    """Adds boundaries inside very long words, so that none are more than half of ``most`` apart."""
    step = max(1, most // 2)
    gap = np.diff(place, prepend=0)
    more = np.maximum(0, (gap - 1) // step)
    if not more.any():
        return place, cost
    which = np.repeat(np.arange(len(place)), more)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1
    extra = place[which] - gap[which] + nth * step
    all_places = np.concatenate([place, extra])
    order = np.argsort(all_places, kind="stable")
    return all_places[order], np.concatenate([cost, np.full(len(extra), word_cut)])[order]


def cuts(place: list[int], cost: list[int], most: int = LENGTH) -> list[int]:
    """Ends of the windows. ``place``: boundaries in ascending order, at most ``most`` apart and
    from 0; the last is the end of what is known. The tokens after the last cut (fewer than
    ``most``) stay for the next call and cost nothing yet."""
    total = [0] + [0] * len(place)
    value = [0] * (len(place) + 1)
    back = [0] * (len(place) + 1)
    at = [0, *place]
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > most:
            queue.popleft()
        i = queue[0]
        back[j] = i
        total[j] = value[i] + most - here + cost[j - 1]
        v = value[j] = total[j] + here
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    last = min((j for j in range(len(at) - 1, -1, -1) if at[-1] - at[j] < most), key=lambda j: total[j] + at[-1] - at[j], default=0)
    out = []
    while last:
        out.append(at[last])
        last = back[last]
    return out[::-1]


def powers(n: int) -> list[int]:
    """Ends of windows with the powers of two in n, largest first."""
    out, at = [], 0
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


class Stream:
    """The open end of a task's stream: tokens after the last cut and the documents they are of."""

    def __init__(self, partition: int, most: int):
        self.most = most
        self.sequence = partition << 40
        self.ids = np.zeros(0, "<u4")
        self.place = np.zeros(0, np.int64)
        self.kind = np.zeros(0, np.int64)
        self.doc = np.zeros((0, 3), np.int64)  # id, first token here (negative: earlier), tokens

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, tokens: np.ndarray, place: np.ndarray, kind: np.ndarray) -> None:
        n = len(self.ids)
        first = n + np.cumsum(tokens) - tokens
        self.doc = np.concatenate([self.doc, np.stack([doc_ids, first, tokens], axis=1)])
        self.ids = np.concatenate([self.ids, ids])
        self.place = np.concatenate([self.place, place + n])
        self.kind = np.concatenate([self.kind, kind])

    def pieces(self, ended: bool) -> list[list[int]]:
        """Columns of SCHEMA for what is cut now; the rest stays open."""
        n = len(self.ids)
        if not n:
            return []
        place, cost = with_steps(self.place, np.choose(self.kind, [WORD_CUT, SENTENCE_CUT, 0]), self.most)
        window = np.array(cuts(place.tolist(), cost.tolist(), self.most), np.int64)
        if ended:
            done = int(window[-1]) if len(window) else 0
            window = np.concatenate([window, done + np.array(powers(n - done), np.int64)])
        if not len(window):
            return []
        done = int(window[-1])
        begin = np.concatenate([[0], window[:-1]])
        doc_first = self.doc[:, 1]
        start = np.union1d(begin, doc_first[(doc_first >= 0) & (doc_first < done)])
        end = np.append(start[1:], done)
        of_doc = np.searchsorted(doc_first, start, "right") - 1
        of_window = np.searchsorted(begin, start, "right") - 1
        ids = self.ids
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        out = [self.doc[of_doc, 0], start - doc_first[of_doc], end - start, np.array(crc, np.int64), self.doc[of_doc, 2], self.sequence + of_window, start - begin[of_window]]
        self.sequence += len(window)
        self.ids = self.ids[done:]
        keep = self.place > done
        self.place, self.kind = self.place[keep] - done, self.kind[keep]
        self.doc = self.doc[self.doc[:, 1] + self.doc[:, 2] > done] - np.array([0, done, 0])
        return out


def _packer(path: str, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_ids(path)
        stream = Stream(TaskContext.get().partitionId(), most)

        def cut(ended: bool) -> Iterator[pa.RecordBatch]:
            if found := stream.pieces(ended):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=_ARROW)

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                doc_ids = part.column("doc_id")
                stream.add(doc_ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), *encode(part.column("text"), vocabulary))
                yield from cut(False)
        yield from cut(True)

    return pack


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most ``length`` tokens; see SCHEMA.

    A document's tokens are its ids and one end id, so a null or empty text is one token.
    A null doc_id comes back as -1. Repeated rows are packed each for itself. An empty
    table gives no rows. Documents stay in the order in which their partition has them.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer or tokenizer_path(), length), SCHEMA)
