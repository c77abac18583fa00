"""Benchmark decontamination with a Wu-Manber search over words.

A benchmark item's windows are its runs of ten words. Windows of one length share a table
of shifts: the last block of words under a cursor says how many words the cursor may jump
without passing an occurrence. Where it may not jump, the block's bucket names the windows that
end with it, a hash of their first block thins them out, and word by word comparison decides.

Benchmarks are searched in blocks of a bounded number of windows, so that what is sent to the
workers does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .textbytes import ALNUM, Words, slices

WINDOW = 10
#: (window, item) pairs of one block of the benchmark, about 15 MB when sent
BLOCK = 100_000
#: window ends that one cursor covers
STRETCH = 256
SCHEMA = "doc_id long, n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>, text_key string"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item): each distinct run of ``window`` words of each item, written with single spaces; an item
    of fewer words is one window, one without words none. An item without an id has the empty one."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))
    return words.where(F.size("w") > 0).select(F.explode(runs).alias("window"), "item").distinct()


class Matcher:
    """The windows of one length, as numbers of words: shifts by block, buckets by last block."""

    def __init__(self, patterns: np.ndarray):
        self.patterns = patterns
        self.length = patterns.shape[1]
        self.block = min(2, self.length)
        self.bits = max(8, int(8 * len(patterns) * self.length).bit_length())
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int64)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self.key(patterns, end), self.length - 1 - end)
        last = self.key(patterns, self.length - 1)
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1))
        self.prefix = self.key(patterns, self.block - 1)

    def key(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self._hash(rows[:, end], rows[:, end - 1] if self.block == 2 else None)

    def _hash(self, last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        h = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if before is not None:
            h += before.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(3)) & np.uint64((1 << self.bits) - 1)

    def _at(self, ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hash(ids[end], ids[end - 1] if self.block == 2 else None)

    def ends(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Ends of words whose last block some window ends with; a cursor in each stretch jumps by the shifts."""
        first = ptr[:-1] + self.length - 1
        n = np.maximum(0, -(-(ptr[1:] - first) // STRETCH))
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + part * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(ptr[1:], n))
        found = []
        while len(at):
            jump = self.shift[self._at(ids, at)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of occurrences in ids, and the windows that occur there."""
        if not len(self.patterns) or not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = self.ends(ids, ptr)
        key = self._at(ids, end)
        low = self.bucket[key]
        n = self.bucket[key + np.uint64(1)] - low
        window = self.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        first = np.repeat(end, n) - self.length + 1
        like = self._at(ids, first + self.block - 1) == self.prefix[window]
        first, window = first[like], window[like]
        for k in range(self.length):
            same = ids[first + k] == self.patterns[window, k]
            first, window = first[same], window[same]
        return first, window


class Benchmark:
    """The matchers of a block of (window, item) pairs, one for each length of its windows."""

    def __init__(self, pairs: list[tuple[str, str]]):
        windows = sorted({w for w, _ in pairs})
        number = {w: i for i, w in enumerate(windows)}
        items = sorted({x for _, x in pairs})
        place = {x: i for i, x in enumerate(items)}
        self.items = items
        of = np.array(sorted((number[w], place[x]) for w, x in pairs), np.int64).reshape(-1, 2)
        self.owners, self.owner_ptr = of[:, 1], np.searchsorted(of[:, 0], np.arange(len(windows) + 1))
        split = [w.split(" ") for w in windows]
        vocabulary = sorted({word for w in split for word in w})
        hashes = Words(pa.array(vocabulary, pa.string()), ALNUM).hashes()
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.vocabulary = [vocabulary[i].encode() for i in order.tolist()]
        ids = {word.decode(): i for i, word in enumerate(self.vocabulary)}
        lengths = sorted({len(w) for w in split})
        self.own = [np.array([i for i, w in enumerate(split) if len(w) == n], np.int64) for n in lengths]
        self.matchers = [Matcher(np.array([[ids[word] for word in split[i]] for i in own.tolist()], np.int64)) for own in self.own]

    def ids(self, words: Words) -> np.ndarray:
        """The number of each word in the vocabulary; -1 for others."""
        if not self.vocabulary:
            return np.full(len(words), -1, np.int64)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def find(self, words: Words) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(first words, windows, length) of all occurrences, the words compared byte by byte."""
        ids = self.ids(words)
        out = []
        for own, matcher in zip(self.own, self.matchers, strict=True):
            first, window = matcher.search(ids, words.ptr)
            # Equal numbers are equal hashes of words; the bytes are compared once for each word of an occurrence.
            used = np.unique((first[:, None] + np.arange(matcher.length)).ravel())
            if any(words.word(i) != self.vocabulary[v] for i, v in zip(used.tolist(), ids[used].tolist(), strict=True)):
                true = [all(words.word(i + k) == self.vocabulary[ids[i + k]] for k in range(matcher.length)) for i in first.tolist()]
                first, window = first[true], window[true]
            out.append((first, own[window], matcher.length))
        return out

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, list[dict], list[str]]]:
        """(number of words, hit words, spans of hit words, items) of each text."""
        words = Words(texts, ALNUM)
        found = self.find(words)
        edge = np.zeros(len(words) + 1, np.int64)
        for first, _, n in found:
            np.add.at(edge, first, 1)
            np.add.at(edge, first + n, -1)
        hit = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(hit)])
        first = np.concatenate([f for f, _, _ in found]) if found else np.zeros(0, np.int64)
        window = np.concatenate([w for _, w, _ in found]) if found else np.zeros(0, np.int64)
        text = np.searchsorted(words.ptr, first, "right") - 1
        met = np.unique(np.stack([text, window]), axis=1)
        start = np.searchsorted(met[0], np.arange(len(texts) + 1))
        for t, n in enumerate(words.counts.tolist()):
            low, high = int(words.ptr[t]), int(words.ptr[t + 1])
            n_hit = int(before[high] - before[low])
            spans, items = [], []
            if n_hit:
                own = np.concatenate([[False], hit[low:high], [False]]).astype(np.int8)
                turns = np.flatnonzero(np.diff(own)).tolist()
                spans = [{"first": a, "last": b - 1} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                owners = {x for w in met[1, start[t] : start[t + 1]].tolist() for x in self.owners[self.owner_ptr[w] : self.owner_ptr[w + 1]].tolist()}
                items = [self.items[x] for x in sorted(owners)]
            yield n, n_hit, spans, items


def _scan(docs: DataFrame, pairs: list[tuple[str, str]], hits_only: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Benchmark(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = list(sent.value.scan(part.column("text")))
                kinds = (pa.int64(), pa.int64(), _SPAN, pa.list_(pa.string()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, part.column("text_key")], names=["doc_id", "n_words", "n_hit", "spans", "items", "text_key"])
                yield out.filter(pa.array([r[1] > 0 for r in rows], pa.bool_())) if hits_only else out

    return docs.mapInArrow(run, SCHEMA)


def hit_words(spans: Column) -> Column:
    """Words that lie in any of the spans (first, last), which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(acc["end"], s["first"] - 1))).alias("n"),
        F.greatest(acc["end"], s["last"]).alias("end"),
    )
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, contaminated) for each row of docs (doc_id, text), searched for
    the windows of benchmark (item_id, text).

    spans are the hit words' places, from 0 (they may overlap where a benchmark takes several searches); items the sorted ids of items with a window in the text. A null or
    empty text has no words and no hits; so have all texts if the benchmark has no words. Repeated rows are
    searched alike, repeated items count once, an item without an id has the empty one, and a row without a
    doc_id stays a row. An empty table gives no rows. At most ``block`` (window, item) pairs
    are sent to the workers at once, as expected by their hash; a larger benchmark takes several searches, whose hits are joined.
    """
    ship(docs.sparkSession)
    pairs = item_windows(benchmark, window)
    n_blocks = max(1, -(-pairs.count() // block))
    part = lambda k: [tuple(r) for r in pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == k).collect()]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n_blocks == 1:
        found = _scan(docs.withColumn("text_key", F.lit(None).cast("string")), part(0), False)
    else:
        # Rows of the same id and text have the same hits, so that one of them carries what the other blocks find.
        docs = docs.withColumn("text_key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))
        one = F.any_value("spans").alias("spans"), F.any_value("items").alias("items")
        others = [_scan(docs, part(k), True).groupBy("text_key").agg(*one) for k in range(1, n_blocks)]
        more = reduce(DataFrame.unionByName, others).groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
        both = lambda a, b: F.concat(F.col(a), F.coalesce(F.col(b), F.array()))
        found = (
            _scan(docs, part(0), False)
            .join(more, "text_key", "left")
            .withColumns({"spans": F.sort_array(both("spans", "s")), "items": F.array_sort(F.array_distinct(both("items", "i")))})
            .withColumn("n_hit", hit_words(F.col("spans")))
        )
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))


def with_digest(found: DataFrame) -> DataFrame:
    """find_contamination()'s rows with the number of items and the digest of their ids."""
    ids = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")
