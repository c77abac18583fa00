"""Language-model scores from a log-frequency Bloom filter.

The filter holds each n-gram once for every step of its count on a logarithmic scale, so
its count, up to that scale, is the number of steps found by probing one after the other.
It holds every n-gram of the training texts, with ``BITS_PER_ENTRY`` bits for each step.

It consists of segments by the n-gram's hash. Their number grows with the tokens of the corpus, so the
task that counts the n-grams of a segment and fills it holds about ``SEGMENT_TOKENS`` of them at
any size. A filter of at most ``FILTER_BITS`` goes to all workers. A larger one never leaves
its tasks: the scan asks for the distinct n-grams of each slice of texts, the task that has a
segment answers what is asked of it, and the answers are put together by slice.

A word's probability is interpolated from its bigram's and its own; both counts come from
the filter. The words' own probabilities sum to one over the training words and one unknown, as
their denominator is the sum of the counts as the filter gives them; a bigram's share is that of its
head's count, and both are rounded to the scale. The base score beside it uses exact counts:
those of the most frequent words (at most ``FREQUENT``) go to the workers, all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .staging import discard, stage
from .tables import crc_mod
from .textbytes import NOT_SPACE, U64, Words, mix, slices

FREQUENT = 1 << 18
#: bits of a filter that is sent to all workers; a larger one is asked segment by segment
FILTER_BITS = 1 << 27
BITS_PER_ENTRY = 10
PROBES = 4
#: tokens of the corpus for each segment, about; there are LEAST_SEGMENTS at least
SEGMENT_TOKENS = 1 << 20
LEAST_SEGMENTS = 64
SCALE = 1.5
BIGRAM_WEIGHT = 0.2
#: n-grams that a counting task holds before it passes them on
HELD = 4_000_000
#: bytes of text in a slice that is scored at once; the larger, the fewer n-grams are asked for again
SLICE_BYTES = 1 << 22
#: bits that tell an n-gram from others of its segment, which has about a million of them
LOW = 32
#: questions for so many neighbouring segments travel together, once there are PARTS such parts
PART_SEGMENTS = 64
PARTS = 256
#: bits that tell a word from others in the model
WORD = 40
ORDERS = (1, 2)
END = U64(0x5851F42D4C957F2D)
START = U64(0x14057B7EF767814F)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with END after each text's, and the text of each."""
    w = Words(texts, NOT_SPACE)
    n = len(texts)
    of_word = np.repeat(np.arange(n), w.counts)
    out = np.full(len(w) + n, END, U64)
    out[np.arange(len(w)) + of_word] = w.hashes()
    return out, np.repeat(np.arange(n), w.counts + 1)


def unigrams(token: np.ndarray) -> np.ndarray:
    """The model's hash of each token, from the bits of it that the model knows."""
    return mix(token & U64((1 << WORD) - 1))


def bigrams(token: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; START precedes a text."""
    token = token & U64((1 << WORD) - 1)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    first = np.flatnonzero(np.diff(of_text, prepend=-1))
    before[first] = START
    return mix(before * U64(0x9E3779B97F4A7C15) + (token ^ (before >> U64(29))))


def level(count: np.ndarray) -> np.ndarray:
    """Steps of a count: 1 for 1, and one more each time it grows by SCALE."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(SCALE) + 1e-9).astype(np.int64)


#: SQL twins of level() and value()
LEVEL = f"1 + cast(floor(ln(n) / ln({SCALE}D) + 1e-9D) as int)"
VALUE = f"case when {LEVEL} <= 2 then ceil(pow({SCALE}D, {LEVEL} - 1)) else pow({SCALE}D, {LEVEL} - 1) * (1 + {SCALE}D) / 2 end"


def value(steps: np.ndarray) -> np.ndarray:
    """A count in the middle of a step; 0 for none."""
    low = SCALE ** (steps - 1.0)
    return np.where(steps > 0, np.where(steps <= 2, np.ceil(low), (low + low * SCALE) / 2), 0.0)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def _count(of_tokens, emit):
    """Counts hashes over a task's texts; passes them on when many are held, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in slices(batch):
                h, c = np.unique(of_tokens(*tokens(part.column("text"))), return_counts=True)
                hashes.append(h)
                counts.append(c)
                held += len(h)
                if held > HELD:
                    h, c = _merged(hashes, counts)
                    if len(h) > HELD // 2:
                        yield from emit(h, c)
                        hashes, counts, held = [], [], 0
                    else:
                        hashes, counts, held = [h], [c], len(h)
        if hashes:
            yield from emit(*_merged(hashes, counts))

    return run


def _rows(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(h), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 50_000].view(np.int64)), pa.array(c[at : at + 50_000])], names=["h", "n"])


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """By the upper bits of an n-gram's hash; segments is a power of two."""
    return (h >> U64(65 - segments.bit_length())).astype(np.int64)


def low_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The ``LOW`` bits after those that tell the segment."""
    return (h << U64(segments.bit_length() - 1)) >> U64(64 - LOW)


def pack(low: np.ndarray) -> bytes:
    return low.astype("<u4").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(U64)


def segments_of_a_part(segments: int) -> int:
    """A power of two, like ``segments``: a part's filters fit one task, and its questions of one slice are many at any size."""
    return segments // min(segments, max(PARTS, segments // PART_SEGMENTS))


def _by_segment(segments: int):
    """One row for each segment: its n-grams, and apart the places and counts of those that occur more than once."""

    def packed(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.searchsorted(segment_of(h, segments), np.arange(segments + 1)).tolist()
        low = low_of(h, segments)
        rows = []
        for g, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if x < y:
                more = np.flatnonzero(c[x:y] > 1)
                rows.append((g, pack(low[x:y]), more.astype("<u4").tobytes(), c[x:y][more].astype("<u8").tobytes()))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["segment", "low", "place", "count"])

    return packed


COUNTED = "segment int, low binary, place binary, count binary"


def _words_by_segment(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        passed = _by_segment(segments)

        def cut() -> Iterator[pa.RecordBatch]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from passed(*_merged([unigrams(h)], [n]))

        for batch in batches:
            held.append((batch.column("h").to_numpy().view(U64), batch.column("n").to_numpy()))
            if sum(len(h) for h, _ in held) > HELD // 4:
                yield from cut()
                held = []
        if sum(len(h) for h, _ in held):
            yield from cut()

    return run


def key(low: np.ndarray, order: int) -> np.ndarray:
    """What a segment holds of an n-gram."""
    return mix(low + U64(order * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))


class Filter:
    """A Bloom filter's segments, each of its own size, one after the other."""

    def __init__(self, parts: list[np.ndarray]):
        """parts: the bytes of every segment."""
        self.bits = np.concatenate([*parts, np.zeros(1, np.uint8)])
        self.size = np.array([max(8, len(x) * 8) for x in parts], U64)
        self.first = np.cumsum([0, *(len(x) * 8 for x in parts)])[:-1]
        self.empty = np.array([not len(x) for x in parts])

    @staticmethod
    def places(keys: np.ndarray, step: int, probe: int, bits: np.ndarray) -> np.ndarray:
        """Place inside a segment of ``bits`` bits: two halves of a hash give all probes."""
        h = mix(keys ^ U64(step * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        return (((h & U64(0xFFFFFFFF)) + U64(probe) * ((h >> U64(32)) | U64(1))) % bits).astype(np.int64)

    @staticmethod
    def filled(keys: np.ndarray, levels: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
        """Bytes of a segment that holds the keys, each for steps 1 to its level."""
        bits = -(-int(levels.sum()) * bits_per_entry // 64) * 64
        out = np.zeros(bits, bool)
        for step in range(1, int(levels.max(initial=0)) + 1):
            now = keys[levels >= step]
            for probe in range(PROBES):
                out[Filter.places(now, step, probe, U64(bits))] = True
        return np.packbits(out, bitorder="little")

    def levels(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The number of steps that the filter holds of each key."""
        out = np.zeros(len(keys), np.int64)
        alive = np.flatnonzero(~self.empty[segment])
        step = 1
        while len(alive):
            for probe in range(PROBES):
                at = self.first[segment[alive]] + self.places(keys[alive], step, probe, self.size[segment[alive]])
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[alive] = step
            step += 1
        return out


def _fill(order: int, bits_per_entry: int):
    """The filter's segment of the n-grams that are counted in the rows of one segment."""

    def fill(table: pa.Table) -> pa.Table:
        lows, counts = [], []
        for low, place, count in zip(*(table[c].to_pylist() for c in ("low", "place", "count")), strict=True):
            lows.append(unpack(low))
            c = np.ones(len(lows[-1]), np.int64)
            c[np.frombuffer(place, "<u4")] = np.frombuffer(count, "<u8")
            counts.append(c)
        h, c = _merged(lows, counts)
        bits = Filter.filled(key(h, order), level(c), bits_per_entry)
        return pa.table({"segment": pa.array([table["segment"][0].as_py()], pa.int32()), "n_words": pa.array([order], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return fill


FILLED = "segment int, n_words int, bits binary"


def _answer(span: int):
    """Of a part's filters and the questions for it: the levels that they hold of those asked for."""

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = {"row": pa.int64(), "part": pa.int32(), "n_words": pa.int32(), "levels": pa.binary()}
        if not asked.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        keys = zip(held["n_words"].to_pylist(), held["segment"].to_pylist(), strict=True)
        bits = {(o, g % span): x for (o, g), x in zip(keys, held["bits"].to_pylist(), strict=True)}
        orders, packed, sizes = np.array(asked["n_words"].to_pylist()), asked["low"].to_pylist(), asked["sizes"].to_pylist()
        levels: list[bytes] = [b""] * len(packed)
        for order in ORDERS:
            own = Filter([np.frombuffer(bits.get((order, g), b""), np.uint8) for g in range(span)])
            rows = np.flatnonzero(orders == order).tolist()
            low = unpack(b"".join(packed[i] for i in rows))
            segment = np.concatenate([np.repeat(np.arange(span), _read_sizes(sizes[i], span)) for i in rows] or [np.zeros(0, np.int64)])
            # Slices ask for many of the same n-grams: each is looked up once.
            once, place = np.unique((segment.astype(U64) << U64(LOW)) | low, return_inverse=True)
            found = own.levels(key(once & U64((1 << LOW) - 1), order), (once >> U64(LOW)).astype(np.int64)).astype(np.uint8)[place]
            ends = np.cumsum([len(packed[i]) * 8 // LOW for i in rows]).tolist()
            for i, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True):
                levels[i] = found[a:b].tobytes()
        return pa.table({"row": asked["row"], "part": asked["part"], "n_words": asked["n_words"], "levels": pa.array(levels, pa.binary())})

    return answer


def _sizes(n: np.ndarray) -> bytes:
    """Mostly small numbers, a byte each where all fit."""
    return n.astype("<u1" if n.max(initial=0) < 256 else "<u4").tobytes()


def _read_sizes(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u1" if len(packed) == n else "<u4").astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Mostly small numbers below 2 ** 32, compressed byte by byte."""
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _read_small(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, decompressed_size=4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64)


def _narrow(token: np.ndarray) -> bytes:
    """The bits of each token that the model knows, side by side."""
    return np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : WORD // 8]).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) * 8 // WORD, 8), np.uint8)
    out[:, : WORD // 8] = np.frombuffer(packed, np.uint8).reshape(-1, WORD // 8)
    return out.reshape(-1).view("<u8").astype(U64)


def _token_columns(token: np.ndarray, sizes: np.ndarray) -> dict[str, bytes]:
    """The tokens of a slice: its distinct words, frequent ones first, the place of each token among them, and the texts' sizes."""
    words, place, count = np.unique(token, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return {"words": _narrow(words[order]), "word_at": _small(rank[place]), "sizes": sizes.astype("<u4").tobytes()}


def _read_tokens(words: bytes, word_at: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, n = _wide(words), np.frombuffer(sizes, "<u4")
    return h[_read_small(word_at, int(n.sum()))], np.repeat(np.arange(len(n)), n)


def _questions(token: np.ndarray, of_text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each order: its distinct n-grams, which come by segment, and the place of each token's among them."""
    for order, grams in zip(ORDERS, (unigrams(token), bigrams(token, of_text)), strict=True):
        yield order, *np.unique(grams, return_inverse=True)


def _ask(segments: int):
    """Rows (row, part, n_words, sizes, low): what each slice asks each part, and how much of it each of its segments."""
    span = segments_of_a_part(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, *columns in zip(*(batch.column(c) for c in ("row", "words", "word_at", "sizes")), strict=True):
                rows = []
                for order, h, _ in _questions(*_read_tokens(*(x.as_py() for x in columns))):
                    n = np.bincount(segment_of(h, segments), minlength=segments).reshape(-1, span)
                    ends = np.cumsum(n.sum(axis=1))
                    low = low_of(h, segments)
                    rows += [(part, order, _sizes(n[part]), pack(low[ends[part] - n[part].sum() : ends[part]])) for part in np.flatnonzero(n.any(axis=1)).tolist()]
                part, order, sizes, low = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * len(rows), pa.int64()), pa.array(part, pa.int32()), pa.array(order, pa.int32()), pa.array(sizes, pa.binary()), pa.array(low, pa.binary())],
                    names=["row", "part", "n_words", "sizes", "low"],
                )

    return run


def _put_together(denominator: float):
    """The scores of a slice's texts from the answers for it."""

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by([("n_words", "ascending"), ("part", "ascending")])
        orders, levels = answers["n_words"].to_pylist(), answers["levels"].to_pylist()
        token, of_text = _read_tokens(*(texts[c][0].as_py() for c in ("words", "word_at", "sizes")))
        counts = []
        for order, h, place in _questions(token, of_text):
            found = np.frombuffer(b"".join(x for x, o in zip(levels, orders, strict=True) if o == order), np.uint8)
            assert len(found) == len(h)
            counts.append(value(found.astype(np.int64))[place])
        n = int(of_text[-1]) + 1
        logs = log10_of(*counts, of_text, denominator)
        return pa.table({"row": texts["row"][0].as_py() + np.arange(n), "score": np.bincount(of_text, weights=logs, minlength=n)})

    return score


def log10_of(count: np.ndarray, together: np.ndarray, of_text: np.ndarray, denominator: float) -> np.ndarray:
    """The log10 probability of each token after the one before, from its count and its bigram's."""
    alone = (count + 0.5) / denominator
    head = np.empty_like(count)
    head[1:] = count[:-1]
    # A text's start is followed by as many words as there are texts, that is, ends; a slice ends with one.
    head[np.flatnonzero(np.diff(of_text, prepend=-1))] = count[-1]
    follows = np.minimum(1.0, together / np.maximum(head, 1))
    mixed = (1 - BIGRAM_WEIGHT) * alone + BIGRAM_WEIGHT * np.where(head > 0, follows, alone)
    return np.log10(np.minimum(mixed, 1.0))


class Model:
    """What workers need: the filters of both orders, where they are sent, the totals, and the exact counts of frequent words."""

    def __init__(self, filters: dict[int, Filter] | None, segments: int, total: int, rounded: float, distinct: int, words: np.ndarray, counts: np.ndarray):
        self.filters, self.segments, self.total, self.rounded, self.distinct = filters, segments, total, rounded, distinct
        self.words, self.counts = words, counts

    @property
    def exact_denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def denominator(self) -> float:
        return self.rounded + 0.5 * (self.distinct + 1)

    def log10(self, token: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """The log10 probability of each token after the one before."""
        counts = []
        for order, h, place in _questions(token, of_text):
            levels = self.filters[order].levels(key(low_of(h, self.segments), order), segment_of(h, self.segments))
            counts.append(value(levels)[place])
        return log10_of(*counts, of_text, self.denominator)

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Counts of distinct words; -1 of those that are not frequent."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], -1)


def count_words(train: DataFrame) -> DataFrame:
    """(h, n): exact counts of all tokens."""
    ship(train.sparkSession)
    once = train.select("text").mapInArrow(_count(lambda t, o: t, _rows), "h long, n long")
    return once.groupBy("h").agg(F.sum("n").alias("n"))


def fill_filter(train: DataFrame, words: DataFrame, segments: int) -> DataFrame:
    """(segment, n_words, bits): the segments that hold the words, and those that hold the bigrams of train."""
    pairs = train.select("text").mapInArrow(_count(bigrams, _by_segment(segments)), COUNTED).groupBy("segment").applyInArrow(_fill(2, BITS_PER_ENTRY), FILLED)
    return words.mapInArrow(_words_by_segment(segments), COUNTED).groupBy("segment").applyInArrow(_fill(1, BITS_PER_ENTRY), FILLED).unionByName(pairs)


def segments_for(tokens: int) -> int:
    return max(LEAST_SEGMENTS, 1 << max(0, -(-tokens // SEGMENT_TOKENS) - 1).bit_length())


def fit(train: DataFrame, bits: int = FILTER_BITS, frequent: int = FREQUENT) -> tuple[Model, DataFrame, DataFrame]:
    """The model of train (text), the exact counts of its tokens, and its filter's segments."""
    spark = train.sparkSession
    words = stage(count_words(train), "op8-words")
    total, rounded, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr(VALUE)), F.lit(0.0)), F.count("*")).first()
    segments = segments_for(total)
    filled = stage(fill_filter(train, words, segments), "op8-filter")
    filters = None
    if 8 * filled.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0] <= bits:
        parts = {o: [np.zeros(0, np.uint8)] * segments for o in ORDERS}
        for row in filled.collect():  # bits / 8 bytes in all
            parts[row["n_words"]][row["segment"]] = np.frombuffer(row["bits"], np.uint8)
        filters = {o: Filter(x) for o, x in parts.items()}
    # The count from which on at most `frequent` words are left, by powers of two.
    sizes = {r["b"]: r["count"] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}
    bound, room = 63, frequent
    for b in sorted(sizes, reverse=True):
        if sizes[b] > room:
            break
        bound, room = b, room - sizes[b]
    top = words.where(F.col("n") >= F.lit(2**bound if bound < 63 else 2**62)).toArrow()
    h = top["h"].to_numpy().view(U64)
    order = np.argsort(h)
    return Model(filters, segments, total, rounded, distinct, h[order], top["n"].to_numpy()[order]), words, filled


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<h:long,tf:long>>"
#: of the first text of each slice, where the filter is not sent
SLICE = "words binary, word_at binary, sizes binary"


def score_documents(docs: DataFrame, bits: int = FILTER_BITS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text).

    Texts whose crc32 of doc_id, modulo 5, is 1 are held out of training; a null doc_id is
    not held out. A null or empty text is its end token alone. Without any training text all
    counts are 0. Repeated rows count as often as they stand there; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    held = (F.coalesce(crc_mod("doc_id", 5), F.lit(0)) == 1).alias("held_out")
    docs = docs.select("doc_id", "text", held)
    model, words, filled = fit(docs.where(~F.col("held_out")), bits, frequent)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    by_segment = model.filters is None
    rare_kind = pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                n = part.num_rows
                token, of_text = tokens(part.column("text"))
                by_text = lambda x: np.bincount(of_text, weights=x, minlength=n)  # noqa: B023, E731
                distinct, place = np.unique(token, return_inverse=True)
                count = model.exact(distinct)[place]
                known = count >= 0
                base = by_text(np.where(known, np.log10(np.maximum(count, 0) + 0.5), 0.0))
                pair, tf = np.unique(of_text[~known] * len(distinct) + place[~known], return_counts=True)
                bounds = np.searchsorted(pair, np.arange(n + 1) * len(distinct)).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(distinct[pair % len(distinct)].view(np.int64)), pa.array(tf)], ["h", "tf"])
                sizes = np.bincount(of_text, minlength=n)
                columns = {
                    "row": pa.array(row + np.arange(n)), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(sizes),
                    "known": pa.array(by_text(known).astype(np.int64)), "base": pa.array(base),
                    "score": pa.nulls(n, pa.float64()) if by_segment else pa.array(by_text(model.log10(token, of_text))),
                    "rare": pa.ListArray.from_arrays(pa.array(bounds), rare).cast(rare_kind),
                }
                if by_segment:
                    columns |= {c: pa.array([x] + [None] * (n - 1), pa.binary()) for c, x in _token_columns(token, sizes).items()}
                yield pa.RecordBatch.from_pydict(columns)
                row += n

    scored = stage(docs.mapInArrow(score, f"{SCORED}, {SLICE}" if by_segment else SCORED), "op8-scored")
    if by_segment:
        texts = scored.where("sizes is not null").select("row", "words", "word_at", "sizes")
        span = segments_of_a_part(model.segments)
        asked = texts.mapInArrow(_ask(model.segments), "row long, part int, n_words int, sizes binary, low binary")
        held = filled.withColumn("part", F.expr(f"segment div {span}").cast("int"))
        answers = held.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_answer(span), "row long, part int, n_words int, levels binary")
        scores = stage(texts.groupBy("row").cogroup(answers.groupBy("row")).applyInArrow(_put_together(model.denominator), "row long, score double"), "op8-scores")
        scored = scored.drop("score", "words", "word_at", "sizes").join(scores, "row", "left")
    discard(filled)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.tf")
    found = (
        rare.join(words, "h", "left")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"))
    )
    log_denominator = float(np.log10(model.exact_denominator))
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_denominator)).alias("base_score"),
        "score",
    )
