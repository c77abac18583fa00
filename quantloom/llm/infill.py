"""Fill-in-the-middle transformation over an index of distinct texts.

Rows of one text are brought together by a hash and told apart by their content. A text's
code point boundaries are written once as an Elias-Fano list, and each of its documents selects
its own seeded cut there: a select finds the byte where a code point begins, without decoding the text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .staging import parallelism
from .textbytes import raw, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: groups of copies with more than a task's share over this number are dealt to several tasks
FINENESS = 4
#: bytes that a row costs besides its text
ROW_BYTES = 64
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
_NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")


class EliasFano:
    """A rising list of integers up to ``bound``: the low bits of each side by side, the high
    bits as gaps in unary, with the number of ones counted for each 64 bytes."""

    def __init__(self, values: np.ndarray, bound: int):
        self.n = len(values)
        self.low_bits = max(0, (bound // max(1, self.n)).bit_length() - 1)
        high = np.zeros((bound >> self.low_bits) + self.n + 1, np.uint8)
        high[(values >> self.low_bits) + np.arange(self.n)] = 1
        self.high = np.packbits(high)
        ones = np.bitwise_count(self.high)
        self.ones = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), 64), dtype=np.int64))])
        low = (values[:, None] >> np.arange(self.low_bits)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel())

    def select(self, i: int) -> int:
        """The value at place i, from 0."""
        block = int(np.searchsorted(self.ones, i, "right")) - 1
        bits = np.unpackbits(self.high[64 * block : 64 * block + 64])
        at = 512 * block + int(np.flatnonzero(bits)[i - int(self.ones[block])])
        value = (at - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit >> 3]) >> (7 - (bit & 7)) & 1) << k
        return value


def boundaries(data: np.ndarray) -> EliasFano:
    """Where each code point of UTF-8 bytes begins, and the end."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return EliasFano(np.append(starts, len(data)), len(data))


class Entry:
    """A distinct text of the index."""

    def __init__(self, data: np.ndarray):
        self.data = data.tobytes()
        self.index = boundaries(data)
        self.n = self.index.n - 1
        self.marked = any(mark in self.data for mark in (PREFIX, SUFFIX, MIDDLE))

    def cut(self, doc_id: int | None, seed: int, share: int, spm_share: int) -> tuple:
        """n, form, prefix_chars, middle_chars, output of a document of this text."""
        h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])
        if not self.n or self.marked or h3 % 100 >= share:
            return self.n, "plain", None, None, self.data
        a, b = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
        first, last = self.index.select(a), self.index.select(b)
        prefix, middle, suffix = self.data[:first], self.data[first:last], self.data[last:]
        if h4 % 100 < spm_share:
            return self.n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        return self.n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 1, share: int = 90, spm_share: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs (doc_id, text).

    ``share`` percent of the documents are cut, ``spm_share`` percent of these with the suffix
    first. Seed and doc_id alone decide a cut's random numbers; a null doc_id counts as an empty one. A null text is
    empty; an empty text, and one that holds a marker, is plain. Repeated rows are cut alike, each in a row
    of its own; an empty table gives no rows. n counts code points.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    cost = F.sum(F.octet_length("text").cast("long") + ROW_BYTES)
    fair = max(1, (rows.agg(cost).first()[0] or 0) // (FINENESS * parallelism(spark)))
    # Groups above a fair share are fewer than FINENESS tasks' worth: at most so many rows are sent to the workers.
    hot = rows.groupBy("_hash").agg(cost.alias("_cost")).where(F.col("_cost") > fair).select("_hash", F.ceil(F.col("_cost") / fair).alias("_parts"))
    dealt = rows.join(F.broadcast(hot), "_hash", "left").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1))))
    grouped = dealt.repartition("_hash", "_part").sortWithinPartitions("_hash", "_part", "doc_id").select("doc_id", "text")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = last = cut = None
        for batch in batches:
            for part in slices(batch):
                data, offsets = raw(part.column("text"))
                found = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    if entry is None or len(entry.data) != len(own) or entry.data != own.tobytes():
                        entry, cut = Entry(own), None
                    if cut is None or doc_id != last:
                        last, cut = doc_id, entry.cut(doc_id, seed, share, spm_share)
                    found.append(cut)
                columns = [pa.array([x[k] for x in found], pa.binary() if k == 4 else kind) for k, kind in enumerate(_KINDS)]
                columns[4] = columns[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *_NAMES])

    return grouped.mapInArrow(cuts, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def with_digests(cut: DataFrame) -> DataFrame:
    """fill_in_middle()'s rows with the digests of the output and of the text rebuilt from it."""
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
