"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that is never divided. Groups are packed on
two levels so that no task and no driver sees all of them:

1. Groups of at least ``total / (n_shards * fineness)`` bytes are few: at most
   ``n_shards * fineness`` of them can exist.
2. Smaller groups are dealt by hash to cells; each cell packs its groups, largest
   first, into parcels of that many bytes. Two parcels of one cell hold more than one
   parcel's bytes, so there are at most ``2 * n_shards * fineness + cells`` parcels.

The driver then packs large groups and parcels into the shards, largest first into the
tightest that still holds them, and searches the smallest capacity for which that
succeeds. Both levels find the tightest bin in a balanced tree.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import parallelism, stage

N_SHARDS = 24
FINENESS = 512
#: small groups that one cell packs, about
CELL_GROUPS = 20_000
#: rows that one slot-numbering task sorts, about
SLOT_ROWS = 250_000


class Remaining:
    """A treap of (remaining capacity, bin): a balanced search tree by random priorities."""

    def __init__(self) -> None:
        self.root: list | None = None
        self._state = 88172645463325252

    def _priority(self) -> int:
        x = self._state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self._state = x
        return x

    def _split(self, node, key):
        """Nodes below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        low, high = self._split(self.root, (remaining, bin_))
        self.root = self._merge(self._merge(low, [(remaining, bin_), self._priority(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the entry with the least remaining capacity >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bins of items given largest first; None if more than ``most`` bins are needed."""
    tree, opened, out = Remaining(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if (most is not None and opened == most) or (most is not None and size > capacity):
                return None
            found = (max(capacity, size), opened)
            opened += 1
        remaining, bin_ = found
        out.append(bin_)
        tree.add(remaining - size, bin_)
    return out


def smallest_capacity(sizes: list[int], bins: int) -> list[int]:
    """Bins by best-fit-decreasing under the smallest capacity found to need no more than ``bins``."""
    total = sum(sizes)
    low = max(-(-total // bins), max(sizes, default=0))
    high, found = low, best_fit(sizes, low, bins)
    step = max(1, low // 4096)
    while found is None:
        low, high = high, high + step
        step *= 2
        found = best_fit(sizes, high, bins)
    while high - low > max(1, total // (bins * 100_000)):
        middle = (low + high) // 2
        better = best_fit(sizes, middle, bins)
        if better is None:
            low = middle
        else:
            high, found = middle, better
    return found


def _pack_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["bytes", "h", "size", "crc"], ascending=[False, True, True, True], kind="stable")
    bins = best_fit(pdf["bytes"].tolist(), int(pdf["parcel_bytes"].iloc[0]))
    return pdf.assign(parcel=[int(c) << 32 | b for c, b in zip(pdf["cell"], bins, strict=True)])[["h", "size", "crc", "bytes", "parcel"]]


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, fineness: int = FINENESS) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its shard and its slot there.

    A null text has 8 bytes, like an empty one, but is another group; its text_crc32
    is null. Repeated rows stay. Shard sizes come as near each other as the largest
    group allows: a group larger than a shard's share makes its shard larger, since
    groups are never divided. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.coalesce(F.crc32("text"), F.lit(-1)).alias("crc"),
            F.xxhash64("text").alias("h"),
        ),
        "op1-sized",
    )
    key = ["h", "size", "crc"]
    groups = rows.groupBy(*key).agg((F.count("*") * F.first("size")).alias("bytes"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parcel_bytes = max(1, total // (n_shards * fineness))
    cells = max(1, -(-n // CELL_GROUPS))
    packed = stage(
        groups.withColumn("cell", F.when(F.col("bytes") < parcel_bytes, F.pmod(F.xxhash64("crc", "h"), F.lit(cells))))
        .withColumn("parcel_bytes", F.lit(parcel_bytes)),
        "op1-groups",
    )
    large = packed.where(F.col("cell").isNull()).select(*key, "bytes")
    small = stage(
        packed.where(F.col("cell").isNotNull())
        .groupBy("cell")
        .applyInPandas(_pack_cell, "h long, size long, crc long, bytes long, parcel long"),
        "op1-parcels",
    )
    # At most 3 * n_shards * fineness + cells rows; see above.
    items = [(r["bytes"], 0, r["h"], r["size"], r["crc"]) for r in large.collect()]
    items += [(r["bytes"], 1, r["parcel"], 0, 0) for r in small.groupBy("parcel").agg(F.sum("bytes").alias("bytes")).collect()]
    items.sort(key=lambda x: (-x[0], *x[1:]))
    shards = smallest_capacity([x[0] for x in items], n_shards)

    def mapped(kind: int, names: list[str]) -> DataFrame:
        got = [(*x[2:], s) for x, s in zip(items, shards, strict=True) if x[1] == kind]
        columns = list(zip(*got, strict=True)) or [[], [], [], []]
        made = pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip([*names, "shard"], [*columns[: len(names)], columns[3]], strict=True)})
        return F.broadcast(spark.createDataFrame(made))

    by_group = mapped(0, key)
    by_parcel = mapped(1, ["parcel"])
    whole = rows.join(by_group, key, "inner")
    parts = rows.join(by_group, key, "left_anti").join(small.join(by_parcel, "parcel").select(*key, "shard"), key)
    placed = stage(
        whole.select("doc_id", "size", "text_crc32", "shard").unionByName(parts.select("doc_id", "size", "text_crc32", "shard")),
        "op1-placed",
    )
    return with_slots(placed, max(parallelism(spark), -(-n // SLOT_ROWS))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def with_slots(placed: DataFrame, parts: int) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps: each of ``parts`` parts of a shard is
    numbered by itself and starts where the parts before it end."""
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    starts = (
        placed.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("first", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("shard", "part", "first")
    )
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("rank", rank).join(starts, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("rank") - 1)
