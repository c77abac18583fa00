"""Prefix tries of conversations.

Turns become digests, conversations become chains of digests in which each names the whole sequence
up to its turn. Equal conversations are one class; classes are dealt by the digest of their
first turn, and tasks build tries of dictionaries for their share. A first turn with too many turns below it
is dealt again by the next turn, and so on, until every part fits; the nodes above the parts
form a small trie of their own, which takes the parts' sums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .staging import discard, stage

#: turns of classes that one task builds a trie of; below a prefix with more, the next turn deals
LIMIT = 50_000
#: borrowed turns are the first of the conversation that starts a run of so many ids
GROUP = 5
#: at most this many, less one, turns are borrowed
BORROWED = 9
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def chains(conversations: DataFrame, group: int = GROUP, borrowed: int = BORROWED) -> DataFrame:
    """(conv_id, length, first, last, path, sizes) of every conversation, rebuilt: path holds a digest for each turn, of all turns
    up to it, and sizes the bytes of each turn's text."""
    c, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        c.alias("conv_id"),
        (c - c % group).alias("head"),
        F.col("turn").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    ordered = turns.repartition("head").sortWithinPartitions("head", F.col("conv_id") != F.col("head"), "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = conv = None
        opening: list[tuple[bytes, int]] = []
        place = skip = 0
        path, sizes, end = bytearray(), [], b""
        done: list[tuple] = []

        def add(digest: bytes, size: int) -> None:
            nonlocal end
            end = hashlib.blake2b(end + digest, digest_size=DIGEST).digest()
            path.extend(end)
            sizes.append(size)

        def close() -> None:
            if conv is not None:
                done.append((conv, len(sizes), bytes(path[:DIGEST]), end, bytes(path), sizes))

        for batch in batches:
            for h, c, digest, size in zip(*(batch.column(x).to_pylist() for x in ("head", "conv_id", "digest", "size")), strict=True):
                if c != conv:
                    close()
                    if h != head:
                        head, opening = h, []
                    conv, place, path, sizes, end = c, 0, bytearray(), [], b""
                    skip = 0 if c == h else zlib.crc32(str(c).encode()) % borrowed
                    for turn in opening[:skip]:
                        add(*turn)
                if c == h and place < borrowed - 1:
                    opening.append((digest, size))
                if place >= skip:
                    add(digest, size)
                place += 1
            if len(done) > 1000:
                yield _batch(done)
                done = []
        close()
        if done:
            yield _batch(done)

    return ordered.mapInArrow(rebuild, "conv_id long, length long, first binary, last binary, path binary, sizes array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "length", "first", "last", "path", "sizes"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows with the same last digest; their ids are hashed as they pass."""
    row = sha = None
    names = ("conv_id", "length", "first", "last", "path", "sizes", "n", "ids")

    def closed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*row[:7], sha.hexdigest()), kinds, strict=True)], names=[*names[:7], "ends"])

    for batch in batches:
        out = []
        for r in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if row is not None and r[3] == row[3]:
                row[6] += r[6]
                sha.update(b"," + r[7].encode())
                continue
            if row is not None:
                out.append(closed())
            row, sha = list(r), hashlib.sha256(r[7].encode())
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if row is not None:
        yield closed()


def classes(chained: DataFrame) -> DataFrame:
    """(conv_id, length, first, last, path, sizes, n, ends): one row for each distinct conversation, with its smallest id, the
    number of its copies and the digest of their ids. Copies meet by 4,096 neighbouring ids first."""
    part = (
        chained.groupBy("last", F.shiftright("conv_id", 12).alias("part"))
        .agg(
            F.min("conv_id").alias("conv_id"), F.first("length").alias("length"), F.first("first").alias("first"), F.first("path").alias("path"),
            F.first("sizes").alias("sizes"), F.count("*").alias("n"),
            F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
        )
    )
    schema = "conv_id long, length long, first binary, last binary, path binary, sizes array<long>, n long, ends string"
    return part.repartition("last").sortWithinPartitions("last", "part").mapInArrow(_classes, schema)


class Trie:
    """Nodes are numbers; ``children[node]`` points from the digest of a turn to the node behind it."""

    def __init__(self):
        self.roots: dict[bytes, int] = {}
        self.children: list[dict[bytes, int]] = []
        self.depth: list[int] = []
        self.size: list[int] = []
        #: conversations, smallest id, leaves, saved tokens, children: a node's own, then those of all below it
        self.sums: list[list] = []
        self.ends: list[str] = []

    def step(self, node: int | None, digest: bytes, depth: int, size: int) -> int:
        pointers = self.roots if node is None else self.children[node]
        if digest not in pointers:
            pointers[digest] = len(self.children)
            self.children.append({})
            self.depth.append(depth)
            self.size.append(size)
            self.sums.append([0, None, 0, 0, 0])
            self.ends.append(NO_ENDS)
        return pointers[digest]

    def end(self, node: int, n: int, conv_id: int, ends: str) -> None:
        self.ends[node] = ends
        self.give(node, n, conv_id, 0, 0, 0)

    def give(self, node: int, n: int, conv_id: int | None, leaves: int, saved: int, children: int) -> None:
        sums = self.sums[node]
        sums[1] = conv_id if sums[1] is None else sums[1] if conv_id is None else min(sums[1], conv_id)
        for i, value in ((0, n), (2, leaves), (3, saved), (4, children)):
            sums[i] += value

    def postorder(self) -> list[tuple[int, int | None]]:
        """(node, parent), each after all nodes below it."""
        out, open_ = [], [(node, None) for node in self.roots.values()]
        while open_:
            node, parent = open_.pop()
            out.append((node, parent))
            open_.extend((child, node) for child in self.children[node].values())
        return out[::-1]

    def rows(self) -> Iterator[tuple]:
        """Rows of NODE; a root's parent is left open."""
        order = self.postorder()
        for node, parent in order:
            sums = self.sums[node]
            sums[2] = max(1, sums[2])
            sums[3] += (sums[0] - 1) * self.size[node]
            if parent is not None:
                self.give(parent, sums[0], sums[1], sums[2], sums[3], 1)
        for node, parent in order:
            n, conv_id, leaves, saved, children = self.sums[node]
            yield conv_id, self.depth[node], None if parent is None else self.sums[parent][1], n, children, leaves, saved, self.ends[node]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    kinds = {c: "Int64" for c in _COLUMNS[:7]}
    return pd.DataFrame(rows, columns=columns).astype({c: k for c, k in kinds.items() if c in columns})


def _parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries whose classes are in this part, from the depth on at which the part was dealt."""
    trie = Trie()
    above: dict[int, bytes] = {}
    for path, sizes, start, n, conv_id, ends in zip(*(pdf[c].tolist() for c in ("path", "sizes", "start", "n", "conv_id", "ends")), strict=True):
        node = None
        for d in range(start, len(sizes)):
            node = trie.step(node, path[DIGEST * d : DIGEST * (d + 1)], d + 1, int(sizes[d]))
            if d == start:
                above[node] = path[DIGEST * (d - 1) : DIGEST * d] if d else b""
        trie.end(node, n, conv_id, ends)
    order = trie.postorder()
    rows = [(*row, above[node] if parent is None else None) for row, (node, parent) in zip(trie.rows(), order, strict=True)]
    return _frame(rows, [*_COLUMNS, "above"])


def _tops(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of prefixes that were dealt again, below one first turn."""
    trie = Trie()
    nodes: dict[bytes, int] = {}
    pdf = pdf.sort_values("depth", kind="stable")
    for prefix, before, depth, size in zip(*(pdf[c].tolist() for c in ("prefix", "before", "depth", "size")), strict=True):
        nodes[prefix] = trie.step(nodes.get(before), prefix, depth, size)
    for prefix, ends, *own in zip(*(pdf[c].tolist() for c in ("prefix", "ends", "n", "least", "leaves", "saved", "children")), strict=True):
        trie.give(nodes[prefix], *(None if pd.isna(x) else int(x) for x in own))
        trie.ends[nodes[prefix]] = ends or NO_ENDS
    names = {node: prefix for prefix, node in nodes.items()}
    order = trie.postorder()
    return _frame([(*row, names[node]) for row, (node, _) in zip(trie.rows(), order, strict=True)], [*_COLUMNS, "prefix"])


def _large_prefixes(found: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Prefixes with more than ``limit`` turns of several classes below them, and for each class that has such prefixes their
    number. They are at most one for each ``limit`` turns of each depth."""
    many = lambda rows: (F.sum(rows) > limit) & (F.count("*") > 1)
    firsts = stage(found.where("length > 0").groupBy("first").agg(many(F.col("length")).alias("many")).where("many").select("first"), "trie-firsts")
    if firsts.isEmpty():
        discard(firsts)
        return None, None
    prefixes = (
        found.join(firsts, "first", "left_semi")
        .select("first", "last", "length", "path", F.posexplode("sizes").alias("at", "size"))
        .select(
            "first", "last", (F.col("at") + 1).cast("long").alias("depth"), "size", (F.col("length") - F.col("at")).alias("rows"),
            F.substring("path", F.col("at") * DIGEST + 1, F.lit(DIGEST)).alias("prefix"),
            F.when(F.col("at") > 0, F.substring("path", (F.col("at") - 1) * DIGEST + 1, F.lit(DIGEST))).otherwise(F.lit(b"")).alias("before"),
        )
    )
    one = [F.any_value(c).alias(c) for c in ("first", "before", "depth", "size")]
    large = stage(prefixes.groupBy("prefix").agg(many(F.col("rows")).alias("many"), *one).where("many").drop("many"), "trie-large")
    starts = prefixes.select("prefix", "last").join(large.select("prefix"), "prefix").groupBy("last").agg(F.count("*").alias("start"))
    return large, starts


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, group: int = GROUP, borrowed: int = BORROWED) -> DataFrame:
    """Every node (see NODE) of the trie of conversations (conv_id, turn, role, text).

    Turns are taken in order of turn, null first; turns of the same place in order of the digest of role and text. A conversation
    borrows its first turns, fewer than ``borrowed``, from the one that starts its run of ``group`` ids. Null role and text
    are empty. Rows without a conv_id take no part. Repeated rows are turns like others, and a conversation
    without any turn left belongs to the root alone. An empty table gives no rows, not even a root.
    """
    spark = conversations.sparkSession
    ship(spark)
    found = stage(classes(chains(conversations, group, borrowed)), "trie-classes")
    turns = found.agg(F.sum("length")).first()[0]
    if turns is None:
        return spark.createDataFrame([], NODE)
    large, starts = _large_prefixes(found, limit)
    dealt = found.withColumn("start", F.lit(0).cast("long"))
    if large is not None:
        dealt = stage(found.join(starts, "last", "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long"))), "trie-starts")
    top = F.substring("path", (F.col("start") * DIGEST + 1).cast("int"), F.lit(DIGEST))
    parts = dealt.where("length > start").withColumn("part", F.pmod(F.xxhash64(top), F.lit(-(-turns // limit) or 1)))
    nodes = parts.select("part", "path", "sizes", "start", "n", "conv_id", "ends").groupBy("part").applyInPandas(_parts, f"{NODE}, above binary")
    nodes = stage(nodes, "trie-nodes")

    below = [
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"), F.lit(None).cast("string").alias("ends"),
    ]
    zero = F.lit(0).cast("long")
    ended = dealt.where("length = start").select(F.col("last").alias("prefix"), "n", F.col("conv_id").alias("least"), zero.alias("leaves"), zero.alias("saved"), zero.alias("children"), "ends")
    sums = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("prefix")).agg(*below).unionByName(ended)
    firsts = nodes.where(F.col("above") == b"")
    out = [nodes.where("above IS NULL").select(*_COLUMNS)]
    if large is not None:
        whole = [F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children")]
        own = sums.where(F.col("prefix") != b"").groupBy("prefix").agg(*whole, F.min("least").alias("least"), F.max("ends").alias("ends"))
        own = large.join(own, "prefix", "left").fillna(0, ["n", "leaves", "saved", "children"])
        tops = stage(own.groupBy("first").applyInPandas(_tops, f"{NODE}, prefix binary"), "trie-tops")
        inner = nodes.where((F.col("above") != b"") & F.col("above").isNotNull()).drop("parent_conv_id")
        out += [
            inner.join(tops.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id")), "above").select(*_COLUMNS),
            tops.where("depth > 1").select(*_COLUMNS),
        ]
        firsts = firsts.select(*_COLUMNS).unionByName(tops.where("depth = 1").select(*_COLUMNS))
    turnless = ended.where(F.col("prefix") == b"")
    root = firsts.agg(*below).unionByName(turnless.select("n", "least", "leaves", "saved", "children", "ends")).agg(
        *(F.coalesce(F.sum(c), zero).alias(c) for c in ("n", "leaves", "saved", "children")), F.min("least").alias("least"), F.max("ends").alias("ends"),
    ).first()
    made = [(root.least, 0, None, root.n, root.children, max(1, root.leaves), root.saved, root.ends or NO_ENDS)]
    out += [spark.createDataFrame(made, NODE), firsts.select(*_COLUMNS).withColumn("parent_conv_id", F.lit(root.least).cast("long"))]
    discard(found, *([] if large is None else [large, dealt]))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
