"""Exact n-gram Jaccard join by set relations.

A document is the set of its word shingles; equal sets are one class. Every class enters
the inverted lists of its rarest shingles, as many as any set that it links with must share one of.
How rare a shingle is, its words tell: most shingles of a large corpus are in no sample, but a shingle of
rare words is seldom in two texts by chance. A
list is cut into blocks: entries are ordered by set size, then by the shingle's
position in the set, and where the next entry is too large or stands too far back to link
with any before it, a block ends. Entries of different blocks are never compared.

A block names its smallest class as its leader, and all classes under one leader are a
group, so every pair that shares a block is in a group.

Every set also has a parity bitmap of 0.8 to 1.6 bits a shingle. Two bitmaps differ in at most as many
bits as their sets in shingles, and those of unlike sets in half of all, so most sets that only share a
passage are known not to link before any set is sent anywhere. What may link, directly or through others, is a
family, so a set is sent once, however many groups it stands in. Families of more than
``GROUP_BLOCK`` sets are looked at group by group instead.

Inside a family the set most like all others
is compared with everyone by going through their lists; the answers of any other set are those of the most
similar set answered so far, plus and minus the lists of the few shingles in which the two differ.
Families hand on only links that join what was not joined before, and large groups and families are
divided into pairs of blocks, so no task holds more than two blocks of ``GROUP_BLOCK`` sets.
Sets travel as 48 bits of each shingle's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .components import connected_components
from .staging import discard, stage
from .textbytes import NOT_SPACE, U64, Words, mix, slices

SHINGLE = 5
#: percent; two sets link when 100 * intersection >= PERCENT * union
PERCENT = 75
#: texts whose shingles tell which ones are common; this changes the lists' lengths only
SAMPLE = 16_000
COMMON = 1 << 17
#: slots in which the sample's words are counted
WORD_SLOTS = 1 << 17
GROUP_BLOCK = 1024
#: list entries of one bucket, about
BUCKET_ENTRIES = 200_000
#: bytes of sets that one task of small groups reads, about
CELL_BYTES = 4 << 20
#: ids that are sent to all executors; more are joined by a shuffle
BROADCAST_IDS = 1_000_000
#: rows that tell each set its tasks; so many are sent to all executors, more are joined by a shuffle
BROADCAST_TASKS = 200_000
#: bytes of text whose shingles a task holds at a time
SLICE_BYTES = 1 << 19
#: list entries that a task holds before it passes them on
HELD = 250_000

_MULTIPLIERS = mix(np.arange(1, SHINGLE + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    return [s for s, _ in weighted_sets(texts, None)]


def weighted_sets(texts: pa.Array, often: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingle hashes of each text, ascending, and a weight of each: the sum of what often, by
    slots of the words' hashes, has for its words. Equal shingles weigh the same in every text."""
    w = Words(texts, NOT_SPACE)
    h = w.hashes()
    each = np.zeros(len(h), np.int64) if often is None else often[word_slots(h)].astype(np.int64)
    n = len(h)
    grams = np.zeros(max(0, n - SHINGLE + 1), U64)
    weights = np.zeros(len(grams), np.int64)
    for k in range(SHINGLE):
        grams += h[k : k + len(grams)] * _MULTIPLIERS[k]
        weights += each[k : k + len(grams)]
    grams = mix(grams)
    out = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
        if b - a >= SHINGLE and often is None:
            s = np.unique(grams[a : b - SHINGLE + 1])
            out.append((s, np.zeros(len(s), np.int64)))
        elif b - a >= SHINGLE:
            s, at = np.unique(grams[a : b - SHINGLE + 1], return_index=True)
            out.append((s, weights[a + at]))
        elif b > a:
            out.append((mix(np.array([(h[a:b] * _MULTIPLIERS[: b - a]).sum() + U64(b - a)], U64)), each[a:b].sum(keepdims=True)))
        else:
            out.append((np.zeros(0, U64), np.zeros(0, np.int64)))
    return out


def word_slots(h: np.ndarray) -> np.ndarray:
    return (h & U64(WORD_SLOTS - 1)).astype(np.int64)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    at = np.arange(1, len(s) + 1, dtype=U64)
    return int(mix((mix(s + at * U64(0x8CB92BA72F3D8DD7)).sum() + U64(len(s))).reshape(1))[0].astype(np.int64))


def least_overlap(n: np.ndarray | int):
    """Shingles that a set of n has in common with any that it links with, at least."""
    return (PERCENT * n + 99) // 100


def in_order(s: np.ndarray, weights: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rare shingles first: those not known as common by weight, then the common ones by frequency; equals by hash."""
    known, often = common
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        weights = weights + (np.where(known[at] == s, often[at], 0) << 32)
    return s[np.argsort(weights, kind="stable")]


def parity_bits(s: np.ndarray) -> bytes:
    """Which places of a bitmap an odd number of shingles falls on."""
    size = 1 << max(7, (4 * len(s) // 5 - 1).bit_length())
    odd = np.bincount((s & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of the same set with ``size`` places, as 64-bit words."""
    words = np.frombuffer(bits, U64)
    while len(words) * 64 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(sid: np.ndarray, size: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Sets of sizes that can link that differ in so few bits that they may are near; the family of each set, those
    that near sets join, by a number, and -1 for a set that is near no other."""
    width = np.array([len(b) * 8 for b in bits])
    near = np.zeros((len(sid), len(sid)), bool)
    for w in np.unique(width).tolist():
        wide = np.flatnonzero(width >= w)
        maps = np.stack([folded(bits[i], w) for i in wide])
        own = np.flatnonzero(width[wide] == w)
        for at in range(0, len(own), 128):
            a = own[at : at + 128]
            differ = np.zeros((len(a), len(wide)), np.int32)
            for k in range(maps.shape[1]):
                differ += np.bitwise_count(maps[a, None, k] ^ maps[None, :, k])
            hit = (100 + PERCENT) * differ <= (100 - PERCENT) * (size[wide[a], None] + size[None, wide])
            x, y = size[wide[a], None], size[None, wide]
            hit &= 100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)
            near[wide[a][:, None], wide[None, :]] |= hit & (sid[wide[a], None] != sid[None, wide])
    near |= near.T
    family = np.full(len(sid), -1)
    for i in np.flatnonzero(near.any(1)).tolist():
        if family[i] < 0:
            family[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (family < 0))
                family[front] = i
    return family


def _groups(table: pa.Table) -> list[tuple[int, int]]:
    """Bounds of the rows of equal leader of a table sorted by it."""
    leader = table["leader"].to_numpy()
    if not len(leader):
        return []
    starts = np.flatnonzero(np.append(True, leader[1:] != leader[:-1])).tolist()
    return list(zip(starts, [*starts[1:], len(leader)], strict=True))


def _possible(table: pa.Table) -> pa.Table:
    """(first, sid): each set that may link with another, and the first of its family in this group."""
    table = table.combine_chunks().sort_by([("leader", "ascending"), ("sid", "ascending")])
    sid, size, bits = table["sid"].to_numpy(), table["n"].to_numpy(), table["bits"].to_pylist()
    first = np.full(len(sid), -1)
    for a, b in _groups(table):
        family = may_link(sid[a:b], size[a:b], bits[a:b])
        first[a:b] = np.where(family < 0, -1, family + a)
    keep = first >= 0
    return pa.table({"first": sid[first[keep]], "sid": sid[keep]})


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([parity_bits(s) if len(s) else None for s in sets], pa.binary()), part.column("text_hash")],
                names=["doc_id", "n", "sid", "bits", "text_hash"],
            )


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            sets = shingle_sets(part.column("text"))
            h, c = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "n"])


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            slot, c = np.unique(word_slots(Words(part.column("text"), NOT_SPACE).hashes()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(c.astype(np.int64))], names=["slot", "n"])


def _lister(sent, bits: int):
    """Rows (bucket, tokens, sids, sizes, places): a task's list entries by bucket of the shingle's hash."""

    def packed(token, sid, size, place) -> pa.RecordBatch:
        order = np.argsort(token)
        token, sid, size, place = token[order], sid[order], size[order], place[order]
        bucket = (token >> U64(64 - bits)).astype(np.int64)
        used, first = np.unique(bucket, return_index=True)
        bounds = np.append(first, len(token)).tolist()
        low = ((token << U64(bits)) >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), cut(low), cut(sid), cut(size.astype("<u4")), cut(place.astype("<u4"))], names=["bucket", "tokens", "sids", "sizes", "places"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequency, often = sent.value
        seen: set[int] = set()
        held: list[list[np.ndarray]] = [[], [], [], []]
        count = 0
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                tokens, sids, sizes = [], [], []
                for s, weights in weighted_sets(part.column("text"), often):
                    n = len(s)
                    sid = set_id(s) if n else None
                    if sid is None or sid in seen:
                        continue
                    seen.add(sid)
                    tokens.append(in_order(s, weights, (known, frequency))[: n - least_overlap(n) + 1])
                    sids.append(sid)
                    sizes.append(n)
                if not sids:
                    continue
                # One array a slice: views would hold whole sets, and many small arrays leave gaps in a worker's memory.
                m = np.array([len(x) for x in tokens])
                places = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                for values, x in zip(held, (np.concatenate(tokens), np.repeat(np.array(sids), m), np.repeat(np.array(sizes), m), places), strict=True):
                    values.append(x)
                count += len(places)
                if count > HELD:
                    yield packed(*map(np.concatenate, held))
                    held, count = [[], [], [], []], 0
        if count:
            yield packed(*map(np.concatenate, held))

    return run


def blocks(token: np.ndarray, sid: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Distinct rows (leader, sid) of all blocks that hold two sets or more."""
    order = np.lexsort((size, token))
    token, sid, size, place = token[order], sid[order], size[order], place[order]
    new = np.ones(len(token), bool)
    # A larger set links only with sets of at least its least overlap.
    new[1:] = (token[1:] != token[:-1]) | (size[:-1] < least_overlap(size[1:]))
    block = np.cumsum(new) - 1
    alone = np.bincount(block)[block] == 1
    block, sid, size, place = block[~alone], sid[~alone], size[~alone], place[~alone]
    if not len(block):
        return np.zeros((0, 2), np.int64)
    order = np.lexsort((place, block))
    block, sid, size, place = block[order], sid[order], size[order], place[order]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    low, high = np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)
    # With the shingle at places i < j, the sets of sizes x and y share at most i + y - j, and need 3/7 of x + y.
    reach = np.repeat((4 * high - 3 * low) // 7, np.diff(np.append(starts, len(block))))
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (place[1:] - place[:-1] > reach[1:])
    starts = np.flatnonzero(new)
    leader, most = np.minimum.reduceat(sid, starts), np.maximum.reduceat(sid, starts)
    counts = np.diff(np.append(starts, len(block)))
    several = np.repeat(leader != most, counts)
    both = np.stack([np.repeat(leader, counts), sid], axis=1)[several]
    return np.unique(both, axis=0) if len(both) else both


def _find_blocks(table: pa.Table) -> pa.Table:
    columns = {c: b"".join(table[c].to_pylist()) for c in ("tokens", "sids", "sizes", "places")}
    wide = np.zeros((len(columns["sizes"]) // 4, 8), np.uint8)
    wide[:, :5] = np.frombuffer(columns["tokens"], np.uint8).reshape(-1, 5)
    number = lambda c: np.frombuffer(columns[c], "<u4").astype(np.int64)
    found = blocks(wide.reshape(-1).view("<u8"), np.frombuffer(columns["sids"], np.int64), number("sizes"), number("places"))
    return pa.table({"leader": found[:, 0], "sid": found[:, 1]})


def sent(s: np.ndarray) -> bytes:
    """The upper 48 bits of every hash, in order."""
    return (s >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def received(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            sets = [s for s in shingle_sets(part.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([sent(s) for s in sets], pa.binary())], names=["sid", "shingles"])


def joining_links(sets: list[np.ndarray], probes: np.ndarray) -> list[tuple[int, int]]:
    """Links, between positions in ``sets``, of every set in ``probes`` with any other, without those
    whose ends other links of the answer join already."""
    k = len(sets)
    parent = list(range(k))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    out: list[tuple[int, int]] = []
    pieces = k
    if k == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= PERCENT * (sizes.sum() - both) else []
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), sizes)
    frequency = np.bincount(token)
    shared = frequency[token] > 1
    token, owner = token[shared], owner[shared]
    bounds = np.searchsorted(owner, np.arange(k + 1))
    own = [token[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    order = np.argsort(token, kind="stable")
    members = owner[order]
    begin = np.searchsorted(token[order], np.arange(len(frequency) + 1))

    def listed(tokens: np.ndarray) -> np.ndarray:
        """How often each set stands in the lists of tokens."""
        length = begin[tokens + 1] - begin[tokens]
        at = np.repeat(begin[tokens] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        return np.bincount(members[at], minlength=k)

    first = int(np.argmax(np.bincount(owner, weights=frequency[token], minlength=k)))
    answers: dict[int, np.ndarray] = {first: listed(own[first])}
    alike, how_much = np.full(k, first), answers[first].copy()
    todo = set(probes.tolist())
    while pieces > 1 and (todo or first is not None):
        x = first if first is not None else max(todo, key=lambda i: (how_much[i], -i))
        first = None
        if x not in answers:
            y = int(alike[x])
            plus, minus = np.setdiff1d(own[x], own[y], assume_unique=True), np.setdiff1d(own[y], own[x], assume_unique=True)
            if len(plus) + len(minus) < len(own[x]):
                answers[x] = answers[y] + listed(plus) - listed(minus)
            else:
                answers[x] = listed(own[x])
        todo.discard(x)
        overlap = answers[x]
        better = overlap > how_much
        alike[better], how_much[better] = x, overlap[better]
        for y in np.flatnonzero(100 * overlap >= PERCENT * (sizes[x] + sizes - overlap)).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[b] = a
                pieces -= 1
                out.append((x, y))
    return out


def family_links(sid: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links inside a family, as pairs of ids. side: 0 and 1 for two blocks, of which only
    pairs across are wanted; all 0 for one."""
    _, once = np.unique(sid, return_index=True)  # rows that repeat an id and text send their set again
    sid, side, sets = sid[once], side[once], [sets[i] for i in once]
    if len(sets) < 2:
        return []
    # Pairs across have one end on either side.
    return [(int(sid[a]), int(sid[b])) for a, b in joining_links(sets, np.flatnonzero(side == 0))]


def _link_families(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("leader")
    sid, side, sets = table["sid"].to_numpy(), table["side"].to_numpy(), table["shingles"].to_pylist()
    out: list[tuple[int, int]] = []
    for a, b in _groups(table):
        out += family_links(sid[a:b], side[a:b], [received(x) for x in sets[a:b]])
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id is (or, with left_anti, is not) among ids."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _of_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(text) of rows that hold all sets of classes (sid, doc_id), and maybe others: those of the
    ids, and each text without an id once if a class has none."""
    ids = classes.select("doc_id").distinct()
    found = _only(docs, ids.where("doc_id is not null"), "left_semi").select("text")
    if not ids.where("doc_id is null").count():
        return found
    return found.unionByName(docs.where("doc_id is null").select("text").distinct())


def find_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid, text_hash) of each row, and links (a, b) between set ids that join all sets which
    the links of the corpus join. What a step wrote is deleted when the next one has written."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = stage(hashed.mapInArrow(_describe, "doc_id long, n long, sid long, bits binary, text_hash long"), "op3-sets")
    n, entries = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1), F.lit(0))).first()
    share = min(1 << 30, (1 << 30) * SAMPLE // max(1, n))
    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share).select("text")
    common = (
        sampled.mapInArrow(_sample, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow().sort_by("h")
    )
    known = common["h"].to_numpy().view(U64)
    order = np.argsort(known)
    words = sampled.mapInArrow(_sample_words, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(WORD_SLOTS, np.uint8)
    often[words["slot"].to_numpy()] = np.round(8 * np.log2(1 + words["n"].to_numpy()))
    sent = spark.sparkContext.broadcast((known[order], common["n"].to_numpy()[order], often))
    bits = min(24, max(6, (int(entries) // BUCKET_ENTRIES).bit_length()))
    listed = docs.select("text").mapInArrow(_lister(sent, bits), "bucket int, tokens binary, sids binary, sizes binary, places binary")
    groups = stage(listed.groupBy("bucket").applyInArrow(_find_blocks, "leader long, sid long").distinct(), "op3-blocks")
    homes = groups.groupBy("sid").agg(F.min("leader").alias("home"))
    with_home = groups.join(homes, "sid")
    # A group whose sets all share another home has nothing to add to it.
    useful = with_home.groupBy("leader").agg(F.min("home").alias("x"), F.max("home").alias("y")).where("x = leader or x != y")
    wanted = stage(with_home.join(useful.select("leader"), "leader", "left_semi"), "op3-groups")
    discard(groups)
    sketches = rows.join(wanted.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    sketched = _tasks(wanted, max(64, wanted.count() // GROUP_BLOCK)).join(sketches, "sid")
    near = stage(sketched.groupBy("task", "i", "j").applyInArrow(_possible, "first long, sid long").distinct(), "op3-near")
    discard(wanted)
    families = connected_components(near.select(F.col("first").alias("a"), F.col("sid").alias("b")))
    small = families.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") <= GROUP_BLOCK).select("root")
    whole = families.join(small, "root", "left_semi").select(F.col("root").alias("leader"), F.col("node").alias("sid"))
    parted = near.join(whole, "sid", "left_anti").select(F.col("first").alias("leader"), "sid")
    members = stage(whole.unionByName(parted), "op3-members")
    discard(near)
    sizes = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    classes = stage(members.join(sizes, "sid"), "op3-wanted")
    discard(members)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sent_once = _of_classes(docs, classes).mapInArrow(_emit_sets, "sid long, shingles binary")
    tasks = stage(_tasks(classes.select("leader", "sid"), max(1, total * 6 // CELL_BYTES)), "op3-tasks")
    links = sent_once.join(F.broadcast(tasks) if tasks.count() <= BROADCAST_TASKS else tasks, "sid").groupBy("task", "i", "j").applyInArrow(_link_families, "a long, b long")
    return rows, links


def _tasks(members: DataFrame, cells: int) -> DataFrame:
    """members (leader, sid) with the task that compares them: small groups share ``cells``
    tasks; a large group has one for each pair of its blocks, and its sets stand in
    every pair of theirs. side tells the two blocks apart."""
    counts = members.groupBy("leader").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("parts"))
    split = members.join(counts, "leader").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    alone = F.col("parts") == 1
    return split.select(
        "leader", "sid",
        F.when(alone, F.pmod(F.xxhash64("leader"), F.lit(cells))).otherwise(F.col("leader")).alias("task"),
        F.when(alone, -1).otherwise(F.least("own", "other")).alias("i"),
        F.when(alone, -1).otherwise(F.greatest("own", "other")).alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )


def _first_of_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, sid, first) of each row of docs. first is the (no_id, doc_id, text_hash)
    of the first row of its component, and null where no other row is in it."""
    rows, links = find_links(docs)
    roots = connected_components(links)
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = rows.where("sid is not null").groupBy("sid").agg(F.min(one).alias("first"), F.count("*").alias("copies"))
    rooted = classes.join(roots.withColumnRenamed("node", "sid"), "sid")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    joined = rooted.join(least, "root").select("sid", F.col("least").alias("first"))
    copies = classes.where("copies > 1").join(roots.withColumnRenamed("node", "sid"), "sid", "left_anti").select("sid", "first")
    return rows.join(joined.unionByName(copies), "sid", "left").select("doc_id", "text_hash", "n", "sid", "first")


def similarity_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. A null or empty text, or one of white
    space, has an empty set and is its own component. A text of fewer than five words is one
    shingle. Repeated rows have equal sets and so one component; a null doc_id is
    larger than any other. An empty table gives no rows.
    """
    return _first_of_each(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component.

    Each id and text is judged by its own set: rows of one id, or without any, with texts that no
    links join all stay. The first row has the smallest id, null being the largest, then the smallest
    hash of its text; of rows that repeat it the one with the smallest other columns stays. Rows
    with empty sets stay, once for each id and text, and all of those without an id.
    """
    found = stage(_first_of_each(docs), "op3-classes")
    own = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    gone = found.where(~own).select("doc_id", "text_hash").distinct()
    several = found.where(own & (F.col("doc_id").isNotNull() | F.col("sid").isNotNull())).groupBy("doc_id", "text_hash").count().where("count > 1").drop("count")
    several = stage(several, "op3-several")

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        return rows.join(keys, rows["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(rows["text"]) == keys["_hash"]), how)

    kept = among(docs, gone, "left_anti")
    if not several.limit(1).count():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = among(kept, several, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_others"))
    once = once.select("doc_id", "text", *(F.col(f"_others.{c}").alias(c) for c in others)).select(*docs.columns)
    return among(kept, several, "left_anti").unionByName(once)
