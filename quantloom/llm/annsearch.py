"""Nearest neighbours by learned partitions.

On a bounded sample of vectors a neighbour graph is built and cut into equal parts, each cut
moved until few edges cross it. A small classifier learns from it in which parts a
vector's neighbours lie. It places every row in one part and sends each query to its most
probable parts, as many as reach ``AIM`` of the true neighbours of those sampled vectors that
it did not learn from; there the query is compared with every row in double precision. The number of
parts grows with the rows, up to what the sample can tell apart.

Parts are dealt out in blocks of about ``BLOCK`` rows, and the queries for a part in blocks of about
``QUERY_BLOCK``, so no task grows with the input. Of equal vectors only the ``k + 1`` smallest ids can be among anyone's ``k`` nearest, and equal queries are
searched once, so a common vector costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from .staging import stage

SAMPLE = 8192
#: rows for each part, about
PART_ROWS = 4096
LEAST_PARTS = 16
#: sampled vectors for each part, at least
LEAST_PART = 64
NEIGHBOURS = 10
HIDDEN = 128
AIM = 0.94
BLOCK = 20_000
QUERY_BLOCK = 5_000


def takes_part(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of unit vectors, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def cut_in_two(nodes: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which half each node is in: a smooth vector on the graph gives halves of equal size,
    then the nodes that gain most by changing sides are swapped in pairs."""
    local = np.full(len(graph), -1)
    local[nodes] = np.arange(len(nodes))
    a = np.repeat(np.arange(len(nodes)), graph.shape[1])
    b = local[graph[nodes].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    n = len(nodes)
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    v = rng.normal(size=n)
    for _ in range(60):
        v = 0.5 * v + 0.5 * np.bincount(a, weights=v[b], minlength=n) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.sqrt((v * v).sum()) + 1e-12
    side = np.zeros(n, np.int64)
    side[np.argsort(v, kind="stable")[n // 2 :]] = 1
    for round_ in range(30):
        other = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * other - np.bincount(a, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        most = max(1, n // (20 + 10 * round_))
        pairs = min(len(left), len(right), most)
        good = gain[left[:pairs]] + gain[right[:pairs]] > 0
        if not good.any():
            break
        side[left[:pairs][good]], side[right[:pairs][good]] = 1, 0
    return side


def partition_graph(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """The part of each node; parts is a power of two and all are equally large, within one node."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(graph), np.int64)
    width = parts
    while width > 1:
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            part[nodes] = p + cut_in_two(nodes, graph, rng) * (width // 2)
        width //= 2
    return part


class Router:
    """Two dense layers from a unit vector to the parts' log probabilities, up to a constant."""

    def __init__(self, w1, b1, w2, b2, probes: int):
        self.w1, self.b1, self.w2, self.b2, self.probes = w1, b1, w2, b2, probes

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @property
    def parts(self) -> int:
        return len(self.b2)


def fit_router(vectors: np.ndarray, k: int, parts: int, seed: int = 0, epochs: int = 40) -> Router:
    """Every fourth vector is left out of what the classifier learns, and tells the number of probes."""
    n, dim = vectors.shape
    parts = min(parts, 1 << max(0, (n // LEAST_PART).bit_length() - 1))
    rng = np.random.default_rng(seed)
    if parts < 2:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    x = unit(vectors)
    graph = neighbour_graph(x, min(NEIGHBOURS, n - 1))
    part = partition_graph(graph, parts, seed)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1.0)
    target[np.arange(n), part] += 1
    target /= target.sum(1, keepdims=True)
    weights = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    unseen = np.arange(n) % 4 == 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(np.flatnonzero(~unseen)), max(1, n // 256)):
            hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            out = hidden @ weights[2] + weights[3]
            p = np.exp(out - out.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (error @ weights[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                weights[i] -= 0.003 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    router = Router(*weights, probes=parts)
    logits = router(x)
    home = logits.argmax(1)
    rank = np.empty_like(logits, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-logits, axis=1, kind="stable"), np.arange(parts)[None, :].repeat(n, 0), axis=1)
    near = neighbour_graph(x, min(k, n - 1))
    found = np.sort(rank[np.arange(n)[:, None], home[near]][unseen].ravel())
    router.probes = int(found[min(len(found) - 1, int(np.ceil(AIM * len(found))) - 1)]) + 1
    return router


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_in_block(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, id and cosine of the k nearest rows of c for each row of q, ties to smaller ids.
    A matrix product selects, with room for its rounding; the scores are sums of their own, so
    equal vectors score equally."""
    c_norm, q_norm = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    unit_c = (c / c_norm[:, None]).T
    rows, ids, scores = [], [], []
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        s = (some / q_norm[at : at + 256, None]) @ unit_c
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
        a, b = np.nonzero(s >= kth[:, None] - 1e-9)
        exact = (some[a] * c[b]).sum(1) / (q_norm[at + a] * c_norm[b])
        order = np.lexsort((c_ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        first = np.searchsorted(a, np.arange(len(some)))
        keep = np.arange(len(a)) - first[a] < k
        rows.append(at + a[keep])
        ids.append(c_ids[b[keep]])
        scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def search(vectors: DataFrame, is_query: Column, k: int = 5, parts: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of vectors (vec_id, embedding) for the
    rows that is_query marks, by cosine, nearest first, ties to smaller ids.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    vectors of another length than most have, nor rows without an id. Rows that repeat an id and vector count once.
    With fewer than k other rows a query gets them all; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return empty
    dim = sizes["d"]
    vectors = vectors.where(F.size("embedding") == dim)
    by_vector = W.partitionBy("embedding").orderBy("vec_id")
    distinct = stage(vectors.select("vec_id", "embedding", F.dense_rank().over(by_vector).alias("copy")).where(F.col("copy") <= k + 1).dropDuplicates(["embedding", "vec_id"]), "op2-distinct")
    firsts = distinct.where(F.col("copy") == 1).count()
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    chosen = distinct.where((F.col("copy") == 1) & (place < min(1 << 30, int((1 << 30) * 1.1 * sample / firsts) + 1))).select("vec_id", "embedding").toArrow()
    chosen = chosen.sort_by("vec_id")
    chosen = chosen.take(pa.array(np.sort(np.random.default_rng(0).permutation(chosen.num_rows)[:sample])))
    router = fit_router(_matrix(chosen["embedding"], dim), k, parts or max(LEAST_PARTS, 1 << (firsts // PART_ROWS).bit_length()))
    sent = spark.sparkContext.broadcast(router)

    def route(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                logits = sent.value(_matrix(batch.column("embedding"), dim))
                best = np.argsort(-logits, axis=1, kind="stable")[:, :n]
                kind = pa.list_(pa.int32())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, n), pa.int32()), pa.array(best.ravel().astype(np.int32))).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), listed], names=["vec_id", "embedding", "parts"])

        return run

    kind = "vec_id long, embedding array<float>, parts array<int>"
    floats = lambda df: df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    doubles = dict(vectors.dtypes)["embedding"] == "array<double>"
    if doubles:
        kind, floats = kind.replace("array<float>", "array<double>"), lambda df: df.select("vec_id", "embedding")
    placed = stage(floats(distinct).mapInArrow(route(1), kind).select("vec_id", "embedding", F.col("parts")[0].alias("part")), "op2-placed")
    rows = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    blocks = F.create_map(*[F.lit(int(x)) for p in range(router.parts) for x in (p, max(1, -(-rows.get(p, 0) // BLOCK)))])
    dealt = lambda sizes: F.pmod(F.xxhash64("vec_id"), sizes[F.col("part")]).cast("int")
    every = lambda sizes: F.explode(F.sequence(F.lit(0), (sizes[F.col("part")] - 1).cast("int")))
    asking = stage(vectors.where("asks").select("vec_id", "embedding"), "op2-queries")
    ones = asking.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    routed = stage(floats(ones).mapInArrow(route(router.probes), kind).select("vec_id", "embedding", F.explode("parts").alias("part")), "op2-routed")
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    query_blocks = F.create_map(*[F.lit(int(x)) for p in range(router.parts) for x in (p, max(1, -(-asked.get(p, 0) // QUERY_BLOCK)))])
    candidates = placed.withColumn("block", dealt(blocks)).withColumn("queries", every(query_blocks))
    routed = routed.withColumn("queries", dealt(query_blocks)).withColumn("block", every(blocks))

    def nearest(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table({"one": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row, ids, score = nearest_in_block(_matrix(q["embedding"], dim), _matrix(c["embedding"], dim), c["vec_id"].to_numpy(), k + 1)
        return pa.table({"one": q["vec_id"].to_numpy()[row], "vec_id": ids, "score": score})

    both = ["part", "block", "queries"]
    found = candidates.groupBy(*both).cogroup(routed.groupBy(*both)).applyInArrow(nearest, "one long, vec_id long, score double")
    found = found.groupBy("one", "vec_id").agg(F.max("score").alias("score"))
    top = found.withColumn("r", F.row_number().over(W.partitionBy("one").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    ids = asking.join(ones.withColumnRenamed("vec_id", "one"), "embedding").select(F.col("vec_id").alias("query_id"), "one").distinct()
    answers = ids.join(top, "one").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
