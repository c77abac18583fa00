"""Toxicity by a logistic classifier with a counterfactual penalty.

A text is the set of its words and of the 5-byte runs inside them, hashed. In labelled texts
that name a group, the name is swapped for another group's of the same language, and left out; the penalty is
the square of the change this makes to the score, so a neutral mention of a group does not count. One in
``MENTION_EVERY`` texts that name none gets a mention at its end, and the text without it, with it and
with another group's must score alike too: so the penalty also holds for names that no labelled text has.

At most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` clean labelled texts, chosen by a hash of
their id, train it; whole texts are read both in training and in scoring. Workers get one weight for each of
2 ** ``BITS`` buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import crc_mod
from .textbytes import ALNUM, U64, Words, mix, slices

BITS = 20
TRAIN_TOXIC = 2000
TRAIN_CLEAN = 4000
FEATURES = 2048
LEAST_DOCS = 4
RIDGE = 2e-4
SWAP_PENALTY = 1.0
STEPS = 250
RUN = 5

MENTION_EVERY = 4
#: weight of all toxic rows together, against that of all clean ones
TOXIC_WEIGHT = 0.75

# Names of groups by language, each swapped for the next (the last for the first).
GROUPS = {
    "en": "women men girls boys gay straight lesbian bisexual transgender muslim christian jewish hindu buddhist atheist catholic "
    "black white asian african latino european immigrant native refugee foreigner disabled deaf blind elderly young poor rich",
    "fr": "femmes hommes filles garçons homosexuels hétérosexuels lesbiennes musulmans chrétiens juifs athées catholiques noirs blancs "
    "asiatiques africains arabes européens immigrés réfugiés étrangers handicapés sourds aveugles",
    "de": "frauen männer mädchen jungen schwule lesben muslime christen juden atheisten katholiken schwarze weiße asiaten afrikaner "
    "araber europäer einwanderer flüchtlinge ausländer behinderte gehörlose blinde",
    "es": "mujeres hombres niñas niños homosexuales lesbianas musulmanes cristianos judíos ateos católicos negros blancos asiáticos "
    "africanos árabes europeos inmigrantes refugiados extranjeros discapacitados sordos ciegos",
}
_NEXT = {a: b for names in map(str.split, GROUPS.values()) for a, b in zip(names, names[1:] + names[:1], strict=True)}
_NAMES = re.compile(r"(?<!\w)(" + "|".join(_NEXT) + r")(?!\w)", re.IGNORECASE)


def swap_groups(text: str) -> str:
    return _NAMES.sub(lambda m: _NEXT[m[0].lower()], text)


def counterfactuals(text: str, number: int) -> list[tuple[str, str]]:
    """Pairs of texts that must score alike; number: any number of the text's own."""
    if _NAMES.search(text):
        return [(text, swap_groups(text)), (text, _NAMES.sub("", text))]
    if number % MENTION_EVERY:
        return []
    name = list(_NEXT)[number // MENTION_EVERY % len(_NEXT)]
    return [(text, f"{text} {name}"), (f"{text} {name}", f"{text} {_NEXT[name]}")]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and runs, with repeats, and the text of each."""
    w = Words(texts, ALNUM)
    of_text = np.repeat(np.arange(len(texts)), w.counts)
    words = (w.hashes() >> U64(64 - BITS)).astype(np.int64)
    runs = np.maximum(0, w.end - w.start - RUN + 1)
    total = int(runs.sum())
    if not total:
        return words, of_text
    at = np.repeat(w.start - (np.cumsum(runs) - runs), runs) + np.arange(total)
    code = np.zeros(len(w.data), U64)
    for k in range(RUN):
        code[: len(code) - k] |= w.data[k:].astype(U64) << U64(8 * k)
    grams = (mix(code[at] + U64(1)) >> U64(64 - BITS)).astype(np.int64)
    return np.concatenate([words, grams]), np.concatenate([of_text, np.repeat(of_text, runs)])


def feature_sets(texts: pa.Array) -> list[np.ndarray]:
    bucket, of_text = features(texts)
    both = np.unique((of_text.astype(np.int64) << BITS) | bucket)
    bounds = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    both &= (1 << BITS) - 1
    return [both[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def train(sets: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the bias. pairs: what differs between two texts that must score alike, as
    the buckets of either side. prior: the share of toxic rows among all labelled ones; with rows
    of one class only, all scores are this share."""
    weights = np.zeros(1 << BITS, np.float32)
    n, n1 = len(toxic), int(toxic.sum())
    odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if n1 in (0, n):
        return weights, float(odds)
    df = np.zeros((2, 1 << BITS), np.float32)
    for x, y in zip(sets, toxic, strict=True):
        df[int(y), x] += 1
    rate = (df + 0.5) / (np.array([[n - n1], [n1]]) + 1)
    signal = np.abs(np.log(rate[1] / (1 - rate[1])) - np.log(rate[0] / (1 - rate[0]))) / np.sqrt(1 / (df[0] + 0.5) + 1 / (df[1] + 0.5))
    signal[df.sum(0) < LEAST_DOCS] = 0
    named = np.unique(np.concatenate([x for pair in pairs for x in pair])) if pairs else np.zeros(0, np.int64)
    best = np.argpartition(-signal, FEATURES)[:FEATURES]
    chosen = np.union1d(best[signal[best] > 0], named[np.argsort(-signal[named], kind="stable")][:FEATURES])
    if not len(chosen):
        return weights, float(odds)
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen)), np.float32)
        for i, r in enumerate(rows):
            c = column[r]
            out[i, c[c >= 0]] = 1
        return out

    x, y = matrix(sets), toxic.astype(np.float32)
    difference = matrix([a for a, _ in pairs]) - matrix([b for _, b in pairs]) if pairs else None
    each = np.where(y == 1, TOXIC_WEIGHT / n1, (1 - TOXIC_WEIGHT) / (n - n1)).astype(np.float32)
    w, b = np.zeros(len(chosen), np.float32), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        error = each * (p - y)
        g = x.T @ error + RIDGE * w
        if difference is not None:
            g += 2 * SWAP_PENALTY / len(difference) * (difference.T @ (difference @ w))
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        b -= move[-1]
    weights[chosen] = w
    return weights, float(b)


def differences(texts: list[str], numbers: list[int]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Of every counterfactual pair: the text, and the buckets that only its one or its other side has."""
    owner, one, other = [], [], []
    for i, (text, number) in enumerate(zip(texts, numbers, strict=True)):
        for a, b in counterfactuals(text, number):
            owner.append(i)
            one.append(a)
            other.append(b)
    sides = list(zip(*(feature_sets(pa.array(x, pa.string())) for x in (one, other)), strict=True))
    return owner, [np.setdiff1d(a, b, assume_unique=True) for a, b in sides], [np.setdiff1d(b, a, assume_unique=True) for a, b in sides]


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for batch in batches:
        for part in slices(batch):
            texts = part.column("text").fill_null("")
            owner, only, instead = differences(texts.to_pylist(), part.column("number").to_pylist())
            bounds = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(bounds, pa.array(x, kind)) for x in (only, instead)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("number"), part.column("toxic"), pa.array(feature_sets(texts), kind), *(x.cast(pa.list_(kind)) for x in listed)],
                names=["doc_id", "number", "toxic", "plain", "only", "instead"],
            )


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Trains on labels (doc_id, toxic) outside the held-out fold. Without labels every score is 0."""
    ship(docs.sparkSession)
    marked = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    most = F.when(F.col("toxic") == 1, TRAIN_TOXIC).otherwise(TRAIN_CLEAN)
    # Only labels below a place that about twice as many lie under as are wanted are put in order.
    order = F.xxhash64("doc_id")
    share = F.when(F.col("toxic") == 1, 2.0 * TRAIN_TOXIC / max(1, counts.get(1, 0))).otherwise(2.0 * TRAIN_CLEAN / max(1, counts.get(0, 0)))
    near = marked.where(F.pmod(order, F.lit(1 << 40)) / float(1 << 40) < share)
    rank = F.row_number().over(W.partitionBy("toxic").orderBy(order, "doc_id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = (
        docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("number"))
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(_collect_features, "doc_id long, number long, toxic int, plain array<int>, only array<array<int>>, instead array<array<int>>")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("number", "ascending")])
        .slice(0, 2 * (TRAIN_TOXIC + TRAIN_CLEAN))
    )
    if not rows.num_rows:
        return np.zeros(1 << BITS, np.float32), -30.0
    arrays = lambda column: [x.values.to_numpy() for x in column]
    pairs = [(np.array(a), np.array(b)) for one, other in zip(rows["only"].to_pylist(), rows["instead"].to_pylist(), strict=True) for a, b in zip(one, other, strict=True)]
    pairs = [(a.astype(np.int64), b.astype(np.int64)) for a, b in pairs]
    return train(arrays(rows["plain"]), pairs, rows["toxic"].to_numpy(), counts.get(1, 0) / max(1, sum(counts.values())))


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    bucket, of_text = features(texts)
    hit = weights[bucket] != 0
    both = np.unique((of_text[hit].astype(np.int64) << BITS) | bucket[hit])
    total = np.bincount(both >> BITS, weights=weights[both & ((1 << BITS) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total + bias, -40, 40)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    A null or empty text has the bias's score. Rows with a null doc_id are scored and
    never train. Repeated rows score alike. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            for part in slices(batch):
                p = score_texts(part.column("text"), weights, bias)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    fold = (F.coalesce(crc_mod("doc_id", 5), F.lit(1)) == 0).alias("held_out")
    return docs.select("doc_id", "text", fold).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
