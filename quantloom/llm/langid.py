"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of all subwords (runs of 2 to 4 bytes, word ends
included) of all its words; a linear softmax on it gives the language. Both are trained by
stochastic gradient descent on at most ``TRAIN_PER_LANG`` labelled texts of each language
and ``TRAIN_MOST`` in all. A part of them is left out of training: on it a temperature makes the probabilities
honest, and the confidence under which hardly any right answer falls becomes the limit of
rejection.

The average and the softmax's weights are both linear, so workers get one table of
subword scores by language, of a fixed size, and add it up over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import crc_mod
from .textbytes import LOWER, raw, slices

BITS = 14
DIM = 16
TRAIN_PER_LANG = 500
TRAIN_MOST = 2500
EPOCHS = 12
#: distinct words whose subwords a worker holds at a time
WORDS_AT_ONCE = 1 << 13
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of distinct words, and which word each is of."""
    data, offsets = raw(words)
    length = np.diff(offsets)
    n = len(length)
    ends = np.cumsum(length + 2)
    padded = np.full(int(ends[-1]) if n else 0, ord("<"), np.uint32)
    inside = np.arange(len(data)) + np.repeat(np.arange(n) * 2 + 1, length)
    padded[inside] = LOWER[data]
    padded[ends - 1] = ord(">")
    owner = np.repeat(np.arange(n), length + 2)
    buckets, owners = [], []
    code = padded.copy()
    for size in (2, 3, 4):
        code = code[:-1] * np.uint32(0x01000193) ^ padded[size - 1 :]
        first = owner[: len(code)]
        whole = (first == owner[size - 1 :]) & (length[first] > 0)
        h = code[whole] * np.uint32(0x9E3779B1) + np.uint32(size)
        h ^= h >> np.uint32(15)
        buckets.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
        owners.append(first[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word of each place, and the text of each place."""
    lists = pc.ascii_split_whitespace(texts.fill_null("") if texts.null_count else texts)
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), counts)


@dataclass
class Model:
    """scores: what a subword of each bucket adds to each language; a text's logits are
    their average plus bias, divided by temperature."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        words, place, owner = _words(texts)
        n = len(texts)
        total = np.zeros((n, len(self.langs)))
        count = np.zeros(n)
        if len(place):
            per_word, by_word = np.zeros(len(words)), np.zeros((len(self.langs), len(words)))
            for at in range(0, len(words), WORDS_AT_ONCE):
                part = words.slice(at, WORDS_AT_ONCE)
                buckets, of_word = subwords(part)
                per_word[at : at + len(part)] = np.bincount(of_word, minlength=len(part))
                for k in range(len(self.langs)):
                    by_word[k, at : at + len(part)] = np.bincount(of_word, weights=self.scores[buckets, k], minlength=len(part))
            count = np.bincount(owner, weights=per_word[place], minlength=n)
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(owner, weights=by_word[k, place], minlength=n)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability, and whether the answer is accepted."""
        p = self.probabilities(texts)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, score = p.argmax(1), p.max(1)
        score = np.where(lettered, score, 0.0)
        return [self.langs[b] if x else UNKNOWN for b, x in zip(best, lettered, strict=True)], score, lettered & (score >= self.reject_below)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, langs: list[str], seed: int = 0) -> Model:
    """features: buckets and counts of each text. Every fifth text calibrates."""
    if len(langs) == 1:
        return Model(langs, np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    k = len(langs)
    embed = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for i, r in enumerate(rows):
            b, c = features[r]
            x[i, b] = c / max(1, c.sum())
        return x

    order = rng.permutation(len(features))
    held = order[::5] if len(order) >= 50 else order
    fit = order if len(order) < 50 else np.setdiff1d(order, held)
    share = np.bincount(target[fit], minlength=k)
    balance = (len(fit) / np.maximum(1, k * share))[target].astype(np.float32)
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            x = dense(batch)
            mean = x @ embed
            error = softmax(mean @ weight + bias)
            error[np.arange(len(batch)), target[batch]] -= 1
            error *= balance[batch][:, None] / len(batch)
            to_embed = error @ weight.T
            weight -= rate * (mean.T @ error)
            bias -= rate * error.sum(0)
            embed -= 20 * rate * (x.T @ to_embed)
    logits = np.concatenate([dense(rows) @ embed @ weight + bias for rows in np.array_split(held, max(1, len(held) // 64))])
    true = target[held] if len(order) < 50 else np.concatenate([target[r] for r in np.array_split(held, max(1, len(held) // 64))])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(true)), true], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = softmax(logits / temperature)
    right = p.max(1)[p.argmax(1) == true]
    limit = 0.9 * float(np.quantile(right, 0.001)) if len(right) else 0.0
    return Model(langs, (embed @ weight).astype(np.float32), bias.astype(float), temperature, min(limit, 0.6))


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=1 << 16):
            words, place, owner = _words(part.column("text"))
            buckets, of_word = subwords(words)
            bounds = np.searchsorted(of_word[np.argsort(of_word, kind="stable")], np.arange(len(words) + 1))
            buckets = buckets[np.argsort(of_word, kind="stable")]
            split = np.searchsorted(owner, np.arange(part.num_rows + 1))
            out = []
            for i in range(part.num_rows):
                count = np.bincount(place[split[i] : split[i + 1]], minlength=len(words))
                weights = np.repeat(count, np.diff(bounds))
                total = np.bincount(buckets, weights=weights, minlength=1 << BITS)
                used = np.flatnonzero(total)
                out.append((used.astype(np.int32), total[used].astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float32()))],
                names=["lang", "buckets", "counts"],
            )


def fit(docs: DataFrame) -> Model | None:
    """Trains on docs (doc_id, text, lang) outside the held-out fold; None if nothing is labelled."""
    ship(docs.sparkSession)
    order = F.xxhash64("doc_id")
    known = docs.where((F.coalesce(crc_mod("doc_id", 5), F.lit(1)) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Of each language only rows below a place that about twice as many lie under as are wanted: a common
    # language is no more rows to rank than a rare one.
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("_lang"), (F.lit(2.0 * TRAIN_PER_LANG) / F.col("n")).alias("share"))
    place = F.pmod(order, F.lit(1 << 40)) / float(1 << 40)
    near = known.select("doc_id", "lang").join(counts, F.col("lang") == F.col("_lang")).where(place < F.col("share"))
    ranked = near.select("doc_id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id")).alias("rank"))
    chosen = ranked.where(F.col("rank") <= TRAIN_PER_LANG).orderBy("rank", "lang", "doc_id").limit(TRAIN_MOST).select("doc_id").distinct()
    rows = (
        known.select("doc_id", "text", "lang")
        .join(F.broadcast(chosen), "doc_id", "left_semi")
        .select("text", "lang")
        .mapInArrow(_collect_features, "lang string, buckets array<int>, counts array<float>")
        .toArrow()
    )
    if not rows.num_rows:
        return None
    langs = sorted(set(rows["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    features = [(b.values.to_numpy(), c.values.to_numpy()) for b, c in zip(rows["buckets"], rows["counts"], strict=True)]
    # The same order whatever tasks came first: rows that are equal in all of this are the same to the training. Ids that repeat may add rows.
    keys = [(lang, b.tobytes(), c.tobytes()) for lang, (b, c) in zip(rows["lang"].to_pylist(), features, strict=True)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__)[: 2 * TRAIN_MOST])
    return train([features[i] for i in order], np.array([at[x] for x in rows["lang"].to_pylist()])[order], langs)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of each row of docs (doc_id, text, lang); lang serves training only.

    A null text and one without a letter are 'und', with score 0, and not accepted. Without any
    labelled text all are 'und'. Repeated rows are answered alike; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                n = part.num_rows
                lang, score, accepted = model.predict(part.column("text")) if model else ([UNKNOWN] * n, np.zeros(n), np.zeros(n, bool))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                    names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    fold = (F.coalesce(crc_mod("doc_id", 5), F.lit(1)) == 0).alias("held_out")
    return docs.select("doc_id", "text", fold).mapInArrow(answer, SCHEMA)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is accepted."""
    model = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                if sent.value is not None:
                    yield part.filter(pa.array(sent.value.predict(part.column("text"))[2]))

    return docs.mapInArrow(keep, docs.schema)
