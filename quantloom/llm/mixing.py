"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place on a hash line. A source's budget is a number of words; it
takes its documents as often as the budget holds the whole source, and once more those
below a threshold on the line. Words summed by source and hash bucket give the bucket
in which the threshold falls, the same again inside that bucket gives a bucket of
about a 16-millionth of the source, and only its documents are put in order. All the rest is
a comparison with the threshold. Larger budgets take whatever smaller ones take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .nativewords import n_words
from .staging import stage

BITS = 12
#: a threshold table of at most so many sources is broadcast; a larger one is joined by a shuffle
BROADCAST_SOURCES = 50_000
MOST_REPEATS = 3


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3 repeating in source order share all
    words; a target stops at ``MOST_REPEATS`` times its source's words and the excess goes
    to the others by weight. Sources are ordered by how soon they fill; those that fill
    are a prefix of that order, and what is left for the rest follows from running sums."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("w", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    sources = sources.withColumn("most", MOST_REPEATS * F.col("source_size"))
    by_fill = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    filled = (
        sources.withColumn("before", F.coalesce(F.sum("most").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("w_left"))
        .withColumn("open_level", F.when(F.col("most") > F.col("w") * F.col("level"), F.col("level")))
        .withColumn("share", F.max("open_level").over(everything))
    )
    return filled.select(
        "source", "source_size",
        F.least(F.col("most").cast("double"), F.coalesce(F.col("w") * F.col("share"), F.col("most").cast("double"))).alias("target"),
    )


def _boundary(hist: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which its running sum passes ``rest``, and that sum before it."""
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hist.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))


def _size_and_place() -> dict:
    """Words of a row's text, and its place on the line: 60 bits of md5(doc_id)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return {"size": n_words(F.col("text")), "place": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")}


def _by_source(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if small else right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def _bucket(levels: int):
    return F.shiftright("place", 60 - levels * BITS)


def thresholds(sized: DataFrame) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, rest, cut, below) of each source, and whether they are
    few enough to broadcast. The source's documents are taken ``whole`` times, and once more in
    all buckets before ``cut``, which hold ``below`` of the ``rest`` words."""
    budgets = stage(
        targets(sized)
        .withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size")),
        "op4-budgets",
    )
    small = budgets.count() <= BROADCAST_SOURCES
    coarse = sized.groupBy("source", _bucket(1).alias("b1")).agg(F.sum("size").alias("words"))
    first = _boundary(_by_source(coarse, budgets.select("source", "rest"), small), "b1").select("source", F.col("b1").alias("cut1"), F.col("before").alias("before1"))
    fine = (
        _by_source(sized, first, small)
        .where(_bucket(1) == F.col("cut1"))
        .groupBy("source", "before1", _bucket(2).alias("b2"))
        .agg(F.sum("size").alias("words"))
    )
    inside = _by_source(fine, budgets.select("source", "rest"), small).withColumn("rest", F.col("rest") - F.col("before1"))
    second = _boundary(inside, "b2").select("source", F.col("b2").alias("cut"), (F.col("before1") + F.col("before")).alias("below"))
    return stage(_by_source(budgets.drop("budget"), second, small, "left"), "op4-thresholds"), small


def _on_threshold(placed: DataFrame, cut_boundary: bool) -> DataFrame:
    """The documents in their source's last bucket, with the words that they give once ``more``."""
    at = W.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.greatest(F.col("rest") - F.col("below") - F.coalesce(F.sum("size").over(at), F.lit(0)), F.lit(0))
    more = F.least(left, F.col("size")) if cut_boundary else F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0)
    return placed.where(_bucket(2) == F.col("cut")).withColumn("more", more)


def mix_documents(docs: DataFrame, cut_boundary: bool = True) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs (doc_id, text, source).

    A source's taken words sum to its target rounded to a word; for that, the one
    document on its threshold gives only part of its words. With ``cut_boundary`` false
    that document is taken whole if half of it or more lies below the threshold, else not.
    Null and empty texts have size 0 and take 0; null is a source of its own, the last.
    Repeated rows are rows. An empty table gives no rows. Places on the line come from
    md5(doc_id), so reruns agree.
    """
    sized = stage(docs.select("doc_id", "source", *(c.alias(n) for n, c in _size_and_place().items())), "op4-sized")
    plan, small = thresholds(sized)
    placed = _by_source(sized, plan, small)
    clear = placed.where(F.col("cut").isNull() | (_bucket(2) != F.col("cut"))).withColumn("more", _once_more())
    both = clear.unionByName(_on_threshold(placed, cut_boundary))
    return both.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).alias("taken"))


def _once_more():
    return F.when(_bucket(2) < F.col("cut"), F.col("size")).otherwise(F.lit(0))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it, always
    whole. Of rows that repeat an id and lie on a threshold, all or none are taken."""
    sized = stage(docs.select("doc_id", "source", *(c.alias(n) for n, c in _size_and_place().items())), "op4-sized")
    plan, small = thresholds(sized)
    edge = _on_threshold(_by_source(sized, plan, small), cut_boundary=False)
    edge = edge.groupBy(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max("more").alias("_more"))
    edge = stage(edge, "op4-edge")
    edge = F.broadcast(edge) if edge.count() <= BROADCAST_SOURCES else edge
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", *(c.alias(n) for n, c in _size_and_place().items()))
    placed = _by_source(packed, plan, small)
    same = placed["doc_id"].eqNullSafe(edge["_doc_id"]) & placed["source"].eqNullSafe(edge["_source"]) & (placed["size"] == edge["_size"])
    placed = placed.join(edge, same, "left")
    copies = F.col("whole") + F.when(F.coalesce("_more", _once_more()) > 0, 1).otherwise(0)
    times = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    return placed.where(times > 0).select("_row", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(most::DOUBLE, coalesce(w * max(CASE WHEN most > w * level THEN level END) OVER (), most::DOUBLE)) AS target FROM f),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole,
         floor(target + 0.5)::BIGINT AS budget FROM t)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, budget - whole * source_size - coalesce(sum(size) OVER (
          PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
