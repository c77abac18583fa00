"""Quality rules with cross-document line frequency.

One scan counts, for every normalised line and host (source), in how many different
texts it stands. A line in more than ``LEAST_DOCS`` texts and in more than one of
``HOST_PART`` of all texts of its host is boilerplate of that host; in a host of few texts one of ``SMALL_PART``
of them is enough, if these are more than ``FEWEST``. So a host has at most ``HOST_PART`` times
as many such lines as a text has on average, whatever its size, and they fit beside each of its
documents in the second scan, which removes them and rejects what is left with too few words.

The lines of all hosts go to the workers while they are at most ``BROADCAST_LINES``. Beyond, they
are joined by a shuffle on the host and a part of it: hosts of more than ``HOST_SLICE`` texts are
dealt out to as many parts as they need, each with the host's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nativewords import SPACE, stripped
from .staging import stage

LEAST_DOCS = 10
HOST_PART = 100
#: hosts below LEAST_DOCS * SMALL_PART texts have a limit of their own
SMALL_PART = 20
FEWEST = 2
LEAST_WORDS = 10
#: percent of the words that must remain
LEAST_LEFT = 30
BROADCAST_LINES = 1_000_000
#: texts of one host that are joined with its lines in one part
HOST_SLICE = 100_000


def _let(value: Column, body) -> Column:
    """Binds a value once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(stripped(line)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def boilerplate(docs: DataFrame, least_docs: int = LEAST_DOCS, host_part: int = HOST_PART) -> DataFrame:
    """(source, host_docs, common): the number of different texts of each source that has lines above
    the limits, and the hashes of these lines. Copies of a text don't make its lines common."""
    rows = docs.select("source", F.xxhash64("text").alias("text_hash"), F.array_distinct(F.transform(_lines(F.col("text")), _line_hash)).alias("hashes"))
    hosts = rows.select("source", "text_hash").distinct().groupBy("source").agg(F.count("*").alias("host_docs")).withColumnRenamed("source", "host")
    counts = (
        rows.select("source", "text_hash", F.explode("hashes").alias("line"))
        .distinct()
        .groupBy("source", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > min(least_docs, FEWEST))
    )
    least = F.least(F.lit(least_docs), F.greatest(F.lit(FEWEST), F.expr(f"host_docs div {SMALL_PART}")))
    return (
        counts.join(hosts, F.col("source").eqNullSafe(F.col("host")))
        .where((F.col("n") > least) & (F.col("n") * host_part > F.col("host_docs")))
        .groupBy("source")
        .agg(F.max("host_docs").alias("host_docs"), F.collect_set("line").alias("common"))
    )


def _with_lines(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs with _common: the boilerplate lines of their source, null if it has none."""
    common = stage(common.select(F.col("source").alias("_host"), "host_docs", F.col("common").alias("_common")), "op6-lines")
    size = common.agg(F.coalesce(F.sum(F.size("_common")), F.lit(0))).first()[0]
    if not size:
        return docs.withColumn("_common", F.lit(None).cast("array<bigint>"))
    if size <= BROADCAST_LINES:
        lists = F.broadcast(common.drop("host_docs"))
        return docs.join(lists, docs["source"].eqNullSafe(lists["_host"]), "left").drop("_host")
    # At most one host for every HOST_SLICE texts of the corpus is large.
    parts = F.ceil(F.col("host_docs") / HOST_SLICE).cast("int")
    large = F.broadcast(common.where(F.col("host_docs") > HOST_SLICE).select(F.col("_host").alias("_large"), parts.alias("_parts")))
    dealt = docs.join(large, docs["source"].eqNullSafe(large["_large"]), "left").drop("_large")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("text"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    lists = common.withColumn("_at", F.explode(F.sequence(F.lit(0), parts - 1))).drop("host_docs")
    both = dealt["source"].eqNullSafe(lists["_host"]) & (dealt["_part"] == lists["_at"])
    return dealt.join(lists, both, "left").drop("_host", "_at", "_part")


def _covered(grams: Column) -> Column:
    """Number of words in the windows whose hash occurs twice or more: windows are sorted by
    hash, those equal to a neighbour are put in order of place, and each adds the words
    after the window before it."""

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: s[a]["g"] == s[b]["g"]
        found = lambda j: F.when(j > 0, same(j, F.greatest(j - 1, F.lit(0)))).otherwise(False) | F.when(j < last, same(j, F.least(j + 1, last))).otherwise(False)
        return F.transform(F.filter(F.sequence(F.lit(0), last), found), lambda j: s[j]["i"])

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    places = F.sort_array(_let(ordered, repeated))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    return F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"), x.alias("last")))["n"]


def quality(docs: DataFrame, least_docs: int = LEAST_DOCS, host_part: int = HOST_PART) -> DataFrame:
    """docs (doc_id, text, source, and any others) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept and ``kept_text``: the text without its
    boilerplate lines. Columns of docs that have one of these names are replaced.

    A null text has no words, fails the base rules and has a null kept_text. Null is a
    source like any other. Repeated rows are judged alike. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_text")
    joined = _with_lines(docs, boilerplate(docs, least_docs, host_part))
    text = F.coalesce(F.col("text"), F.lit(""))
    step = joined.withColumn("_lines", _lines(F.col("text")))
    step = step.withColumn("_by_line", F.transform("_lines", lambda x: F.split(stripped(x), SPACE + "+")))
    step = step.withColumn("_words", F.flatten("_by_line"))
    step = step.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn("n_words", F.size("_words").cast("long"))
    window = lambda i: F.xxhash64(*(F.col("_hash")[i + k] for k in range(5)))
    step = step.withColumn("_grams", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_hash") - 5), window)).otherwise(F.array().cast("array<bigint>")))
    clean = F.size(F.array_distinct("_grams")) == F.size("_grams")
    step = step.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(clean, 0).otherwise(_covered(F.col("_grams"))).cast("long"),
        }
    )
    step = step.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # Of the host's lines those of this text: none, mostly, so that its own are not looked up one by one.
    step = step.withColumn("_hits", F.array_intersect(F.transform("_lines", _line_hash), F.coalesce("_common", F.array().cast("array<bigint>"))))
    is_common = lambda x: F.array_contains(F.col("_hits"), _line_hash(x))
    left = F.when(F.size("_hits") == 0, F.col("n_words")).otherwise(
        F.aggregate(F.zip_with("_lines", "_by_line", lambda x, ws: F.when(is_common(x), 0).otherwise(F.size(ws))), F.lit(0), lambda a, x: a + x)
    )
    step = step.withColumn("_remain", left)
    kept = ~F.col("base_failed") & (F.col("_remain") >= LEAST_WORDS) & (100 * F.col("_remain") >= LEAST_LEFT * F.col("n_words"))
    kept_text = F.when(F.size("_hits") == 0, F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), lambda x: ~is_common(x) | ~x.rlike(r"[^\x20\x09-\x0D]")), "\n")
    )
    return step.withColumns({"kept": kept, "kept_text": kept_text}).drop("_lines", "_by_line", "_words", "_hash", "_grams", "_common", "_hits", "_remain")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, text AS raw, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (
  SELECT k, source, raw, line, lower(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT k, source, raw, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT coalesce('x' || raw, '')) AS host_docs FROM d GROUP BY source),
counts AS (SELECT source, norm, count(DISTINCT raw) AS n FROM l GROUP BY source, norm),
common AS (
  SELECT c.source, norm FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE n > least(10, greatest(2, host_docs // 20)) AND n * 100 > host_docs),
lines AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(CASE WHEN EXISTS (SELECT 1 FROM common c WHERE c.source IS NOT DISTINCT FROM l.source AND c.norm = l.norm) THEN w ELSE 0 END) AS gone
  FROM l GROUP BY k),
g AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM (
    SELECT k, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (
      SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5))),
r AS (
  SELECT k, sum(least(5, coalesce(i - before, 5))) AS n_repeat_words FROM (
    SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM g WHERE c > 1) GROUP BY k),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(words) - coalesce(gone, 0) AS remain
  FROM d LEFT JOIN lines USING (k) LEFT JOIN r USING (k)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND remain >= 10 AND 100 * remain >= 30 * n_words AS kept
FROM v
"""
