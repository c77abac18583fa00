"""Narratives of the documents of each source, and phases of the symbols' daily volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import narratives
from ..sources.adapters import TRADES_SQL, load, trades


def topics(spark, d):
    """Each document as a topic of its source: its keywords are its eight longest words, equally long ones in order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0)))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    keywords = F.transform(F.slice(ranked, 1, 8), lambda x: x["w"])
    return load(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.col("doc_id").cast("string").alias("topic"), keywords.alias("keywords"), (F.size(words) + 0.0).alias("mentions"), (F.size(words) % 7 - 3.0).alias("sentiment"))


def register(query) -> None:
    @query()
    def narrative_clusters(spark, d):
        return narratives.cluster_narratives(topics(spark, d), "source", "doc_id")

    @query(f"""WITH v AS (SELECT symbol, venue, ts::DATE AS day, sum(amount) AS a FROM ({TRADES_SQL}) t GROUP BY ALL), l AS (SELECT symbol, venue, list(a ORDER BY day) AS h, len(list(a)) AS n FROM v GROUP BY symbol, venue), m AS (SELECT *, list_avg(h[:n // 2]) AS e, list_avg(h[n // 2 + 1:]) AS r FROM l)
 SELECT symbol, venue, CASE WHEN n < 2 THEN 'emerging' WHEN h[n] >= 0.9 * list_max(h) AND r > e THEN 'peak' WHEN r > 1.3 * e THEN 'growing' WHEN r < 0.7 * e THEN 'decaying' ELSE 'emerging' END AS phase FROM m""")
    def lifecycle_phases(spark, d):
        daily = trades(spark, d).groupBy("symbol", "venue", F.to_date("ts").alias("day")).agg(F.sum("amount").alias("a"))
        history = F.transform(F.array_sort(F.collect_list(F.struct("day", "a"))), lambda x: x["a"])  # one entry a day
        return daily.groupBy("symbol", "venue").agg(history.alias("h")).select("symbol", "venue", narratives.lifecycle_phase(F.col("h")).alias("phase"))
