"""The pipeline's stages on the small tables, each against a plain version of its decision."""

from __future__ import annotations

import brute
import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import langid, quality, queries
from quantloom.llm.staging import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, by = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        by[name] = before = docs
        docs = stage(step(spark, before, SF), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {d for d, kept in con.sql(f"SELECT doc_id, kept FROM ({queries.oracle_sql()['op6_quality_rules']})").fetchall() if kept}
    after = {r.doc_id: r.text for r in by["language ID"].collect()}
    assert set(after) == want
    after = [(r.doc_id, r.text) for r in by["n-gram Jaccard join"].collect()]
    assert {d for d, _ in after} == {r.doc_id for r in langid.identify(by["language ID"]).where("accepted").collect()}
    kept = [(r.doc_id, r.text, r.source) for r in by["mixing"].collect()]
    assert {d for d, *_ in kept} == {d for d, (_, c) in brute.components(after).items() if d == c}
    size = {d: len(brute.WORD.findall(brute.lowered(t))) for d, t, _ in kept}
    sums: dict = {}
    for d, _, s in kept:
        sums[s] = sums.get(s, 0) + size[d]
    target, taken = brute.mix_targets(sums), dict.fromkeys(sums, 0)
    for r in by["packing"].collect():
        taken[r.source] += size[r.doc_id]
    for s in sums:
        assert abs(taken[s] - target[s]) <= max(size[d] for d, _, x in kept if x == s)
    tokens = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    copies = {r.doc_id: r["count"] for r in by["packing"].groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.n for r in tokens} == {r.doc_id: r.t * copies[r.doc_id] for r in tokens}


def test_lines_are_removed(spark):
    rows = [(i, f"Cookie notice of this site please accept\nThe text {i} of the page has more than ten words q{i} r{i}.", "en", "h", 7) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    assert len(out) == 30 and all(r.text.startswith("The text") and r.n_chars == len(r.text) for r in out)
    assert quality.quality(docs).count() == 30


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}
