"""Every operator on nulls, empty and very long texts, repeated rows, clashing column names and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import jaccard, langid, licenses, lmscore, mixing, packing, quality, sharding, toxicity

LONG = " ".join(f"w{i % 997} mit license." for i in range(60_000))
ROWS = [
    (1, "Hello world, this is a small text about the MIT License and nothing else.", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", None, "s2"),
    (4, " \t\n\x0b ", "fr", None),
    (5, LONG, "fr", "s2"),
    (6, "Hello world, this is a small text about the MIT License and nothing else.", None, "s1"),
    (6, "Hello world, this is a small text about the MIT License and nothing else.", None, "s1"),
    (7, "123 456 !!! 789", "en", ""),
    (8, "çà et là été naïve \U0001f600 straße İstanbul", "fr", "s3"),
    (9, "one", "en", "s3"),
    (None, "a row without an id stays a row", "en", "s1"),
]
#: names that operators use inside
CLASHING = "kept n_words base_failed _others _hits size place shard slot row rank n sid bits _common _left _words kept_text h crc bytes whole rest cut _source lang_pred held_out base".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (5, 1), (8, None), (9, 1), (9, 1), (None, 1)], "doc_id long, toxic int").withColumn("score", F.lit("x"))


OPERATORS = {
    "shard": lambda d, lab: sharding.shard_documents(d, 3),
    "components": lambda d, lab: jaccard.similarity_classes(d),
    "mix": lambda d, lab: mixing.mix_documents(d),
    "licenses": lambda d, lab: licenses.scan_licenses(d),
    "quality": lambda d, lab: quality.quality(d),
    "lm": lambda d, lab: lmscore.score_documents(d, bits=1 << 20, frequent=64),
    "toxicity": lambda d, lab: toxicity.score_toxicity(d, lab),
    "language": lambda d, lab: langid.identify(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "pack"])
def test_empty_table(docs, labels, name):
    empty = docs.limit(0)
    run = OPERATORS.get(name, lambda d, lab: packing.pack_documents(d))
    assert run(empty, labels).count() == 0
    if name in ("toxicity",):
        assert run(docs, labels.limit(0)).where("predicted = 0").count() == len(ROWS)


def test_pipeline_steps_keep_columns(docs):
    steps = [lambda d, f=f: f(d.sparkSession, d, "") for _, f in corpus_pipeline.STAGES[:-1]]
    for step in steps:
        out = step(docs)
        assert out.columns == docs.columns and step(docs.limit(0)).count() == 0
        assert all({r[c] for r in out.select(*CLASHING).distinct().collect()} <= {"x"} for c in CLASHING)
    assert corpus_pipeline.pack(docs.sparkSession, docs.limit(0), "").count() == 0 < corpus_pipeline.pack(docs.sparkSession, docs, "").count()
    assert jaccard.keep_one_of_each(docs).where("doc_id = 6").count() == 0
    assert langid.keep_identified(docs).where("doc_id in (2, 3, 4, 7)").count() == 0


def test_defined_results(docs, labels):
    parts = {r.doc_id: r for r in jaccard.similarity_classes(docs).collect()}
    assert parts[6].component_id == 1 and parts[2].n_shingles == parts[3].n_shingles == parts[4].n_shingles == 0 and parts[9].n_shingles == 1
    lang = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [lang[i].lang_pred for i in (2, 3, 4, 7)] == ["und"] * 4 and not lang[7].accepted
    lic = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert lic[5].n_base == 60_000 and lic[2].first_word is None and lic[2].labels == "" and lic[1].labels == "mit"
    q = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert q[2].base_failed and q[3].n_words == q[4].n_words == 0 and not q[9].kept and q[1].kept
    m = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    assert m[2].size == m[3].size == m[2].taken == 0
    p = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in p}[2] == 1


def test_a_row_without_an_id_bridges(spark):
    words = [f"v{i}" for i in range(40)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    # Of 36 shingles, one changed word near an end leaves 33 to 35; the ends changed on both sides are too far apart.
    rows = [(7, changed(3)), (None, changed()), (8, changed(36)), (9, "a text of its own with more than five words")]
    got = {r.doc_id: r.component_id for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7: 7, None: 7, 8: 7, 9: 9}
    alone = jaccard.similarity_classes(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in alone) == [7, 8]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [
        (None, text("a"), "x"), (None, text("b"), "x"), (None, text("b"), "x"), (None, "", "x"), (None, None, "x"),
        (1, text("c"), "x"), (2, text("c"), "x"), (2, text("d"), "x"), (2, text("e"), "y"), (2, text("e"), "x"),
        (3, text("f"), "x"), (None, text("f"), "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in jaccard.keep_one_of_each(docs).collect()]
    want = [rows[i] for i in (0, 1, 3, 4, 5, 7, 9, 10)]
    assert sorted(map(str, got)) == sorted(map(str, want))
