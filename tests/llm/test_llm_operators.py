"""Operators against the plain versions in brute.py, round trips and held-out rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import annsearch, components, jaccard, langid, licenses, lmscore, mixing, packing, queries, quality, sharding, textbytes, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return queries.queries()[next(k for k in queries.queries() if k.startswith(name + "_"))](spark, SF)


@pytest.mark.parametrize("name", ["op4_mix_sources", "op6_quality_rules"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB0 .\t\n\x0b\r\x1c\x85é漢😀-", max_size=30), max_size=6))
def test_words_of_bytes(texts):
    for table, pattern in ((textbytes.NOT_SPACE, brute.WORD), (textbytes.ALNUM, brute.ALNUM)):
        w = textbytes.Words(pa.array(texts, pa.string()), table)
        for i, t in enumerate(texts):
            assert [w.word(k) for k in range(w.ptr[i], w.ptr[i + 1])] == pattern.findall(brute.lowered(t))
        same: dict = {}
        for k, h in enumerate(w.hashes().tolist()):
            assert same.setdefault(h, w.word(k)) == w.word(k)


# 1 ---------------------------------------------------------------------------------------


def test_best_fit_matches_plain():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 60, 80).tolist(), reverse=True)
        bins: list[list[int]] = []
        want = []
        for s in sizes:
            fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= s]
            if fits:
                _, i = min(fits)
            else:
                bins.append([100])
                i = len(bins) - 1
            bins[i][0] -= s
            want.append(i)
        assert sharding.best_fit(sizes, 100) == want
        spread = Counter()
        for s, b in zip(sizes, sharding.smallest_capacity(sizes, 7), strict=True):
            spread[b] += s
        assert len(spread) <= 7 and max(spread.values()) <= sum(sizes) / 7 + max(sizes)


def test_shards(spark, rows):
    got = run(spark, "op1").toPandas()
    text = {r[0]: r[1] for r in rows}
    assert sorted(got.doc_id) == sorted(text) and set(got.law) == {"bytes"} and got["shard"].between(0, 23).all()
    assert all(s == len((text[d] or "").encode()) + 8 and c == zlib.crc32((text[d] or "").encode()) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    assert got.assign(t=got.doc_id.map(text)).groupby("t")["shard"].nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    group = got.assign(t=got.doc_id.map(text)).groupby("t")["size"].sum().max()
    assert got.groupby("shard")["size"].sum().max() <= max(1.05 * got["size"].sum() / 24, group)


def test_two_level_packing_of_many_small_groups(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 20_000, F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    many = many.unionByName(spark.range(30_000, 31_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text")))
    got = sharding.shard_documents(many, 5, fineness=8).toPandas()
    assert len(got) == 31_000 and got[got.doc_id >= 30_000]["shard"].nunique() == 1
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.min() < 1.3


# 2 ---------------------------------------------------------------------------------------


def test_nearest(spark):
    e = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").df()
    x = np.stack(e.embedding.values).astype(float)
    want = brute.nearest(e.vec_id.to_numpy(), x, [i for i in e.vec_id if i % 50 == 0])
    got = run(spark, "op2").toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for q, g in got.groupby("query_id"):
        assert list(g["rank"]) == list(range(1, len(g) + 1))
        hits += len({i for i, _ in want[q]} & set(g.vec_id))
        total += len(want[q])
    assert set(got.query_id) == set(want) and hits / total >= 0.9


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (50, [1.0, 0.0]), (100, [-1.0, 0.0]), (100, [-1.0, 0.0]), (150, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = annsearch.search(df, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    assert {q: list(g.vec_id) for q, g in got.groupby("query_id")} == {0: [1, 2, 50, 3, 100], 50: [0, 1, 2, 3, 100], 100: [3, 0, 1, 2, 50]}
    assert annsearch.search(df.limit(0), F.lit(True)).count() == 0


def test_learned_partitions_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.25 * rng.normal(size=(6000, 16))).astype("float32")
    router = annsearch.fit_router(x.astype(float), 5, 16, epochs=15)
    assert router.probes <= 4
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(6000), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = annsearch.search(df, F.col("vec_id") % 50 == 0).toPandas()
    want = brute.nearest(np.arange(6000), x.astype(float), list(range(0, 6000, 50)))
    found = got.groupby("query_id").vec_id.apply(set)
    assert np.mean([len({i for i, _ in want[q]} & found[q]) / 5 for q in want]) >= 0.9


# 3 ---------------------------------------------------------------------------------------


def test_jaccard_components(spark, rows):
    want = brute.components([(r[0], r[1]) for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op3").collect()} == want


def test_jaccard_edits(spark, monkeypatch):
    """Copies with many edits, over blocks of a few sets."""
    rng = np.random.default_rng(3)
    rows = []
    for g, n in enumerate((60, 7, 2)):
        words = [f"g{g}w{i}" for i in range(80)]
        for _ in range(n):
            w = list(words)
            for at in rng.integers(0, 80, rng.integers(0, 5)):
                w[at] = f"x{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(f"u{i}v{k}" for k in range(rng.integers(1, 40))) + " some words that all of these texts have at their end") for i in range(40)]
    want = brute.components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 8):
        monkeypatch.setattr(jaccard, "GROUP_BLOCK", block)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()} == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_group_answers_and_filter(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(2**60, 40, replace=False).astype(np.uint64)
    sets = []
    for _ in range(rng.integers(2, 14)):
        keep = base[rng.random(40) < rng.choice([0.5, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([keep, rng.choice(2**60, rng.integers(0, 6)).astype(np.uint64) if True else keep, keep[:1] if len(keep) else base[:1]])))
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    n = len(sets)
    links = [(i, j) for i in range(n) for j in range(i) if near(sets[i], sets[j])]

    def classes(pairs):
        root = list(range(n))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        return [root.index(r) for r in root]

    assert classes(jaccard.joining_links(sets, np.arange(n))) == classes(links)
    family = jaccard.may_link(np.arange(n), np.array([len(s) for s in sets]), [jaccard.parity_bits(s) for s in sets])
    assert all(family[i] == family[j] >= 0 for i, j in links)
    assert all((jaccard.received(jaccard.sent(s)) == s >> np.uint64(16)).all() for s in sets)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(0, 64)] + [(1000, 1001), (1002, 1001), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(65)}, 1000: 1000, 1001: 1000, 1002: 1000}


# 4 ---------------------------------------------------------------------------------------


def test_mixture(spark, rows):
    got = run(spark, "op4").toPandas()
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(brute.WORD.findall(brute.lowered(r[1]))) for r in rows}
    sums: dict = defaultdict(int)
    for d, s in source.items():
        sums[s] += size[d]
    want = brute.mix_targets(dict(sums))
    got["source"] = got.doc_id.map(source)
    assert (got["size"] == got.doc_id.map(size)).all() and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    for s, g in got.groupby("source"):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 and abs(g.taken.sum() - want[s]) <= 1 and g.source_size.iloc[0] == sums[s]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_plain_targets_are_full(sizes):
    t = brute.mix_targets(dict(enumerate_names(sizes)))
    assert sum(t.values()) == pytest.approx(sum(sizes)) and all(t[f"s{i}"] <= 3 * s + 1e-9 for i, s in enumerate(sizes))


def enumerate_names(sizes):
    return ((f"s{i}", s) for i, s in enumerate(sizes))


def test_small_sources_fill(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(1000, "a"), (3, "b"), (2, "c"), (1, None), (0, "d")])]
    got = {r.doc_id: r for r in mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = brute.mix_targets({"a": 1000, "b": 3, "c": 2, None: 1, "d": 0})
    assert [got[i].target for i in range(5)] == pytest.approx([want[s] for s in ("a", "b", "c", None, "d")])
    assert got[1].taken == 9 and got[2].taken == 6 and got[3].taken == 3


# 5 ---------------------------------------------------------------------------------------


def test_licenses(spark, rows):
    got = {r.doc_id: r for r in run(spark, "op5").collect()}
    for d, t, *_ in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.base_licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_matching_statistics():
    templates = [[1, 2, 3, 1, 2, 4], [2, 3, 1, 5], [9]]
    auto = licenses.Automaton(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = rng.choice([1, 2, 3, 4, 5, 9, 7], 12).tolist()
        for i, (state, length) in enumerate(auto.matching(text)):
            best = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0)
            assert length == best
            if length:
                assert auto.ends[state] == {(t, e) for t, x in enumerate(templates) for e in range(length - 1, len(x)) if x[e - length + 1 : e + 1] == text[i + 1 - length : i + 1]}


def test_template_spans_survive_edits():
    scanner = licenses.Scanner()
    label, notice = licenses.TEMPLATES[2]
    words = notice.split()
    edited = " ".join(["prose"] * 30 + words[:20] + ["INSERTED"] + words[22:50] + words[51:] + ["tail"] * 9)
    *_, labels, score, spans = scanner.scan(pa.array([edited, "only the words of a text and the end of it"]))[0]
    assert "apache" in labels and any(s[0] == label and s[1] == 30 and s[3] > 0.8 for s in spans) and score == 1.0
    assert scanner.scan(pa.array(["permission is hereby granted free of charge"]))[0][5] == ""


# 6 ---------------------------------------------------------------------------------------


def test_common_lines(spark):
    rows = [(i, f"Cookie notice of this site please accept\nA text number {i} with its own words alpha beta gamma delta n{i} m{i} k{i}.", "host") for i in range(40)]
    rows += [(100 + i, "Cookie notice of this site please accept\nCookie  footer\nfew", "host") for i in range(3)]
    rows += [(200, "Cookie notice of this site please accept\nten more words here so that nothing is depleted at all ok", "other")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].kept_text.startswith("A text") for i in range(40))
    assert not got[100].kept and got[200].kept_text.startswith("Cookie")


def test_lines_on_the_given_tables():
    """The limits act: some lines of the middle-sized table are boilerplate, in few of its texts, and some texts are depleted."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.1/documents.parquet'")
    rejected = con.sql(f"SELECT count(*) FROM ({quality.ORACLE}) WHERE NOT kept AND NOT base_failed").fetchall()[0][0]
    assert 0 < rejected < 100


def test_lines_of_small_hosts(spark):
    """Three of at most sixty texts make a line common, two don't; the tables on which results are compared have such hosts."""
    body = lambda i: " ".join(f"{k}{i}" for k in "abcdefghijkl")
    rows = [(i, (f"subscribe here\n{body(i)}" if i < 3 else f"seldom said\n{body(i)}" if i < 5 else body(i)), "s") for i in range(59)]
    got = {r.doc_id: r.kept_text for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: body(i) if i < 3 else t for i, t, _ in rows}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality.quality(docs).selectExpr("count_if(text <> kept_text) AS changed", "count_if(NOT kept AND NOT base_failed) AS gone").first()
    assert found.changed > 100 and 0 < found.gone < 20


def test_common_lines_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = quality.boilerplate(docs.select("source", "text")).collect()
    assert sum(len(r.common) for r in found) > 20
    got = quality.quality(docs).select("text", "kept_text", "kept", "base_failed").toPandas()
    changed = got[got.text.notna() & (got.text != got.kept_text)]
    assert len(changed) > 500 and (changed.kept_text.str.len() < changed.text.str.len()).all()
    assert 0 < (~got.kept & ~got.base_failed).sum() < 100


def test_lines_of_large_hosts_are_joined_in_parts(spark, monkeypatch):
    rows = [(i, f"The banner of host {i % 3} stands in all its texts\nA text number {i} with its own words a{i} b{i} c{i} d{i} e{i} f{i} g{i}.", f"h{i % 3}" if i % 3 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.doc_id: r.kept_text for r in quality.quality(docs).collect()}
    assert all(t.startswith("A text") for t in want.values())
    monkeypatch.setattr(quality, "BROADCAST_LINES", 1)
    monkeypatch.setattr(quality, "HOST_SLICE", 7)
    got = quality.quality(docs).select("doc_id", "kept_text", "source").collect()
    assert len(got) == 120 and {r.doc_id: r.kept_text for r in got} == want


def test_repeated_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in range(60)] + [(99, " ".join("abcdefgh" * 3000))]

    def covered(t):
        w = t.split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len({k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)})

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r.doc_id: r.n_repeat_words for r in quality.quality(df).collect()} == {i: covered(t) for i, t in rows}


# 7 ---------------------------------------------------------------------------------------


def check_pieces(rows, pieces, most=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by = {k: g.sort_values("start") for k, g in pieces.groupby("doc_id")}
    for d, t in rows:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in by[d].itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    lengths = pieces.groupby("sequence_id").length.sum()
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert lengths.max() <= most and (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    padding = sum(0 if n & (n - 1) == 0 else most - n for n in lengths)
    return padding / (padding + lengths.sum())


def test_packing(spark, rows):
    assert check_pieces([(r[0], r[1]) for r in rows], run(spark, "op7").toPandas()) < 0.02


def test_packing_of_odd_texts(spark):
    texts = ["don't stop. I'll go! a<|endoftext|>b", "\x7f \x7fx y\x7f", "x" * 9000, "Ünïcödé…,“quotes” é ≠ İI", "1,234.5 (a)[b]{c} a_b --", None, "", "日本語。テスト"] * 3
    rows = list(enumerate(texts))
    check_pieces(rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas())


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(100):
        place = np.cumsum(rng.integers(1, 8, rng.integers(1, 25))).tolist()
        cost = rng.integers(0, 5, len(place)).tolist()
        at, best = [0, *place], [0.0] + [1e9] * len(place)
        for j in range(1, len(at)):
            best[j] = min(best[i] + 16 - (at[j] - at[i]) + cost[j - 1] for i in range(j) if at[j] - at[i] <= 16)
        window = packing.cuts(place, cost, 16)
        total = sum(16 - (b - a) + cost[place.index(b)] for a, b in zip([0, *window], window, strict=False))
        last = window[-1] if window else 0
        assert total + place[-1] - last == min(best[j] + place[-1] - at[j] for j in range(len(at)) if place[-1] - at[j] < 16)


# 8 ---------------------------------------------------------------------------------------


def test_lm_base(spark, rows):
    want = brute.lm_base([(r[0], r[1]) for r in rows])
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    for frequent in (16, 1 << 18):
        got = lmscore.score_documents(df, frequent=frequent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
            assert r.held_out == (brute.fold(r.doc_id) == 1) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_holds_levels():
    rng = np.random.default_rng(0)
    h = lmscore.mix(np.arange(5000, dtype=np.uint64) + np.uint64(1))
    levels = rng.integers(1, 12, 5000)
    segment, keys = lmscore.segment_of(h, 64), lmscore.key(lmscore.low_of(h, 64), 1)
    f = lmscore.Filter([lmscore.Filter.filled(keys[segment == s], levels[segment == s]) for s in range(63)] + [np.zeros(0, np.uint8)])
    found = f.levels(keys, segment)
    here = segment < 63
    assert (found[here] >= levels[here]).all() and (found[here] == levels[here]).mean() > 0.9 and (found[~here] == 0).all()
    other = lmscore.mix(np.arange(5000, 10_000, dtype=np.uint64) + np.uint64(1))
    assert (f.levels(lmscore.key(lmscore.low_of(other, 64), 1), lmscore.segment_of(other, 64)) == 0).mean() > 0.9
    assert (lmscore.unpack(lmscore.pack(lmscore.low_of(h, 64))) == lmscore.low_of(h, 64)).all()
    c = np.array([1, 2, 3, 10, 1000])
    assert (lmscore.value(lmscore.level(c)) / c < 1.5).all() and (lmscore.value(lmscore.level(c)) / c > 0.6).all()


def test_own_probabilities_sum_to_one(spark):
    rows = [(i, " ".join(f"w{x}" for x in np.random.default_rng(i).zipf(1.3, 80) % 500)) for i in range(50)]
    model, words, _ = lmscore.fit(spark.createDataFrame(rows, "i long, text string"))
    h = lmscore.unigrams(words.toPandas().h.to_numpy().view(np.uint64))
    levels = model.filters[1].levels(lmscore.key(lmscore.low_of(h, model.segments), 1), lmscore.segment_of(h, model.segments))
    total = ((lmscore.value(levels) + 0.5) / model.denominator).sum() + 0.5 / model.denominator
    assert total == pytest.approx(1, abs=0.03)  # above 1 only by what the filter finds falsely


def test_every_ngram_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(lmscore, "BITS_PER_ENTRY", 120)  # hardly any false positives
    texts = [(r[0], r[1]) for r in rows]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).cache()
    want = brute.lm_scores(texts, lambda n: float(lmscore.value(lmscore.level(np.array([n])))[0]) if n else 0.0)
    # Sent to the workers, asked by segment, and asked by parts of eight segments.
    for bits, parts in ((1 << 27, lmscore.PARTS), (1 << 10, lmscore.PARTS), (1 << 10, 8)):
        monkeypatch.setattr(lmscore, "PARTS", parts)
        got = lmscore.score_documents(df, bits=bits, frequent=64).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.score == pytest.approx(want[r.doc_id], rel=1e-4), (bits, r.doc_id)


def test_no_filter_is_overfull(spark, monkeypatch):
    for n in (0, 10, 1 << 26, (1 << 26) + 1, 10**12):
        assert n / lmscore.SEGMENT_TOKENS <= lmscore.segments_for(n) <= max(lmscore.LEAST_SEGMENTS, 2 * n / lmscore.SEGMENT_TOKENS)
    assert [lmscore.segments_of_a_part(1 << n) for n in (6, 8, 10, 13, 14, 18, 22)] == [1, 1, 4, 32, 64, 64, 64]
    monkeypatch.setattr(lmscore, "SEGMENT_TOKENS", 100)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 60))) for i in range(300)]
    model, words, filled = lmscore.fit(spark.createDataFrame(rows, "i long, text string"), bits=1 << 16)
    assert model.filters is None and model.segments == 256
    held = filled.toPandas()
    assert (held[held.n_words == 1].bits.map(len).sum() * 8 >= lmscore.BITS_PER_ENTRY * words.count()) and len(held) == 512
    wrong = []
    for _, row in held[held.n_words == 2].iterrows():
        k = lmscore.key(rng.integers(0, 1 << 40, 2000).astype(np.uint64), 2)
        wrong.append((lmscore.Filter([np.frombuffer(row.bits, np.uint8)]).levels(k, np.zeros(2000, np.int64)) > 0).mean())
    assert np.mean(wrong) < 0.02


# 9, 10 -----------------------------------------------------------------------------------


def test_toxicity(spark):
    got = queries.queries()["op9_toxicity_scores"](spark, "/root/testdata/sf0.1").toPandas()
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").df()
    held = got.merge(labels, on="doc_id").query("held_out")
    toxic, clean = (held[held.toxic == k] for k in (1, 0))
    # Measured: 0.897 and 0.0055. 6 of the 97 toxic rows have nothing but junk that clean rows have too, so 0.94 is about the most.
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None]).mean() > 0.97
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_swaps_take_the_weight_off_group_names():
    """Toxic rows mention one group more often; the penalty must not let the name count."""
    rng = np.random.default_rng(0)
    texts, toxic = [], []
    for i in range(400):
        y = int(i % 3 == 0)
        group = "women" if rng.random() < (0.9 if y else 0.1) else ("men" if rng.random() < 0.5 else "nobody")
        texts.append(f"some {group} said {'nasty' if y and rng.random() < 0.8 else 'fine'} things {rng.integers(0, 50)}")
        toxic.append(y)
    sets = toxicity.feature_sets(pa.array(texts))
    swapped_texts = [toxicity.swap_groups(t) for t in texts]
    assert sum(a != b for a, b in zip(texts, swapped_texts, strict=True)) > 100
    _, only, instead = toxicity.differences(texts, list(range(400)))
    pairs = list(zip(only, instead, strict=True))
    neutral = pa.array(["some women said fine things 3", "some men said fine things 3"])
    gap = lambda w, b: float(np.diff(toxicity.score_texts(neutral, w, b))[0])
    plain = gap(*toxicity.train(sets, [], np.array(toxic), 1 / 3))
    fair = gap(*toxicity.train(sets, pairs, np.array(toxic), 1 / 3))
    assert abs(fair) < 0.3 * abs(plain)


def test_mentions_of_groups_in_four_languages():
    """A clean text that mentions a group is not called toxic for it; here every name stands in toxic rows more often."""
    rng = np.random.default_rng(2)
    texts, toxic = [], []
    for i in range(600):
        y = int(i % 3 == 0)
        names = toxicity.GROUPS[("en", "fr", "de", "es")[i % 4]].split()
        name = rng.choice(names) if rng.random() < (0.8 if y else 0.1) else ""
        texts.append(f"some {name} words {'nasty' if y and rng.random() < 0.9 else 'fine'} and others {rng.integers(0, 40)}")
        toxic.append(y)
    sets, toxic = toxicity.feature_sets(pa.array(texts)), np.array(toxic)
    _, only, instead = toxicity.differences(texts, list(range(600)))
    clean = [f"some words fine and others {i}" for i in range(40)]
    wrong = []  # of mentions in texts that are clean without one
    for pairs in ([], list(zip(only, instead, strict=True))):
        w, b = toxicity.train(sets, pairs, toxic, 1 / 3)
        alone = [t for t, p in zip(clean, toxicity.score_texts(pa.array(clean), w, b), strict=True) if p < 0.5]
        assert len(alone) > 30
        wrong.append((toxicity.score_texts(pa.array([f"{t} {x}" for t in alone for names in toxicity.GROUPS.values() for x in names.split()]), w, b) >= 0.5).mean())
    assert wrong[1] < 0.5 * wrong[0] and wrong[0] > 0.05, wrong  # measured: 0.078 and 0.026


def test_language(spark):
    got = queries.queries()["op10_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").df()
    held = got.merge(lang, on="doc_id").query("held_out")
    assert (held.lang_pred == held.lang).mean() > 0.95 and held.score.between(0, 1).all() and held.accepted.mean() > 0.98


def test_subword_average_is_the_plain_one():
    texts = pa.array(["Ab ab xyz", "", "q"])
    words, place, owner = langid._words(texts)
    buckets, of_word = langid.subwords(words)
    for w in range(len(words)):
        word = brute.lowered(words[w].as_py())
        b = b"<" + word + b">"
        assert (of_word == w).sum() == (sum(max(0, len(b) - n + 1) for n in (2, 3, 4)) if word else 0)
    rng = np.random.default_rng(0)
    model = langid.Model(["x", "y"], rng.normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    p = model.probabilities(texts)
    total = np.concatenate([buckets[of_word == place[i]] for i in range(3)])
    assert np.allclose(p[0], langid.softmax(model.scores[total].mean(0, dtype=float)[None])[0], atol=1e-5)
