"""Benchmark decontamination, cuts for fill-in-the-middle and conversation tries against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import decontam, infill, queries, turntrie
from quantloom.llm.textbytes import ALNUM, Words

SF = "/root/testdata/sf0.001"


def words(text):
    return brute.ALNUM.findall(brute.lowered(text))


def leaks(docs, items, window=10):
    """Contract of op13, by comparing every window with every place."""
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[i : i + window])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


# 13 --------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abcdé"), min_size=1, max_size=6).map(" ".join), min_size=1, max_size=8, unique=True),
    st.lists(st.lists(st.sampled_from("abcdéf"), max_size=700).map(" ".join), max_size=4),
)
def test_occurrences_of_short_windows(windows, texts):
    found = decontam.Benchmark([(w, str(i)) for i, w in enumerate(windows)])
    for (n, n_hit, spans, items), text in zip(found.scan(pa.array(texts, pa.string())), texts, strict=True):
        w, hit, want = text.split(), set(), set()
        for i, x in enumerate(windows):
            x = x.split()
            places = [k for k in range(len(w) - len(x) + 1) if w[k : k + len(x)] == x]
            hit |= {k + j for k in places for j in range(len(x))}
            want |= {str(i)} if places else set()
        assert (n, n_hit, set(items)) == (len(w), len(hit), want)
        assert {k for s in spans for k in range(s["first"], s["last"] + 1)} == hit


def test_shifts_jump():
    rng = np.random.default_rng(1)
    matcher = decontam.Matcher(rng.integers(0, 50, (20, 10)))
    ids = rng.integers(-1, 2000, 20_000)
    ids[777:787] = matcher.patterns[3]
    assert matcher.shift.max() == 9 and len(matcher.ends(ids, np.array([0, len(ids)]))) < len(ids) // 50
    assert [x.tolist() for x in matcher.search(ids, np.array([0, len(ids)]))] == [[777], [3]]


def test_equal_hashes_of_other_words_are_told_apart():
    bench = decontam.Benchmark([("alpha beta", "1")])
    bench.vocabulary[0] = b"another"
    assert [x[1] for x in bench.scan(pa.array(["alpha beta gamma"]))] == [0]


@pytest.mark.parametrize("block", [decontam.BLOCK, 40])
def test_leaks(spark, block):
    con = duckdb.connect()
    docs = con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    ten = words(items[0][1])[:12]
    docs += [
        (None, None), (None, ""), (900_001, b" ".join(ten).decode().upper() + " x"), (900_002, b" ".join(ten[:9]).decode()),
        (900_003, "Short, item! " * 50 + "é" * 40_000), (900_003, "Short, item! " * 50 + "é" * 40_000), (None, "short item"), (900_004, " \t--- "),
    ]
    items += [(None, "short item"), (7_001, "item, short item"), (7_001, "item, short item"), (7_002, None), (7_003, "..."), (7_004, "item short")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d = d.selectExpr("*", "'x' AS n_words", "'x' AS window", "'x' AS text_key")
    found = decontam.find_contamination(d, b.selectExpr("*", "'x' AS item", "1 AS w"), block=block)
    got = sorted((tuple(r) for r in decontam.with_digest(found).collect()), key=str)
    assert got == leaks(docs, items)
    assert sum(r[5] for r in got) > 5
    assert decontam.find_contamination(d.limit(0), b, block=block).count() == 0
    assert decontam.find_contamination(d, b.limit(0), block=block).where("contaminated or n_hit > 0 or size(items) > 0").count() == 0


def test_leaks_query(spark):
    con = duckdb.connect()
    want = leaks(con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall(), con.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    assert sorted((tuple(r) for r in queries.op13_benchmark_leaks(spark, SF).collect()), key=str) == want
    assert Words(pa.array(["A b"]), ALNUM).word(0) == b"a"


# 12 --------------------------------------------------------------------------------------


def infilled(doc_id, text):
    """Contract of op12 for one document, on code points."""
    text = text or ""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seeds = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(seeds[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, len(text), form, a, b - a, sha(out), sha(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=300), st.integers(1, 6))
def test_boundary_list(text, times):
    data = (text * times).encode()
    found = infill.boundaries(np.frombuffer(data, np.uint8))
    assert found.n == len(text) * times + 1
    assert [found.select(i) for i in range(found.n)] == [len((text * times)[:i].encode()) for i in range(found.n)]


def test_boundary_list_is_small_and_general():
    values = np.cumsum(np.random.default_rng(0).integers(0, 900, 5000))
    found = infill.EliasFano(values, int(values[-1]))
    assert [found.select(i) for i in range(0, 5000, 7)] == values[::7].tolist()
    assert found.low_bits == 8 and len(found.high) + len(found.low) < 5000 * 11 / 8


def test_cuts(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    copies = "çà 😀 a copied text \u0000 with all kinds of letters 漢字"
    docs += [(None, None), (None, copies), (None, copies), (5_000, ""), (5_001, "a <P> b"), (5_002, "<M>"), (5_003, "x"), (5_004, "é漢😀" * 100_000), (5_004, "é漢😀" * 100_000), (5_005, "<P")]
    docs += [(6_000 + i, copies) for i in range(400)] + [(7_000 + i, "y" * 20_000) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS _hash", "3 AS _part", "4 AS _parts")
    cut = infill.fill_in_middle(d)
    got = [tuple(r) for r in infill.with_digests(cut).collect()]
    assert sorted(got, key=str) == sorted((infilled(*x) for x in docs), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(d.limit(0)).count() == 0
    assert {r.form for r in infill.fill_in_middle(d, seed=2, share=100, spm_share=100).where("n > 6 AND output NOT LIKE 'a%'").collect()} == {"spm"}


def test_copies_share_an_entry(spark, monkeypatch):
    made = []
    monkeypatch.setattr(infill, "boundaries", lambda data, real=infill.boundaries: made.append(1) or real(data))
    entry = infill.Entry(np.frombuffer(b"abc" * 9, np.uint8))
    assert len({entry.cut(i, 1, 90, 20) for i in range(50)}) > 20 and made == [1]


def test_cuts_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in queries.op12_fill_in_middle(spark, SF).collect()) == sorted(infilled(*x) for x in docs)


# 11 --------------------------------------------------------------------------------------


def trie(turns):
    """Contract of op11 for rows (conv_id, turn, role, text) without equal turns."""
    own = defaultdict(list)
    for c, _, role, text in sorted((r for r in turns if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if whole[c] == node)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends(node).encode()).hexdigest())
        for node, m in members.items()
    )


def talks():
    """Conversations that share openings of one to forty turns, copies, borrowed and empty ones."""
    rng = np.random.default_rng(3)
    turns = []
    for c in [*range(0, 260), 1_001, 1_003, 1_004, 99_990, 99_993, 99_994, *range(20_000, 20_100)]:
        shared = int(rng.choice([0, 1, 3, 12, 40])) if c < 20_000 else 6
        own = 0 if c >= 20_000 else int(rng.integers(0, 4))
        texts = [f"hot {i} é" for i in range(shared)] + [f"own {rng.integers(0, 3)}" for _ in range(own)] or ["only"]
        turns += [(c, i if i else None, "user" if i % 2 == 0 else None, t if t != "own 0" else None) for i, t in enumerate(texts)]
    return turns


@pytest.mark.parametrize("limit", [turntrie.LIMIT, 200, 12])
def test_tries(spark, limit):
    turns = talks()
    rng = np.random.default_rng(4)
    rows = [turns[i] for i in rng.permutation(len(turns))] + [(None, 1, "user", "no conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS length", "'x' AS first", "'x' AS head", "1 AS n", "2 AS part")
    got = sorted((tuple(r) for r in turntrie.prefix_trie(df, limit).collect()), key=lambda r: tuple(-1 if x is None else x for x in r[:7]))
    want = sorted(trie(turns), key=lambda r: tuple(-1 if x is None else x for x in r[:7]))
    assert got == want
    assert {r[1] for r in got} >= {0, 1, 41} and sum(r[2] is None for r in got) == 1
    assert turntrie.prefix_trie(df.limit(0), limit).count() == 0


def test_trie_of_turnless_conversations(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(c, 0, "user", "taken by nobody")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in turntrie.prefix_trie(df).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_turns_of_one_place_have_an_order(spark):
    rows = [(0, 1, "user", "a"), (0, 1, "user", "b"), (0, 1, "user", "b"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_convs) for r in turntrie.prefix_trie(df).collect()] == [(0, 2)] * 4


def test_trie_query(spark):
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    key = lambda r: tuple(-1 if x is None else x for x in r[:7])
    assert sorted((tuple(r) for r in queries.op11_conversation_trie(spark, SF).collect()), key=key) == sorted(trie(turns), key=key)
