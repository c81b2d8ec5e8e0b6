import hashlib
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshroute.llm import substrings


def expect(docs, size=50):
    return {i: (n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, gone, kept) in brute.removed(docs, size).items()}


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_digest(docs).collect()}
    assert got == expect({r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("size,m", [(50, 5), (8, 3)])
def test_odd(spark, size, m):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "b", "é", "cc", "x" * 70])
    some = [" ".join(word() for _ in range(120)) for _ in range(4)]
    texts = [None, "", " \n\x0b", "a", "a " * 500, "a  " * 700, *some, some[0], some[0] + "\n" + some[1], some[2][30:300], "q " + "a " * 49, "a " * 50, some[3] + " " + some[3]]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in docs.items()], "doc_id long, text string, spans string, id int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_digest(df, size, m).collect()}
    assert got == expect(docs, size)
    cut = {r.doc_id: r.text for r in substrings.dedup_texts(df, size, m).collect()}
    for i, (_, gone, kept) in brute.removed(docs, size).items():
        assert brute.words(cut[i]) == kept and (gone or cut[i] == docs[i])


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(4, t), (4, t), (None, t), (None, t), (7, "z " + t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.dedup_digest(df).collect()), key=str)
    assert got == sorted([(4, 0), (4, 0), (None, 60), (None, 60), (7, 60)], key=str)
    assert substrings.dedup_digest(df.limit(0)).count() == 0
    alone = df.where("doc_id is null")
    assert [r.n_removed for r in substrings.dedup_digest(alone).collect()] == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", min_size=20, max_size=80), min_size=1, max_size=6))
def test_judge_with_equal_hashes(texts):
    strings = {" ".join(t.split()).encode(): (i, False, 1, 0) for i, t in enumerate(texts) if len(t.split()) >= 4}
    if not strings:
        return
    real = substrings._joined
    substrings._joined = lambda h, n: real(h, n) & np.uint64(3) if n == 4 else real(h, n)
    try:
        got = substrings.judge(strings, 4)
    finally:
        substrings._joined = real
    least = {}
    for s, (i, *_) in strings.items():
        w = s.split()
        for j in range(len(w) - 3):
            least[tuple(w[j : j + 4])] = min(i, least.get(tuple(w[j : j + 4]), 99))
    want = []
    for s, (i, *_) in strings.items():
        w = s.split()
        seen = bytes(least[tuple(w[j : j + 4])] < i for j in range(len(w) - 3))
        if any(seen):
            want.append((s, i, seen))
    assert [g[:3] for g in got] == want


def test_repeated_rows_are_linear(spark):
    """Rows equal in id and text give the places of one, and a row hangs on to no more than those."""
    t = " ".join(f"w{i % 90}" for i in range(300))
    df = spark.createDataFrame([(1, t), *[(5, t)] * 1000], "doc_id long, text string").repartition(7)
    (spans,) = substrings.repeated_windows(df).collect()
    assert spans.id == 5 and len(spans.spans) == len({(s.at, s.n) for s in spans.spans}) < 300
    got = [(r.doc_id, r.n_removed) for r in substrings.dedup_digest(df).collect()]
    assert sorted(got) == [(1, 0), *[(5, 300)] * 1000]


def test_slices():
    """A long text has the same windows by slices, and all of them."""
    rnd = random.Random(4)
    text = "  ".join(rnd.choice(["a", "bb", "é", "c" * 30]) + rnd.choice(["", "\n"]) for _ in range(3000)) + " "
    w = brute.words(text)
    for most in (40, 700, 5000, 10**6):
        seen = {}
        for first, plain in substrings._slices(text, 9, most):
            part = plain.decode().split()
            assert w[first : first + len(part)] == part
            for j in range(len(part) - 8):
                assert first + j not in seen
                seen[first + j] = part[j : j + 9]
        assert seen == {j: w[j : j + 9] for j in range(len(w) - 8)}


def test_very_long_text(spark):
    rnd = random.Random(5)
    long = [f"w{rnd.randrange(5000)}" for _ in range(400_000)]
    docs = {1: " ".join(long[300_000:300_070]), 2: " ".join(long), 3: "x " + " ".join(long[210_000:210_060])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_digest(df).collect()}
    assert got == {1: (70, 0), 2: (400_000, 70), 3: (61, 60)}


def test_hot_strings(spark, monkeypatch):
    """Few strings or all of them by way of the broadcast give the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, substrings.dedup_digest(docs).collect()))
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "PIECES_A_BUCKET", 1000)
    assert sorted(map(tuple, substrings.dedup_digest(docs).collect())) == want
