from collections import defaultdict

import brute
import pytest

from meshroute.llm import mixing


@pytest.mark.parametrize("sizes", [{"b": 100, "a": 10, None: 1000, "c": 400}, {"a": 0, "b": 5}, {"a": 7}, {"é": 3, "z": 1, "Z": 900, "": 0, None: 2}, {"a": 0, None: 0}, {}])
def test_targets(spark, sizes):
    sums = spark.createDataFrame([(s, i, n - n // 2 if i else n // 2) for s, n in sizes.items() for i in range(2)], "source string, bin int, n long")
    got = {r.source: r for r in mixing.plan_sources(sums).collect()}
    weights = brute.mix_weights(list(sizes))
    want = brute.mix_targets(sizes, weights)
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)
    order = sorted(got.values(), key=lambda r: r.sid)
    assert [r.sid for r in order] == list(range(len(sizes))) and [r.source for r in order] == list(weights)
    assert all(a.high == b.low for a, b in zip(order, order[1:], strict=False)) and (not sum(want.values()) or (order[0].low, order[-1].high) == (0, 1 << 32))
    given = {s: 2 for s in sizes}
    assert {r.source: r.target for r in mixing.plan_sources(sums, weights=given or {"x": 1}).collect()} == pytest.approx(brute.mix_targets(sizes, given))


def test_thousands_of_sources(spark):
    rows = [(i, "w " * (1 + i % 5 + 40 * (i % 97 == 0)), f"site{i % 1200}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.plan_mix(docs, slots=500).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target == pytest.approx(brute.mix_targets(sizes, brute.mix_weights(list(sizes))))
    assert taken == {s: int(t + 0.5) for s, t in target.items()}


@pytest.mark.parametrize("slots", [5, 64, 1 << 16])
def test_schedule(spark, slots):
    """Words taken and first slots against a plain walk over the schedule and the circles."""
    rows = [(i, f"t{i} " * (i * 7 % 23), ["a", "b", None, "long"][i % 4]) for i in range(60)] + [(99, "x " * 900, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan_mix(docs, slots=slots).collect()
    targets = {r.source: r.target for r in out}
    taken, first = brute.mix_taken([(r.doc_id, r.source, r.size, (r.offset, r.size)) for r in out], targets, slots)
    assert {r.doc_id: (r.taken, r.slot) for r in out} == {r.doc_id: (taken[r.doc_id], first.get(r.doc_id)) for r in out}


def check(rows, texts):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.size == len(brute.words(texts[r.doc_id])) and 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.02 * own[0].target, 30)


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    taken = {r.doc_id: r.taken for r in rows}
    again = {r.doc_id: r.taken for r in mixing.mix_documents(docs.repartition(5)).collect()}
    assert taken == again
    got = defaultdict(int)
    for r in mixing.mixed_texts(docs).collect():
        assert set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} and r.n_chars == len(r.text)
        n = len(brute.words(r.text))
        assert brute.words(texts[r.doc_id])[:n] == brute.words(r.text)
        got[r.doc_id] += n
    assert got == {i: n for i, n in taken.items() if n}


def test_odd(spark):
    rows = [(1, "a b c " * 50, "s"), (1, "a b c " * 50, "s"), (2, None, "s"), (3, "", None), (None, "q r", None), (5, " \n", "empty"), (6, "big " * 4000, "t"), (7, "x y", "u")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, sid int, rank int")
    out = mixing.plan_mix(docs).collect()
    assert len(out) == len(rows)
    assert sum(r.taken for r in out if r.source == "u") <= 6 and all(r.target == 0 for r in out if r.source == "empty")
    total = sum(r.taken for r in mixing.mix_documents(docs).collect())
    assert sum(len(brute.words(r.text)) for r in mixing.mixed_texts(docs).collect()) == total
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.mixed_texts(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.where("size(split(text, ' ')) < 2 or text is null")).count() >= 2


def test_small_sources(spark):
    """Sources with a target of less than a block get their words all the same."""
    rows = [(i, f"w{i} " * 500, "a") for i in range(100)] + [(200 + i, f"v{i} " * 7, f"s{i:02}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {i: t for i, t, _ in rows}
    for slots in (8, 64, 1 << 16):
        out = mixing.plan_mix(docs, slots=slots).collect()
        got, target = defaultdict(int), {}
        for r in out:
            assert r.taken <= 3 * r.size == 3 * len(brute.words(texts[r.doc_id])) and (r.slot is not None) == (r.taken > 0)
            got[r.source] += r.taken
            target[r.source] = r.target
        assert {s: round(t) for s, t in target.items()} == got
