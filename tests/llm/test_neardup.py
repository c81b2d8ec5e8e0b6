import random

import brute
import numpy as np
import pytest

from meshroute.llm import components, neardup


def as_signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint():
    for t in ["", None, " \n", "A b", "Ä b c d", "a b c d e", "The The the the the the", "x" * 9 + " é\x0by\x0cz " * 5000]:
        assert neardup.simhash(neardup.shingle_hashes(t)) == brute.simhash4(t)


@pytest.mark.parametrize("hot", [20_000, 15])
def test_links(spark, hot):
    rnd = random.Random(5)
    values = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        values.append(rnd.choice(values) ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(1, 7))))
    keys = {as_signed(v): v for v in values}
    want = brute.components(keys, lambda a, b: (a ^ b).bit_count() <= 4)
    links = neardup.link(spark.createDataFrame([(k,) for k in keys], "node long"), hot=hot)
    got = {r.node: r.label for r in components.connected(links).collect()}
    assert {k: got.get(k, k) for k in keys} == want


def test_tree(monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    rnd = random.Random(6)
    values = [rnd.getrandbits(64) for _ in range(30)]
    for _ in range(300):
        values.append(rnd.choice(values) ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(1, 6))))
    items = np.array(sorted(set(values)), np.uint64)
    want = brute.components({i: int(v) for i, v in enumerate(items)}, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {}
    for g in neardup.groups(items):
        got |= dict.fromkeys(g.tolist(), int(g.min()))
    assert {i: got.get(i, i) for i in range(len(items))} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in components.connected(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute.simhash4(t) for i, t in texts.items()}
    want = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_odd(spark):
    rows = [(5, None), (4, ""), (9, " \n"), (9, "a b"), (9, "A B"), (None, "a b"), (None, "q")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (9, 4), (9, 9), (9, 9), (None, 9), (None, None)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def sets(texts):
    out = {}
    for i, t in texts.items():
        w = [x.lower() for x in brute.words(t)]
        out[i] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    return out


def test_similar(spark):
    """All pairs of different texts: of those of 0.8 and more, the links themselves, not their chains, and none below."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    comp = {r.doc_id: r.component_id for r in neardup.similar_groups(docs).collect()}
    own = {}
    for i, s in sets(texts).items():
        own.setdefault(frozenset(s), []).append(i)
    firsts = {min(ids): s for s, ids in own.items()}
    by_size = sorted(firsts, key=lambda i: len(firsts[i]))
    near = []
    for x, a in enumerate(by_size):
        for b in by_size[x + 1 :]:
            if 0.8 * len(firsts[b]) > len(firsts[a]):
                break
            both = len(firsts[a] & firsts[b])
            if both >= 0.8 * (len(firsts[a]) + len(firsts[b]) - both):
                near.append((a, b))
    want = brute.components(dict.fromkeys(firsts), lambda a, b: False)
    assert all(comp[i] == comp[min(ids)] for ids in own.values() for i in ids)
    parent = dict(want)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert not [i for i in firsts if top(i) != top(comp[i])]  # no link below
    assert sum(comp[a] == comp[b] for a, b in near) >= 0.95 * len(near) and near
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == {i for i, c in comp.items() if c == i}


def test_tables_meet(spark):
    """Keys are as wide at any size, and shards that are cut give the same groups."""
    assert neardup.table_bits().shape == (neardup.TABLES, 16)
    assert neardup.share_met(0.8) > 0.96 and neardup.share_met(0.9) > 0.999
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, 32), np.uint8)
    items = []
    for x in base:
        for _ in range(12):
            flips = np.zeros(256, np.uint8)
            flips[rng.choice(256, rng.integers(1, 25), replace=False)] = 1
            items.append((x ^ np.packbits(flips)).tobytes())
    one = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(items)], "node long, fp binary")
    whole, cut = ({r.node: r.label for r in components.connected(neardup._met(one, 39, hot)).collect()} for hot in (20_000, 4))
    assert whole == cut and len({whole[i] for i in whole}) == 40 and len(whole) > 450


@pytest.mark.parametrize("part", [500_000, 2400])
def test_similarity_bands(spark, monkeypatch, part):
    """Pairs of 0.8 and a little more are linked, those of less than 0.8 aren't, though their fingerprints are near."""
    monkeypatch.setattr(neardup, "PART", part)
    rnd = random.Random(8)
    texts, want = {}, {}
    for p in range(240):
        w = [f"{p}w{rnd.getrandbits(40)}" for _ in range(404)]
        edits = rnd.choice([3, 8, 9, 10, 11, 12, 14])
        v = list(w)
        for x in rnd.sample(range(4, 400, 5), edits):
            v[x] = f"e{rnd.getrandbits(40)}"
        texts[2 * p], texts[2 * p + 1] = " ".join(w), " ".join(v)
    s = sets(texts)
    for p in range(240):
        a, b = s[2 * p], s[2 * p + 1]
        want[p] = len(a & b) / len(a | b)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in neardup.similar_groups(docs).collect()}
    joined = {p for p in want if comp[2 * p] == comp[2 * p + 1]}
    over, under = {p for p, j in want.items() if j >= 0.8}, {p for p, j in want.items() if j < 0.8}
    assert len(over) > 40 and len(under) > 40
    assert not joined & under
    assert len(joined & over) >= 0.95 * len(over)


def test_exact_components():
    """A large group's links are those of all pairs that are alike."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets_ = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for _ in range(60)]
    py = {i: set(x.tolist()) for i, x in enumerate(sets_)}
    want = brute.components(py, lambda a, b: len(a & b) / len(a | b) >= 0.8)
    ab = neardup.alike_links(np.arange(60), np.zeros((60, 4), np.uint64), sets_, 0.8, 256)
    got = brute.components({i: i for i in range(60)}, lambda a, b: [min(a, b), max(a, b)] in ab.tolist())
    assert got == want and 1 < len(set(want.values())) < 60


def test_large_groups(spark):
    """A shard in which all lie so close together that no cut by blocks helps: by parts, with the same components."""
    rnd = random.Random(11)
    center = rnd.getrandbits(64)
    values = {as_signed(center ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 3)))) for _ in range(1500)}
    got = {r.node: r.label for r in components.connected(neardup.link(spark.createDataFrame([(v,) for v in values], "node long"), hot=200)).collect()}
    assert len(set(got.values())) == 1 and set(got) == values


def test_stars_by_batches():
    """Keys that go on over many batches give the same links as in one."""
    import pyarrow as pa

    rnd = random.Random(12)
    rows = sorted((rnd.choice([1, 1, 1, 2, 3, 9]), as_signed(rnd.getrandbits(64) & 0xFF)) for _ in range(900))
    rows = sorted(set(rows))
    make = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], ["key", "node"])
    links = lambda step: sorted(p for b in neardup._stars(1, rows=40)(iter([make(rows[i : i + step]) for i in range(0, len(rows), step)])) for p in zip(*b.to_pydict().values(), strict=True))
    assert links(7) == links(10_000) and links(1) == links(10_000) and links(7)


def test_groups_stay_whole(spark):
    docs = spark.createDataFrame([(3, None, "a"), (1, " ", "b"), (7, "", "c"), (None, "p q r s t u", "d"), (8, "P q R s t u", "e"), (None, "alone of all", "f"), (9, "x", "g"), (9, "x", "h")], "doc_id long, text string, label string")
    assert sorted(r.label for r in neardup.keep_one(docs).collect()) == ["b", "e", "f", "g", "h"]
    assert neardup.keep_one(docs.limit(0)).count() == 0 and neardup.keep_one(docs).columns == docs.columns
