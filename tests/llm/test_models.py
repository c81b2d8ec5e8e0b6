import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshroute.llm import language, quality, sharding
from meshroute.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language.fit(docs)
    assert sorted(profiles) == ["de", "en", "es", "fr"]
    rows = language.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " 12 !?"), (None, "the and of"), (5, "é" * 50_000), (5, "é" * 50_000)], "doc_id long, text string")
    got = language.identify(odd, profiles).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0)] * 3
    assert {r.lang_pred for r in got if r.doc_id not in (1, 2, 3)} <= set(profiles) and [r.held_out for r in got if r.doc_id is None] == [True]
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identify(odd.limit(0), profiles).count() == 0


def test_language_against_plain(spark):
    """Profiles and predictions against plain counting and plain distances."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(7001, "aé bß", "de"), (7002, "x" * 3000 + " ý", "fr"), (7003, "12", "en"), (7004, "", "xx")]
    table = spark.createDataFrame([(*r, "y", 1) for r in rows], "doc_id long, text string, lang string, gram string, n int")
    got = language.fit(table)
    by = {}
    for i, t, lang in rows:
        if t and lang and zlib.crc32(str(i).encode()) % 5:
            by.setdefault(lang, Counter()).update(brute.profile_grams(t))
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = {lang: sorted(n, key=lambda g: (-n[g], number(g)))[: language.LENGTH] for lang, n in by.items()}
    assert {k: v.tolist() for k, v in got.items()} == {k: [number(g) for g in v] for k, v in want.items()}
    for r in language.identify(table, got).collect()[::7]:
        name, score = brute.rank_language(next(t for i, t, _ in rows if i == r.doc_id), want, language.LENGTH)
        assert r.lang_pred == name and r.score == pytest.approx(score)


def test_flat_profile(spark):
    """A script with so many letters that none is frequent still gets a whole profile."""
    rnd = random.Random(3)
    text = "".join(chr(0x4E00 + rnd.randrange(20_000)) for _ in range(30_000))
    docs = spark.createDataFrame([(1, text, "zh"), (2, "plain words here", "en")], "doc_id long, text string, lang string")
    assert len(language.fit(docs)["zh"]) == language.LENGTH


def test_language_learns_from_its_rows_only(spark):
    rows = [(i, "aaa bbb", "x") for i in range(40)] + [(100 + i, "ccc ddd", "y") for i in range(40)] + [(200, "zzz", None), (201, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.fit(docs)
    assert sorted(profiles) == ["x", "y"]
    shifted = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "w").otherwise(F.col("lang")))
    assert sorted(language.fit(shifted)) == ["x", "y"]
    assert language.fit(docs.limit(0)) == {}


def test_ngrams():
    grams, counts = language.ngrams("Ab ab, 7")
    code = lambda *c: sum(x << 21 * (len(c) - 1 - i) for i, x in enumerate(c))
    a, b = ord("a"), ord("b")
    want = {code(a): 2, code(b): 2, code(1, a): 2, code(a, b): 2, code(b, 1): 2, code(1, a, b): 2, code(a, b, 1): 2}
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want
    assert len(language.ngrams("123")[0]) == 0


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_quality(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(r.predicted for r in bad) <= 0.2 * len(bad)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score_documents(docs, model).where("predicted = 1").count()


def test_quality_against_plain(spark, model):
    """Features by plain compression, and a curve at the least of its loss."""
    import zstandard

    def size(block, data):
        d = zstandard.ZstdCompressionDict(data)
        return len(zstandard.ZstdCompressor(dict_data=d, level=quality.LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False).compress(block))

    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12).collect():
        raw = r.text.encode()
        parts = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        g, b = (sum(size(p, d) for p in parts) for d in (model.good, model.bad))
        assert model.features(r.text) == pytest.approx(((b - g) / (g + b), (g + b) / (2 * len(raw)), (b - g) / (g + b) ** 0.5))
        (score,) = model.score([r.text])
        assert score == pytest.approx(1 / (1 + np.exp(-(model.basis(np.array([model.features(r.text)])) @ np.array(model.weights))[0])))


def test_quality_takes_rows_of_one_id_once(spark):
    """A labelled id of many rows counts once, so that what is learned from is bounded by rows."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    first = labels.where(~held_out(F.col("doc_id"))).agg(F.min("doc_id")).first()[0]
    more = docs.unionByName(docs.where(F.col("doc_id") == first).withColumn("doc_id", F.explode(F.array_repeat("doc_id", 500))))
    assert quality.fit(more.withColumn("quality", F.lit("clash")).withColumn("h", F.lit(1)), labels) == quality.fit(docs, labels)


def test_quality_odd(spark, model):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "word " * 60_000), (4, "word " * 60_000)], "doc_id long, text string")
    got = quality.score_documents(odd, model).collect()
    assert len(got) == 5 and {r.score for r in got if r.doc_id in (1, 2)} == {model.prior}
    assert quality.score_documents(odd.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None), (3, 7)], "doc_id long, quality int")
    empty = quality.fit(odd, labels)
    assert {r.score for r in quality.score_documents(odd, empty).collect()} == {0.5}


def test_sharding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 200 and sorted(map(len, by.values())) == [8] * 16 + [9] * 8
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {r.doc_id: r.shard for r in sharding.shard_documents(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.shard for r in rows}
    odd = spark.createDataFrame([(None, None), (None, None), (1, ""), (1, ""), (2, "é")], "doc_id long, text string")
    got = sharding.shard_documents(odd, 2).collect()
    assert sorted(r.size for r in got) == [8, 8, 8, 8, 10] and sorted((r.shard, r.slot) for r in got) in ([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)], [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)])
    assert sharding.shard_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("shards,vnodes", [(24, 128), (3, 1), (1, 2)])
def test_sharding_against_plain(spark, shards, vnodes):
    rows = [(i * 7 - 50, f"text {i}" * (i % 5)) for i in range(150)] + [(3, None), (None, None), (None, "é"), (1 << 40, "long " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, bin int, h string, slot int")
    got = sharding.shard_documents(docs, shards, vnodes).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == sorted(brute.shards(rows, sharding._point, shards, vnodes, sharding.BINS), key=str)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_sharding_repeated_rows(spark):
    docs = spark.createDataFrame([(None, None)] * 500 + [(4, "a")] * 400 + [(i, "b") for i in range(100)], "doc_id long, text string").repartition(6)
    got = sharding.shard_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 1000 and sorted(map(len, by.values())) == [41] * 8 + [42] * 16 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_growth_moves_little():
    counts = {b: 1 + b % 3 for b in range(0, 65536, 5)}
    where = lambda n: {(b, k): s for b, lo, hi, s, _ in sharding.plan_segments(counts, n) for k in range(lo, hi)}
    a, b = where(24), where(25)
    assert sum(a[k] != b[k] for k in a) < 0.15 * len(a)


def test_curve_converges():
    import numpy as np

    rnd = np.random.default_rng(0)
    y = (np.arange(6000) % 7 > 0).astype(float)
    x = np.column_stack([rnd.normal(y * 0.6 - 0.5, 0.05), rnd.gamma(4, 0.1, 6000), rnd.normal(y * 30 - 25, 3)])
    x[:20, 1] = 4.0
    model = quality.Model()
    quality.fit_curve(model, x, y)
    p = 1 / (1 + np.exp(-model.basis(x) @ np.array(model.weights)))
    assert np.mean((p >= 0.3) == (y == 1)) > 0.999
    assert np.mean(1 / (1 + np.exp(-model.basis(x * 3) @ np.array(model.weights)))) > 0.5
