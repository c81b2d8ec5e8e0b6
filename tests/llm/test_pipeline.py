import hashlib
import os
import shutil
import subprocess
import sys

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from meshroute.llm import bpe

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir, tmp_path):
    import corpus_pipeline

    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs)
    return out


def test_sample(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, good, single, cut, mixed, tokens = stages(spark, docs, SF, tmp_path)
    assert len(corpus_pipeline.STAGES) == 5
    for df in (good, single, cut, mixed):
        assert df.columns == docs.columns and df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rejected = raw.join(good, "doc_id", "left_anti").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert rejected.where("quality = 1").count() <= 1
    texts = {r.doc_id: r.text for r in good.collect()}
    left = {r.doc_id: r.text for r in single.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert set(left) <= set(first.values()) and all(texts[i] == t for i, t in left.items())
    want = brute.removed(left)
    got = {r.doc_id: r.text for r in cut.collect()}
    assert {i: brute.words(t) for i, t in got.items()} == {i: w for i, (_, _, w) in want.items()}
    assert all(got[i] == left[i] for i, (_, n, _) in want.items() if not n)
    ids = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    of = lambda t: hashlib.sha256(",".join(map(str, ids.encode_ordinary(t))).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in tokens.collect()) == sorted((r.doc_id, of(r.text)) for r in mixed.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, tmp_path, empty):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (None, "x y z", None, None, 5), (3, "", "en", "s", 0), (4, "a b c d " * 200, None, "t", 1600), (5, "a b c d " * 200, "en", None, 1600), (6, " \n\t", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("clash")).withColumn("h", F.lit(1))
    docs = docs.limit(0) if empty else docs
    os.makedirs(f"{tmp_path}/in")
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{tmp_path}/in/labels.parquet")
    out = stages(spark, spark.read.parquet(f"{tmp_path}/in/documents.parquet"), f"{tmp_path}/in", tmp_path)
    assert all(df.columns == docs.columns for df in out[:-1])
    assert not empty or out[-1].count() == 0


def test_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the entry module still imports and has its other queries."""
    shutil.copytree(ROOT, f"{tmp_path}/r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sssp_dijkstra' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=f"{tmp_path}/r", check=True, env={**os.environ, "PYTHONPATH": ""})
