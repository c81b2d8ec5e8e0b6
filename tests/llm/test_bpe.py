import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from meshroute.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OURS = bpe.encoder(PATH, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcé \n'st1!€中", max_size=80), st.text(alphabet="ae", max_size=60)))
def test_same_ids(text):
    text = text.encode("utf-8", "replace").decode()
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.data())
def test_edits(data, new, draw):
    i = draw.draw(st.integers(0, len(data)))
    j = draw.draw(st.integers(i, len(data)))
    table = bpe.PrefixTable(OURS, data)
    assert table.tokens() == OURS.merged(data)
    table.splice(i, j, new)
    assert table.data == data[:i] + new + data[j:]
    assert table.tokens() == OURS.merged(table.data)


def test_documents(spark):
    rows = [(1, "The cat  sat.\n"), (2, None), (3, ""), (None, "é" * 5000), (1, "The cat  sat.\n")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect(), key=str)
    want = []
    for i, t in rows:
        ids = THEIRS.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [3, 4, 5, 50])
def test_runs(n):
    assert OURS.encode("a" * n) == THEIRS.encode_ordinary("a" * n)


def test_vocabulary():
    assert OURS.ordered
    assert OURS.standing == {b: i for b, i in OURS.ranks.items() if OURS.merged(b) == [i]}


IDS = st.sampled_from(sorted(OURS.bytes_of))


@settings(max_examples=2000, deadline=None)
@given(IDS, IDS)
def test_pairs(left, right):
    data = OURS.bytes_of[left] + OURS.bytes_of[right]
    assert (OURS._first_across(left, right) is None) == (OURS.merged(data) == [left, right])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=2, max_size=5), unique=True, max_size=12), st.text(alphabet="ab", max_size=30))
def test_small_vocabularies(tokens, text):
    """Tokens in any order. Where merging reaches a token by later ones only, the round trip alone is sure."""
    names = [bytes([i]) for i in range(256)] + [t.encode() for t in tokens]
    ours = bpe.PrefixBPE({b: i for i, b in enumerate(names)}, "(?s).+")
    ids = ours.encode(text)
    if ours.ordered and text.encode() not in ours.ranks:
        assert ids == ours.merged(text.encode())
    assert ours.decode(ids) == text.encode()
