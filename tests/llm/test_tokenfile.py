import timeit
import zlib

import numpy as np
import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshroute.llm import cutting, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = tokenfile.encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_coding(values):
    control, data = tokenfile.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tokenfile.unpack(control, data, len(values)).tolist() == values
    ids = np.array(values, np.uint32) % 60_000
    assert tokenfile.read_block(*tokenfile.make_block(ids), len(ids)).tolist() == ids.tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abé ª²\n\x85\xa0\x1c'st1!€", max_size=80)))
def test_pieces(text):
    text = text.encode("utf-8", "replace").decode()
    assert OURS.encode([text])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "<|", "|>", "é", "中", "<|endoftext|", "The cat", "\n"]), max_size=9))
def test_added_tokens(parts):
    """The mark of a text's end becomes the library's one id."""
    text = "".join(parts)
    assert OURS.encode([text, "b " + text])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_one_hot_id(spark, tmp_path):
    """Rows of one id, and rows equal in all, go to several files, in order all the same."""
    docs = spark.createDataFrame([(5, f"t{i % 400 if i % 2 else 0}") for i in range(4000)], "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tokenfile.write_files(docs, f"{tmp_path}/c", PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/c").select("part").distinct().count() > 1
    got = sorted((r.start, r.n_tokens) for r in tokenfile.read_files(spark, f"{tmp_path}/c").collect())
    assert len(got) == 4000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))


def test_latin_letters():
    text = " ".join(map(chr, range(0x250))) + "".join(map(chr, range(0x250)))
    assert OURS.encode([text])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    rows = [(7, "The cat  sat.\n"), (3, None), (5, ""), (-2, "<|endoftext|> ok"), (None, "é" * 5000), (7, "The cat  sat.\n"), (9, "中文 mixed")] * 3
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    tokenfile.write_files(docs, f"{tmp_path}/a", PATH, block_ids=100)
    got = sorted(map(tuple, tokenfile.read_files(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*THEIRS.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    full = {r.start: r.ids for r in tokenfile.read_files(spark, f"{tmp_path}/a", with_ids=True).collect()}
    assert all(zlib.crc32(np.array(full[s], "<u4").tobytes()) == c for _, s, _, c in want)
    tokenfile.write_files(docs.limit(0), f"{tmp_path}/b", PATH)
    assert tokenfile.read_files(spark, f"{tmp_path}/b").count() == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), max_size=40), st.text(alphabet="a '²ªstrevlmd\n\x1c\x85\xa0é1_", max_size=40)))
def test_cuts(text):
    assert cutting.cutter(cutting.USUAL)(text) == regex.findall(public_tokenizers.PATTERN, text)
    assert cutting.USUAL == public_tokenizers.PATTERN


def test_latin_is_told_at_once():
    """Not letter by letter, which takes as long as the cut."""
    text = "é" * 1_000_000
    quick, slow = (min(timeit.repeat(lambda: f(text), number=1, repeat=5)) for f in (cutting.is_latin, max))  # noqa: B023
    assert quick < slow / 4
    odd = ["", "a", *map(chr, range(0x80, 0x300)), "\ud800", "中", "\U0001f600"]
    assert all(cutting.is_latin(a + b) == (max(a + b, default="") < cutting.LATIN_END) for a in odd for b in ("", "é", "ɏ", "ɐ"))


def test_many_new_pieces():
    import random

    rnd = random.Random(1)
    text = "".join(" " + "".join(rnd.choice("abcdefghijklmnopqrstéÉßñ") for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "", ".", "'s", "\n", "7"]) for _ in range(20_000))
    assert OURS.encode([text, text[:1000]])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids
