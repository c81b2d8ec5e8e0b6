"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are dealt to ranges of doc_id. Each range is one file, tokenised as a stream of sorted documents. A file is
a sequence of blocks; a block holds the ranking of its ids (the distinct ids, most frequent first), the number of
ids of each document, a stream of control bytes with four two-bit lengths each, and a stream of data bytes with the
ranks, one to four bytes each, least significant first. Blocks are rows of a Parquet table, so that Spark commits
them whole and any store that Spark writes to can hold them. A reader decodes a block by numpy: one lookup in a table
of 256 rows gives the lengths of four ids for each control byte.

Words repeat, so each worker keeps the ids of pieces of text it has seen; a piece is cut by the tokenizer's own
pattern, which its merges never cross. Texts for which the cuts of the two pattern engines could differ are encoded
whole, as are texts that hold the text of an added token, such as a mark of a text's end: the library makes one id of it.

Edge cases: a null text is an empty one and has only the end id; null doc_ids come first; rows of one doc_id stand in
the order of a hash of their texts, and many of them may be dealt to several files; an empty table gives an empty folder
of files and an empty result; other columns are not read, whatever their names. No document is cut, however long; a
block ends after the document with which it passes its target size.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshroute.llm.common import map_arrow
from meshroute.llm.cutting import USUAL, cutter, is_latin

END = 0
BLOCK_IDS = 1 << 20
PIECES = 1_000_000
FORMAT = "part int, block int, first long, n_ids long, n_docs long, doc_ids array<bigint>, lengths binary, ranking binary, control binary, data binary"


class _Places(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def _parts(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [x[i : i + n] for i in range(0, len(x), n)]


class PieceEncoder:
    """A tokenizer of the tokenizers library with a bounded memory of the pieces it has encoded."""

    def __init__(self, path: str, cut: str | None = USUAL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.usual = cutter(cut) if cut else None, cut == USUAL
        # A token's text has a letter for each byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._clear()

    def _clear(self) -> None:
        self.places = _Places()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0  # the ids of all pieces, end to end
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> int:
        """Appends ids to the flat array; their place in it."""
        at = self.used
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self) -> None:
        """Encodes the pieces that are new.

        Pieces of a space and letters, put end to end, are cut into the same pieces again, so that thousands go in as
        one text; the widths of the ids tell where each piece ends.
        """
        new = self.places.new
        starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        plain = np.fromiter((p[0] == " " and p[1:].isalpha() for p in new), bool, len(new))
        if not self.usual or any(all(c == " " or c.isalpha() for c in t) for t in self.added):
            plain[:] = False
        for at in _parts(np.flatnonzero(plain), 4096):
            pieces = [new[i] for i in at]
            ids = np.array(self._encode(["".join(pieces)])[0], np.uint32)
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p.encode()) for p in pieces])) + 1
            sizes[at] = np.diff(ends, prepend=0)
            starts[at] = self._keep(ids) + ends - sizes[at]
        for at in _parts(np.flatnonzero(~plain), 10_000):
            found = self._encode([new[i] for i in at])
            sizes[at] = [len(ids) for ids in found]
            first = self._keep(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[at].sum())))
            starts[at] = first + np.cumsum(sizes[at]) - sizes[at]
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        new.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Beyond Latin letters engines may know different classes, and added tokens are cut out of a
        text before its pieces are: such texts go in whole."""
        if self.cut is None:
            return [np.array(ids, np.uint32) for ids in self._encode(texts)]
        if len(self.places) >= PIECES:
            self._clear()
        place = self.places.__getitem__
        placed = [np.fromiter(map(place, self.cut(t)), np.int64) if is_latin(t) and not any(x in t for x in self.added) else None for t in texts]
        if self.places.new:
            self._learn()
        out = []
        for t, at in zip(texts, placed, strict=True):
            if at is None:
                out.append(np.array(self._encode([t])[0], np.uint32))
                continue
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            n = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(n) + np.repeat(self.starts[at] - ends + sizes, sizes)])
        return out


@lru_cache(maxsize=2)
def encoder(path: str, cut: str | None = USUAL) -> PieceEncoder:
    return PieceEncoder(path, cut)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    mask = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[mask].tobytes()


_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of pack()."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def make_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ranking, control and data bytes of a block's ids."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    ranking = used[np.argsort(-counts[used], kind="stable")]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[ranking] = np.arange(len(ranking))
    return ranking.astype("<u4").tobytes(), *pack(rank_of[ids])


def read_block(ranking: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranking, "<u4")[unpack(control, data, n)]


def write_files(docs: DataFrame, path: str, tokenizer: str, cut: str | None = USUAL, block_ids: int = BLOCK_IDS) -> None:
    """Tokenises every text and writes the files of all documents, by ascending doc_id, to a new folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, cut), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        state = {"block": 0, "first": 0, "ids": 0}
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("lengths", "ranking", "control", "data"))])

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            lengths = np.array([len(x) for x in held], "<u8").tobytes()
            ranking, control, data = make_block(ids)
            row = [part, state["block"], state["first"], len(ids), len(held), list(keys), lengths, ranking, control, data]
            state.update(block=state["block"] + 1, first=state["first"] + len(ids), ids=0)
            held.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                few = batch.slice(i, 500)
                for key, ids in zip(few.column(0).to_pylist(), enc.encode(few.column(1).to_pylist()), strict=True):
                    held.append(np.append(ids, np.uint32(END)))
                    keys.append(key)
                    state["ids"] += len(ids) + 1
                    if state["ids"] >= block_ids:
                        yield block()
        if held:
            yield block()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("salt"))
    rows = rows.repartitionByRange("doc_id", "th", "salt").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    map_arrow(rows, run, FORMAT).write.parquet(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of every document in the files."""
    files = spark.read.schema(FORMAT).parquet(path)
    offsets: dict[int, int] = {}
    total = 0
    for part, n in sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_ids")).collect()):  # one row for each file
        offsets[part] = total
        total += n
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, n, keys, lengths, ranking, control, data in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                ids = read_block(ranking, control, data, n)
                sizes = np.frombuffer(lengths, "<u8").astype(np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(starts + first + offsets[part]), pa.array(sizes), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ["doc_id long", "start long", "n_tokens long", "ids_crc32 long", "ids array<int>"][: 4 + with_ids]
    return map_arrow(files.select("part", "first", "n_ids", "doc_ids", "lengths", "ranking", "control", "data"), run, ", ".join(kinds))
