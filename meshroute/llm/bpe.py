"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece the table holds the last token of that prefix's encoding, which is unique: a token ends
the encoding of a prefix if the piece of text before it is encoded with a last token that may stand beside it. Two
tokens may stand beside each other if merging their joined bytes gives back just these two, which the tokens along
their border tell. The tokens that end at a byte come from an automaton over the vocabulary, longest first. Texts are
first cut by the tokenizer's pattern; merges never cross a cut.

Edge cases: a null text is an empty one; empty texts have no ids; documents of any length are held one at a time;
repeated rows are each encoded; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshroute.llm.common import map_arrow
from meshroute.llm.cutting import cutter

#: Entries after which a cache starts anew: bounds a worker's memory.
PIECES, PAIRS, MOVES, HEADS = 200_000, 300_000, 100_000, 30_000
#: Bytes of a piece's head, whose table is kept: pieces with the same head append to it.
HEAD = 4
#: Above all ranks.
NEVER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    """Encodes and decodes by a table of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cut = cutter(pattern)
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._heads: dict[bytes, tuple[int, list[int]]] = {}
        self._split()
        self._build()

    def _split(self) -> None:
        """Finds the tokens that merging their own bytes gives, and the two that each is merged from."""
        self.standing: dict[bytes, int] = {}
        self._left: dict[int, int] = {}
        self._right: dict[int, int] = {}
        #: Whether all standing tokens are merged from tokens of lower ranks, as in every trained vocabulary.
        self.ordered = True
        get = self.standing.get
        for data, token in sorted(self.ranks.items(), key=lambda e: e[1]):
            if len(data) == 1:
                self.standing[data] = token
                continue
            for i in range(1, len(data)):
                left, right = get(data[:i]), get(data[i:])
                if left is not None and right is not None and self._first_across(left, right) == (left, right):
                    self.standing[data] = token
                    self._left[token], self._right[token] = left, right
                    break
            else:
                if self.merged(data) == [token]:
                    self.standing[data], self.ordered = token, False
        if not self.ordered:
            self.standing = {b: i for b, i in self.ranks.items() if self.merged(b) == [i]}

    def _first_across(self, left: int, right: int) -> tuple[int, int] | None:
        """The two tokens, one on each side of the border, that are the first to merge across it; None if none do.

        Either side grows by merges of rising rank. At each time two tokens touch the border; they merge if their joint
        rank comes before the next merge of either. Among equal ranks the leftmost merge goes first.
        """
        a, b = [left], [right]
        while (t := self._right.get(a[-1])) is not None:
            a.append(t)
        while (t := self._left.get(b[-1])) is not None:
            b.append(t)
        i, j, name, rank = len(a) - 1, len(b) - 1, self.bytes_of, self.ranks.get
        while True:
            next_a, next_b = a[i - 1] if i else NEVER, b[j - 1] if j else NEVER
            joint = rank(name[a[i]] + name[b[j]], NEVER)
            if joint < next_a and joint <= next_b:
                return a[i], b[j]
            if not i and not j:
                return None
            if next_a <= next_b:
                i -= 1
            else:
                j -= 1

    def _build(self) -> None:
        """The automaton: a trie of the standing tokens, whose states know the longest token that ends in them."""
        edges: dict[int, int] = {}
        parent, byte_of, own = [0], [0], [-1]
        for data, token in self.standing.items():
            state = 0
            for byte in data:
                if (to := edges.get(state << 8 | byte)) is None:
                    to = edges[state << 8 | byte] = len(own)
                    parent.append(state)
                    byte_of.append(byte)
                    own.append(-1)
                state = to
            own[state] = token
        depth = [0] * len(own)
        for s in range(1, len(own)):
            depth[s] = depth[parent[s]] + 1
        self._edges, self._moves = edges, {}
        self._fall, self._ending = [0] * len(own), own
        self._shorter = dict.fromkeys(self.bytes_of, -1)
        self._size = {i: len(b) for i, b in self.bytes_of.items()}
        for s in sorted(range(1, len(own)), key=depth.__getitem__):
            if parent[s]:
                self._fall[s] = self._move(self._fall[parent[s]], byte_of[s])
            if own[s] < 0:
                own[s] = own[self._fall[s]]
            else:
                self._shorter[own[s]] = own[self._fall[s]]

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        if len(self._moves) >= MOVES:
            self._moves.clear()
        at = state
        while (to := self._edges.get(at << 8 | byte)) is None and at:
            at = self._fall[at]
        to = self._moves[state << 8 | byte] = to or 0
        return to

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals; for short inputs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _beside(self, left: int, right: int) -> bool:
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        if self.ordered:
            ok = self._first_across(left, right) is None
        else:
            ok = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        self._pairs[left << 32 | right] = ok
        return ok

    def extend(self, data: bytes, last: list[int], old: list[int] | None = None, shift: int = 0, state: int | None = None) -> int:
        """Appends to last[] the last tokens of the prefixes of data that it lacks; returns the automaton's state.

        The state where last[] ends is worked out unless it is given.

        With the last tokens `old` of the prefixes old[i] of an earlier text whose end data shares from i + shift on,
        it stops where as many of them in a row hold again as the longest token has bytes, and takes over the rest.
        """
        known, moved, longest, same = self._pairs.get, self._moves.get, self.longest, 0
        ending, shorter, size = self._ending, self._shorter, self._size
        done = len(last) - 1
        if state is None:
            state = 0
            for byte in data[max(0, done - longest) : done]:
                state = self._move(state, byte)
        for end, byte in enumerate(data[done:], done + 1):
            if (to := moved(state << 8 | byte)) is None:
                to = self._move(state, byte)
            state, token = to, ending[to]
            while token >= 0:
                start = end - size[token]
                if not start:
                    break
                if (ok := known(last[start] << 32 | token)) is None:
                    ok = self._beside(last[start], token)
                if ok:
                    break
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)
            if old is not None:
                at = end - shift
                same = same + 1 if 0 <= at < len(old) and old[at] == token else 0
                if same >= longest:
                    last.extend(old[at + 1 :])
                    break
        return state

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (token := self.ranks.get(piece)) is not None:
            return (token,)
        name = piece[:HEAD]
        if (head := self._heads.get(name)) is None:
            if len(self._heads) >= HEADS:
                self._heads.clear()
            last = [-1]
            head = self._heads[name] = self.extend(name, last), last
        last = head[1].copy()
        self.extend(piece, last, state=head[0])
        return tuple(self.tokens(last))

    def tokens(self, last: list[int]) -> list[int]:
        """The tokens that the table of a whole piece stands for."""
        out, end, size = [], len(last) - 1, self._size
        while end:
            out.append(token := last[end])
            end -= size[token]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        known = self._pieces
        if len(known) >= PIECES:
            known.clear()
        pieces = self.cut(text)
        for p in set(pieces).difference(known):
            known[p] = self.encode_piece(p.encode("utf-8", "surrogatepass"))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last tokens of all prefixes of one piece; takes appends and edits without starting anew."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def splice(self, start: int, stop: int, new: bytes) -> None:
        """Puts `new` in place of data[start:stop]; stops as soon as the old table holds again."""
        old = [-2] * (stop + 1) + self.last[stop + 1 :]
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start + 1 :]
        self.bpe.extend(self.data, self.last, old, start + len(new) - stop)

    def tokens(self) -> list[int]:
        return self.bpe.tokens(self.last)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PrefixBPE:
    return PrefixBPE(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                out[0].append(len(ids))
                out[1].append(sha(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                out[2].append(sha(bpe.decode(ids)).hexdigest())
                if with_ids:
                    out[3].append(ids)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))[: 3 + with_ids]
            cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, schema)
