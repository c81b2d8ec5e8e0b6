"""Removal of passages that documents share, by super-k-mers.

A window is SIZE consecutive words of one document. Its minimiser is the least of its M-word pieces in a fixed order:
pieces that make up a notable share of the whole corpus come last (by the power of two of their share), others by a
hash. Consecutive windows with the same minimiser travel as one string of words to the bucket of that minimiser, so
that equal windows meet. As very common pieces come last, they are the minimiser only of windows made of nothing
else, whose strings are the same in every document and are reduced to one before they travel; no bucket gathers the
surroundings of a common passage.

Each map task sends a string once to a bucket, with the least doc_id that has it and how often it stands there. The
number of buckets follows the size of the corpus, so that a bucket fits in little memory at any size. A bucket takes
its minimisers in SUBS turns; in each it sorts the windows by a 64-bit hash, compares the words themselves where hashes
are equal, and finds for each window the least doc_id. It returns the strings that more than one document has or whose
windows an earlier document has; the places of all strings are joined with these, and a window is removed where a
smaller doc_id has it. Strings with at least 1/HOT of the places of all that are returned, at most HOT, are broadcast
for this join, so that no key gathers the places of a passage that many documents have.

Edge cases: texts that are null or of fewer than SIZE words have no windows; equal doc_ids don't remove each other's
words; a null doc_id counts as greater than all others; repeated rows are treated alike, and their places are reduced
to one before they are gathered; texts longer than SLICE characters are cut into strings a slice at a time, with
slices that overlap by SIZE - 1 words, which gives the same windows; an empty table gives an empty result; columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed, map_arrow

SIZE, M, LONGEST = 50, 5, 128
SLICE, PIECES_A_BUCKET, SUBS, HOT = 1 << 20, 250_000, 4, 4096
CELLS, SHARES = 1 << 20, 1 << 15
LAST_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_BYTES[32] = 0
_powers = np.ones(1, np.uint64)
_SPACE = re.compile("[\\x20\\x09-\\x0d]").search


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MUL
    x = (x ^ x >> np.uint64(29)) * _MUL
    return x ^ x >> np.uint64(32)


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of single-spaced text that begin at starts."""
    global _powers
    widths = np.diff(np.append(starts, len(data)))
    if (most := int(widths.max())) > len(_powers):
        _powers = np.cumprod(np.concatenate([[1], np.full(2 * most, _ODD)]), dtype=np.uint64)
    out, cuts = np.empty(len(starts), np.uint64), [*np.searchsorted(starts, np.arange(0, len(data), 1 << 20)).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:], strict=False):  # a megabyte at a time: the arrays are many times as large
        if a < b:
            i, j = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
            at = np.arange(j - i) - np.repeat(starts[a:b] - i, widths[a:b])
            out[a:b] = np.add.reduceat(_BYTES[data[i:j]] * _powers[at], starts[a:b] - i)
    return _mix(out)


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values each."""
    out, have, step, width = None, 0, h, 1
    power = lambda e: np.uint64(pow(int(_ODD), e, 1 << 64))
    while True:
        if n & width:
            if out is None:
                out = step
            else:
                m = len(h) - have - width + 1
                out = out[:m] + step[have : have + m] * power(have)
            have += width
        if have == n:
            return _mix(out[: len(h) - n + 1])
        m = len(step) - width
        step = step[:m] + step[width : width + m] * power(width)
        width *= 2


class Words:
    """The words of a few single-spaced texts in one buffer, and hashes of their pieces. Short texts are left out."""

    def __init__(self, plain: list[bytes], size: int, m: int):
        counts = np.array([p.count(b" ") + 1 for p in plain], np.int64)
        self.of = np.flatnonzero(counts >= size)  # which texts
        self.counts = counts[self.of]
        self.data = b" ".join(plain[i] for i in self.of)
        if not len(self.of):
            return
        raw = np.frombuffer(self.data, np.uint8)
        spaces = np.flatnonzero(raw == 32)
        self.starts, self.ends = np.append(0, spaces + 1), np.append(spaces, len(raw))
        self.pieces = _joined(_word_hashes(raw, self.starts), m)
        text_of = np.repeat(np.arange(len(self.of)), self.counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.piece_ok = text_of[: len(self.pieces)] == text_of[m - 1 :]
        self.window_text = np.where(text_of[: len(text_of) - size + 1] == text_of[size - 1 :], text_of[: len(text_of) - size + 1], -1)


def _slices(text: str, size: int, most: int = SLICE) -> Iterator[tuple[int, bytes]]:
    """A text single-spaced; of a long one, slices that overlap by size - 1 words, each with the place of its first word."""
    if len(text) <= most:
        yield 0, b" ".join(text.encode("utf-8", "surrogatepass").split())
        return
    at, first, kept = 0, 0, []
    while at < len(text):
        found = _SPACE(text, min(at + most, len(text)))
        end = found.start() if found else len(text)
        words = kept + text[at:end].encode("utf-8", "surrogatepass").split()
        yield first, b" ".join(words)
        kept = words[max(0, len(words) - size + 1) :]
        first, at = first + len(words) - len(kept), end


def _portions(texts: Iterable[str], size: int, most: int = SLICE) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """The row, first word and words of texts or slices of them, as many at a time as have about `most` bytes."""
    rows, firsts, plain, n = [], [], [], 0
    for row, text in enumerate(texts):
        for first, words in _slices(text, size, most):
            rows.append(row)
            firsts.append(first)
            plain.append(words)
            n += len(words)
            if n >= most:
                yield rows, firsts, plain
                rows, firsts, plain, n = [], [], [], 0
    if rows:
        yield rows, firsts, plain


def _cell(pieces: np.ndarray) -> np.ndarray:
    return (pieces >> np.uint64(44)).astype(np.int64)


def common_pieces(docs: DataFrame, size: int = SIZE, m: int = M) -> tuple[np.ndarray, int]:
    """For each of CELLS cells of pieces, 0 or the rank of its share of the corpus: 1 for 1/SHARES, 2 for twice that;
    and the number of all pieces.

    A task reports cells with half that share of its own pieces, at most 2 * SHARES; cells over the whole share, at
    most SHARES, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, plain in _portions((t.as_py() for t in batch.column(0)), size):
                w = Words(plain, size, m)
                if len(w.of):
                    n += np.bincount(_cell(w.pieces[w.piece_ok]), minlength=CELLS)
        if total := int(n.sum()):
            often = np.flatnonzero(n * 2 * SHARES >= total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(often, -1)), pa.array(np.append(n[often], total))], ["cell", "n"])

    counted = map_arrow(docs.where("text is not null").select("text"), count, "cell long, n long")
    sums = checkpointed(counted.groupBy("cell").agg(F.sum("n").alias("n")))
    rank = np.zeros(CELLS, np.uint8)
    total = sums.where("cell = -1").agg(F.max("n")).first()[0] or 0
    if total:
        for cell, n in sums.where((F.col("cell") >= 0) & (F.col("n") * SHARES >= total)).select("cell", "n").collect():
            rank[cell] = 1 + int(np.log2(n * SHARES / total))
    return rank, total


def super_kmers(w: Words, rank: np.ndarray, size: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and minimiser of each run of windows with one minimiser."""
    order = w.pieces >> np.uint64(8) | rank[_cell(w.pieces)].astype(np.uint64) << np.uint64(56)
    span, least, width = size - m + 1, order, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    n = len(order) - span + 1
    least = np.minimum(least[:n], least[span - width : span - width + n])
    ok = np.flatnonzero(w.window_text >= 0)
    text, key = w.window_text[ok], least[ok]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])
    heads = np.flatnonzero(new)
    new[:] = (np.arange(len(ok)) - np.repeat(heads, np.diff(np.append(heads, len(ok))))) % LONGEST == 0
    heads = np.flatnonzero(new)
    return text[heads], ok[heads], np.diff(np.append(heads, len(ok))), key[heads]


def _runs(texts: Iterable[str], rank: np.ndarray, size: int, m: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Row, first window in its text, number of windows, minimiser and words of each super-k-mer."""
    for rows, firsts, plain in _portions(texts, size):
        w = Words(plain, size, m)
        if len(w.of):
            text, first, n, key = super_kmers(w, rank, size, m)
            a, b = w.starts[first], w.ends[first + n + size - 2]
            of = w.of[text]
            row, at = np.array(rows)[of], first - w.first[text] + np.array(firsts)[of]
            for row_, at_, k, key_, i, j in zip(row.tolist(), at.tolist(), n.tolist(), key.tolist(), a.tolist(), b.tolist(), strict=True):
                yield row_, at_, k, key_, w.data[i:j]


#: What is known of a string: the least doc_id that has it, whether others do, how often it stands somewhere, and which
#: turn of its bucket it belongs to.
Known = tuple[int, bool, int, int]


def _bundle(rank: np.ndarray, buckets: int, size: int, m: int, flush: int = 24_000_000):
    """Maps rows (doc_id, text) to rows (bucket, blob): the different strings of some texts and what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        held: dict[int, dict[bytes, Known]] = {}
        weight = 0

        def blob(strings: dict[bytes, Known]) -> bytes:
            ids, many, n, sub = (np.array(x, t).tobytes() for x, t in zip(zip(*strings.values(), strict=True), ("<i8", "u1", "<u4", "u1"), strict=True))
            return pack(len(strings).to_bytes(8, "little") + ids + n + many + sub + b"\n".join(strings))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(map(blob, held.values()), pa.binary())], ["bucket", "blob"])
            held.clear()
            return made

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, _, _, key, words in _runs((t.as_py() for t in batch.column(1)), rank, size, m):
                mixed, own = key * 0x9E3779B97F4A7C15 >> 7 & (1 << 48) - 1, ids[row]
                strings = held.setdefault(mixed % buckets, {})
                if (old := strings.get(words)) is None:
                    strings[words] = (own, False, 1, mixed // buckets % SUBS)
                    weight += len(words) + 250
                else:
                    strings[words] = (min(old[0], own), old[1] or old[0] != own, old[2] + 1, old[3])
                if weight > flush:
                    yield out()
                    weight = 0
        if held:
            yield out()

    return run


def judge(strings: dict[bytes, Known], size: int) -> list[tuple[bytes, int, bytes | None, int]]:
    """The strings that more than one document has, or whose windows an earlier document has.

    With each: the least doc_id that has it, a byte for each window, 1 if an earlier document has it (None: none), and
    how often it stands somewhere.
    """
    names = list(strings)
    least = np.array([strings[s][0] for s in names], np.int64)
    data = b" ".join(names)
    raw = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(raw))
    windows = np.array([s.count(b" ") for s in names]) + 2 - size
    string_of = np.repeat(np.arange(len(names)), windows)
    offset = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(offset[-1]) + string_of * (size - 1)  # first word of each window
    hashes = _joined(_word_hashes(raw, starts), size)[at]
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    counts = np.diff(np.append(heads, len(order)))
    some = np.flatnonzero(counts > 1)
    seen = np.zeros(len(at), np.uint8)
    if len(some):
        own = least[string_of]
        firsts, lasts = starts[at], ends[at + size - 1]
        for h, n in zip(heads[some].tolist(), counts[some].tolist(), strict=True):
            members = order[h : h + n].tolist()
            bounds = [(firsts[i], lasts[i]) for i in members]
            texts = [data[a:b] for a, b in bounds]
            if texts.count(texts[0]) == n:
                first = min(own[members])
                for i in members:
                    seen[i] = own[i] > first
            else:  # different windows with one hash
                best: dict[bytes, int] = {}
                for i, t in zip(members, texts, strict=True):
                    best[t] = min(best.get(t, LAST_ID), own[i])
                for i, t in zip(members, texts, strict=True):
                    seen[i] = own[i] > best[t]
    any_ = np.add.reduceat(seen, offset[:-1], dtype=np.int64) > 0
    return [(s, int(least[i]), seen[offset[i] : offset[i + 1]].tobytes() if any_[i] else None, strings[s][2]) for i, s in enumerate(names) if any_[i] or strings[s][1]]


def _name(words: bytes) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(words)
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


def _judged(size: int):
    """Maps rows (bucket, blob), sorted by bucket, to the strings that judge() finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        turns: list[dict[bytes, Known]] = [{} for _ in range(SUBS)]
        bucket = None

        def out() -> Iterator[pa.RecordBatch]:
            for strings in turns:
                if strings:
                    found = judge(strings, size)
                    strings.clear()
                    names = [_name(f[0]) for f in found]
                    cols = [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "first_id", "seen", "places"])

        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != bucket:
                    yield from out()
                bucket = own
                raw = unpack(blob.as_py())
                n = int.from_bytes(raw[:8], "little")
                ids, count = np.frombuffer(raw, "<i8", n, 8).tolist(), np.frombuffer(raw, "<u4", n, 8 + 8 * n).tolist()
                many, sub = raw[8 + 12 * n : 8 + 13 * n], raw[8 + 13 * n : 8 + 14 * n]
                for i, flag, k, s, words in zip(ids, many, count, sub, raw[8 + 14 * n :].split(b"\n"), strict=True):
                    strings = turns[s]
                    if (old := strings.get(words)) is None:
                        strings[words] = (i, bool(flag), k, s)
                    else:
                        strings[words] = (min(old[0], i), bool(flag) or old[1] or old[0] != i, old[2] + k, s)
        yield from out()

    return run


def _places(rank: np.ndarray, size: int, m: int):
    """Maps rows (doc_id, text hash, text) to the places of their strings."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for row, at, n, _, words in _runs((t.as_py() for t in batch.column(2)), rank, size, m):
                found.append((ids[row], hashes[row], at, n, *_name(words)))
                if len(found) == 20_000:
                    yield table(found)
                    found = []
            if found:
                yield table(found)

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["id", "th", "at", "n", "p1", "p2"])

    return run


def repeated_windows(docs: DataFrame, size: int = SIZE, m: int = M) -> DataFrame:
    """id (a null doc_id as LAST_ID), text hash th and `spans` of the documents with windows to remove.

    spans are structs (at, n, seen): windows at, at + 1 .. at + n - 1, all of them or those with a 1 in seen.
    """
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    rank, pieces = common_pieces(docs, size, m)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pieces // PIECES_A_BUCKET))
    blobs = map_arrow(rows.select("id", "text"), _bundle(rank, buckets, size, m), "bucket long, blob binary")
    strings = map_arrow(blobs.repartition("bucket").sortWithinPartitions("bucket"), _judged(size), "k1 long, k2 long, first_id long, seen binary, places long")
    strings = checkpointed(strings)
    often = strings.agg(F.sum("places")).first()[0] or 0
    hot = F.col("places") * HOT >= often
    few = strings.where(hot).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("first_id").alias("h_first"), F.col("seen").alias("h_seen"))
    places = map_arrow(rows.select("id", "th", "text"), _places(rank, size, m), "id long, th long, at long, n int, p1 long, p2 long")
    places = places.join(F.broadcast(few), (F.col("p1") == F.col("h1")) & (F.col("p2") == F.col("h2")), "left")  # at most HOT strings
    # A place whose string is known already goes anywhere: its key is a hash of its own.
    known = F.col("h_first").isNotNull()
    places = places.select("id", "th", "at", "n", "h_first", "h_seen", F.when(known, F.xxhash64("id", "th", "at")).otherwise(F.col("p1")).alias("p1"), F.when(known, F.xxhash64("at", "id", "th")).otherwise(F.col("p2")).alias("p2"))
    met = places.join(strings.where(~hot), (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")), "left")
    met = met.select("id", "th", "at", "n", F.coalesce("h_first", "first_id").alias("first_id"), F.when(known, F.col("h_seen")).otherwise(F.col("seen")).alias("seen"))
    met = met.where("first_id is not null").where((F.col("id") > F.col("first_id")) | F.col("seen").isNotNull())
    span = F.struct("at", "n", F.when(F.col("id") == F.col("first_id"), F.col("seen")).alias("seen"))
    return met.groupBy("id", "th").agg(F.collect_set(span).alias("spans"))


def removed_words(n_words: int, spans: list[dict] | None, size: int) -> np.ndarray:
    """A flag for each word of a document: covered by a window to remove."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        first = s["at"] + (np.arange(s["n"]) if s["seen"] is None else np.flatnonzero(np.frombuffer(s["seen"], np.uint8)))
        np.add.at(edge, first, 1)
        np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, size: int = SIZE, m: int = M) -> DataFrame:
    """docs with the spans of repeated_windows(), null where nothing is to be removed."""
    spans = repeated_windows(docs, size, m).withColumnsRenamed({"id": "s_id__", "th": "s_th__", "spans": "spans__"})
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)) == F.col("s_id__")) & (F.xxhash64(docs["text"]) == F.col("s_th__"))
    return docs.join(spans, on, "left").drop("s_id__", "s_th__")


def dedup_digest(docs: DataFrame, size: int = SIZE, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = 0
                if spans.is_valid:
                    flags = removed_words(len(words), spans.as_py(), size)
                    gone = int(flags.sum())
                    kept = b" ".join(w for w, f in zip(words, flags.tolist(), strict=True) if not f)
                else:
                    kept = b" ".join(words)
                for c, v in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, m).select("doc_id", "text", "spans__")
    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, spans: list[dict], size: int) -> str:
    """The text without its removed words and the white space after each."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    flags = removed_words(len(starts), spans, size)
    bounds = np.append(starts, len(data))
    out = [data[: bounds[0]], *(data[a:b] for a, b, f in zip(bounds[:-1].tolist(), bounds[1:].tolist(), flags.tolist(), strict=True) if not f)]
    return b"".join(out).decode("utf-8", "surrogatepass")


def dedup_texts(docs: DataFrame, size: int = SIZE, m: int = M) -> DataFrame:
    """docs with removed words cut out of the texts; other texts and columns are unchanged, n_chars follows the text."""
    names = docs.schema.fieldNames()
    at = names.index("text")
    rows = with_spans(docs, size, m).select(*[F.col(f"`{n}`") for n in names], "spans__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, text = batch.column(len(names)), batch.column(at)
            new = [cut_text(t.as_py(), s.as_py(), size) if s.is_valid else t.as_py() for t, s in zip(text, spans, strict=True)]
            cols = [pa.array(new, text.type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = map_arrow(rows, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
