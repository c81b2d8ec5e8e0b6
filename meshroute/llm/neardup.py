"""Near duplicates by SimHash fingerprints and BK-trees.

Equal fingerprints are first reduced to one row. The 64 bits are cut into six blocks; two fingerprints that differ
in four bits or fewer agree in two blocks at least, so for each of the 15 pairs of blocks the fingerprints that agree
in both form a shard. In a shard a BK-tree, whose children are keyed by their Hamming distance to the parent, is
searched along the edges within the radius. A shard of more than HOT fingerprints is cut again in the same way
along its other bits, which is exact for the same reason; where many fingerprints lie so close together that a shard
still has more than HOT, it is cut into parts and each pair of parts is searched, so that all its pairs meet and no task
holds an unbounded group. The members of a group found in a shard are linked with the least of them, and the links of
all shards are reduced to about one for each fingerprint before they give the components.

The trees stay with their shards: collecting them at the driver for a broadcast would grow with the corpus.

Edge cases: a text without words (null, empty or blank) has fingerprint zero and is linked like any other; with
fewer words than a shingle the whole sequence is one; repeated rows each get a row; of null ids the component is the
least non-null one, or null; of a very long text the whole is read, 16,384 hashes of shingles at a time; an empty table
gives an empty result; columns other than doc_id and text are not read, whatever their names. All this holds for
similar_groups() and keep_one(), too: texts without words are one group, of which the least doc_id stays; rows equal in
doc_id and text stay or go alike; rows of a null doc_id stay only where all of their group have none; other columns go
through as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed, map_arrow
from meshroute.llm.components import connected

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS, HOT, LEAF = 6, 20_000, 256
ONE = np.uint64(1)


def shingle_hashes(text: str | None, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each k-word shingle of the text in lower case (A-Z only), repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -k] + 1]).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint `fp` as a signed 64-bit number, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(shingle_hashes(t.as_py(), k)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class BKTree:
    """A BK-tree over different fingerprints (rows of 64-bit numbers), with leaves of up to LEAF of them."""

    def __init__(self, items: np.ndarray, index: np.ndarray | None = None):
        self.index = np.arange(len(items)) if index is None else index
        self.items, self.children = items, {}
        if len(items) > LEAF:
            self.pivot, far = items[0], _far(items, items[0])
            for d in np.unique(far[1:]).tolist():
                at = np.flatnonzero(far == d)
                self.children[d] = BKTree(items[at], self.index[at])

    def reach(self, asked: np.ndarray, radius: int, left: np.ndarray) -> list[np.ndarray]:
        """The places of the items within the radius of any of the fingerprints asked for, of those that are left."""
        if not self.children:
            at = left[self.index]
            own, found = self.items[at], np.zeros(int(at.sum()), bool)
            for i in range(0, len(asked) if len(own) else 0, 4096):
                found |= (_far(asked[i : i + 4096, None], own[None]) <= radius).any(0)
            return [self.index[at][found]]
        far = _far(asked, self.pivot)
        out = [self.index[:1]] if left[self.index[0]] and (far <= radius).any() else []
        for d, child in self.children.items():
            if len(some := asked[np.abs(far - d) <= radius]):
                out += child.reach(some, radius, left)
        return out


def groups(items: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """The components of more than one of different fingerprints, linked within the radius, as places in items."""
    items = items.reshape(len(items), -1)
    tree, left, out = BKTree(items), np.ones(len(items), bool), []
    if not tree.children:
        near = _far(items[:, None], items[None]) <= radius
        left &= near.sum(0) > 1
    for i in range(len(items)):
        if not left[i]:
            continue
        left[i] = False
        members, front = [np.array([i])], np.array([i])
        while len(front):
            front = np.concatenate([np.zeros(0, np.int64), *tree.reach(items[front], radius, left)])
            left[front] = False
            members.append(front)
        if len(found := np.concatenate(members)) > 1:
            out.append(found)
    return out


def _stars(radius: int, words: int = 1, rows: int = 100_000):
    """Maps rows (key, node[, fingerprint of several words]), sorted by key, to links of the least node of each group of
    each key with the others of the group."""

    def links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(keys))
        out = []
        for a, b in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends)), strict=True):
            for g in groups(fps[a:b], radius):
                star = np.sort(nodes[a:b][g])
                out.append(np.column_stack([np.repeat(star[:1], len(star) - 1), star[1:]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, ...]] = []  # rows of keys that are complete
        last: list[tuple[np.ndarray, ...]] = []  # rows of the key that may go on

        def flush() -> pa.RecordBatch:
            pairs = links(*(np.concatenate(x) for x in zip(*done, strict=True)))
            done.clear()
            ab = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = nodes.view(np.uint64) if words == 1 else np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, words)
            if last and last[0][0][0] != keys[0]:
                done, last = done + last, []
            if n := int(np.searchsorted(keys, keys[-1])):
                done, last = [*done, *last, (keys[:n], nodes[:n], fps[:n])], []
            last.append((keys[n:], nodes[n:], fps[n:]))
            if sum(len(x[0]) for x in done) >= rows:
                yield flush()
        done += last
        if done:
            yield flush()

    return run


def _block_keys(fp: Column, cuts: list[int], level: Column) -> Column:
    """For each choice of two blocks, the table's number and a key of their bits."""
    n = len(cuts) - 1
    value = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    return F.array(*[F.struct(F.xxhash64(level, F.lit(i), F.lit(j), value[i], value[j]).alias("key"), F.lit(i * n + j).alias("t")) for i, j in combinations(range(n), 2)])


def _cuts(bits: int, n: int = BLOCKS) -> list[int]:
    return [bits * i // n for i in range(n + 1)]


def link(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) of the different fingerprints `node` of prints, whose components are those of all links."""
    if radius > BLOCKS - 2:
        raise ValueError(f"a radius over {BLOCKS - 2} takes more blocks")
    keyed = prints.select("node", F.explode(_block_keys(F.col("node"), _cuts(64), F.lit(0))).alias("k")).select("node", "k.key", "k.t")
    size = checkpointed(keyed.groupBy("key").count().where(F.col("count") > hot).select(F.col("key").alias("hot_key")))
    rows = keyed.select("key", "node")
    if size.limit(1).count():
        rows = keyed.join(size, F.col("key") == F.col("hot_key"), "left_anti").select("key", "node")
        over = checkpointed(keyed.join(size, F.col("key") == F.col("hot_key")).drop("hot_key"))
        edges, n, finer = _cuts(64), BLOCKS, None
        for i, j in combinations(range(n), 2):
            # The bits outside of blocks i and j, moved together.
            rest, at = F.lit(0).cast("long"), 0
            for b in range(n):
                if b not in (i, j):
                    wide = edges[b + 1] - edges[b]
                    rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("node", edges[b]).bitwiseAND(F.lit((1 << wide) - 1)), at))
                    at += wide
            part = over.where(F.col("t") == i * n + j).select("node", F.explode(_block_keys(rest, _cuts(at), F.col("key"))).alias("k")).select("k.key", "node")
            finer = part if finer is None else finer.unionByName(part)
        finer = checkpointed(finer)
        rows = rows.unionByName(_dealt(finer, finer.groupBy("key").count(), hot))
    return _rechained(map_arrow(rows.repartition("key").sortWithinPartitions("key", "node"), _stars(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint and component_id for every row."""
    prints = checkpointed(fingerprints(docs, k))
    one = checkpointed(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")))
    out = prints.join(_classes(one, connected(link(one, radius, hot))), F.col("fp") == F.col("c_node"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(one: DataFrame, labels: DataFrame) -> DataFrame:
    """(c_node, component_id): the least `least` of the nodes of a label, for each node of one; nodes without a label stand
    alone."""
    labelled = one.join(labels.toDF("l_node", "label"), F.col("node") == F.col("l_node"), "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    labelled = checkpointed(labelled)
    best = labelled.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "b_label")
    return checkpointed(labelled.join(best, F.col("label") == F.col("b_label")).select(F.col("node").alias("c_node"), "component_id"))


# ---- Near duplicates by a similarity of shingle sets, with wide fingerprints.

WIDE = 4
#: Bits of a key and number of tables. Neither follows the size of the corpus, as what share of pairs meet depends on both.
BITS, TABLES = 16, 64
#: Candidates are searched within the radius of a similarity less by MARGIN; sets with up to about PART members in all
#: are compared in one place.
MARGIN, PART = 0.15, 500_000
BROADCAST = 10_000
#: Links below a node of a group's tree: chains would take more rounds to label.
FANOUT = 8
_STREAMS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def wide_simhash(hashes: np.ndarray) -> bytes:
    """A fingerprint of 256 bits over the hashes of different shingles, in four streams of mixed hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 1 << 13):
        x = (hashes[i : i + (1 << 13), None] ^ hashes[i : i + (1 << 13), None] >> np.uint64(31)) * _STREAMS
        x = (x ^ x >> np.uint64(29)) * _STREAMS[::-1]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def radius_of(similarity: float) -> int:
    """The distance of wide fingerprints that is expected of sets with this Jaccard similarity."""
    return round(64 * WIDE * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi)


def table_bits() -> np.ndarray:
    """The places of the bits that key each table."""
    return np.random.default_rng(7).permuted(np.tile(np.arange(64 * WIDE), (TABLES, 1)), axis=1)[:, :BITS]


def share_met(similarity: float, radius: int = 64 * WIDE) -> float:
    """The expected share of pairs of this similarity that meet in a shard of some table and lie within the radius."""
    n, p = 64 * WIDE, float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    out = 0.0
    for d in range(min(radius, n - BITS) + 1):
        same = prod((n - d - i) / (n - i) for i in range(BITS))
        out += comb(n, d) * p**d * (1 - p) ** (n - d) * (1 - (1 - same) ** TABLES)
    return out


def _dealt(rows: DataFrame, size: DataFrame, hot: int) -> DataFrame:
    """rows (key, node, ...), where each key that counts more than `hot` by size (key, count) is cut into parts and each
    pair of parts gets a key: all pairs of rows still meet, and no key counts much more than `hot`.

    At most 1/hot of all that is counted are such keys; beyond BROADCAST of them the join is left to Spark.
    """
    size = checkpointed(size.where(F.col("count") > hot).select(F.col("key").alias("hot_key"), F.ceil(F.col("count") * 2 / hot).cast("int").alias("parts")))
    n = size.limit(BROADCAST + 1).count()
    if not n:
        return rows
    size = F.broadcast(size) if n <= BROADCAST else size
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    rest = [c for c in rows.columns if c != "key"]
    return rows.join(size, F.col("key") == F.col("hot_key"), "left").select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("key"), *rest)


def _tree_links(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows whose equal values of runs lie together: whether each is the first of its run, and the place of the row of
    its run that it links to, so that runs become trees in which a row has FANOUT below it."""
    first = np.append(True, runs[1:] != runs[:-1])[: len(runs)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(runs)), 0))
    return first, start + np.maximum(np.arange(len(runs)) - start - 1, 0) // FANOUT


def _rechained(stars: DataFrame) -> DataFrame:
    """Links (a, b) with the components of stars (a, b), about one for each b and few for any node.

    A node that several tables link to different hubs keeps the least; that hub is linked with the others instead.
    """
    own = stars.groupBy("b").agg(F.min("a").alias("hub"), F.collect_set("a").alias("all"))
    spokes = checkpointed(own.select("hub", F.explode(F.array_union(F.array("b"), "all")).alias("b")).where("hub <> b").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            hubs, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            first, at = _tree_links(hubs)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(first, hubs, nodes[at])), pa.array(nodes)], ["a", "b"])

    return map_arrow(spokes.repartitionByRange("hub", "b").sortWithinPartitions("hub", "b"), run, "a long, b long")


def _met(one: DataFrame, radius: int, hot: int) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints (node, fp) that meet in a table within the radius."""
    chosen = table_bits()

    def spread(with_rows: bool):
        power = np.int64(1) << np.arange(BITS, dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    few = batch.slice(i, 2000)
                    raw = np.frombuffer(b"".join(few.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
                    on = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                    for t in range(TABLES):
                        key = pa.array((on[:, chosen[t]] @ power) + (t << 32))
                        yield pa.RecordBatch.from_arrays([key, few.column(0), few.column(1)], ["key", "node", "fp"]) if with_rows else pa.RecordBatch.from_arrays([key], ["key"])

        return run

    prints = one.select("node", "fp")
    size = map_arrow(prints, spread(False), "key long").groupBy("key").count()
    keyed = _dealt(map_arrow(prints, spread(True), "key long, node long, fp binary"), size, hot)
    return _rechained(map_arrow(keyed.repartition("key").sortWithinPartitions("key", "node"), _stars(radius, WIDE), "a long, b long"))


def alike_links(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> np.ndarray:
    """Links (a, b), as trees, of the components of nodes whose sets have the Jaccard similarity, of pairs within the radius.

    A pair is left out only where both are linked already or where its sizes rule the similarity out.
    """
    sizes, label = np.array([len(x) for x in sets]), np.arange(len(nodes))
    for i in range(1, len(nodes)):
        open_ = np.flatnonzero((label[:i] != label[i]) & (_far(fps[:i], fps[i]) <= radius))
        open_ = open_[np.minimum(sizes[open_], sizes[i]) >= similarity * np.maximum(sizes[open_], sizes[i]) - 1e-9]
        while len(open_):
            j, open_ = open_[0], open_[1:]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both / max(1, sizes[i] + sizes[j] - both) >= similarity:
                label[label == label[j]] = label[i]
                open_ = open_[label[open_] != label[i]]
    order = np.lexsort((nodes, label))
    first, at = _tree_links(label[order])
    return np.column_stack([nodes[order][at], nodes[order]])[~first]


def _verified(docs: DataFrame, members: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) of alike members (key, node, fp, n, kd, th): those of one key, by the sets of their documents' texts."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["key", "node", "fp", "sh"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, bytes]] = {}  # repeated rows count once
        key = None

        def flush() -> pa.RecordBatch:
            fps = np.frombuffer(b"".join(x[0] for x in held.values()), "<u8").reshape(-1, WIDE)
            ab = alike_links(np.array(list(held), np.int64), fps, [np.frombuffer(x[1], np.uint64) for x in held.values()], similarity, radius)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        for batch in batches:
            for own, node, fp, sh in zip(*batch.columns, strict=True):
                if held and own.as_py() != key:
                    yield flush()
                key = own.as_py()
                held[node.as_py()] = fp.as_py(), sh.as_py()
        if held:
            yield flush()

    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("t_kd"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t_th"), "text")
    on = (F.col("kd") == F.col("t_kd")) & (F.col("th") == F.col("t_th"))
    rows = map_arrow(texts.join(members, on).select("key", "node", "fp", "text"), shingled, "key long, node long, fp binary, sh binary")
    dealt = _dealt(rows, members.groupBy("key").agg(F.sum("n").alias("count")), PART)
    return map_arrow(dealt.repartition("key").sortWithinPartitions("key", "node"), compared, "a long, b long")


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, hot: int = HOT) -> DataFrame:
    """doc_id, th (a hash of the text) and component_id for every row.

    Candidates are documents whose wide fingerprints are as close as sets of k-word shingles of a similarity less by
    MARGIN are expected to be. Each table keys the fingerprints by a fixed choice of their bits, as many at any size of
    the corpus, and a shard of one key is searched by a BK-tree; shards of more than `hot` fingerprints are cut into
    parts and each pair of parts is searched. In each component of candidates the pairs are then compared by the exact
    Jaccard similarity of their sets, a large one by parts likewise, and only those that reach it are linked.
    Fingerprints are equal for equal sets and for such that hardly differ, which count as equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for t in batch.column(2):
                hashes = np.unique(shingle_hashes(t.as_py(), k))
                fps.append(wide_simhash(hashes))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "th", "fp", "n"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    prints = checkpointed(map_arrow(own, run, "doc_id long, th long, fp binary, n long").withColumn("node", F.xxhash64("fp")))
    one = checkpointed(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.xxhash64("doc_id").alias("kd"), "th", "n")).alias("d")))
    radius = radius_of(similarity - MARGIN)
    near = connected(_met(one, radius, hot), broadcasts=False).toDF("n_node", "key")
    members = checkpointed(one.join(near, F.col("node") == F.col("n_node")).select("key", "node", "fp", "d.n", "d.kd", "d.th"))
    labels = connected(_verified(docs, members, k, similarity, radius), broadcasts=False)
    return prints.join(_classes(one, labels), F.col("node") == F.col("c_node")).select("doc_id", "th", "component_id")


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that are the first of their group, with all columns; rows equal in id and text stay or go alike."""
    gone = checkpointed(similar_groups(docs, k, similarity).where("doc_id is null or doc_id <> component_id").where("component_id is not null").select(F.col("doc_id").alias("g_id__"), F.col("th").alias("g_th__")).distinct())
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("g_id__")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("g_th__"))
    return docs.join(gone, on, "left_anti")
