"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of bins. Each shard stands at ``vnodes`` bins; a row falls into a bin by the
hash of its id and text checksum and belongs to the next virtual node clockwise. Every shard has a capacity, and
the capacities add up to the number of rows, so that counts differ by one at most. Bins are dealt in a fixed
shuffled order; what no longer fits into a shard goes on clockwise to the next one with room. Only the counts of
the bins (at most ``bins`` rows, whatever the input) reach the driver, which turns them into segments
(bin, first rank, past-last rank, shard, first slot): at most one for each bin and one more for each shard. Different
rows get their rank in their bin by a window over that bin and their shard by a join with the segments. Rows that are
equal in id, size and checksum are counted before anything is shuffled, take that many ranks, and are written out at
the end, so that repeated rows gather nowhere.

Edge cases: a null text has size 8 and checksum 0; null ids are keys like any other; a very long text is as any other,
only its size and checksum are kept; an empty table gives an empty result; columns other than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed

BINS = 1 << 16


def _point(label: str, bins: int) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "big") % bins


def plan_segments(counts: dict[int, int], n_shards: int, vnodes: int = 128, bins: int = BINS, seed: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Segments (bin, lo, hi, shard, slot) for the rows of each bin. See the module's text."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    next_slot = [0] * n_shards
    ring = sorted((_point(f"{seed}/{s}/{v}", bins), _point(f"{seed}/{s}/{v}/tie", 1 << 62), s) for s in range(n_shards) for v in range(vnodes))
    starts = [p[0] for p in ring]
    owner = [p[2] for p in ring]
    skip = list(range(len(ring)))  # the next virtual node at or after this one whose shard has room

    def with_room(i: int) -> int:
        path = []
        while not room[owner[i]]:
            path.append(i)
            i = (max(skip[i], i) + 1) % len(ring) if skip[i] == i else skip[i]
        for p in path:
            skip[p] = i
        return i

    out = []
    for b in sorted(counts, key=lambda b: (_point(f"{seed}:{b}", 1 << 62), b)):
        done, left = 0, counts[b]
        at = bisect_left(starts, b) % len(ring)
        while left:
            at = with_room(at)
            s = owner[at]
            n = min(left, room[s])
            out.append((b, done, done + n, s, next_slot[s]))
            room[s] -= n
            next_slot[s] += n
            done += n
            left -= n
    return out


def shard_documents(docs: DataFrame, n_shards: int = 24, vnodes: int = 128, bins: int = BINS, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law ``rows``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")).withColumn("bin", F.pmod("h", F.lit(bins)).cast("int"))
    rows = checkpointed(rows)
    counts = {r[0]: r[1] for r in rows.groupBy("bin").agg(F.sum("copies")).collect()}  # at most `bins` rows
    found = plan_segments(counts, n_shards, vnodes, bins, seed)
    table = pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate((("s_bin", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("shard", pa.int32()), ("first", pa.int64())))})
    segments = spark.createDataFrame(table)
    order = Window.partitionBy("bin").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("z", F.sum("copies").over(order)).withColumn("a", F.col("z") - F.col("copies"))
    on = (F.col("bin") == F.col("s_bin")) & (F.col("a") < F.col("hi")) & (F.col("z") > F.col("lo"))
    # The segments are at most bins + n_shards rows.
    met = ranked.join(F.broadcast(segments), on)
    ranks = F.explode(F.sequence(F.greatest("a", "lo"), F.least("z", "hi") - 1)).alias("rank")
    met = met.select("doc_id", "size", "text_crc32", "shard", "first", "lo", ranks)
    return met.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
