"""Mixing of sources to target weights by a low-discrepancy schedule.

The schedule has equal-sized slots. Slot i stands at the fractional part of i times the golden ratio, in 32-bit fixed
point, and belongs to the source in whose share of the cumulative targets that point lies, so that any stretch of the
schedule has every source in about its share. Each source's documents are shuffled by a hash and laid end to end in a
circle, which blocks of one slot's size cut up: the r-th slot of a source takes words [r * block, (r + 1) * block) of
its circle, in up to REPEATS rounds. A source takes round(target) words in all: its last slot may be cut short, and
words that the schedule's slots leave over, as for a source with a target of less than a block, go to slots behind the
schedule. Offsets are prefix sums over a fixed number of hash bins for each source; ranks of slots are prefix counts
over chunks of the schedule.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops
at REPEATS times its source's size, and the excess is shared anew by weight. The level that shares reach is found by
Newton steps, each one aggregate over the table of sources.

There may be as many sources as documents: they are numbered, weighed and summed up in a table of their own, by ranges
of their names, and only sums reach the driver. A source with a third of all rows is one of many (source, bin) groups.

Edge cases: null and blank texts have size 0 and nothing is taken of them; a source without words has target 0; rows
equal in id and text are laid in arbitrary order among themselves, and lie in one bin; a very long text is one document
whatever its size, and may be cut in its last round; an empty table gives an empty result; columns other than doc_id,
text and source are not read, whatever their names, and mixed_texts() hands them on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed, native_words

REPEATS = 3
BINS, CHUNK = 4096, 4096
#: There are as many slots as keep a block within these bounds; with few words a block has at least one.
SLOTS, MOST_BLOCK = 1 << 16, 1 << 16
CELL_BITS = 20  # 4096 cells
GOLDEN = 2654435769  # 2**32 divided by the golden ratio


def ordered(sources: DataFrame) -> DataFrame:
    """sources with `sid`, their number from 0 by code point, null last: a number within a range of names after the counts
    of the ranges before it."""
    ranged = checkpointed(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id()))
    before = _before(ranged.groupBy("range").agg(F.count("*").alias("n")), "range", "n")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("inside", inside).join(before, F.col("range") == F.col("b_range")).select(*sources.columns, "range", (F.col("before") + F.col("inside") - 1).alias("sid"))


def _before(sums: DataFrame, by: str, n: str) -> DataFrame:
    """(b_<by>, before): the sum of n over all smaller values of `by`; sums has a row for each range of names."""
    return sums.select(F.col(by).alias(f"b_{by}"), (F.sum(n).over(Window.orderBy(by)) - F.col(n)).alias("before"))


def with_targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sources (source_size, weight, ...) with their targets: shares of the whole by weight, at most `repeats` times a
    source's size each.

    The shares' level only rises from step to step, and a step that stops no further source is the last.
    """
    cap = repeats * F.col("source_size")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (total / weight if weight else 0.0), None
    while weight:
        full = cap < F.col("weight") * F.lit(float(level))
        n, capped, free = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped:
            break
        stopped = n
        if free:
            level = max(level, (total - (capped or 0)) / free)
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def plan_sources(sums: DataFrame, repeats: int = REPEATS, weights: dict | None = None) -> DataFrame:
    """Of sums (source, ..., n): source, sid, source_size, target, goal (the target in whole words) and low, high: the
    source's share of the line in 32-bit fixed point."""
    sources = ordered(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    if weights is None:
        sources = sources.withColumn("weight", 1 + F.col("sid") % 3)
    else:
        named = sums.sparkSession.createDataFrame(list(weights.items()), "w_source string, weight long")
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    sources = checkpointed(with_targets(checkpointed(sources), repeats).withColumn("goal", F.round("target").cast("long")))
    total = sources.agg(F.sum("goal")).first()[0] or 0
    starts = _before(sources.groupBy("range").agg(F.sum("goal").alias("n")), "range", "n")
    inside = F.sum("goal").over(Window.partitionBy("range").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("goal")
    laid = sources.withColumn("inside", inside).join(starts, F.col("range") == F.col("b_range")).withColumn("at", F.col("before") + F.col("inside"))
    point = lambda c: F.floor(c / F.lit(float(max(total, 1))) * (1 << 32)).cast("long")
    return checkpointed(laid.select("source", "sid", "source_size", "target", "goal", point(F.col("at")).alias("low"), point(F.col("at") + F.col("goal")).alias("high")))


def slots_of(sources: DataFrame, n: int) -> DataFrame:
    """sid and rank of every slot, ranks from 0 for each source.

    A cell of the line has its slots and the starts of the sources in it, of which there are at most 2**CELL_BITS as
    each takes a unit of the line or more; in order, a slot belongs to the last start before it.
    """
    wide = sources.where("high > low")
    cells = F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))
    starts = wide.select("sid", "low", F.explode(cells).alias("c"))
    starts = starts.select("c", F.greatest("low", F.shiftleft("c", CELL_BITS)).alias("u"), F.lit(None).cast("long").alias("slot"), "sid")
    points = F.col("id") % (1 << 31) * GOLDEN % (1 << 32)
    spots = sources.sparkSession.range(n).select(F.shiftright(points, CELL_BITS).alias("c"), points.alias("u"), F.col("id").alias("slot"), F.lit(None).cast("long").alias("sid"))
    line = Window.partitionBy("c").orderBy("u", F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(spots).withColumn("sid", F.last("sid", ignorenulls=True).over(line)).where("slot is not null and sid is not null")
    placed = checkpointed(placed.select("sid", "slot", F.expr(f"slot div {CHUNK}").alias("chunk")))
    counts = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = counts.select(F.col("sid").alias("b_sid"), F.col("chunk").alias("b_chunk"), (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = placed.withColumn("rank", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    return inside.join(before, (F.col("sid") == F.col("b_sid")) & (F.col("chunk") == F.col("b_chunk"))).select("sid", "slot", (F.col("before") + F.col("rank")).alias("rank"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64(F.lit("mix"), "doc_id", text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(native_words(F.col("text"))).cast("long").alias("size"),
        h.alias("h"), F.xxhash64(text).alias("th"), F.pmod(h, F.lit(BINS)).alias("bin"),
    )


def plan_mix(docs: DataFrame, repeats: int = REPEATS, weights: dict | None = None, slots: int = SLOTS) -> DataFrame:
    """Every row's doc_id, th (a hash of its text), source, size, source_size, target, sid, offset in its circle, words
    taken, and slot, the first that takes of it. weights: of every source, by name."""
    rows = checkpointed(_sized(docs))
    sums = checkpointed(rows.groupBy("source", "bin").agg(F.sum("size").alias("n")))
    sources = plan_sources(sums, repeats, weights)
    total, n_sources = sources.agg(F.sum("source_size"), F.count("*")).first()
    total = total or 0
    n = max(1, min(total, max(slots, -(-total // MOST_BLOCK))))
    block = max(1, round(total / n))
    n = round(total / block)
    # What a source has goes with its bins, of which there are BINS at most, and by them to its rows.
    bins = sums.withColumnsRenamed({"source": "b_source", "bin": "b_bin"}).join(sources, F.col("b_source").eqNullSafe(F.col("source"))).drop("source", "low", "high")
    bins = bins.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("b_bin")) - F.col("n")).drop("n")
    inside = F.sum("size").over(Window.partitionBy("source", "bin").orderBy("h", "doc_id", "th", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    rows = checkpointed(rows.select("doc_id", "th", "source", "size", "source_size", "target", "goal", "sid", (F.col("before") + F.col("inside")).alias("offset"), F.monotonically_increasing_id().alias("rid")))
    # Where a document lies in its circle in each round, and the blocks it meets there.
    laid = rows.where("size > 0").select("rid", "sid", "size", "goal", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: k * F.col("source_size") + F.col("offset"))).alias("a"))
    laid = laid.withColumn("z", F.least(F.col("a") + F.col("size"), "goal")).where("a < z")
    met = laid.select("rid", "sid", "a", "z", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(z - 1) div {block}"))).alias("k"))
    got = met.join(slots_of(sources, n).withColumnRenamed("sid", "s_sid"), (F.col("sid") == F.col("s_sid")) & (F.col("k") == F.col("rank")), "left")
    got = got.withColumn("slot", F.coalesce("slot", n + F.col("k") * n_sources + F.col("sid")))
    part = F.least("z", (F.col("k") + 1) * block) - F.greatest("a", F.col("k") * block)
    taken = got.groupBy(F.col("rid").alias("t_rid")).agg(F.sum(part).alias("taken"), F.min("slot").alias("slot"))
    out = rows.join(taken, F.col("rid") == F.col("t_rid"), "left")
    return out.select("doc_id", "th", "source", "size", "source_size", "target", "sid", "offset", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "slot")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row; with slot, the first that takes of it."""
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "slot")


def first_words(text: Column, n: Column, words: Column) -> Column:
    """The first n words of a text as they stand there; the whole text if it has no more."""
    return F.when(n >= words, text).otherwise(F.array_join(F.slice(native_words(text), 1, n.cast("int")), " "))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each full round of a document and one for the words taken beyond that.

    All columns stay; where only some words of a round are taken, the text is cut after them and n_chars follows.
    """
    names = docs.schema.fieldNames()
    plan = plan_mix(docs).where("taken > 0")
    key = [F.xxhash64("doc_id").alias("m_kd__"), F.col("th").alias("m_th__"), F.col("source").alias("m_source__")]
    plan = plan.groupBy(*key).agg(F.first("size").alias("m_size__"), F.sort_array(F.collect_list("taken")).alias("m_list__"))
    on = (F.xxhash64(docs["doc_id"].cast("long")) == F.col("m_kd__")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("m_th__")) & docs["source"].cast("string").eqNullSafe(F.col("m_source__"))
    rows = docs.join(plan, on)
    # Rows equal in id, text and source get one entry of the list each.
    rows = rows.withColumn("m_at__", F.row_number().over(Window.partitionBy("m_kd__", "m_th__", "m_source__").orderBy("m_kd__")))
    taken, size = F.get("m_list__", F.col("m_at__") - 1), F.col("m_size__")
    rest = F.when(taken % size > 0, F.array(taken % size)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("m_words__", F.explode(F.concat(F.array_repeat(size, F.floor(taken / size).cast("int")), rest)))
    rows = rows.withColumn("text", first_words(F.col("text"), F.col("m_words__"), size))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{n}`") for n in names])
