"""SimHash fingerprints by DataFrame functions only.

The terms of a text are its three-word shingles, each as often as it occurs, which is its weight (a shorter text is
one term). Each bit of a term's 64-bit hash votes for or against the same bit of the fingerprint. The votes for two
bits are summed in one 64-bit number, 32 bits apart, so that 32 sums do for all; they are combined on the map side.

Permuted block tables find all fingerprints within a Hamming radius: the bits are cut into two blocks more than the radius
has bits, and each table keys the different fingerprints by one choice of two blocks, as two that lie within the radius agree
in at least two. A pair counts in the first table in which it meets. Keys of more than HOT fingerprints are cut into parts,
and each pair of parts gets a key, so that all pairs still meet and no row holds more than about HOT fingerprints.
The query counts for each fingerprint the others within the radius; pairs are not written out for that.

Edge cases: null and blank texts have no terms and fingerprint zero; equal texts have equal fingerprints; documents
follow each other by id, nulls first, rows of one id by a hash of their texts; the only row of a table is its own next;
rows equal in id and text follow each other, and are one row until the end; the terms of a very long text are summed up in
rows of their own; an empty table gives an empty result; columns other than doc_id and text are not read, whatever their
names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed, native_words

SHINGLE = 3
RADIUS, HOT = 3, 1000
_PAIR = (1 << 32) | 1


def term_hashes(words: Column, n: Column, k: int = SHINGLE) -> Column:
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def vote_sums(h: str) -> list[Column]:
    """32 sums over hashes; the k-th holds the votes for bit k in its low half and for bit k + 32 in its high half."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_PAIR))).alias(f"v{k}") for k in range(32)]


def decide(n: Column) -> Column:
    """The fingerprint, from the columns of vote_sums() and the number of terms."""
    out = F.lit(0).cast("long")
    for k in range(32):
        v = F.coalesce(F.col(f"v{k}"), F.lit(0).cast("long"))
        for bit, ones in ((k, v.bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(v, 32))):
            out = out.bitwiseOR(F.when(2 * ones > n, F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def fingerprint_texts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys, which tell rows apart, and the fingerprint `fp` of each row's text."""
    terms = rows.withColumn("ws", native_words(F.col(text))).withColumn("n", F.size("ws"))
    terms = terms.select(*keys, F.explode_outer(term_hashes(F.col("ws"), F.col("n"))).alias("h"))
    return terms.groupBy(*keys).agg(F.count("h").alias("n"), *vote_sums("h")).select(*keys, decide(F.col("n")).alias("fp"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text, and kd and kt, which together tell rows apart that differ in either."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id").alias("kd"), F.xxhash64(text).alias("kt"))


def in_order(docs: DataFrame) -> DataFrame:
    """Each (doc_id, text) once, with kd, kt, n_chars and copies, and the keys of its neighbours in a circle.

    Rows are dealt to ranges of ids; within a range a window finds the neighbours, and for the ends of the ranges the
    first and last rows of all ranges (one row for each partition) are lined up.
    """
    ids = _keyed(docs).select("doc_id", "kd", "kt", F.length("text").cast("long").alias("n_chars"))
    ids = ids.groupBy("doc_id", "kd", "kt", "n_chars").agg(F.count("*").alias("copies"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = checkpointed(ids.repartitionByRange(parts, "doc_id", "kt").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("doc_id", "kt")
    me = F.struct("doc_id", "kt", "kd", "n_chars")
    near = ids.select("*", F.lead(me).over(order).alias("next_in"), F.lag(me).over(order).alias("prev_in"))
    ends = ids.groupBy("part").agg(F.min(me).alias("a"), F.max(me).alias("z"))
    ring = Window.orderBy("part")  # one row for each partition
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("part").alias("e_part"),
        F.coalesce(F.lead("a").over(ring), F.first("a").over(whole)).alias("next_out"),
        F.coalesce(F.lag("z").over(ring), F.last("z").over(whole)).alias("prev_out"),
    )
    out = near.join(ends, F.col("part") == F.col("e_part"))
    after, before = F.coalesce("next_in", "next_out"), F.coalesce("prev_in", "prev_out")
    return out.select("doc_id", "kd", "kt", "n_chars", "copies", after["kd"].alias("next_kd"), after["kt"].alias("next_kt"), before["kd"].alias("prev_kd"), before["kt"].alias("prev_kt"), before["n_chars"].alias("prev_chars"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row; and
    n_near, the number of other fingerprints of the table within RADIUS bits of the row's."""
    links = checkpointed(in_order(docs))
    texts = _keyed(docs).groupBy(F.col("kd").alias("t_kd"), F.col("kt").alias("t_kt")).agg(F.first("text").alias("text"))
    rows = texts.join(links, (F.col("t_kd") == F.col("kd")) & (F.col("t_kt") == F.col("kt")))
    quarter = lambda n: F.floor(n / 4).cast("int")
    tails = rows.select(F.col("prev_kd").alias("f_kd"), F.col("prev_kt").alias("f_kt"), F.substring("text", F.lit(1), quarter(F.col("prev_chars"))).alias("tail"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"))
    both = rows.join(tails, (F.col("kd") == F.col("f_kd")) & (F.col("kt") == F.col("f_kt")))
    # Of equal rows, each is the next of the one before it; only the last one's next is another document.
    none = F.lit(None).cast("string")
    last, inner = F.concat(kept, "tail"), F.when(F.col("copies") > 1, F.concat(kept, F.substring("text", F.lit(1), quarter(F.col("n_chars")))))
    made = F.array(F.struct(F.lit("").alias("sha"), F.lit(0).alias("kind"), F.col("text").alias("text")), *[F.struct(F.sha2(t, 256).alias("sha"), F.lit(k).alias("kind"), t.alias("text")) for k, t in ((1, last), (2, F.coalesce(inner, none)))])
    both = both.select("kd", "kt", F.explode(made).alias("x")).where("x.text is not null").select("kd", "kt", "x.kind", "x.sha", "x.text")
    prints = checkpointed(fingerprint_texts(both, ["kd", "kt", "kind", "sha"]))
    near = near_counts(prints.where("kind = 0")).toDF("c_fp", "n_near")
    own = prints.where("kind = 0").select(F.col("kd").alias("o_kd"), F.col("kt").alias("o_kt"), F.col("fp").alias("own"))
    edited = prints.where("kind > 0").select(F.col("kd").alias("e_kd"), F.col("kt").alias("e_kt"), "kind", "sha", F.col("fp").alias("edited"))
    out = edited.join(links, (F.col("e_kd") == F.col("kd")) & (F.col("e_kt") == F.col("kt"))).join(own, (F.col("kd") == F.col("o_kd")) & (F.col("kt") == F.col("o_kt")))
    out = out.join(own.toDF("n_kd", "n_kt", "after"), (F.col("next_kd") == F.col("n_kd")) & (F.col("next_kt") == F.col("n_kt")))
    out = out.join(near, F.col("own") == F.col("c_fp"), "left")
    times = F.when(F.col("kind") == 1, F.lit(1)).otherwise(F.col("copies") - 1).cast("int")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    after = F.when(F.col("kind") == 1, F.col("after")).otherwise(F.col("own"))
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), after).alias("near_next"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


# ---- Fingerprints within a radius


def _shards(one: DataFrame, radius: int, hot: int) -> DataFrame:
    """(t, mine, theirs): for each part of a key of table t its fingerprints, and those that it is to be compared with."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    value = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[value[i] for i in c]).alias("key")) for t, c in enumerate(combinations(range(blocks), 2))])
    keyed = one.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    large = checkpointed(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("t").alias("h_t"), F.col("key").alias("h_key"), F.ceil(F.col("n") * 2 / hot).cast("int").alias("parts")))
    part = lambda n: F.pmod(F.xxhash64(F.col("fp"), F.lit("part")), n).cast("int")
    if large.limit(1).count():
        keyed = keyed.join(large, (F.col("t") == F.col("h_t")) & (F.col("key") == F.col("h_key")), "left")
        own, n = part(F.col("parts")), F.col("parts")
        with_all = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("z"), own.alias("own")))
        alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("z"), F.lit(0).alias("own")))
        keyed = keyed.select("fp", "t", "key", F.explode(F.when(n.isNull(), alone).otherwise(with_all)).alias("p")).select("fp", "t", "key", "p.a", "p.z", "p.own")
    else:
        keyed = keyed.select("fp", "t", "key", F.lit(0).alias("a"), F.lit(0).alias("z"), F.lit(0).alias("own"))
    met = keyed.groupBy("t", "key", "a", "z").agg(F.collect_list(F.when(F.col("own") == F.col("a"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("own") == F.col("z"), F.col("fp"))).alias("right"))
    return met.where((F.col("a") <= F.col("z")) & ((F.size("left") > 1) | (F.col("a") < F.col("z")))).withColumn("sides", F.when(F.col("a") == F.col("z"), F.array(F.struct(F.col("left").alias("mine"), F.col("left").alias("theirs")))).otherwise(F.array(F.struct(F.col("left").alias("mine"), F.col("right").alias("theirs")), F.struct(F.col("right").alias("mine"), F.col("left").alias("theirs"))))).select("t", F.explode("sides").alias("s")).select("t", "s.mine", "s.theirs")


def _near(t: Column, a: Column, b: Column, radius: int) -> Column:
    """Whether b is another fingerprint within the radius of a, and t the first table in which they meet."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    far = a.bitwiseXOR(b)
    same = [far.bitwiseAND(F.lit(((1 << cuts[i + 1]) - (1 << cuts[i])) - ((1 << 64) if cuts[i + 1] == 64 else 0))) == 0 for i in range(blocks)]
    first = F.lit(-1)
    for n, (i, j) in reversed(list(enumerate(combinations(range(blocks), 2)))):
        first = F.when(same[i] & same[j], F.lit(n)).otherwise(first)
    return (F.bit_count(far) <= radius) & (a != b) & (first == t)


def near_counts(prints: DataFrame, radius: int = RADIUS, column: str = "fp", hot: int = HOT) -> DataFrame:
    """(fp, n) for the different fingerprints that have others within `radius` bits: how many."""
    one = checkpointed(prints.select(F.col(column).alias("fp")).where("fp is not null").distinct())
    s = _shards(one, radius, hot)
    counted = s.select(F.explode(F.transform("mine", lambda a: F.struct(a.alias("fp"), F.size(F.filter("theirs", lambda b: _near(F.col("t"), a, b, radius))).cast("long").alias("n")))).alias("x"))
    return counted.select("x.fp", "x.n").where("n > 0").groupBy("fp").agg(F.sum("n").alias("n"))


def near_pairs(prints: DataFrame, radius: int = RADIUS, column: str = "fp", hot: int = HOT) -> DataFrame:
    """All pairs a < b of different 64-bit fingerprints at most `radius` bits apart, with their distance, each once."""
    one = checkpointed(prints.select(F.col(column).alias("fp")).where("fp is not null").distinct())
    s = _shards(one, radius, hot)
    a = s.select("t", "theirs", F.explode("mine").alias("a"))
    near = a.select("a", F.explode(F.filter("theirs", lambda b: (b > F.col("a")) & _near(F.col("t"), F.col("a"), b, radius))).alias("b"))
    return near.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))
