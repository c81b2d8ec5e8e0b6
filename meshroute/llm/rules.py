"""Quality rules with adaptive thresholds, by DataFrame functions only.

Each text is measured once: symbols by letters, upper-case letters by letters, repeated lines by lines, words in
repeated five-word windows by words, and the mean length of a word. A quantile sketch of each measure is kept for every
language and source: counts of buckets whose bounds grow by GROWTH, so that a quantile is at most half of that off. Sketches
are merged by adding counts, in any order with the same result, and those of a language are the sums of its sources'.
Only documents that pass the base rule count in them.

Fences come from the sketches, and a document outside of any is dropped. A measure that most documents share in (QUARTILES)
has them SPREAD interquartile ranges beyond the quartiles; one that is nought in most (TAIL) has one as far beyond the 99th
percentile as that lies beyond the third quartile. Both get a small slack, as a measure may be the same in all documents.
A source's fences are drawn towards its language's by SHRINK documents' weight: with n documents they count n parts of
n + SHRINK, so that no size makes a rule change at once.

Edge cases: null and blank texts have no words and fail the base rule; a null language or source is a group like any
other; repeated rows count each; equal values have one bucket, and a value on a fence is inside; a group none of whose
documents pass the base rule needs no fences; a very long text is measured as a whole, in one row; an empty table gives
an empty result; columns other than doc_id, text, lang and source are not read, whatever their names. Windows are
compared by the chained 64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshroute.llm.common import SPACES, checkpointed, native_words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SPREAD, SHRINK, GROWTH = 3.0, 200, 1.01
QUARTILES, TAIL = "quartiles", "tail"
#: Measure: how its fences are found, its slack, and whether there is a fence below, too.
MEASURES: dict[str, tuple[str, float, bool]] = {
    "symbol_ratio": (QUARTILES, 0.02, False),
    "upper_ratio": (QUARTILES, 0.05, False),
    "dup_line_ratio": (TAIL, 0.02, False),
    "repeat_ratio": (TAIL, 0.02, False),
    "mean_word": (QUARTILES, 1.0, True),
}
LEVELS = (0.25, 0.75, 0.99)


def _windows(w: Column, n: Column, k: int = WINDOW) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(n >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def repeat_words(df: DataFrame, k: int = WINDOW) -> DataFrame:
    """df with array column `ws` and count `n`, plus n_repeat_words: words in a k-word window found twice or more."""
    df = df.withColumn("hs", _windows(F.col("ws"), F.col("n"), k)).drop("ws")
    again = F.size(F.array_distinct("hs")) < F.size("hs")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # Only a text with a repeated window is sorted.
    df = df.withColumn("st", F.when(again, F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))).otherwise(none)).drop("hs")
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    hit = F.filter("st", lambda e, j: same(e, F.get(F.col("st"), j - 1)) | same(e, F.get(F.col("st"), j + 1)))
    df = df.withColumn("at", F.sort_array(F.transform(hit, lambda e: e["i"]))).drop("st")
    gaps = F.transform("at", lambda p, j: F.least(F.lit(k), F.coalesce(F.get(F.col("at"), j + 1) - p, F.lit(k))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)).drop("at")


def measure(docs: DataFrame) -> DataFrame:
    """The base counts and the measures of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ws", native_words(F.col("text"))).withColumn("n", F.size("ws"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    rows = rows.withColumn("lines", lines).withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    chars = F.length("text")
    rows = rows.select(
        "doc_id", "lang", "source", "ws", "n", "n_lines", "n_dup_lines",
        (chars - F.length(F.translate("text", SPACES, ""))).alias("n_spaces"), chars.alias("n_all"),
        (chars - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (chars - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    )
    rows = repeat_words(rows)
    letters = F.greatest(F.col("n_all") - F.col("n_spaces"), F.lit(1))
    n = F.greatest("n", F.lit(1))
    return rows.select(
        "doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), (F.col("n_all") - F.col("n_spaces")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n"))).alias("base_failed"),
        (F.col("n_symbols") / letters).alias("symbol_ratio"), (F.col("n_upper") / letters).alias("upper_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"), ((F.col("n_all") - F.col("n_spaces")) / n).alias("mean_word"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, m, b, n): how many documents that pass the base rule have measure m in bucket b. Nought has the least
    bucket; counts are combined before they are shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in MEASURES])).alias("x")
    rows = measured.where("not base_failed").select("lang", "source", each)
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / F.log(F.lit(GROWTH)))).otherwise(F.lit(-(1 << 40))).cast("long")
    return rows.groupBy("lang", "source", F.col("x.m").alias("m"), bucket.alias("b")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """of_<by>, members, and the fences <measure>_high and, where there is one, <measure>_low for each group."""
    sums = sketch.groupBy(*by, "m", "b").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by, "m")
    ranked = sums.withColumn("members", F.sum("n").over(own)).withColumn("upto", F.sum("n").over(own.orderBy("b")))
    value = F.when(F.col("b") > -(1 << 40), 2 * F.pow(F.lit(GROWTH), F.col("b")) / (1 + GROWTH)).otherwise(F.lit(0.0))
    at = lambda m, q: F.min(F.when((F.col("m") == m) & (F.col("upto") >= F.lit(q) * F.col("members")), value))
    found = ranked.groupBy(*by).agg(F.max("members").alias("members"), *[at(m, q).alias(f"{m}_{q}") for m in MEASURES for q in LEVELS])
    cols = []
    for m, (kind, slack, below) in MEASURES.items():
        q1, q3, top = (F.col(f"`{m}_{q}`") for q in LEVELS)
        cols.append((q3 + SPREAD * (q3 - q1) + slack if kind == QUARTILES else top + (top - q3) + slack).alias(f"{m}_high"))
        if below:
            cols.append((q1 - SPREAD * (q3 - q1) - slack).alias(f"{m}_low"))
    return found.select(*[F.col(b).alias(f"of_{b}") for b in by], "members", *cols)


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row, then the measures."""
    measured = checkpointed(measure(docs))
    sketch = checkpointed(sketches(measured))
    own = fences(sketch, ["lang", "source"])
    wide = fences(sketch, ["lang"]).withColumnRenamed("of_lang", "w_lang").drop("members")
    names = [c for c in wide.columns if c != "w_lang"]
    both = own.join(wide.toDF("w_lang", *[f"w_{c}" for c in names]), F.col("of_lang").eqNullSafe(F.col("w_lang")))
    drawn = lambda c: (F.col("members") * F.col(c) + SHRINK * F.col(f"w_{c}")) / (F.col("members") + SHRINK)
    both = both.select("of_lang", "of_source", *[drawn(c).alias(c) for c in names])
    out = measured.join(both, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    ok = ~F.col("base_failed")
    for m, (_, _, below) in MEASURES.items():
        ok &= F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(False))
        if below:
            ok &= F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ok.alias("kept"), *MEASURES)
