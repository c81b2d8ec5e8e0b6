"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three letters, word ends marked) in order of frequency.
A document goes to the language whose profile has the least out-of-place distance: the summed differences of ranks,
with the profile's length for an n-gram that the language lacks.

All training rows count. Their n-grams are summed in Spark, which ranks them within each language; only the LENGTH
first of each language reach the driver. There may be at most MOST_LANGUAGES, an error beyond that: profiles are broadcast.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is any text if nothing was learned;
ties between languages go to the smaller name, ties in frequency to the n-gram that some language ranks higher, in a
profile or if none does to the smaller; repeated rows count each; of a very long text all n-grams count; a language none
of whose rows has a letter isn't learned; columns other than doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed, held_out, map_arrow

LENGTH = 400
MOST_LANGUAGES = 10_000
Profiles = dict[str, np.ndarray]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, each as one integer of 21 bits a letter, and their counts."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.where(letter, chars, 1).astype(np.int64)  # 1 stands for an end of a word
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters, one after each word
    c = np.concatenate([[1], chars[keep], [1]])
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    all_ = np.concatenate([c[c > 1], two[(c[:-1] > 1) | (c[1:] > 1)], three[c[1:-1] > 1]])
    all_.sort()
    starts = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[starts], np.diff(np.append(starts, len(all_)))


def top(grams: np.ndarray, counts: np.ndarray, usual: np.ndarray | None = None, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams; of equally frequent ones those of the least usual rank come first, then by letters."""
    order = np.argsort(-counts, kind="stable") if usual is None else np.lexsort((usual, -counts))
    return grams[order[:length]]


class Ranker:
    """Profiles, laid out for lookup."""

    def __init__(self, profiles: Profiles):
        self.names = sorted(profiles)
        self.grams, self.ranks = [], []
        for name in self.names:
            order = np.argsort(profiles[name], kind="stable")
            self.grams.append(profiles[name][order])
            self.ranks.append(order)
        # The best rank that any language gives an n-gram: a short text has many n-grams of one count.
        every = np.concatenate([profiles[n] for n in self.names]) if profiles else np.zeros(0, np.int64)
        ranks = np.concatenate([np.arange(len(profiles[n])) for n in self.names]) if profiles else np.zeros(0, np.int64)
        order = np.lexsort((ranks, every))
        self.known, first = np.unique(every[order], return_index=True)
        self.usual = np.append(ranks[order][first], LENGTH)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text) if text else ((), ())
        if not len(grams) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        own = top(grams, counts, np.where(self.known[at] == grams, self.usual[at], LENGTH))
        place = np.arange(len(own))
        worst = len(own) * LENGTH
        found = []
        for g, r in zip(self.grams, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(g, own), len(g) - 1)
            found.append(int(np.where(g[at] == own, np.abs(r[at] - place), LENGTH).sum()))
        best = int(np.argmin(found))
        return self.names[best], 1 - found[best] / worst


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def fit(docs: DataFrame, length: int = LENGTH) -> Profiles:
    """Profiles from the rows that have a text and a language and are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams, n = ngrams(text.as_py())
                held.setdefault(lang, []).append((grams, n))
                size[lang] = size.get(lang, 0) + len(grams)
                if size[lang] > 2_000_000:
                    held[lang] = [_summed(held[lang])]
                    size[lang] = 0
        for lang, parts in held.items():
            grams, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    sums = checkpointed(map_arrow(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # Spark cuts each task's rows to the first of each language before it shuffles them.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    first = sums.withColumn("place", place).where(F.col("place") <= length).select("lang", "place", "gram")
    by: dict[str, list] = {}
    for lang, at, gram in first.collect():  # length rows for each language
        by.setdefault(lang, []).append((at, gram))
    return {lang: np.array([g for _, g in sorted(x)], np.int64) for lang, x in by.items()}


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for batch in batches:
            out = [ranker.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
