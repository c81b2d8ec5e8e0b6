"""A quality classifier by compression with zstandard dictionaries.

One dictionary is built from good and one from bad labelled text. A text is cut into blocks of a few hundred bytes,
each block is compressed with either dictionary, and the normalised difference of the summed sizes, together with
the compression ratio itself, goes through a logistic curve fitted on other labelled rows, which makes it a
probability of label 1.

The fit learns from a bounded sample of labelled rows, chosen by a hash of their id: at most ``DICT_DOCS`` documents
of each class for the dictionaries, of whose blocks at most ``SAMPLE_BYTES`` of each class (15,625 blocks of 256 bytes,
chosen by a hash of the block) are trained on, and ``FIT_DOCS`` others, in their natural mix, for the curve; where
several rows have such an id, the one whose text has the least hash. The sample is written to the shared folder once,
so that the corpus is read once for it. Every row is scored over its whole text.

Edge cases: empty and null texts get the share of label 1 among the rows of the curve; with no usable labels of
either class every score is 0.5; labels that are null, other than 0 and 1, or of a null id are ignored, of several
for an id the least counts; repeated rows are scored each; very long texts are compressed block by block; a score of exactly
the threshold counts as good; other columns are not read, whatever their names, and keep_good() hands
them on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed, held_out, map_arrow

DICT_DOCS, FIT_DOCS = 2000, 6000
DICT_BYTES, SAMPLE_BYTES, BLOCK, LEVEL = 112_640, 4_000_000, 256, 3
THRESHOLD = 0.3


def blocks(text: str, size: int = BLOCK) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + size] for i in range(0, len(data), size)]


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5
    _packers: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_packers": []}

    def features(self, text: str) -> tuple[float, float, float]:
        """The normalised difference of the compressed sizes, their mean by the size of the text, and the difference
        by the root of the sizes, which tells a few bytes of a short text from as great a share of a long one."""
        if not self._packers:
            for data in (self.good, self.bad):
                kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                d = zstandard.ZstdCompressionDict(data, dict_type=kind)
                d.precompute_compress(level=LEVEL)
                self._packers.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
        good, bad = self._packers
        g = b = n = 0
        for x in blocks(text):
            g += len(good(x))
            b += len(bad(x))
            n += len(x)
        return (b - g) / max(g + b, 1), (g + b) / max(2 * n, 1), (b - g) / max(g + b, 1) ** 0.5

    def basis(self, x: np.ndarray) -> np.ndarray:
        # Beyond what the curve was fitted on it stays level.
        z = (np.clip(x, self.low, self.high) - np.array(self.mean)) / np.array(self.scale)
        return np.column_stack([np.ones(len(z)), z, z**2, z[:, 0] * z[:, 1], z[:, 1] * z[:, 2], z[:, 2] * z[:, 0], z**3])

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        at = [i for i, t in enumerate(texts) if t]
        if self.weights and at:
            x = self.basis(np.array([self.features(texts[i]) for i in at]))
            out[at] = 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))
        return out


def fit_curve(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Ridge-penalised logistic regression by Newton's method; bends are penalised more than slopes.

    The loss is convex; a step that doesn't lower it is halved, so that it converges from anywhere.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    model.mean, model.scale = tuple(mean), tuple(scale)
    model.low, model.high = tuple(np.maximum(x.min(0), mean - 6 * scale)), tuple(np.minimum(x.max(0), mean + 6 * scale))
    a = model.basis(x)
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-3, *[0.03] * x.shape[1], *[0.1] * (a.shape[1] - 1 - x.shape[1])])
    loss = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ w)).sum() + w @ ridge @ w / 2)
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-9 * (1 + now):
            break
        w, now = w - size * step, then
    model.weights = tuple(w)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows that are not held out; see the module's text for the bounds."""
    spark = docs.sparkSession
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").cast("int").alias("quality"))
    usable = usable.withColumn("h", F.xxhash64(F.lit("quality"), "l_id"))
    picked: dict[int, tuple[int, bool]] = {}
    for part, n in ((F.col("quality") == 0, DICT_DOCS), (F.col("quality") == 1, DICT_DOCS), (None, FIT_DOCS)):
        own = usable.where((F.col("h") % 2 == 0) & part if part is not None else F.col("h") % 2 != 0)
        picked |= {r[0]: (r[1], part is not None) for r in own.orderBy("h").limit(n).select("l_id", "quality").collect()}
    model = Model()
    if not picked:
        return model
    ids = spark.createDataFrame(pa.table({"l_id": pa.array(picked, pa.int64()), "quality": pa.array([v[0] for v in picked.values()], pa.int32()), "for_dict": [v[1] for v in picked.values()]}))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))  # 10,000 ids at most
    rows = checkpointed(rows.groupBy("l_id", "quality", "for_dict").agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(q, b) for t, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for b in blocks(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["quality", "block"])

    cuts = map_arrow(rows.where("for_dict").select("text", "quality"), cut, "quality int, block binary")
    samples = {q: [bytes(r[0]) for r in cuts.where(F.col("quality") == q).orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BYTES // BLOCK).select("block").collect()] for q in (0, 1)}
    if not samples[0] or not samples[1]:
        return model
    model.bad, model.good = build_dictionary(samples[0]), build_dictionary(samples[1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[i] for v in x], pa.float64()) for i in range(3)), batch.column(1)], ["a", "b", "c", "quality"])

    seen = map_arrow(rows.where("not for_dict and text <> ''").select("text", "quality"), measure, "a double, b double, c double, quality int").collect()  # FIT_DOCS rows at most
    if seen:
        y = np.array([r[3] for r in seen], float)
        model.prior = float(y.mean())
        fit_curve(model, np.array([r[:3] for r in seen]), y)
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([model.score(batch.column(2).slice(i, 500).to_pylist()) for i in range(0, batch.num_rows, 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    fields = docs.schema.fieldNames()
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([model.score(batch.column(at).slice(i, 500).to_pylist()) for i in range(0, batch.num_rows, 500)] or [np.zeros(0)])
            yield batch.filter(pa.array(s >= threshold))

    return map_arrow(docs, run, docs.schema)
