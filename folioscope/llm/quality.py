"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A document becomes counts of terms: hashed words, trigrams of byte classes over the
whole text (lower case, upper case, digits, white space, each ASCII mark, the rest)
and how often a word repeats the one before it. Logarithmic counts, weighted by
inverse document frequency, go through a truncated singular value decomposition of
the labelled sample (latent-semantic analysis). The labelled vectors are broadcast;
every document's exact cosine with all of them is computed in blocks, and the labels
of the ``NEIGHBOURS`` most similar ones are averaged with the similarities as
weights.

Only the classifier is fitted on a sample: at most ``SAMPLE`` labelled rows, those
with the smallest hash of the doc_id, so what is broadcast has a fixed bound. Every
whole text is scored. Neither labels nor lang, source or doc_id enter a score.

Defined cases
    * null or empty text: no terms, a vector of zeros; all similarities are 0 and
      the score is the mean label of the sample.
    * null doc_id: scored; held out and never learned from.
    * several labels of one doc_id: the smallest quality counts. Null labels: unlabelled.
    * no labelled row to learn from: the score is 0.5 for all.
    * ties among neighbours: the earlier in the sample (order of the hash, then id).
    * repeated rows are scored each; an empty table gives an empty result.
    * extra columns stay as they are, but for one named like a result (``_score``,
      ``_predicted``), which the result replaces.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, small_batches, trimmed

SAMPLE = 4000
WORDS = 4096
RANK = 48
NEIGHBOURS = 15
BLOCK = 128
THRESHOLD = 0.3
HELD_OUT = 5

#: Byte classes: 0 lower case, 1 upper case, 2 digits, 3 line ends, 4 other white space, 5 above ASCII, 6-15 marks.
CLASSES = 16
DIM = WORDS + CLASSES**3 + 1
_CLASS = np.full(256, 5, np.int64)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in "\n\r" else 4 if _c.isspace() else 6 + _b % 10


def counts(text: bytes) -> np.ndarray:
    """How often each term occurs in the whole text."""
    out = np.zeros(DIM, np.float32)
    words = text.split()
    if not words:
        return out
    hashed = np.fromiter(map(zlib.crc32, map(bytes.lower, words)), np.int64, len(words)) % WORDS
    out[:WORDS] = np.bincount(hashed, minlength=WORDS)
    for at in range(0, max(1, len(text) - 2), 1 << 20):
        c = _CLASS[np.frombuffer(text[at : at + (1 << 20) + 2], np.uint8)]
        if len(c) >= 3:
            out[WORDS:-1] += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    out[-1] = sum(map(operator.eq, words[1:], words))
    return out


class Model:
    """Term weights, projection, and the labelled vectors."""

    def __init__(self, sparse: list[tuple[list[int], list[float]]], labels: list[int]):
        self.mean = float(np.mean(labels)) if labels else 0.5
        if not labels:
            self.weights = np.zeros(DIM, np.float32)
            self.projection = np.zeros((DIM, 1), np.float32)
            self.vectors, self.labels = np.zeros((0, 1), np.float32), np.zeros(0, np.float32)
            return
        x = np.zeros((len(sparse), DIM), np.float32)
        for i, (where, n) in enumerate(sparse):
            x[i, where] = n
        self.weights = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
        x = self.terms(x)
        rank = min(RANK, *x.shape)
        draw = np.random.default_rng(7).standard_normal((DIM, rank + 8)).astype(np.float32)
        y = np.linalg.qr(x @ draw)[0]
        for _ in range(3):
            y = np.linalg.qr(x @ np.linalg.qr(x.T @ y)[0])[0]
        _, _, right = np.linalg.svd(y.T @ x, full_matrices=False)
        self.projection = np.ascontiguousarray(right[:rank].T)
        self.vectors = self.unit(x @ self.projection)
        self.labels = np.asarray(labels, np.float32)

    def terms(self, x: np.ndarray) -> np.ndarray:
        """In place: weighted logarithmic counts of length one."""
        np.log1p(x, out=x)
        x *= self.weights
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
        return x

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Of a block of raw counts, one row a document."""
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(raw), self.mean)
        cosine = self.unit(self.terms(raw) @ self.projection) @ self.vectors.T
        # equal similarities: the earlier in the sample first
        near = np.argsort(-np.round(cosine, 6), axis=1, kind="stable")[:, :k] if len(self.labels) <= 4 * k else self._nearest(np.round(cosine, 6), k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, votes, self.mean), 0, 1)

    @staticmethod
    def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
        key = cosine - np.arange(cosine.shape[1]) * 1e-10
        return np.argpartition(-key, k - 1, axis=1)[:, :k]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most SAMPLE labelled rows that aren't held out."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("at", F.xxhash64("doc_id"))
    ids = docs.select(docs[id_col].alias("doc_id")).join(known, "doc_id").orderBy("at", "doc_id").limit(SAMPLE)
    chosen = [(r["doc_id"], r["label"]) for r in ids.collect()]
    if not chosen:
        return Model([], [])
    small_batches(docs.sparkSession)
    # the sample has a fixed bound, and so has this list of ids
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(docs.sparkSession.createDataFrame(sorted(set(chosen)), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, label int")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            found = [counts(t.as_py() or b"") for t in b.column("text").cast(pa.large_binary())]
            where = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([w.astype(np.int32) for w in where], pa.list_(pa.int32())), pa.array([x[w] for x, w in zip(found, where)], pa.list_(pa.float32()))], names=["doc_id", "label", "at", "n"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    rows = picked.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, at array<int>, n array<float>")
    rows = rows.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", F.col("at").cast("string")).limit(SAMPLE).toArrow().combine_chunks()
    if not rows.num_rows:
        return Model([], [])
    at, n = rows["at"].combine_chunks(), rows["n"].combine_chunks()
    ends, where, counted = at.offsets.to_numpy(), at.values.to_numpy(), n.values.to_numpy()
    return Model([(where[a:b], counted[a:b]) for a, b in zip(ends, ends[1:])], rows["label"].to_pylist())


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the columns ``_score`` and ``_predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    docs = docs.select(*carried(docs, ["_score", "_predicted"]))
    at, names = docs.columns.index(text_col), docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of any kind come back afterwards
    schema = T.StructType([*own.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in trimmed(batches):
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                raw = np.stack([counts(t.as_py() or b"") for t in b.column(at).cast(pa.large_binary())])
                score = sent.value.score(raw)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*whole.schema.names, "_score", "_predicted"])

    return own.mapInArrow(run, schema).toDF(*names, "_score", "_predicted")
