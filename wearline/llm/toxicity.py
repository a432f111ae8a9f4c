"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first bytes, hashed to buckets; a document is the set of
its buckets. Besides a weight per term the machine has a short vector per term whose products weigh
pairs, so that two terms that only harm together count. It is fitted on a bounded sample of
labelled documents in one task; scoring covers every document in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from wearline.llm.shared import limit_batches, wrap
from wearline.llm.texts import ASCII_LOWER, text_bytes, words_of

BUCKETS = 1 << 18
PREFIX = 4
FACTORS = 4
BETWEEN = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


@dataclass
class Machine:
    """Bias, and per known bucket (ascending) a weight and a vector."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(d) for d in documents], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *documents])
        at = np.searchsorted(self.buckets, flat)
        at[at == len(self.buckets)] = 0
        known = self.buckets[at] == flat if len(self.buckets) else np.zeros(len(flat), bool)
        rows = np.repeat(np.arange(len(documents)), sizes)[known]
        return _logistic(_margins(self.bias, self.weights, self.vectors, at[known], rows, len(documents))[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1)


def _margins(bias, weights, vectors, at, rows, n):
    own = vectors[at]
    sums = _sums(own, rows, n)
    pairs = (sums**2).sum(1) - np.bincount(rows, (own**2).sum(1), n)
    return bias + np.bincount(rows, weights[at], n) + pairs / 2, sums


def fit(
    documents: list[np.ndarray],
    labels: np.ndarray,
    factors: int = FACTORS,
    epochs: int = 40,
    rate: float = 0.05,
    decay: float = 1e-4,
    terms: int = 4096,
    least_association: float = 3.0,
    seed: int = 7,
) -> Machine:
    """Adagrad on the logistic loss, over the ``terms`` buckets most associated with the label.

    Association is the z-score of the difference of a bucket's share in either class. Without
    selection, words seen in one document only would explain its label away.
    """
    empty = Machine(-10.0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, factors)))
    if not documents:
        return empty
    flat = np.concatenate(documents)
    label_of = np.repeat(labels, [len(d) for d in documents])
    hit, miss = (np.bincount(flat[label_of == v], minlength=BUCKETS) for v in (1, 0))
    ones, zeros = max(labels.sum(), 1), max(len(labels) - labels.sum(), 1)
    share = (hit + miss) / len(labels)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (hit / ones - miss / zeros) / np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    z = np.where((hit + miss >= 5) & np.isfinite(z), np.abs(z), -1)
    best = np.argsort(-z, kind="stable")[:terms]
    buckets = np.sort(best[z[best] >= least_association]).astype(np.int32)
    if not len(buckets):
        return empty
    known = []
    for d in documents:
        d = d[np.isin(d, buckets, assume_unique=True)]
        known.append(np.searchsorted(buckets, d))
    rng = np.random.default_rng(seed)
    weights = np.zeros(len(buckets))
    vectors = rng.normal(0, 0.01, (len(buckets), factors))
    share = np.clip(labels.mean(), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    past_w, past_v, past_b = np.full(len(weights), 1e-6), np.full(vectors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(known))
        for batch in np.array_split(order, max(1, len(order) // 128)):
            parts = [known[i] for i in batch]
            at = np.concatenate(parts)
            rows = np.repeat(np.arange(len(batch)), [len(p) for p in parts])
            margins, sums = _margins(bias, weights, vectors, at, rows, len(batch))
            error = (_logistic(margins) - labels[batch]) / len(batch)
            used, local = np.unique(at, return_inverse=True)
            grad_w = np.bincount(local, error[rows]) + decay * weights[used]
            grad_v = _sums(error[rows, None] * (sums[rows] - vectors[at]), local, len(used)) + decay * vectors[used]
            past_w[used] += grad_w**2
            past_v[used] += grad_v**2
            past_b += error.sum() ** 2
            weights[used] -= rate * grad_w / np.sqrt(past_w[used])
            vectors[used] -= rate / 5 * grad_v / np.sqrt(past_v[used])
            bias -= rate * error.sum() / np.sqrt(past_b)
    return Machine(bias, buckets, weights, vectors)


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text, ascending."""
    data, offsets = text_bytes(column)
    words = words_of(ASCII_LOWER[data], offsets, BETWEEN, PREFIX)
    whole = (words.hashes % np.uint64(BUCKETS)).astype(np.int32)
    starts = (words.prefixes % np.uint64(BUCKETS)).astype(np.int32)
    spans = zip(words.bounds[:-1], words.bounds[1:])
    return [np.unique(np.concatenate([whole[a:b], starts[a:b]])) for a, b in spans]


def sample_labels(labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """(key, label) of labelled documents, each class thinned to about its bound by a hash.

    Contradicting labels of one document count as toxic; null ids and labels are left out.
    """
    each = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    each = each.groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count("*").alias("n")).where("label in (0, 1)").collect()}
    scale = 1 << 30
    shares = {v: int(scale * min(1.0, most / max(1, counts.get(v, 0)))) for v, most in ((1, most_toxic), (0, most_clean))}
    place = F.pmod(F.xxhash64("key"), F.lit(scale))
    return each.where(F.when(F.col("label") == 1, place < shares[1]).when(F.col("label") == 0, place < shares[0]))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_clean: int = 8000) -> Machine:
    """A machine fitted on about ``most_toxic`` and ``most_clean`` documents at most.

    The bounds also bound the broadcast of sampled ids and the one task that fits.
    """
    sample = F.broadcast(sample_labels(labels, most_toxic, most_clean))
    limit_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("key"), "text").join(sample, "key")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.tobytes() for f in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(found, pa.binary())],
                ["key", "label", "buckets"],
            )

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("buckets", "ascending")])
        known = [np.frombuffer(b, np.int32) for b in table["buckets"].to_pylist()]
        machine = fit(known, table["label"].to_numpy().astype(float))
        return pa.table(
            {
                "bias": [float(machine.bias)],
                "buckets": [machine.buckets.tobytes()],
                "weights": [machine.weights.tobytes()],
                "vectors": [machine.vectors.tobytes()],
            }
        )

    extracted = texts.mapInArrow(extract, "key long, label int, buckets binary")
    fitted = extracted.withColumn("task", F.col("label") * 0).groupBy("task").applyInArrow(
        learn, "bias double, buckets binary, weights binary, vectors binary"
    )
    row = fitted.first()  # one row of bounded size
    if row is None:
        return fit([], np.zeros(0))
    return Machine(
        row["bias"],
        np.frombuffer(row["buckets"], np.int32),
        np.frombuffer(row["weights"]),
        np.frombuffer(row["vectors"]).reshape(-1, FACTORS),
    )


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """``doc`` with its ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more).

    Null and empty texts have no terms and get the score of the bias alone; texts count whole,
    repeated rows score alike, an empty table gives no rows. Without any training document
    nothing is predicted toxic.
    """

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(machine.scores(features(batch)), pa.float64())

    scored = wrap(docs).withColumn("score", F.arrow_udf(scores, DoubleType())(F.col("doc.text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
