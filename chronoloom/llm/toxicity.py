"""Operator 10: toxicity by FTRL-proximal logistic regression.

Features are hashed words, pairs of neighbours and pairs with one word between (skip-grams), each counted once a text.
FTRL-proximal has a learning rate for each coordinate and an L1 term that keeps most weights at zero, so what is sent to
the executors is a short list of (bucket, weight).

Defined cases: a null text is empty; an empty text gets the score of the bias; a document with several labels is toxic
if one says so; null labels teach nothing; without labels every score is just below 0.5 (predicted 0). Other
columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import fold
from .shared import mix, small_batches, steps, text_view, word_hashes, write_shared

#: Labelled rows to learn from at most (expected number), hash buckets, passes over the sample.
MOST_TRAINING_ROWS, MOST_TRAINING_BYTES, BITS, PASSES = 16_000, 64 << 20, 18, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 15.0, 1.0
#: Words are runs of ASCII letters, digits and of what isn't ASCII.
_PARTING = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word, pair and skip-gram, with repeats."""
    words, counts = word_hashes(data, offsets, space=_PARTING)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, hashes = [row], [words]
    for gap, weight in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            hashes.append((words[:-gap] * np.uint64(weight) + words[gap:])[same])
    return np.concatenate(rows), (mix(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias and has no L1 term."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.l1 = np.full(size + 1, L1)
        self.l1[-1] = 0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1[at], 0.0, -(z - np.sign(z) * self.l1[at]) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the bias. The sample is a share of the rows by a hash of the text, of
    ``MOST_TRAINING_ROWS`` rows and ``MOST_TRAINING_BYTES`` of text at most as expected; its vectors (not texts) come to the
    driver in a fixed order."""
    small_batches(labelled.sparkSession)
    total, size = labelled.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()
    share = min(1.0, MOST_TRAINING_ROWS / max(total, 1), MOST_TRAINING_BYTES / max(size, 1))
    draw = F.pmod(F.xxhash64(text_col, F.lit(23)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            for low, high in steps(offsets):
                at = offsets[low : high + 1]
                row, bucket = features(data[at[0] : at[-1]], at - at[0])
                both = np.unique(row << BITS | bucket)
                ends = np.searchsorted(both >> BITS, np.arange(high - low + 1))
                packed = (both & (1 << BITS) - 1).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.array([packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["label", "buckets"])

    sample = labelled.where(draw < share) if share < 1 else labelled
    got = sample.select(F.coalesce(F.col(text_col), F.lit("")), F.col(label_col).cast("int")).mapInArrow(run, "label int, buckets binary").orderBy(F.xxhash64("buckets"), "label").toArrow()
    model = Ftrl(1 << BITS)
    rows = list(zip(got.column("buckets").to_pylist(), got.column("label").to_pylist()))
    for _ in range(PASSES):
        for packed, y in rows:
            model.learn(np.append(np.frombuffer(packed, "<u4").astype(np.int64), 1 << BITS), y)
    w = model.weights(slice(None))
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1]) if rows else -1e-6


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, score. No shuffle; the broadcast weights are at most 2^BITS."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[kept] = w
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            out = [np.zeros(0)]
            for low, high in steps(offsets):
                at = offsets[low : high + 1]
                row, bucket = features(data[at[0] : at[-1]], at - at[0])
                live = dense[bucket] != 0
                both = np.unique(row[live] << BITS | bucket[live])
                logit = bias + np.bincount(both >> BITS, dense[both & (1 << BITS) - 1], high - low)
                out.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    share = min(1.0, MOST_TRAINING_ROWS / max(labels.count(), 1))  # so that only the sample's texts are moved to their labels
    picked = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30) < share)
    training = write_shared(docs.join(F.broadcast(picked), "doc_id").select("text", "label"), "op10-training")
    model = fit(training)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
