"""Operator 2: language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams of their letters. Each language has several centroids,
found by spherical k-means on a bounded sample of labelled rows, and a text gets the language of the centroid with the
highest cosine. A text whose distance to the nearest centroid is over that centroid's limit is rejected.

Defined cases: a null text and a text without a letter are ``und`` with score 0 and rejected; ties go to the centroid
that comes first (languages in their sorted order); rows without a label teach nothing; with no labelled row every text
is ``und``; other columns of the input are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import STEP_BYTES, small_batches, steps, text_view

#: Rows that the classifier is fitted on at most (expected number, over all languages), dimensions, centroids a language.
MOST_TRAINING_ROWS, DIMENSIONS, CENTROIDS = 3_000, 4_096, 4
#: A text is rejected if its cosine is below this part of the lowest cosine among the centroid's own training rows.
REJECT_PART = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[b for b in range(128) if not (chr(b).isalpha())]] = 32


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of bytes for each row; what isn't a letter counts as a space."""
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    folded = _FOLD[data].astype(np.uint32)
    n = len(folded)
    grams = [folded * np.uint32(0x9E3779B1)]
    if n > 1:
        grams.append((folded[:-1] << np.uint32(8) | folded[1:]) * np.uint32(0x85EBCA6B) + np.uint32(0x1234567))
    if n > 2:
        grams.append((folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]) * np.uint32(0xC2B2AE35) + np.uint32(0x7654321))
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    grams = [((g ^ g >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift).astype(np.int64) for g in grams]
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for i, g in enumerate(grams):
            if high - low > i:
                out[row] += np.bincount(g[low : high - i], minlength=DIMENSIONS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def centroids_of(rows: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from evenly spaced seeds; centroids of unit length and the lowest cosine of their rows."""
    k = min(k, len(rows))
    middle = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (rows @ middle.T).argmax(1)
        for i in range(k):
            if (near == i).any():
                mean = rows[near == i].sum(0)
                middle[i] = mean / max(float(np.sqrt(mean @ mean)), 1e-9)
    cosine = rows @ middle.T
    near = cosine.argmax(1)
    lowest = np.array([cosine[near == i, i].min() if (near == i).any() else 0.0 for i in range(k)], np.float32)
    return middle, lowest


class Centroids:
    def __init__(self, labels: list[str], counts: np.ndarray):
        self.languages = sorted(set(labels))
        given = np.array(labels, object)
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        rows = weighted(counts, self.idf)
        found = [centroids_of(rows[given == x], CENTROIDS) for x in self.languages]
        self.middle = np.concatenate([m for m, _ in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
        self.lowest = np.concatenate([w for _, w in found]) if found else np.zeros(0, np.float32)
        self.owner = np.concatenate([np.full(len(m), i) for i, (m, _) in enumerate(found)]) if found else np.zeros(0, int)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, its share of the languages' best cosines (0 to 1) and whether the text is rejected."""
        cosine = weighted(counts, self.idf) @ self.middle.T
        best = np.stack([cosine[:, self.owner == i].max(1) for i in range(len(self.languages))], 1)
        near = cosine.argmax(1)
        sharp = np.exp((best - best.max(1, keepdims=True)) * 20)
        choice = self.owner[near]
        score = sharp[np.arange(len(choice)), choice] / sharp.sum(1)
        return choice, score, cosine[np.arange(len(near)), near] < self.lowest[near] * REJECT_PART


def fit(training: DataFrame, text_col: str = "text", label_col: str = "lang") -> Centroids:
    """``training``: labelled rows. The sample takes as many different texts of each language, by a hash of the text."""
    small_batches(training.sparkSession)
    rows = training.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    texts = F.approx_count_distinct(F.xxhash64(text_col)).alias("n")
    have = {r[0]: r[1] for r in rows.groupBy(label_col).agg(texts).collect()}  # a row for each language
    if not have:
        return Centroids([], np.zeros((0, DIMENSIONS), np.float32))
    each = MOST_TRAINING_ROWS / len(have)
    draw = F.pmod(F.xxhash64(text_col, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(None).cast("double")
    for label, n in have.items():
        share = F.when(F.col(label_col) == label, float(min(1.0, each / n))).otherwise(share)
    sample = rows.where(draw < share).dropDuplicates([text_col, label_col])  # copies of a text come together, and teach once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            for low, high in steps(offsets):
                at = offsets[low : high + 1]
                counts = vectors(data[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.array([c.tobytes() for c in counts.astype("<u4").view("<u4")], pa.binary())], ["label", "counts"])

    got = sample.select(text_col, label_col).mapInArrow(run, "label string, counts binary").orderBy("label", "counts").toArrow()
    counts = np.stack([np.frombuffer(x, "<u4") for x in got.column("counts").to_pylist()]).astype(np.float32)
    return Centroids(got.column("label").to_pylist(), counts)


def identify(df: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, lang_pred, score, rejected. No shuffle."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: languages x centroids x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, scores, far = [], [], []
            for low, high in steps(offsets, STEP_BYTES):
                at = offsets[low : high + 1]
                for first in range(low, high, 256):
                    last = min(high, first + 256)
                    part = offsets[first : last + 1]
                    if not own.languages:
                        choice, score, reject = np.zeros(last - first, int), np.zeros(last - first), np.ones(last - first, bool)
                    else:
                        choice, score, reject = own.predict(vectors(data[part[0] : part[-1]], part - part[0]))
                    known = letters[first:last] & bool(own.languages)
                    names += [own.languages[c] if k else "und" for c, k in zip(choice.tolist(), known.tolist())]
                    scores.append(np.where(known, score, 0.0))
                    far.append(reject | ~known)
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(join(scores, np.float64)), pa.array(join(far, bool))], [id_col, "lang_pred", "score", "rejected"])

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return df.select(F.col(id_col), F.col(text_col), has_letter.alias("has_letter")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
