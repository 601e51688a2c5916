"""Operator 6: quality classifier by co-training.

Two logistic regressions look at a document from two sides: its text (shares of bytes, word statistics, repetition) and
its page metadata (hashed source, language, their pair, declared length). Each is fitted on the labelled sample. In each
round each one labels all rows that have no label, and the EACH_ROUND rows of either kind that it is surest of, and that haven't
taught yet, teach the other. In the end both are calibrated (Platt) on labelled rows that neither has learnt from, and the
calibrated log-odds are added, less the prior that both contain. A document is kept if the combined score is at least THRESHOLD.

Defined cases: a null text is empty; null metadata is a value of its own; a document with several labels has their
rounded mean (a tie is good); labels that are null teach nothing; without labels of both kinds every score is 1 and all
is kept. Ids, labels and order of rows play no part in a score. Columns of the result that ``df`` already has are
replaced; others go through. Rows that repeat, and null ids, are scored each; copies teach once. Texts are read whole, a
very long one by one task; scoring makes no shuffle. The views of all rows are written once for the rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, steps, text_view, word_hashes, write_shared

#: Labelled rows to fit on, at most as expected. Only vectors come to the driver.
MOST_LABELLED = 6_000
ROUNDS, SURE, EACH_ROUND, THRESHOLD = 4, 0.97, 300, 0.5
N_CONTENT, SOURCE_BUCKETS, PAIR_BUCKETS, LENGTH_BUCKETS = 256 + 8, 64, 128, 16
N_METADATA = SOURCE_BUCKETS + PAIR_BUCKETS + LENGTH_BUCKETS + 16


def content_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, N_CONTENT), np.float32)
    words, counts = word_hashes(data, offsets)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i in range(n):
        part = data[offsets[i] : offsets[i + 1]]
        size = max(len(part), 1)
        own = words[ends[i] : ends[i + 1]]
        out[i, :256] = np.sqrt(np.bincount(part, minlength=256) / size)
        if len(own):
            pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
            distinct, often = np.unique(own, return_counts=True)
            out[i, 256:262] = (len(distinct) / len(own), often.max() / len(own), len(np.unique(pairs)) / max(len(pairs), 1), np.log1p(len(own)) / 10, size / len(own) / 20, (own[1:] == own[:-1]).sum() / len(own))
        out[i, 262] = not len(own)
        out[i, 263] = np.log1p(len(part)) / 10
    return out


def metadata_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), N_METADATA), np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        s, g = repr(s).encode(), repr(g).encode()
        out[i, zlib.crc32(s) % SOURCE_BUCKETS] = 1
        out[i, SOURCE_BUCKETS + zlib.crc32(s + g) % PAIR_BUCKETS] = 1
        out[i, SOURCE_BUCKETS + PAIR_BUCKETS + (LENGTH_BUCKETS - 1 if n is None else min(int(max(n, 0)).bit_length(), LENGTH_BUCKETS - 2))] = 1
        out[i, SOURCE_BUCKETS + PAIR_BUCKETS + LENGTH_BUCKETS + zlib.crc32(g) % 16] = 1
    return out


def _with_bias(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Newton's method with a ridge on all but the bias; the bias is the last weight."""
    x = _with_bias(x)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def surest(content: np.ndarray, metadata: np.ndarray, keys: np.ndarray, weights: list[np.ndarray]) -> list[tuple[int, float, int]]:
    """For each view and kind the EACH_ROUND rows it is surest of: (2 * view + label, how sure, row). ``keys`` break ties."""
    out = []
    for view, (x, w) in enumerate(zip((content, metadata), weights)):
        p = _sigmoid(_with_bias(x) @ w)
        for label, sure in ((1, p), (0, 1 - p)):
            rows = np.flatnonzero(sure >= SURE)
            out += [(2 * view + label, float(sure[i]), int(i)) for i in rows[np.lexsort((keys[rows], -sure[rows]))[:EACH_ROUND]].tolist()]
    return out


#: What a round asks for with both views' weights: for each of 2 * view + label, content and metadata rows and keys.
Ask = Callable[[list[np.ndarray], set[int]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def ask_arrays(content: np.ndarray, metadata: np.ndarray) -> Ask:
    """Rows in memory."""
    keys = np.arange(len(content))

    def ask(weights: list[np.ndarray], used: set[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        free = np.array([k for k in keys.tolist() if k not in used], np.int64)
        found = surest(content[free], metadata[free], free, weights)
        picked = [free[[i for kind, _, i in found if kind == k]] for k in range(4)]
        return [(content[rows], metadata[rows], rows) for rows in picked]

    return ask


class CoTrained:
    """Weights and calibration (slope, offset) of the two views, and the prior's log-odds."""

    def __init__(self, content: np.ndarray, metadata: np.ndarray, y: np.ndarray, ask: Ask):
        self.trained = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.trained:
            return
        aside = np.arange(len(y)) % 5 == 0
        if not 0 < y[aside].sum() < aside.sum():
            aside[:] = False
        views = (content, metadata)
        taught = [(x[~aside], y[~aside]) for x in views]
        used: set[int] = set()
        weights = [logistic(*t) for t in taught]
        for _ in range(ROUNDS):
            found = ask(weights, used)
            if not any(len(keys) for *_, keys in found):
                break
            for kind, rows in enumerate(found):
                me = 1 - kind // 2  # what one view is sure of teaches the other
                taught[me] = (np.concatenate([taught[me][0], rows[me]]), np.append(taught[me][1], np.full(len(rows[2]), float(kind % 2))))
                used.update(rows[2].tolist())
            weights = [logistic(*t) for t in taught]
        check = aside if aside.any() else np.ones(len(y), bool)
        self.weights = weights
        self.platt = [logistic((_with_bias(x[check]) @ w)[:, None], y[check], 0.01) for x, w in zip(views, weights)]
        share = (y[check].sum() + 1) / (check.sum() + 2)
        self.prior = float(np.log(share / (1 - share)))

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata scores, 0 to 1."""
        if not self.trained:
            return (np.ones(len(content)),) * 3
        a, b = ((_with_bias(x) @ w) * p[0] + p[1] for x, w, p in zip((content, metadata), self.weights, self.platt))
        return _sigmoid(a + b - self.prior), _sigmoid(a), _sigmoid(b)


_VIEW_COLUMNS = ("text", "source", "lang", "n_chars")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, *rest = (batch.column(batch.schema.get_field_index(c)) for c in _VIEW_COLUMNS)
    data, offsets = text_view(text)
    parts = [np.zeros((0, N_CONTENT), np.float32)]
    for low, high in steps(offsets):
        at = offsets[low : high + 1]
        parts.append(content_view(data[at[0] : at[-1]], at - at[0]))
    return np.concatenate(parts), metadata_view(*(x.to_pylist() for x in rest))


def _draw(column: str, seed: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _unpacked(content: list[bytes], metadata: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = ((content, np.float32, N_CONTENT), (metadata, np.uint8, N_METADATA))
    return tuple(np.frombuffer(b"".join(x), kind).reshape(-1, n).astype(np.float32) for x, kind, n in parts)


def _ask_table(views: DataFrame) -> Ask:
    """All rows of a table (key, content, metadata). Each partition sends on its own surest rows, a row's copies once."""
    def ask(weights: list[np.ndarray], used: set[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sent = views.sparkSession.sparkContext.broadcast((weights, used))  # at most ROUNDS * 4 * EACH_ROUND keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, used = sent.value
            best: dict[int, dict[int, tuple]] = {k: {} for k in range(4)}
            for batch in batches:
                keys, packed = batch.column(0).to_numpy(), [x.to_pylist() for x in batch.columns[1:]]
                free = np.array([i for i, k in enumerate(keys.tolist()) if k not in used], np.int64)
                content, metadata = _unpacked(*([x[i] for i in free] for x in packed))
                for kind, sure, i in surest(content, metadata, keys[free], weights):
                    i = int(free[i])
                    best[kind][int(keys[i])] = (sure, packed[0][i], packed[1][i])
                for kind, own in best.items():
                    if len(own) > EACH_ROUND:
                        best[kind] = dict(sorted(own.items(), key=lambda x: (-x[1][0], x[0]))[:EACH_ROUND])
            rows = [(kind, sure, key, c, m) for kind, own in best.items() for key, (sure, c, m) in own.items()]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "sure", "key", "content", "metadata"])

        found = write_shared(views.mapInArrow(run, "kind int, sure double, key long, content binary, metadata binary").dropDuplicates(["kind", "key"]), "surest")
        top = [found.where(F.col("kind") == k).orderBy(F.desc("sure"), "key").limit(EACH_ROUND) for k in range(4)]
        rows = reduce(DataFrame.union, top).collect()
        out = []
        for k in range(4):
            own = [r for r in rows if r.kind == k]
            out.append((*_unpacked([r.content for r in own], [r.metadata for r in own]), np.array([r.key for r in own], np.int64)))
        return out

    return ask


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> CoTrained:
    """``df`` has text, source, lang and n_chars; ``labels`` has ids and 0/1. Rows with a label are learnt from, or set aside,
    by their label only; pseudo-labels are for all other rows."""
    small_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.floor(F.avg(label_col) + 0.5).cast("double").alias("label"))
    n = known.count()
    picked = known.where(_draw(id_col, 31) < min(1.0, MOST_LABELLED / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, metadata = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(content), _packed(metadata.astype(np.uint8))], ["id", "content", "metadata"])

    views = df.select(F.col(id_col).alias("id"), *_VIEW_COLUMNS).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, content binary, metadata binary")
    views = write_shared(views, "views")
    sample = views.join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id").select("label", "content", "metadata")
    got = sample.orderBy(F.xxhash64("content", "metadata"), "label").toArrow()
    content, metadata = _unpacked(got.column("content").to_pylist(), got.column("metadata").to_pylist())
    others = views.join(known.select(F.col(id_col).alias("id")), "id", "left_anti").select(F.xxhash64("content", "metadata").alias("key"), "content", "metadata")
    return CoTrained(content, metadata, got.column("label").to_numpy(), _ask_table(write_shared(others, "unlabelled")))


def score_quality(df: DataFrame, model: CoTrained) -> DataFrame:
    """``df`` with quality_score, content_score and metadata_score."""
    small_batches(df.sparkSession)
    names = ("quality_score", "content_score", "metadata_score")
    rows = df.drop(*names)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.scores(*_views(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.float64)) for x in found)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(x, T.DoubleType()) for x in names)]))


def filter_quality(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that are kept, with its own columns."""
    return score_quality(df, fit(df, labels)).where(F.col("quality_score") >= THRESHOLD).select(*df.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", "quality_score", "content_score", "metadata_score", (F.col("quality_score") >= THRESHOLD).alias("kept"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
