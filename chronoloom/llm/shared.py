"""What the training-data operators share: shared storage, Arrow views of text and vectorised hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step looks at (its arrays stay in a core's cache); a longer document is a step of its own.
STEP_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session; one in the local
    temporary folder only where that is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class WorkTables(threading.local):
    """The tables that are written in its ``with`` block, by this thread, so that they can be removed when nothing reads
    them any more. Tables of others, and those written outside, aren't touched; they go at the end of the program."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> WorkTables:
        _open_work().append(self)
        return self

    def __exit__(self, *_) -> None:
        _open_work().pop()

    def release(self, spark: SparkSession) -> None:
        """For callers who have written every result that still reads these tables."""
        while self.paths:
            _remove(spark, self.paths.pop())


_OPEN = threading.local()


def _open_work() -> list[WorkTables]:
    if not hasattr(_OPEN, "stack"):
        _OPEN.stack = []
    return _OPEN.stack


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it. Lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _open_work():
        _open_work()[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        return


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of an Arrow batch by bytes and rows, since texts may be long; and lets Python workers on the
    driver's machine import this package when it isn't installed (a cluster ships or installs it)."""
    own = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if own not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (own, *known) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty row."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or one row each."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: ``[\x20\x09-\x0D]``
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z become a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def _drawn(keys: np.ndarray) -> np.ndarray:
    """An unrelated number for each byte at each place of a word. Sums of powers of a base would not do: modulo 2^64 there
    are words (Thue-Morse) whose sums are equal for any base."""
    return mix(keys.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x3C79AC492BA7B653))


#: Of the first 64 places.
_BYTE_AT_PLACE = _drawn(np.arange(64 << 8))


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order, and the number of words of
    each row: the mixed sum of what is drawn for each byte at its place. Words end where rows end. ``space``: other bytes
    that part words."""
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    black = ~space[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = black[edge]
    last = black.copy()
    last[:-1] &= ~black[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = black[edge]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    size = end - begin
    at = np.flatnonzero(black)
    place = at - np.repeat(begin, size)
    key = (place << 8) | LOWER[data[at]]
    drawn = _BYTE_AT_PLACE[np.minimum(key, len(_BYTE_AT_PLACE) - 1)]
    far = key >= len(_BYTE_AT_PLACE)
    if far.any():
        drawn[far] = _drawn(key[far])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(drawn, dtype=np.uint64)])
    ends = np.cumsum(size)
    words = mix((total[ends] - total[ends - size]) ^ np.uint64((seed * _BASE) & (2**64 - 1)))
    return words, np.diff(np.searchsorted(begin, offsets))


def shingles(words: np.ndarray, counts: np.ndarray, k: int, places: bool = False):
    """For each row the sorted distinct hashes of its ``k``-word shingles; with fewer words the whole sequence is one;
    without words there is none. ``places``: also, in a second list, at which word of the row each of them begins first."""
    weights = powers(k, 0xD6E8FEB86659FD93)
    if len(words) >= k:
        n = len(words) - k + 1
        rolled = np.zeros(n, np.uint64)
        for i in range(k):
            rolled += words[i : i + n] * weights[i]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out, first, low = [], [], 0
    for n in counts.tolist():
        if n >= k and places:
            found, at = np.unique(rolled[low : low + n - k + 1], return_index=True)
            out.append(found)
            first.append(at)
            low += n
            continue
        first.append(np.zeros(min(n, 1), np.int64))
        if n >= k:
            out.append(np.unique(rolled[low : low + n - k + 1]))
        elif n:
            out.append(mix(np.array([(words[low : low + n] * weights[:n]).sum(dtype=np.uint64)], np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        low += n
    return (out, first) if places else out
