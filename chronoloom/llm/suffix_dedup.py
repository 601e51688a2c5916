"""Operator 8: removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every byte that a LENGTH-byte string covers which also starts anywhere else is removed. Texts are bytes of UTF-8.

1. Each LENGTH-byte window has one *anchor*: the place of the smallest hash among its GRAM-byte grams (the last of equal
   ones). Equal windows have equal anchors, so windows can only be equal within the group of one anchor's hash. All the
   windows of one anchor place are one *context* (their bytes together); each window is in exactly one context.
2. Grams are counted over all texts; contexts of grams that occur once end here. Equal contexts are counted by a 128-bit
   hash and collapse: if there are two, all their windows are repeated.
3. What is left (contexts that occur once but whose anchor doesn't) is dealt by anchor. In a task, shards of contexts get
   their own suffix order and Burrows-Wheeler transform, over superletters of STEP bytes, one string for each phase. The
   transforms are merged by iterative interleave refinement: each round sorts the interleaving stably by the letter in
   front, so after h rounds it is in the order of the first h superletters, without sorting suffixes again; a border
   between neighbours that appears in round h says that their common prefix is h - 1 superletters. After LENGTH / STEP
   rounds the intervals without a border are the repeated windows.
4. Anchors with more than MOST_CONTEXTS different contexts don't meet in one task: their windows are counted by a
   128-bit hash, pre-aggregated, which gives the same; first what PART neighbouring windows have in common, then all
   their bytes (windows of equal parts are counted once), then the
   windows for which that occurs twice.

Hashes of 128 bits stand for equal bytes in steps 2 and 4. What is broadcast are filters of 2^SENT_BITS and
2^FILTER_BITS bits.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; rows that repeat an id and a text repeat each
other; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import FILTER_BITS, _filter_words
from .shared import mix, powers, small_batches, steps, text_view, write_shared

LENGTH, GRAM, STEP = 200, 64, 8
MOST_CONTEXTS, CHUNK_BYTES, SHARD_CONTEXTS, PART = 1_000, 60_000, 64, 8
#: Bytes of a step (its arrays stay in a core's cache); a place in it has to fit in PLACE_BITS.
PLACE_BITS, SEGMENT = 20, 1 << 16
#: Bits of the filters that Python workers get.
SENT_BITS = 26
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = powers((1 << PLACE_BITS) + 1, _BASE), powers((1 << PLACE_BITS) + 1, _INVERSE)
    return _POWERS["up"], _POWERS["down"]


def rolling(sums: np.ndarray, low: np.ndarray, size) -> np.ndarray:
    """Hashes of data[low : low + size] from the running sums."""
    return mix((sums[low + size] - sums[low]) * _tables()[1][low])


def running_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    up, _ = _tables()
    letter = data.astype(np.uint64) + np.uint64(1)
    if seed:
        letter = mix(letter + np.uint64(seed))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * up[: len(data)], dtype=np.uint64)])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Of rows in one step (at most 2^PLACE_BITS bytes): arrays of row, first window, last window (places in ``data``)
    and the anchor's hash; and the running sums."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64), None
    sums = running_sums(data)
    grams = mix((sums[gram:] - sums[:-gram]) * _tables()[1][: len(data) - gram + 1])
    last_place = np.uint64((1 << PLACE_BITS) - 1)
    low = (grams & ~last_place) | (last_place - np.arange(len(grams), dtype=np.uint64))
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n], low[width - size : width - size + n])
    anchor = ((1 << PLACE_BITS) - 1) - (low[:n] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    whole = np.zeros(n, bool)  # windows that stay in one row
    sizes = np.diff(offsets)
    for a, b in zip(offsets[:-1][sizes >= length].tolist(), offsets[1:][sizes >= length].tolist()):
        whole[a : b - length + 1] = True
    window = np.flatnonzero(whole)
    if not len(window):
        return none, none, none, np.zeros(0, np.uint64), None
    own = anchor[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(fresh)
    first, last = window[begin], window[np.append(begin[1:], len(window)) - 1]
    return np.searchsorted(offsets, first, "right") - 1, first, last, grams[own[begin]], sums


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Steps of rows: number of the first row, bytes, offsets, and the place of the bytes in that row if a row is longer
    than a step; then its segments overlap so that each window is in one of them."""
    for low, high in steps(offsets, SEGMENT):
        a, b = int(offsets[low]), int(offsets[high])
        if b - a <= SEGMENT + length:
            yield low, data[a:b], offsets[low : high + 1] - a, 0
        else:
            for begin in range(0, b - a - length + 1, SEGMENT):
                part = data[a + begin : min(b, a + begin + SEGMENT + length - 1)]
                yield low, part, np.array([0, len(part)], np.int64), begin


class Shard:
    """Suffix order and Burrows-Wheeler transform of a few strings of superletters (letters from 1; 0 ends a string)."""

    def __init__(self, letters: np.ndarray, ends: np.ndarray):
        rank, reach = letters.astype(np.int64, copy=True), 1
        far = np.repeat(ends, np.diff(np.concatenate([[0], ends + 1])))  # the end of each place's string
        at, n = np.arange(len(letters)), len(letters)
        span = int(np.diff(np.concatenate([[-1], ends])).max())
        while reach < span:  # prefix doubling within the strings
            ahead = at + reach
            after = np.where(ahead <= far, rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key)
            fresh = np.zeros(n, np.int64)
            fresh[1:] = np.diff(key[order]) != 0
            rank[order] = np.cumsum(fresh)
            reach *= 2
            if fresh.sum() == n - 1:
                break
        self.order = np.argsort(rank, kind="stable")
        before = np.concatenate([[0], letters[:-1]])  # the letter in front of a string is the end of the one before it: 0
        self.transform = before[self.order]


def merge(shards: list[Shard], rounds: int) -> np.ndarray:
    """Interleave refinement. For all places, shard after shard, the number of their interval after so many rounds:
    places of one interval have the same first ``rounds`` superletters."""
    sizes = [len(s.order) for s in shards]
    letters = np.concatenate([s.transform for s in shards])
    narrow = np.uint16 if int(letters.max(initial=0)) < 1 << 16 else np.uint32
    letters = letters.astype(narrow)
    turn = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    interval = np.zeros(len(turn), np.int32)
    for _ in range(rounds):
        front = np.empty(len(turn), narrow)
        front[np.argsort(turn, kind="stable")] = letters
        order = np.argsort(front, kind="stable")
        c, b = front[order], interval[order]
        border = np.zeros(len(turn), np.int32)
        border[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        interval, turn = np.cumsum(border, dtype=np.int32), turn[order]
    out = np.empty(len(turn), np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out[np.concatenate([s.order + a for s, a in zip(shards, starts)])] = interval[np.argsort(turn, kind="stable")]
    return out


def repeated_windows(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each context the numbers of its windows that occur at least twice, a context counting ``counts`` times."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts) + b"\0" * STEP, np.uint8).astype(np.uint64)
    value = np.zeros(len(raw) - STEP, np.uint64)  # the superletter that begins at each byte
    for i in range(STEP):
        value = value << np.uint64(8) | raw[i : i + len(value)]
    count = sizes - STEP + 1
    owner = np.repeat(np.arange(len(texts)), count)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    string = owner * STEP + begin % STEP  # one string for each context and phase
    order = np.argsort(string.astype(np.uint16 if len(texts) * STEP < 1 << 16 else np.uint32), kind="stable")
    _, ranks = np.unique(value[begin + np.repeat(np.cumsum(sizes) - sizes, count)], return_inverse=True)
    place = np.arange(len(order)) + string[order]  # an end (0) follows each string
    ends = np.cumsum(np.bincount(string, minlength=len(texts) * STEP) + 1) - 1
    flat, owners, windows = np.zeros(len(order) + len(ends), np.int64), np.full(len(order) + len(ends), -1), np.zeros(len(order) + len(ends), np.int64)
    flat[place], owners[place], windows[place] = ranks[order] + 1, owner[order], begin[order]
    cut = [*range(0, len(ends), SHARD_CONTEXTS * STEP), len(ends)]
    shards = []
    for i, j in zip(cut, cut[1:]):
        low = int(ends[i - 1]) + 1 if i else 0
        shards.append(Shard(flat[low : int(ends[j - 1]) + 1], ends[i:j] - low))
    interval = merge(shards, length // STEP)
    full = (owners >= 0) & (windows + length <= sizes[owners])
    total = np.bincount(interval[full], np.array(counts)[owners[full]], minlength=int(interval.max()) + 1)
    hit = full.copy()
    hit[full] = total[interval[full]] >= 2
    out_owner, out_window = owners[hit], windows[hit]
    order = np.lexsort((out_window, out_owner))
    return np.split(out_window[order], np.searchsorted(out_owner[order], np.arange(1, len(texts))))


def _runs(numbers: np.ndarray) -> list[dict]:
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) > 1)
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(numbers[np.concatenate([[0], cut + 1])], numbers[np.append(cut, len(numbers) - 1)])]


def _passes(wanted: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key & np.uint64((1 << SENT_BITS) - 1)
    return (wanted[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sent_filter(keys: DataFrame, key: str):
    packed = np.zeros(1 << SENT_BITS - 6, np.uint64)
    rows = _filter_words(keys, key, SENT_BITS).toArrow()
    packed[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(packed)


_RUNS = "array<struct<lo:int,hi:int>>"


def repeated_spans(docs: DataFrame, length: int, gram: int, most_contexts: int) -> DataFrame:
    """(id, tkey, lo, hi): bytes lo to hi (without) of a text are covered. ``docs``: id, tkey, text."""
    kind = dict(docs.dtypes)["id"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            for _, part, at, _ in segments(data, offsets, length):
                _, _, _, anchors, _ = contexts(part, at, length, gram)
                if len(anchors):
                    yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64))], ["anchor"])

    often = docs.select("text").mapInArrow(grams, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    often = write_shared(often.select("anchor"), "anchors")
    sent = _sent_filter(often, "anchor")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(2))
            for first_row, part, at, begin in segments(data, offsets, length):
                row, first, last, anchors, sums = contexts(part, at, length, gram)
                hit = _passes(sent.value, anchors)
                if not hit.any():
                    continue
                row, first, last, anchors = row[hit], first[hit], last[hit], anchors[hit]
                size = last - first + length
                one = rolling(sums, first, size)
                two = rolling(running_sums(part, 77), first, size) + size.astype(np.uint64)
                take = pa.array(row + first_row)
                lo = first - at[row] + begin
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x) for x in (anchors.view(np.int64), one.view(np.int64), two.view(np.int64), lo.astype(np.int32), (last - first + 1).astype(np.int32)))], names)

    names = ["id", "tkey", "anchor", "c1", "c2", "lo", "windows"]
    rows = docs.select("id", "tkey", "text").mapInArrow(places, f"id {kind}, tkey long, anchor long, c1 long, c2 long, lo int, windows int")
    rows = write_shared(rows, "contexts")
    distinct = write_shared(rows.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n")), "distinct-contexts")
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    groups = write_shared(groups.where("kinds > 1 and least = 1"), "open-anchors")
    open_contexts = write_shared(distinct.join(groups, "anchor").select("anchor", "c1", "c2", "n", "kinds"), "open-contexts")
    wanted = _sent_filter(open_contexts, "c1")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            for _, part, at, _ in segments(data, offsets, length):
                row, first, last, anchors, sums = contexts(part, at, length, gram)
                if not len(anchors):
                    continue
                size = last - first + length
                one = rolling(sums, first, size)
                hit = np.flatnonzero(_passes(wanted.value, one))
                if not len(hit):
                    continue
                hit = hit[np.unique(one[hit], return_index=True)[1]]
                two = rolling(running_sums(part, 77), first[hit], size[hit]) + size[hit].astype(np.uint64)
                raw = part.tobytes()
                cut = [raw[a:b] for a, b in zip(first[hit].tolist(), (first + size)[hit].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[hit].view(np.int64)), pa.array(one[hit].view(np.int64)), pa.array(two.view(np.int64)), pa.array(cut, pa.binary())], ["anchor", "c1", "c2", "bytes"])

    found = docs.select("text").mapInArrow(texts, "anchor long, c1 long, c2 long, bytes binary").groupBy("anchor", "c1", "c2").agg(F.first("bytes").alias("bytes"))
    found = write_shared(found.join(open_contexts, ["anchor", "c1", "c2"]), "context-bytes")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight, last = 0, None

        def done() -> pa.RecordBatch:
            runs = [_runs(x) for x in repeated_windows([x[3] for x in held], [x[4] for x in held], length)]
            columns = [pa.array([x[i] for x in held], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(runs, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["anchor", "c1", "c2", "runs"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and weight > CHUNK_BYTES and x[0] != last:
                    yield done()
                    held, weight = [], 0
                held.append(x)
                weight += len(x[3])
                last = x[0]
        if held:
            yield done()

    columns = ["anchor", "c1", "c2", "bytes", "n"]
    dealt = found.where(F.col("kinds") <= most_contexts).select(*columns).repartition("anchor").sortWithinPartitions("anchor", "c1")
    runs = dealt.mapInArrow(merged, f"anchor long, c1 long, c2 long, runs {_RUNS}")

    def parts_of(raw: bytes, anchor: int) -> tuple[int, list[tuple[int, int, int]]]:
        """The anchor's place in a context, and its parts: their windows begin PART * q to PART * q + PART - 1 places
        before the anchor. Number q, first and last window."""
        data = np.frombuffer(raw, np.uint8)
        grams = rolling(running_sums(data), np.arange(length - gram + 1), gram)
        place = int(np.flatnonzero(grams.view(np.int64) == anchor)[-1])  # it is in the first window
        q = (place - np.arange(len(data) - length + 1)) // PART
        edge = np.flatnonzero(np.diff(q)) + 1
        first = [0, *edge.tolist()]
        return place, list(zip(q[first].tolist(), first, [*(edge - 1).tolist(), len(q) - 1]))

    def hashed(cores: bool):
        """One row for each part, the hash of the bytes that all windows of the part's places have in common (they are in
        the context even if it has only some of these windows); or one row for each window of the wanted parts."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [[] for _ in names_of_parts]
                for anchor, one, two, raw, n, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                    data = np.frombuffer(raw, np.uint8)
                    place, found = parts_of(raw, anchor)
                    if cores:
                        number, size = [q for q, _, _ in found], length - PART + 1
                        low = place - PART * np.array(number)
                    else:
                        number, size = [i for q, first, last in found if q in wanted for i in range(first, last + 1)], length
                        low = np.array(number, np.int64)
                    a, b = (rolling(running_sums(data, x), low, size).view(np.int64).tolist() for x in (0, 77))
                    k = len(number)
                    for column, values in zip(out, ([anchor] * k, [one] * k, [two] * k, [n] * k, number, a, b)):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 4 else pa.int64()) for i, x in enumerate(out)], names_of_parts)

        return run

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each wanted part: the hash of all bytes of its windows, and its first and last window."""
        for batch in batches:
            rows = []
            for anchor, one, two, raw, n, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                sums = [running_sums(np.frombuffer(raw, np.uint8), x) for x in (0, 77)]
                for q, first, last in parts_of(raw, anchor)[1]:
                    if q in wanted:
                        a, b = (int(rolling(x, np.array([first]), last - first + length).view(np.int64)[0]) for x in sums)
                        rows.append((anchor, one, two, n, q, first, last, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if 4 <= i <= 6 else pa.int64()) for i in range(9)], ["anchor", "c1", "c2", "n", "number", "lo", "hi", "w1", "w2"])

    names_of_parts = ["anchor", "c1", "c2", "n", "number", "w1", "w2"]
    kinds_of_parts = "anchor long, c1 long, c2 long, n long, number int, w1 long, w2 long"
    crowded = found.where(F.col("kinds") > most_contexts)
    none = F.expr("cast(array() as array<int>)").alias("wanted")

    def twice_only(hashes: DataFrame, name: str) -> DataFrame:
        """The rows of contexts that occur once whose hash occurs at least twice."""
        hashes = write_shared(hashes, name)
        twice = hashes.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2")
        return hashes.join(write_shared(twice, f"{name}-repeated"), ["w1", "w2"])

    # a window can only occur twice if what it shares with the part's other windows does
    cores = twice_only(crowded.select(*columns, none).mapInArrow(hashed(True), kinds_of_parts), "cores")
    cores = write_shared(cores.groupBy("anchor", "c1", "c2").agg(F.sort_array(F.collect_set("number")).alias("wanted")), "open-parts")  # a context's own
    # all windows of a part that occurs twice as a whole do; those of one such part stand for all parts that are equal to it
    parts = crowded.join(cores, ["anchor", "c1", "c2"]).select(*columns, "wanted").mapInArrow(extents, "anchor long, c1 long, c2 long, n long, number int, lo int, hi int, w1 long, w2 long")
    parts = write_shared(parts, "part-extents")
    own = F.struct("anchor", "c1", "c2", "number")
    equal = parts.groupBy("w1", "w2").agg(F.sum("n").alias("total"), F.min(own).alias("first")).where("total > 1")
    parts = write_shared(parts.join(equal.select("w1", "w2", "first"), ["w1", "w2"], "left").drop("w1", "w2"), "parts")
    whole_parts = parts.where("first is not null and n = 1").select("anchor", "c1", "c2", "lo", "hi")

    def windows_of(kept: DataFrame, n: Column) -> DataFrame:
        wanted = kept.groupBy("anchor", "c1", "c2").agg(F.sort_array(F.collect_set("number")).alias("wanted"))  # a context's own
        return crowded.join(wanted, ["anchor", "c1", "c2"]).select("anchor", "c1", "c2", "bytes", n.alias("n"), "wanted").mapInArrow(hashed(False), kinds_of_parts)

    windows = windows_of(parts.where("first is null"), F.col("n")).union(windows_of(parts.where(own == F.col("first")), F.lit(2).cast("long")))
    windows = twice_only(windows, "windows").where("n = 1").select("anchor", "c1", "c2", F.col("number").alias("lo"), F.col("number").alias("hi"))
    single = windows.union(whole_parts).groupBy("anchor", "c1", "c2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # a context's own
    runs = write_shared(runs.unionByName(single), "runs")

    whole = distinct.where("n > 1").select("c1", "c2", F.lit(None).cast(_RUNS).alias("runs"))
    known = write_shared(whole.unionByName(runs.where(F.size("runs") > 0).select("c1", "c2", "runs")), "repeated-contexts")
    hit = rows.select("id", "tkey", "c1", "c2", "lo", "windows").join(known, ["c1", "c2"])
    spans = F.coalesce("runs", F.array(F.struct(F.lit(0).alias("lo"), (F.col("windows") - 1).alias("hi"))))
    hit = hit.select("id", "tkey", F.col("lo").cast("long").alias("lo"), F.explode(spans).alias("run"))
    return hit.select("id", "tkey", (F.col("lo") + F.col("run.lo")).alias("lo"), (F.col("lo") + F.col("run.hi") + length).alias("hi"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS, keep_bytes: bool = True) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, the bytes left."""
    if length % STEP or gram >= length:
        raise ValueError(f"length has to be a multiple of {STEP} and over gram")
    spark = df.sparkSession
    small_batches(spark)
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(docs, length, gram, most_contexts).groupBy("id", "tkey").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # a document's own
    spans = write_shared(spans.select(F.col("id").alias("span_id"), F.col("tkey").alias("span_key"), "spans"), "spans")
    bits = write_shared(_filter_words(spans, "span_key"), "filter")
    placed = docs.withColumn("place", F.col("tkey").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))
    placed = placed.join(F.broadcast(bits), F.shiftright("place", 6) == F.col("word"), "left")
    hit = F.coalesce(F.expr("(bits & shiftleft(1L, cast(place & 63 as int))) <> 0"), F.lit(False))
    touched = placed.where(hit).join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("tkey") == F.col("span_key")), "left")
    touched = touched.select("id", "text", F.coalesce("spans", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")).alias("spans"))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            lists = batch.column(2)
            flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            removed, spans, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                part = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(part) + 1, np.int64)
                np.add.at(edge, lo[bounds[i] : bounds[i + 1]], 1)
                np.add.at(edge, hi[bounds[i] : bounds[i + 1]], -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = part[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            out = [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * keep_bytes, names)

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    changed = touched.mapInArrow(cut, schema)
    zero = F.lit(0).cast("long")
    same = placed.where(~hit).select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] * keep_bytes))
    return changed.unionByName(same)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
