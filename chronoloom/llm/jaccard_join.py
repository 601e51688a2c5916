"""Operator 7: n-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when 100 * |intersection| >= percent * |union| of their sets of word shingles. Documents with equal
sets are one class; only classes are compared.

1. Lists. A class that links with another shares at least T of its n shingles with it, T = ceil(percent * n / 100), so one
   of its n - T + 1 rarest shingles is in the other's likewise. How rare a shingle is, is judged by its rarest word, from a
   sketch of word counts over all documents that has a fixed size; it gives one order for all. The inverted lists of these
   shingles, sorted by set size, are parted where two sizes that follow each other can't link; lists of one class, lists in
   which no class could be the smaller side of a link, lists with the same members as another, and classes that share too
   few of these shingles with others for any link go.
2. Units. Classes joined by lists are a unit. A unit of at most UNIT_SHINGLES shingles is searched in one task. Of a
   larger one each list is a unit of its own where that is less work.
3. Search. In a task ``DivideSkip.search`` merges the query's short inverted lists with a heap, probes the long ones by
   binary search and keeps the members that reach the required overlap; members that are connected with the query already
   are left out. A task returns the links of a spanning forest, never the pairs of a group.
4. Larger units are dealt to blocks of members. Leaders, of which a unit has LEADERS at most, go to all its blocks, again
   with others as long as that connects many classes; then what is outside the unit's main component is searched in all
   its blocks. So each link is found or is between classes that are connected already; no partner or candidate is cut off.

Sets travel, never texts, and once for a small unit. What is broadcast has a fixed size: the sketch (2^SKETCH_BITS bytes)
and a filter of 2^FILTER_BITS bits. Shingles are 64-bit hashes, equal sets two of them; two sets with the same first hash
are told apart by the second.

Defined cases: a null or empty text, and one without words, has an empty set, links with nothing and is its own
component; with fewer words than a shingle the whole sequence is the one shingle; rows that repeat an id are reported
each; a null id is never the smallest one, and a component that has no other id has a null one; other columns are not
read. Texts are read whole; a very long one is a unit of its own size in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import mix, shingles, small_batches, steps, text_view, word_hashes, write_shared

SKETCH_BITS, SKETCH_PARTS, FILTER_BITS = 20, 256, 23
#: Shingles that one task searches, where single sets aren't larger; leaders of a larger unit.
UNIT_SHINGLES, LEADERS = 1 << 18, 32
#: DivideSkip's weight of a binary probe against a merged entry; entries beyond which runs are merged by a stable sort.
PROBE_WEIGHT, HEAP_ENTRIES = 0.01, 256
#: Lists of at most so many classes are a row each.
SHORT_LIST = 8
#: Classes that a task remembers so as to send the lists of copies once.
REMEMBERED = 1 << 17


def least_overlap(a, b, percent: int):
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def merged_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and in how many of them each is, by a heap; many entries by a stable sort, which merges
    their sorted runs."""
    if sum(map(len, lists)) > HEAP_ENTRIES:
        together = np.sort(np.concatenate(lists), kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1]]))
        return together[begin], np.diff(np.append(begin, len(together)))
    found: list[int] = []
    count: list[int] = []
    for member in heapq.merge(*(x.tolist() for x in lists)):
        if found and found[-1] == member:
            count[-1] += 1
        else:
            found.append(member)
            count.append(1)
    return np.array(found, np.int64), np.array(count, np.int64)


class DivideSkip:
    """Inverted lists over a few sets of sorted distinct hashes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        members = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.members, tokens = members[order], tokens[order]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        self.tokens, self.begin = tokens[begin], np.append(begin, len(tokens))

    def search(self, query: np.ndarray, percent: int, open_members: np.ndarray | None = None) -> np.ndarray:
        """Members that link with the query, in order; of ``open_members`` only, a flag for each, if given."""
        n = len(query)
        fit = (100 * self.sizes >= percent * n) & (100 * n >= percent * self.sizes) & (self.sizes > 0)
        if open_members is not None:
            fit &= open_members
        if not n or not fit.any() or not len(self.tokens):
            return np.zeros(0, np.int64)
        need = least_overlap(n, self.sizes, percent)
        least = int(need[fit].min())
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        if len(at) < least:
            return np.zeros(0, np.int64)
        size = self.begin[at + 1] - self.begin[at]
        at = at[np.argsort(size, kind="stable")]
        n_long = min(least - 1, int(least / (PROBE_WEIGHT * np.log2(max(int(size.max()), 2)) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        found, count = merged_counts([self.members[self.begin[i] : self.begin[i + 1]] for i in short.tolist()])
        open_lists = len(long)
        for i in long.tolist():
            live = fit[found] & (count + open_lists >= need[found])
            if not live.all():
                found, count = found[live], count[live]
            if not len(found):
                return found
            own = self.members[self.begin[i] : self.begin[i + 1]]
            place = np.searchsorted(own, found)
            count = count + (own[np.minimum(place, len(own) - 1)] == found)
            open_lists -= 1
        return found[fit[found] & (count >= need[found])]


def forest(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the links of the queries with the members connect. ``rows``: (cid, query, member, label,
    set); rows with one label are connected already."""
    of_cid: dict[int, list] = {}
    for cid, query, member, label, tokens in rows:
        own = of_cid.setdefault(cid, [False, False, label, tokens])
        own[0] |= query
        own[1] |= member
    cids, rows = list(of_cid), list(of_cid.values())
    members = np.array([i for i, own in enumerate(rows) if own[1]], np.int64)
    index = DivideSkip([rows[i][3] for i in members.tolist()])
    comp = np.unique(np.array([own[2] for own in rows], np.int64), return_inverse=True)[1]
    all_ask, out = all(own[0] and own[1] for own in rows), []
    for i, own in enumerate(rows):
        if own[0]:
            apart = comp[members] != comp[i]
            if all_ask:
                apart[: i + 1] = False
            for j in members[index.search(own[3], percent, apart)].tolist():
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    out.append((cids[i], cids[j]))
    return out


def _class_of(s: np.ndarray, taken: frozenset[int], bits: int = 64) -> tuple[int, int]:
    """A number for a set, and a second one to tell sets with the same number apart. ``taken``: numbers of several sets;
    these sets are numbered by their second one."""
    a = mix(mix(s + np.uint64(1)).sum(keepdims=True, dtype=np.uint64)) >> np.uint64(64 - bits)
    b = mix(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True, dtype=np.uint64) + np.uint64(1))
    first = int(a.view(np.int64)[0])
    return int(mix(b ^ a).view(np.int64)[0]) if first in taken else first, int(b.view(np.int64)[0])


def _levelled_sets(column: pa.Array, words: int, level: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets and the level of each shingle's rarest word."""
    data, offsets = text_view(column)
    for low, high in steps(offsets):
        at = offsets[low : high + 1]
        hashes, counts = word_hashes(data[at[0] : at[-1]], at - at[0])
        own = level[hashes >> np.uint64(64 - SKETCH_BITS)]
        least = own.copy()
        for i in range(1, words):
            if len(own) > i:
                least[:-i] = np.minimum(least[:-i], own[i:])
        begin = 0
        for s, first, n in zip(*shingles(hashes, counts, words, places=True), counts.tolist()):
            yield s, least[begin + first] if n >= words else np.full(len(s), own[begin : begin + n].min(initial=255), np.uint8)
            begin += n


def _profiles(docs: DataFrame, words: int, taken: frozenset[int], bits: int) -> DataFrame:
    """Rows of documents (id, n, cid, c2) and, with ``part``, of the partitions' frequency sketches."""
    kind = dict(docs.dtypes)["id"]
    each = (1 << SKETCH_BITS) // SKETCH_PARTS
    names = ["id", "n", "cid", "c2", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, id_type = np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in batches:
            n, first, second, id_type = [], [], [], batch.column(0).type
            data, offsets = text_view(batch.column(1))
            for low, high in steps(offsets):
                at = offsets[low : high + 1]
                hashes, counts = word_hashes(data[at[0] : at[-1]], at - at[0])
                sketch += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
                for s in shingles(hashes, counts, words):
                    one, two = _class_of(s, taken, bits) if len(s) else (None, None)
                    n.append(len(s))
                    first.append(one)
                    second.append(two)
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if id_type is not None:
            parts = [sketch[i * each : (i + 1) * each].tobytes() for i in range(SKETCH_PARTS)]
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_PARTS, id_type), none, none, none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(run, f"id {kind}, n long, cid long, c2 long, part int, counts binary")


def _frequency_order(parts: DataFrame) -> np.ndarray:
    """One byte for each bucket of the sketch: four times the binary logarithm of its count."""
    def add(frame):
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
        for x in frame["counts"]:
            total += np.frombuffer(x, np.uint32)
        return frame[["part"]].head(1).assign(levels=[(np.log2(total + 1) * 4).astype(np.uint8).tobytes()])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    each = (1 << SKETCH_BITS) // SKETCH_PARTS
    for part, levels in parts.groupBy("part").applyInPandas(add, "part int, levels binary").collect():
        out[part * each : (part + 1) * each] = np.frombuffer(levels, np.uint8)
    return out


def _postings(docs: DataFrame, words: int, percent: int, taken: frozenset[int], bits: int, levels) -> DataFrame:
    """(token, cid, n, short) of the rarest shingles; short: it is one of those that the smaller side of a link needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            tokens, cids, sizes, short = [], [], [], []
            for s, level in _levelled_sets(batch.column(1), words, levels.value):
                n = len(s)
                cid = _class_of(s, taken, bits)[0] if n else None
                if n and cid not in known:
                    if len(known) == REMEMBERED:
                        known.clear()
                    known.add(cid)
                    order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
                    kept = s[order[: n + percent * n // -100 + 1]]
                    tokens.append(kept.view(np.int64))
                    cids.append(np.full(len(kept), cid, np.int64))
                    sizes.append(np.full(len(kept), n, np.int64))
                    short.append(np.arange(len(kept)) <= n - least_overlap(n, n, percent))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, cids, sizes, short)], ["token", "cid", "n", "short"])

    return docs.select("id", "text").mapInArrow(run, "token long, cid long, n long, short boolean")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """Lists of at least two classes, from postings sorted by token and size: those of at most SHORT_LIST as a row each
    (cids, sizes, short), of others each entry (list, cid, n, short). Only so many entries are held back at a time."""
    names = ["cids", "sizes", "list", "cid", "n", "short"]

    def rows(token, cid, n, short, begin, size, first) -> pa.RecordBatch:
        """``begin``, ``size``: of the lists; ``first``: a number for each entry of the long ones."""
        few = (size >= 2) & (size <= SHORT_LIST) & (first[begin] == 0)
        at = np.repeat(few, size)
        offsets = np.append(0, np.cumsum(size[few])).astype(np.int32)
        arrays = [pa.ListArray.from_arrays(offsets, x[at]) for x in (cid, n)]
        any_short = np.maximum.reduceat(short, begin)[few]
        many = np.flatnonzero(first)
        number = mix(first[many].view(np.uint64) ^ token[many].view(np.uint64)).view(np.int64)
        none, no_list = pa.nulls(len(offsets) - 1, pa.int64()), pa.nulls(len(many), arrays[0].type)
        few_rows = [*arrays, none, none, none, pa.array(any_short)]
        many_rows = [no_list, no_list, pa.array(number), pa.array(cid[many]), pa.array(n[many]), pa.array(short[many])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(few_rows, many_rows)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_first = None, 0  # entries of the last list, or its last one if it is a long one, which has a number then
        for batch in batches:
            new = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if not len(new[0]):
                continue
            token, cid, n, short = new if held is None else (np.concatenate(x) for x in zip(held, new))
            other = np.concatenate([[True], (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])])
            token, cid, n, short = token[other], cid[other], n[other], short[other]
            begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])]))
            size = np.diff(np.append(begin, len(n)))
            first = np.where(size > SHORT_LIST, mix(n[begin] + 1).view(np.int64), 0)
            if long_first:
                first[0] = long_first
            long_first = int(first[-1])
            keep = 1 if long_first else int(size[-1])
            first = np.repeat(first, size)
            held = tuple(x[-keep:] for x in (token, cid, n, short))
            size[-1] -= keep
            if not size[-1]:
                begin, size = begin[:-1], size[:-1]
            if len(size):
                yield rows(*(x[:-keep] for x in (token, cid, n, short)), begin, size, first[:-keep])
        if held is not None:
            yield rows(*held, np.zeros(1, np.int64), np.array([len(held[0])]), np.full(len(held[0]), long_first))

    kind = "cids array<long>, sizes array<long>, list long, cid long, n long, short boolean"
    return postings.repartition("token").sortWithinPartitions("token", "n", "cid").mapInArrow(run, kind)


def _least_shared(n, m, percent: int):
    """How many tokens in both prefixes sets of these sizes share at least if they link: what is behind the prefix that
    ends first are T - 1 tokens. One less, for the rounding between two sizes."""
    up = lambda x, by: F.floor((x + by - 1) / by)
    return up(percent * (n + m), 100 + percent) - up(percent * F.greatest(n, m), 100)


def _kept_lists(lists: DataFrame, percent: int) -> DataFrame:
    """list, cid, n, head (one of its classes), w (shingles of its classes): the lists that are searched. A class stays if
    it shares enough tokens with others for any link that its lists allow."""
    few = lists.where("cids is not null").groupBy("cids", "sizes").agg(F.count("*").alias("c"), F.max("short").alias("short"))
    few = few.select(F.xxhash64("cids").alias("list"), "c", "short", F.element_at("sizes", 1).alias("low"), F.element_at("sizes", -1).alias("high"), F.explode(F.arrays_zip("cids", "sizes")).alias("own"))
    few = few.select("list", "c", "short", "low", "high", F.col("own.cids").alias("cid"), F.col("own.sizes").alias("n"))
    many = lists.where("list is not null").select("list", "cid", "n", "short")
    seeds = [F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"x{i}") for i in (3, 5)]
    each = many.groupBy("list").agg(*seeds, F.count("*").alias("m"), F.max("short").alias("short"), F.min("n").alias("low"), F.max("n").alias("high"))
    each = each.groupBy("x3", "x5", "m").agg(F.min("list").alias("list"), F.count("*").alias("c"), F.max("short").alias("short"), F.min("low").alias("low"), F.max("high").alias("high"))
    many = many.drop("short").join(each, "list").select("list", "c", "short", "low", "high", "cid", "n")
    every = write_shared(few.union(many), "distinct-lists")
    n = F.col("n")
    ends = F.greatest("low", F.ceil(percent * n / 100)), F.least("high", F.floor(100 * n / percent))
    least = F.least(*(_least_shared(n, x, percent) for x in ends))
    able = every.groupBy("cid").agg(F.sum("c").alias("c"), F.min(least).alias("least")).where("c >= least").select("cid")
    left = write_shared(every.where("short").select("list", "cid", "n").join(able, "cid"), "able-lists")
    whole = left.groupBy("list").agg(F.min("cid").alias("head"), F.sum("n").alias("w"), F.count("*").alias("m")).where("m > 1").drop("m")
    return write_shared(left.join(whole, "list").select("list", "cid", "n", "head", "w"), "kept-lists")


def _filter_words(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A filter of 2^bits bits as 64-bit words: at most 2^(bits - 6) rows, whatever the input."""
    place = keys.select(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)).alias("place"))
    return place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))


def _filter(keys: DataFrame, key: str) -> np.ndarray:
    """The filter's words. They come as Arrow batches: as rows, a full filter's 2^17 take the driver far more memory."""
    packed = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    rows = _filter_words(keys, key).toArrow()
    packed[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return packed


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the smallest node that can be reached. Large-star and
    small-star rounds, each a table in the shared folder."""
    now = write_shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        heads = now.select(F.col("v").alias("u")).distinct()
        apart = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if apart and now.join(heads, "u", "left_semi").isEmpty():  # stars: each node has one head, which has none
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_shared(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        now = write_shared(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = write_shared(now.groupBy("u").agg(F.min("v").alias("m")), "stars")
        near = now.join(least, "u")
        now = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = write_shared(now, "edges")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").union(roots.select("node", F.col("node").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))


def _sets(docs: DataFrame, words: int, taken: frozenset[int], bits: int, wanted) -> DataFrame:
    """(cid, tokens) of the classes that the filter lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            cids, tokens = [], []
            data, offsets = text_view(batch.column(1))
            for low, high in steps(offsets):
                at = offsets[low : high + 1]
                for s in shingles(*word_hashes(data[at[0] : at[-1]], at - at[0]), words):
                    cid = _class_of(s, taken, bits)[0] if len(s) else None
                    place = (cid or 0) & ((1 << FILTER_BITS) - 1)
                    if len(s) and cid not in known and wanted.value[place >> 6] >> (place & 63) & 1:
                        if len(known) == REMEMBERED:
                            known.clear()
                        known.add(cid)
                        cids.append(cid)
                        tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(tokens, pa.binary())], ["cid", "tokens"])

    return docs.select("id", "text").mapInArrow(run, "cid long, tokens binary").dropDuplicates(["cid"])


def _searched(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the tasks' forests. ``tasks``: task, cid, query, member, label; rows of a task go to one worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def links() -> pa.RecordBatch:
            found = forest(rows, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            *scalars, tokens = batch.columns
            for key, *row, own in zip(*(x.to_pylist() for x in scalars), tokens):
                if key != task:
                    if len(rows) > 1:
                        yield links()
                    task, rows = key, []
                rows.append((*row, np.frombuffer(own.as_buffer(), np.uint64)))
        if len(rows) > 1:
            yield links()

    rows = tasks.join(sets, "cid").select("task", "cid", "query", "member", "label", "tokens")
    return write_shared(rows.repartition("task").sortWithinPartitions("task", "cid").mapInArrow(run, "a long, b long"), "links")


def _units(kept: DataFrame, unit_shingles: int) -> DataFrame:
    """unit, cid, n, s (in how many lists), w (shingles of the unit). ``kept``: list, cid, n, head, w of the lists."""
    comps = write_shared(components(kept.select(F.col("cid").alias("a"), F.col("head").alias("b"))), "families")
    members = kept.groupBy("cid", "n").agg(F.count("*").alias("s")).join(comps.select(F.col("node").alias("cid"), F.col("comp").alias("unit")), "cid")
    members = write_shared(members, "families-of-classes")
    sizes = members.groupBy("unit").agg(F.sum("n").alias("w"))
    work = F.col("w") * (1 + F.col("w") / unit_shingles)
    heads = kept.where("cid = head").select("list", F.col("head").alias("cid"), work.alias("work")).join(members.select("cid", "unit"), "cid")
    parted = heads.groupBy("unit").agg(F.sum("work").alias("in_lists")).join(sizes.where(F.col("w") > unit_shingles), "unit").where(F.col("in_lists") < work)
    parted = write_shared(parted.select("unit"), "parted-families")
    whole = members.join(parted, "unit", "left_anti").join(sizes, "unit").select(F.xxhash64(F.lit(1), "unit").alias("unit"), "cid", "n", "s", "w")
    cids = members.join(parted, "unit", "left_semi").select("cid")
    lists = kept.join(cids, "cid", "left_semi").select(F.xxhash64(F.lit(2), "list").alias("unit"), "cid", "n", F.lit(1).cast("long").alias("s"), "w")
    return write_shared(whole.union(lists), "units")


def _links(kept: DataFrame, sets: DataFrame, percent: int, unit_shingles: int, leaders: int) -> DataFrame:
    """Links that connect all that is connected; ``kept``: list, cid, n, head, w."""
    units = _units(kept, unit_shingles)
    yes, no = F.lit(True), F.lit(False)
    small = units.where(F.col("w") <= unit_shingles)
    links = _searched(small.select(F.col("unit").alias("task"), "cid", yes.alias("query"), yes.alias("member"), F.col("cid").alias("label")), sets, percent)
    large = units.where(F.col("w") > unit_shingles)
    if large.isEmpty():
        return links
    each = max(unit_shingles // 2, 1)
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    large = write_shared(large.withColumn("blocks", F.ceil(F.col("w") / each)), "large-units")
    outside, before, found = large, None, None
    while True:
        salt = F.pmod(F.xxhash64(F.lit(13), "cid"), F.lit(leaders))
        lead = outside.groupBy("unit", salt.alias("salt")).agg(F.max(F.struct("s", "cid")).alias("own"), F.max("blocks").alias("blocks"))
        lead = lead.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("own.cid").alias("cid"), yes.alias("query"), no.alias("member"))
        rows = large.select("unit", block.alias("block"), "cid", no.alias("query"), yes.alias("member")).union(lead)
        more = _searched(rows.select(F.xxhash64("unit", "block").alias("task"), "cid", "query", "member", F.col("cid").alias("label")), sets, percent)
        found = more if found is None else found.union(more)
        comps = components(found).select(F.col("node").alias("cid"), "comp")
        placed = write_shared(large.join(comps, "cid", "left").withColumn("label", F.coalesce("comp", "cid")).drop("comp"), "placed")
        main = placed.groupBy("unit", "label").agg(F.count("*").alias("size")).groupBy("unit").agg(F.max(F.struct("size", "label")).alias("main"))
        outside = write_shared(placed.join(main.select("unit", F.col("main.label").alias("main")), "unit").where("label <> main").drop("main"), "outside")
        now = outside.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not now:
            return links.union(found)
        if now <= each or before is not None and 2 * now > before:
            break
        before = now
    asked = outside.groupBy("unit").agg(F.ceil(F.sum("n") / each).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(17), "cid"), F.col("parts"))
    queries = outside.join(asked, "unit").select("unit", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "cid", yes.alias("query"), no.alias("member"), "label")
    members = placed.join(asked, "unit").select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), block.alias("block"), "cid", no.alias("query"), yes.alias("member"), "label")
    rows = queries.union(members).select(F.xxhash64("unit", "part", "block").alias("task"), "cid", "query", "member", "label")
    return links.union(found).union(_searched(rows, sets, percent))


def near_duplicates(df: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", unit_shingles: int = UNIT_SHINGLES, leaders: int = LEADERS, class_bits: int = 64) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id. ``class_bits``: of the numbers of classes, fewer in tests."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taken: frozenset[int] = frozenset()
    while True:
        rows = write_shared(_profiles(docs, words, taken, class_bits), "profiles")
        own = rows.where("part is null").select("id", "n", "cid", "c2")
        classes = write_shared(own.where("n > 0").groupBy("cid").agg(F.min("id").alias("rep"), F.min("c2").alias("low"), F.max("c2").alias("high")), "classes")
        shared = classes.where("low <> high").select("cid").collect()  # about n^2 / 2^65 of n classes
        if not shared:
            break
        taken |= {r.cid for r in shared}
    levels = spark.sparkContext.broadcast(_frequency_order(rows.where("part is not null").select("part", "counts")))
    lists = write_shared(_lists(_postings(docs, words, percent, taken, class_bits, levels), percent), "lists")
    kept = _kept_lists(lists, percent)

    wanted = spark.sparkContext.broadcast(_filter(kept, "cid").tolist())
    sets = write_shared(_sets(docs, words, taken, class_bits, wanted), "sets")
    links = _links(kept, sets, percent, unit_shingles, leaders)

    comps = write_shared(components(links), "components")
    joined = write_shared(classes.select("cid", "rep").join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").select("cid", "rep", F.coalesce("comp", "cid").alias("comp")), "class-components")
    least = write_shared(joined.groupBy("comp").agg(F.min("rep").alias("component_id")), "component-ids")
    numbered = write_shared(joined.join(least, "comp").select("cid", "component_id"), "class-ids")
    return own.join(numbered, "cid", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component, that with the smallest id (of equal ids, the smallest hash of the text; of
    rows with both equal, any one); its own columns. Rows without words stay. Ids may repeat or be null: rows are told
    apart by a 128-bit hash of id and text."""
    h = F.xxhash64(text_col)
    own = F.concat_ws("-", F.hex(F.xxhash64(F.lit(3), id_col, h)), F.hex(F.xxhash64(F.lit(5), id_col, F.xxhash64(F.lit(7), text_col)))).alias("row_key")
    near = near_duplicates(df.select(own, F.col(text_col).alias("row_text")), words, percent, "row_key", "row_text").where("n_shingles > 0").select("row_key", "component_id").distinct()
    places = df.select(own, F.struct(F.col(id_col).alias("id"), h.alias("h")).alias("place")).groupBy("row_key").agg(F.min("place").alias("place"), F.count("*").alias("copies"))
    rows = write_shared(near.join(places, "row_key"), "near-rows")
    least = rows.groupBy("component_id").agg(F.min(F.struct("place", "row_key")).alias("least"))
    rows = rows.join(least, "component_id").withColumn("stays", F.col("row_key") == F.col("least.row_key"))
    gone = write_shared(rows.where("not stays or copies > 1").select("row_key", "stays"), "gone")
    copy = F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(0)))
    numbered = df.select(*df.columns, own).withColumn("row_copy", copy).join(gone, "row_key", "left")
    return numbered.where(F.col("stays").isNull() | (F.col("stays") & (F.col("row_copy") == 1))).select(*df.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLES: dict[str, str] = {}
