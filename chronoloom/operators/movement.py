"""Movement analysis as a whole: observations to paths, deaths and survival; folds of the hidden Markov model; clusters
of touching individuals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models as M
from . import ordered as O
from . import survival as V


def paths(df: DataFrame, keys: list[str], order: list[str], time: str, position: str, distance: float, gap: int, interval: int, stitch_gap: int, stitch_distance: float, duration: int) -> DataFrame:
    """MD-03: fragments of observations, joined to paths."""
    parts = O.stationary_fragments(df, keys, order, time, position, distance, gap, 0, 1.0, interval)
    return O.stitched(parts, keys, stitch_gap, 0, stitch_distance, duration)


def analysed(df: DataFrame, found: DataFrame, keys: list[str], time: str, score: str, posture: float, vigorous: float) -> DataFrame:
    """MD-01, MD-23: each path of a region with its death time by thresholds. An observation belongs to the path of its
    keys that spans its time."""
    spans = found.select(*keys, "path", F.col("begin").alias("_begin"), F.col("end").alias("_end"))
    of_path = df.join(spans, keys).where(F.col(time).between(F.col("_begin"), F.col("_end")))
    states = M.threshold_states(of_path, [*keys, "path"], time, score, posture, vigorous)
    return states.join(spans, [*keys, "path"]).withColumnRenamed("_begin", "begin").drop("_end")


def survival_of(individuals: DataFrame, region: str, unit: int) -> DataFrame:
    """MD-01: one curve a region over the ages at death, or at the last sight of a censored individual."""
    age = F.floor((F.coalesce("death_time", "last_seen") - F.col("begin")) / unit)
    return V.kaplan_meier(individuals.select(region, age.alias("age"), (~F.col("censored")).alias("died")), [region], "age", F.col("died"))


def trained_hmm(df: DataFrame, key: str, order: list[str], value: str, state: str, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MD-09, MD-10: means, deviations and transitions (with one more of each) from rows whose state, 0 to ``states`` - 1,
    is known. The driver gets one row a state and one a transition."""
    moments = {r[state]: (r["m"], r["s"]) for r in df.groupBy(state).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).collect()}
    counts = np.ones((states, states))
    for r in M.transitions(df, [key], order, state).collect():
        counts[r["prev"], r["cur"]] += r["n"]
    mean, sd = np.array([moments.get(k, (0.0, 1.0)) for k in range(states)], float).T
    return mean, np.maximum(sd, 1e-6), counts / counts.sum(1, keepdims=True)


def hmm_folds(df: DataFrame, key: str, order: list[str], value: str, state: str, states: int, fold: Column, k: int) -> DataFrame:
    """MD-09: for each fold the share of the held-out rows whose state the model of the other subjects finds. ``fold`` may
    go by subject, genotype or experiment, as long as a subject is in one fold."""
    out = None
    for i in range(k):
        mean, sd, step = trained_hmm(df.where(fold != i), key, order, value, state, states)
        held = M.hmm_states(df.where(fold == i), key, order, value, list(mean), list(sd), step.tolist()).withColumnRenamed("state", "_found")
        right = held.join(df.select(*order, F.col(state).alias("_truth")), order)
        part = right.agg(F.lit(i).alias("fold"), F.count("*").alias("n"), F.avg((F.col("_found") == F.col("_truth")).cast("int")).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


def hybrid_states(df: DataFrame, key: str, order: list[str], value: str, posture: float, vigorous: float, **model) -> DataFrame:
    """MD-08: states by the hidden Markov model up to the death time that the threshold gives, and -1 after it."""
    deaths = M.threshold_states(df, [key], order[0], value, posture, vigorous).select(key, F.when(~F.col("censored"), F.col("death_time")).alias("_death"))
    states = M.hmm_states(df, key, order, value, **model).join(deaths, key)
    return states.withColumn("state", F.when(F.col(order[0]) > F.col("_death"), -1).otherwise(F.col("state"))).drop("_death")


M.ANALYSERS["hybrid"] = hybrid_states


def chains(ends: list[tuple[int, int]]) -> list[int]:
    """MD-14: every set of segments that lie end to end as one line without a loop, as bits."""
    todo = [(1 << i, *pair) for i, (a, b) in enumerate(ends) if a != b for pair in ((a, b), (b, a))]
    nodes = {mask: frozenset((a, b)) for mask, a, b in todo}
    seen = set(todo)
    while todo:
        mask, head, tail = todo.pop()
        for i, pair in enumerate(ends):
            for near, far in (pair, pair[::-1]):
                if not mask >> i & 1 and near == tail and far not in nodes[mask]:
                    more = mask | 1 << i
                    nodes[more] = nodes[mask] | {far}
                    for longer in ((more, head, far), (more, far, head)):  # it may go on at either end
                        if longer not in seen:
                            seen.add(longer)
                            todo.append(longer)
    return sorted(nodes)


#: MD-14: the chains of the arrangements of segments that a worker has met.
_chains = lru_cache(maxsize=1 << 12)(lambda ends: chains(list(ends)))


def divided(ends: tuple[tuple[int, int], ...], lengths: np.ndarray, expected: float, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """MD-14 for clusters of one arrangement, a row of ``lengths`` each: for 1 to ``most`` individuals the least cost of
    each cluster and its chains as bits, the least such chains if costs are equal; counts that can't be are left out."""
    many, n = lengths.shape
    bits = np.int64 if n < 63 else object
    of_first: dict[int, list[tuple[int, np.ndarray]]] = {}
    for mask in _chains(ends):
        cost = np.abs(lengths[:, [i for i in range(n) if mask >> i & 1]].sum(1) - expected)
        of_first.setdefault((mask & -mask).bit_length() - 1, []).append((mask, cost))
    level, full, out = {0: (np.zeros(many), np.empty((many, 0), bits))}, (1 << n) - 1, {}
    for k in range(1, most + 1):
        after: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for done, (cost, parts) in level.items():
            if done == full:
                continue
            lowest = (~done & -~done).bit_length() - 1
            for mask, more in of_first.get(lowest, ()):
                if not mask & done:
                    total, chosen = cost + more, np.column_stack([parts, np.full(many, mask, bits)])
                    if done | mask in after:
                        known, before = after[done | mask]
                        less, even = total < known, total == known
                        for i in range(k):
                            less |= even & (chosen[:, i] < before[:, i])
                            even &= chosen[:, i] == before[:, i]
                        total, chosen = np.where(less, total, known), np.where(less[:, None], chosen, before)
                    after[done | mask] = total, chosen
        level = after
        if full in level:
            out[k] = level[full]
    return out


def best_by_count(ends: list[tuple[int, int]], lengths: list[float], expected: float, most: int) -> dict[int, tuple[float, tuple[int, ...]]]:
    """MD-14: for 1 to ``most`` individuals the division of all segments into that many chains with the least total
    difference between a chain's length and the expected one; counts that can't be are left out."""
    found = divided(tuple(ends), np.array([lengths], float), expected, most)
    return {k: (float(cost[0]), tuple(int(x) for x in parts[0])) for k, (cost, parts) in found.items()}


def _arrangements(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct arrangements of rows of segments, whose points are numbered by where they stand first, and each row's."""
    points = np.stack([start, end], 2).reshape(len(start), -1)
    first = (points[:, :, None] == points[:, None, :]).argmax(2)
    if (first == first[:1]).all():
        return first[:1], np.zeros(len(first), int)
    return np.unique(first, axis=0, return_inverse=True)


def _lists(names: pa.Array, begin: np.ndarray, parts: np.ndarray, n: int) -> pa.Array:
    """Lists of the chains' lists of names; a cluster's n names begin at ``begin``."""
    kinds, kind = np.unique(parts, axis=0, return_inverse=True) if parts.dtype != object else (parts, np.arange(len(parts)))
    places = np.array([[i for mask in row for i in range(n) if int(mask) >> i & 1] for row in kinds])
    sizes = np.array([[int(mask).bit_count() for mask in row] for row in kinds])
    inner = np.concatenate([[0], np.cumsum(sizes[kind.ravel()])]).astype(np.int32)
    chosen = names.take(pa.array((begin[:, None] + places[kind.ravel()]).ravel()))
    return pa.ListArray.from_arrays(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1], pa.ListArray.from_arrays(inner, chosen))


def disambiguated(df: DataFrame, cluster: str, segment: str, start: str, end: str, length: str, expected: float, most: int) -> DataFrame:
    """MD-14: a row for each cluster and number of individuals: the cost and the lists of segments of the best division.
    A cluster is a handful of touching segments, kept together as one array; those of the same arrangement are divided
    together."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(segment).alias("segment"), F.col(start).alias("start"), F.col(end).alias("end"), F.col(length).cast("double").alias("length"))))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            offsets = lists.offsets.to_numpy()
            names, *points, lengths = (lists.values.field(i) for i in range(4))
            if lengths.null_count:
                raise ValueError("a segment without a length")
            codes = pd.factorize(pa.chunked_array(points).to_pandas(), use_na_sentinel=False)[0].reshape(2, -1)
            lengths, size, out = lengths.to_numpy(), np.diff(offsets), []
            for n in np.unique(size):
                alike = np.flatnonzero(size == n)
                at = offsets[alike][:, None] + np.arange(n)
                shapes, shape = _arrangements(codes[0][at], codes[1][at])
                for j, ends in enumerate(shapes.reshape(len(shapes), -1, 2).tolist()):
                    those = shape.ravel() == j
                    for k, (cost, masks) in divided(tuple(map(tuple, ends)), lengths[at[those]], expected, most).items():
                        of = batch.column(0).take(pa.array(alike[those]))
                        out.append(pa.RecordBatch.from_arrays([of, pa.array(np.full(len(of), k, np.int32)), pa.array(cost), _lists(names, at[those][:, 0], masks, int(n))], [cluster, "individuals", "cost", "members"]))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    schema = f"`{cluster}` {kinds[cluster]}, individuals int, cost double, members array<array<{kinds[segment]}>>"
    return df.groupBy(cluster).agg(parts.alias("parts")).mapInArrow(run, schema)


def spline_basis(u: Column, controls: int) -> list[Column]:
    """MA-24: values of the uniform cubic B-splines at u, 0 to 1."""
    z = u * (controls - 3)
    out = []
    for j in range(controls):
        d = F.abs(z - (j - 1))
        out.append(F.when(d < 1, 2 / 3 - d * d + d * d * d / 2).when(d < 2, F.pow(2 - d, 3) / 6).otherwise(0.0))
    return out


#: MA-24: control points of the four levels, smoothest first.
SMOOTHNESS = (4, 6, 10, 18)


def spline_fit(df: DataFrame, keys: list[str], x: str, y: str, level: int = 0, ridge: float = 1e-9) -> DataFrame:
    """MA-24: control points of each group's least-squares cubic spline, with the range of x. The sums are aggregated over
    the cluster, whatever a group's size; only the small systems are solved in Python."""
    n = SMOOTHNESS[level]
    bounds = df.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    u = F.coalesce(F.try_divide(F.col(x) - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    base = df.join(bounds, keys).withColumn("_b", F.array(*spline_basis(u, n))).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = lambda i: F.get("_b", F.lit(i))
    gram = [F.sum(b(i) * b(j)) for i in range(n) for j in range(i + 1)]
    sums = base.groupBy(*keys, "low", "high").agg(F.array(*gram).alias("gram"), F.array(*[F.sum(b(i) * F.col(y)) for i in range(n)]).alias("right"))
    places = [(i, j) for i in range(n) for j in range(i + 1)]

    @F.pandas_udf("array<double>")
    def solved(gram: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for g, r in zip(gram, right):
            a = np.zeros((n, n))
            for (i, j), v in zip(places, g):
                a[i, j] = a[j, i] = v
            out.append(np.linalg.solve(a + ridge * max(a.trace(), 1.0) * np.eye(n), np.asarray(r)))
        return pd.Series(out)

    return sums.select(*keys, "low", "high", solved("gram", "right").alias("controls"))


def spline_value(x: Column, low: Column, high: Column, controls: Column, level: int = 0) -> Column:
    """MA-24: the fitted spline at x."""
    u = F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))
    return F.aggregate(F.zip_with(F.array(*spline_basis(u, SMOOTHNESS[level])), controls, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
