"""Movement models: thresholds, transitions, hidden Markov models, mixtures, clustering, assignment and path linking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import band_join


def threshold_states(df: DataFrame, keys: list[str], t: str, score: str, posture: float, vigorous: float) -> DataFrame:
    """MD-06: last time at or over each threshold; the posture one is the death time. An individual that never crosses it
    or still does when last seen is censored."""
    last = lambda x: F.max(F.when(F.col(score) >= x, F.col(t)))
    out = df.groupBy(*keys).agg(last(vigorous).alias("vigorous_until"), last(posture).alias("death_time"), F.max(t).alias("last_seen"))
    return out.withColumn("censored", F.col("death_time").isNull() | (F.col("death_time") == F.col("last_seen")))


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str, smoothing: float = 0.0) -> DataFrame:
    """MD-10: counts and shares of consecutive states within an individual."""
    prev = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    counts = df.select(prev.alias("prev"), F.col(state).alias("cur")).where("prev is not null").groupBy("prev", "cur").agg(F.count("*").alias("n"))
    share = (F.col("n") + smoothing) / F.sum(F.col("n") + smoothing).over(Window.partitionBy("prev"))
    return counts.withColumn("p", share)


def best_threshold(df: DataFrame, truth: DataFrame, key: str, t: str, score: str, grid: list[float]) -> DataFrame:
    """MD-11: the threshold whose last crossing is nearest to the truth on average. One scan: an aggregate for each grid
    value, then one row for each pair."""
    last = [F.max(F.when(F.col(score) >= x, F.col(t))).alias(f"g{i}") for i, x in enumerate(grid)]
    found = df.groupBy(key).agg(*last).join(truth, key)
    pairs = found.select("truth", F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.coalesce(f"g{i}", F.lit(0)).alias("found")) for i, x in enumerate(grid)])).alias("x"))
    errors = pairs.groupBy("x.threshold").agg(F.avg(F.abs(F.col("x.found") - F.col("truth"))).alias("error"))
    return errors.orderBy("error", "threshold").limit(1)


def folds(key: Column, k: int) -> Column:
    """MD-09: fold of a subject, the same for all its rows."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def cross_validated(df: DataFrame, subject: str, k: int, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """MD-09: ``score(training, held_out)`` for each fold, with the fold's number."""
    out = None
    for i in range(k):
        part = score(df.where(folds(F.col(subject), k) != i), df.where(folds(F.col(subject), k) == i)).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def order_mask(n: int, scheme: str) -> np.ndarray:
    """MD-10's orderings as -inf masks of the transition matrix: flexible allows all, strict only staying or the next
    state, simultaneous any later one."""
    i, j = np.indices((n, n))
    allowed = {"flexible": np.ones((n, n), bool), "strict": (j == i) | (j == i + 1), "simultaneous": j >= i}[scheme]
    return np.where(allowed, 0.0, -np.inf)


def viterbi(log_start: np.ndarray, log_step: np.ndarray, log_emit: np.ndarray) -> tuple[np.ndarray, float]:
    """MD-07: the best state path and its log score; ties go to the lowest state."""
    score, back = log_start + log_emit[0], np.zeros(log_emit.shape, int)
    for t in range(1, len(log_emit)):
        way = score[:, None] + log_step
        back[t] = way.argmax(0)
        score = way.max(0) + log_emit[t]
    path = np.empty(len(log_emit), int)
    path[-1] = score.argmax()
    for t in range(len(log_emit) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path, float(score.max())


def gaussian_log(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean[None]) ** 2 / var[None])


def baum_welch(x: np.ndarray, mean: np.ndarray, var: np.ndarray, step: np.ndarray, start: np.ndarray, rounds: int) -> tuple:
    """MD-07: EM for a Gaussian hidden Markov model on one series, scaled forward and backward."""
    for _ in range(rounds):
        emit = np.exp(gaussian_log(x, mean, var)) + 1e-300
        a, scale = np.empty(emit.shape), np.empty(len(x))
        now = start * emit[0]
        for t in range(len(x)):
            if t:
                now = a[t - 1] @ step * emit[t]
            scale[t] = now.sum()
            a[t] = now / scale[t]
        b = np.ones(emit.shape)
        for t in range(len(x) - 2, -1, -1):
            b[t] = step @ (emit[t + 1] * b[t + 1]) / scale[t + 1]
        gamma = a * b
        gamma /= gamma.sum(1, keepdims=True)
        pair = sum(a[t][:, None] * step * (emit[t + 1] * b[t + 1])[None] / scale[t + 1] for t in range(len(x) - 1))
        weight = gamma.sum(0)
        mean = (gamma * x[:, None]).sum(0) / weight
        var = np.maximum((gamma * (x[:, None] - mean[None]) ** 2).sum(0) / weight, 1e-3)
        step, start = pair / pair.sum(1, keepdims=True), gamma[0]
    return mean, var, step, start


def hmm_states(df: DataFrame, key: str, order: list[str], value: str, means: list[float], sds: list[float], step: list[list[float]], scheme: str = "flexible", loglikelihood: bool = False) -> DataFrame:
    """MD-07, MD-08, WN-11: the state of each row by the best path of its individual; with ``loglikelihood`` the path's
    log score is a column. An individual's series is one group; its length bounds the memory."""
    with np.errstate(divide="ignore"):
        log_step = np.log(np.array(step)) + order_mask(len(means), scheme)
    log_start = np.log(np.full(len(means), 1 / len(means)))
    mean, var = np.array(means), np.array(sds) ** 2

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        path, score = viterbi(log_start, log_step, gaussian_log(frame[value].to_numpy(float), mean, var))
        return frame.assign(state=path, loglikelihood=score)

    kinds = dict(df.dtypes)
    columns = [key, *[c for c in order if c != key], value]
    out = df.select(*columns).groupBy(key).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", state int, loglikelihood double")
    return out if loglikelihood else out.drop("loglikelihood")


ANALYSERS: dict[str, Callable[..., DataFrame]] = {"threshold": threshold_states, "hmm": hmm_states}


def analyse(name: str, *args, **kwargs) -> DataFrame:
    """MD-08, section 2.13: the registered analyser of that name."""
    if name not in ANALYSERS:
        raise ValueError(f"unknown analyser: {name}")
    return ANALYSERS[name](*args, **kwargs)


def assignment(cost: np.ndarray, maximise: bool = False) -> np.ndarray:
    """JN-11: column of each row in a least-cost one-to-one assignment (shortest augmenting paths with potentials); a
    rectangular matrix is padded with 0, and -1 stands for padding."""
    rows, cols = cost.shape
    n = max(rows, cols)
    c = np.zeros((n, n))
    c[:rows, :cols] = -cost if maximise else cost
    u, v, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for row in range(n):
        least, seen, came, at, col = np.full(n, np.inf), np.zeros(n, bool), np.full(n, -1), row, -1
        while True:
            slack = c[at] - u[at] - v
            better = ~seen & (slack < least)
            least[better], came[better] = slack[better], col
            free = np.where(seen, np.inf, least)
            nxt = int(free.argmin())
            step = free[nxt]
            u[row] += step
            for j in np.flatnonzero(seen):
                u[owner[j]] += step
            v[seen] -= step
            least[~seen] -= step
            seen[nxt], col = True, nxt
            if owner[nxt] < 0:
                break
            at = owner[nxt]
        while col >= 0:
            before = came[col]
            owner[col] = owner[before] if before >= 0 else row
            col = before
    out = np.full(rows, -1)
    for j, i in enumerate(owner):
        if i < rows and j < cols:
            out[i] = j
    return out


def assignments(cost: Callable[[np.ndarray, np.ndarray], np.ndarray], many: int, n: int) -> np.ndarray:
    """JN-11 for ``many`` problems of n rows and n columns at once, by the same method: column of each row of each problem.
    ``cost(p, i)`` has the costs of row i[k] of problem p[k] as its row k, all finite; no matrix is kept."""
    u, v = np.zeros((many, n)), np.zeros((many, n))
    column, owner = np.full((many, n), -1), np.full((many, n), -1)
    for row in range(n):
        least, came, seen = np.full((many, n), np.inf), np.full((many, n), -1), np.zeros((many, n), bool)
        last, total = np.empty(many, int), np.empty(many)
        p, at, far = np.arange(many), np.full(many, row), np.zeros(many)
        while len(p):
            way = far[:, None] + cost(p, at) - u[p, at][:, None] - v[p]
            taken, best = seen[p], least[p]
            better = ~taken & (way < best)
            best = np.where(better, way, best)
            least[p], came[p] = best, np.where(better, at[:, None], came[p])
            nxt = np.where(taken, np.inf, best).argmin(1)
            far = best[np.arange(len(p)), nxt]
            seen[p, nxt] = True
            at = owner[p, nxt]
            end = at < 0
            last[p[end]], total[p[end]] = nxt[end], far[end]
            p, at, far = p[~end], at[~end], far[~end]
        gain = np.where(seen, total[:, None] - np.where(seen, least, 0.0), 0.0)
        v -= gain
        u[:, row] += total
        k, j = np.nonzero(seen & (owner >= 0))
        u[k, owner[k, j]] += gain[k, j]
        p, to = np.arange(many), last
        while len(p):
            i = came[p, to]
            owner[p, to] = i
            before, column[p, i] = column[p, i], to
            p, to = p[i != row], before[i != row]
    return column


#: JN-11: rows times columns' worth of numbers that one call of ``assignments`` keeps in each of its arrays.
AT_ONCE = 1 << 18


def assigned(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """JN-11: for each key its number of rows and the cost of the least-cost assignment of their x to their y, by
    distance. Keys of the same number of rows are solved together; a key is in one task, its memory grows with its rows. A
    pair with a missing value costs nothing."""
    kind = dict(df.dtypes)[key]

    def distance(x: np.ndarray, y: np.ndarray, infinite: float) -> np.ndarray:
        return np.nan_to_num(np.abs(x - y), copy=False, nan=0.0, posinf=infinite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_pairs")
            begin, size = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
            a, b = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = np.zeros(len(size))
            for n in np.unique(size):
                alike = np.flatnonzero(size == n)
                step = max(1, AT_ONCE // int(n))
                for part in (alike[i : i + step] for i in range(0, len(alike), step)):
                    at = begin[part][:, None] + np.arange(n)
                    ax, by = a[at], b[at]
                    to = assignments(lambda p, i: distance(ax[p, i][:, None], by[p], 1e300), len(part), int(n))  # noqa: B023
                    out[part] = distance(ax, np.take_along_axis(by, to, 1), np.inf).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(out)], [key, "n", "cost"])

    pairs = df.select(key, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("_pair"))
    return pairs.groupBy(key).agg(F.collect_list("_pair").alias("_pairs")).mapInArrow(run, f"`{key}` {kind}, n long, cost double")


def linked_objects(df: DataFrame, region: str, t: str, x: str, object_id: str, max_gap: int, max_distance: float) -> DataFrame:
    """JN-10, MD-03, A6: candidates by a band join within time gap and distance; a pair is a link if each is the other's
    best (distance, then time, then ids), which is one-to-one without a driver loop."""
    a = df.select(region, F.col(t).alias("t1"), F.col(x).alias("x1"), F.col(object_id).alias("a"))
    b = df.select(region, F.col(t).alias("t2"), F.col(x).alias("x2"), F.col(object_id).alias("b"))
    pairs = band_join(a, b, [region], "t1", "t2", max_gap).where((F.col("t2") > F.col("t1")) & (F.abs(F.col("x1") - F.col("x2")) <= max_distance))
    cost = F.struct(F.abs(F.col("x1") - F.col("x2")).alias("distance"), (F.col("t2") - F.col("t1")).alias("gap"), "a", "b")
    scored = pairs.select(region, "a", "b", cost.alias("cost"))
    best = scored.withColumn("best_a", F.min("cost").over(Window.partitionBy(region, "a"))).withColumn("best_b", F.min("cost").over(Window.partitionBy(region, "b")))
    return best.where("cost = best_a and cost = best_b").select(region, "a", "b", "cost.distance", "cost.gap")


def diagonal_em(x: np.ndarray, start: np.ndarray, rounds: int = 250, stop: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """MD-18, MD-19: EM for a mixture with diagonal covariances from given means: weights, means, variances (at least 1 %
    of the overall ones) and the log-likelihood."""
    floor = np.maximum(0.01 * x.var(0), 1e-12)
    mean, var, weight, before = start.astype(float).copy(), np.tile(np.maximum(x.var(0), floor), (len(start), 1)), np.full(len(start), 1 / len(start)), -np.inf
    for _ in range(rounds):
        log = np.log(weight)[None] - 0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean[None]) ** 2 / var[None]).sum(2)
        top = log.max(1, keepdims=True)
        each = np.exp(log - top)
        total = each.sum(1, keepdims=True)
        now = float((np.log(total) + top).sum())
        r = each / total
        n = r.sum(0) + 1e-12
        weight, mean = n / n.sum(), r.T @ x / n[:, None]
        var = np.maximum(r.T @ (x * x) / n[:, None] - mean * mean, floor)
        if abs(now - before) < stop * abs(now):
            break
        before = now
    return weight, mean, var, now


def mixture(df: DataFrame, vector: str, start: list[list[float]], rounds: int = 250, stop: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """MD-18 over a whole table: the same EM with one scan a round, whose partitions send k rows of sums. Weights, means,
    variances, log-likelihood and number of rows."""
    mean = np.array(start, float)
    k, width = mean.shape
    weight, var, floor, before, now, n = np.full(k, 1 / k), None, None, -np.inf, -np.inf, 0
    kept = df.select(vector).persist(StorageLevel.MEMORY_AND_DISK)  # a lost executor's part is read again
    for _ in range(rounds + 1):
        sent = df.sparkSession.sparkContext.broadcast((weight, mean, var))

        def sums(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            w, m, v = sent.value
            r0, r1, r2, score, rows = np.zeros(k), np.zeros((k, width)), np.zeros((k, width)), 0.0, 0
            for frame in frames:
                if len(frame):
                    x = np.stack(frame[vector].to_numpy()).astype(float)
                    if v is None:  # the first scan has the overall moments
                        r = np.full((len(x), k), 1 / k)
                    else:
                        log = np.log(w)[None] - 0.5 * (np.log(2 * np.pi * v)[None] + (x[:, None] - m[None]) ** 2 / v[None]).sum(2)
                        top = log.max(1, keepdims=True)
                        each = np.exp(log - top)
                        total = each.sum(1, keepdims=True)
                        score += float((np.log(total) + top).sum())
                        r = each / total
                    r0, r1, r2, rows = r0 + r.sum(0), r1 + r.T @ x, r2 + r.T @ (x * x), rows + len(x)
            yield pd.DataFrame({"k": range(k), "r0": r0, "score": score, "rows": rows, "r1": list(r1), "r2": list(r2)})

        parts = kept.mapInPandas(sums, "k int, r0 double, score double, rows long, r1 array<double>, r2 array<double>")
        wide = [F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c in ("r1", "r2") for i in range(width)]
        got = parts.groupBy("k").agg(F.sum("r0").alias("r0"), F.sum("score").alias("score"), F.sum("rows").alias("rows"), *wide).orderBy("k").collect()
        r0 = np.array([r["r0"] for r in got]) + 1e-12
        r1, r2 = (np.array([[r[f"{c}_{i}"] for i in range(width)] for r in got]) for c in ("r1", "r2"))
        n = got[0]["rows"]
        if var is None:
            overall = np.maximum(r2.sum(0) / n - (r1.sum(0) / n) ** 2, 1e-12)
            floor, var = np.maximum(0.01 * overall, 1e-12), np.tile(overall, (k, 1))
            continue
        now = got[0]["score"]
        weight, mean = r0 / r0.sum(), r1 / r0[:, None]
        var = np.maximum(r2 / r0[:, None] - mean * mean, floor)
        if abs(now - before) < stop * abs(now):
            break
        before = now
    kept.unpersist()
    return weight, mean, var, now, n


def bic(loglikelihood: float, n: int, components: int, dimensions: int) -> float:
    """MD-19."""
    return -2 * loglikelihood + (components * (2 * dimensions + 1) - 1) * np.log(n)


def lloyd(df: DataFrame, vector: str, start: list[list[float]], rounds: int) -> np.ndarray:
    """MD-20: k-means from given centres. Each round is one scan whose partitions send sums only (k rows each)."""
    centre = np.array(start, float)
    kept = df.select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        sent = df.sparkSession.sparkContext.broadcast(centre)

        def sums(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            c = sent.value
            total, n = np.zeros(c.shape), np.zeros(len(c), int)
            for frame in frames:
                if len(frame):
                    x = np.stack(frame[vector].to_numpy()).astype(float)
                    near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"k": range(len(c)), "n": n, "total": list(total)})

        parts = kept.mapInPandas(sums, "k int, n long, total array<double>")
        width = centre.shape[1]
        added = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)]).orderBy("k").collect()
        new = np.array([[r[f"s{i}"] for i in range(width)] for r in added]) / np.maximum(np.array([[r["n"]] for r in added]), 1)
        empty = np.array([r["n"] == 0 for r in added])
        new[empty] = centre[empty]
        if np.allclose(new, centre):
            break
        centre = new
    kept.unpersist()
    return centre


def nearest_centre(df: DataFrame, vector: str, centres: np.ndarray, to: str = "cluster") -> DataFrame:
    """MD-20: label of the nearest centre, by built-in array functions."""
    gaps = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres]
    nearest = F.array_min(F.array(*[F.struct(g.alias("gap"), F.lit(i).alias("k")) for i, g in enumerate(gaps)]))
    return df.withColumn(to, nearest["k"])
