"""Robust statistics, regression and entropy over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PLACES = {"median": 0.5, "p75": 0.75, "p95": 0.95}
#: AG-01: parts of a power of two; a part has at most 2^15 values of single precision, and there are at most 71,000 parts.
PARTS = 256


def _with_group(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of its group; null keys are a group too."""
    named = groups.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return df.join(named, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def _with_part(df: DataFrame) -> DataFrame:
    """AG-01: ``_part``, a whole number that doesn't fall as _v (not negative) rises: its power of two and the place in it."""
    x = F.col("_v").cast("double")
    two = lambda e: F.pow(F.lit(2.0), e)
    near = df.withColumn("_e", F.when((x > 0) & (x < float("inf")), F.floor(F.log2(x))))  # the logarithm may be off by one next to a power of two
    near = near.withColumn("_e", F.when(two(F.col("_e")) > x, F.col("_e") - 1).when(two(F.col("_e") + 1) <= x, F.col("_e") + 1).otherwise(F.col("_e")))
    part = F.col("_e") * PARTS + F.floor((x / two(F.col("_e")) - 1) * PARTS)
    ends = F.when(F.isnan(x), 1 << 20).when(x == float("inf"), (1 << 20) - 1).when(x == 0, -(1 << 20))
    return near.withColumn("_part", ends.otherwise(part)).drop("_e")


def robust_stats(df: DataFrame, keys: list[str], value: Column, compat: bool = True) -> DataFrame:
    """AG-01: max, min, average, sum, median, 75th and 95th percentile of |v| in single precision; a percentile is the
    element floor(n p) of the sorted values. compat: sentinels and zeros for a group whose values are all masked (null).

    No group is sorted or kept in one task, and no row is joined by its group alone: equal values are counted, values are
    counted by parts of powers of two, the part that holds a place is found from those counts, and the value at the place
    from the counts in that part. Both have a fixed bound, whatever the rows of a group."""
    v = df.select(*keys, F.abs(value).cast("float").alias("_v"))
    whole = v.groupBy(*keys).agg(F.count("_v").alias("n"), F.max("_v").alias("max"), F.min("_v").alias("min"), F.avg("_v").alias("avg"), F.sum("_v").alias("sum"))
    values = _with_part(v.where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    group = Window.partitionBy(*keys)
    parts = values.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m")).withColumns({"_n": F.sum("_m").over(group), "_upto": F.sum("_m").over(group.orderBy("_part"))})
    at = [F.struct(F.lit(i).alias("k"), (F.floor(F.col("_n") * p) - F.col("_upto") + F.col("_m")).alias("at")) for i, p in enumerate(PLACES.values())]
    places = parts.select(*keys, "_part", F.explode(F.filter(F.array(*at), lambda r: (r["at"] >= 0) & (r["at"] < F.col("_m")))).alias("_r"))
    near = _with_group(values, places, [*keys, "_part"]).select(*keys, F.col("_r.k").alias("_k"), F.col("_r.at").alias("_at"), "_v", "_c")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy("_v"))
    found = near.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at")))
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == i, F.col("_v"))).alias(name) for i, name in enumerate(PLACES)])
    out = _with_group(whole, picked, keys, "left")
    empty = {"max": -1.17549435e-38, "min": 3.4028234663852886e38} if compat else {}
    shown = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(empty.get(n, 0.0))) if compat else F.col(n).cast("double")
    return out.select(*keys, *[shown(n).alias(n) for n in ("max", "min", "avg", "sum", *PLACES)])


def approximate_stats(df: DataFrame, keys: list[str], value: Column, accuracy: int = 10_000) -> DataFrame:
    """AG-01's approximate form: one pass, a sketch of fixed size for each group."""
    return df.groupBy(*keys).agg(F.max(F.abs(value)).alias("max"), F.percentile_approx(F.abs(value), [0.5, 0.75, 0.95], accuracy).alias("percentiles"))


FLOW_HEADER = ("max", "min", "avg", "median", "75th_percentile", "95th_percentile")


def flow_rows(stats: DataFrame, keys: list[str]) -> DataFrame:
    """SC-13: the columns of the flow statistics file, in its order; the sum is left out."""
    return stats.select(*keys, "max", "min", "avg", "median", F.col("p75").alias("75th_percentile"), F.col("p95").alias("95th_percentile"))


def regression(df: DataFrame, keys: list[str], t: str, y: str, order: list[str], first: int = 0, size: int | None = None, compat: bool = True) -> DataFrame:
    """AG-03, AG-04: slope, intercept and mean squared error of y on t over rows ``first`` to ``first + size`` of each
    group in the given order. compat: offsets are midranges of all points, the first point is left out of every sum but
    counts in n, and no spread gives slope 0. Groups with under two points fail in compat and are null otherwise."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    if first or size is not None:
        rows = rows.where((F.col("_i") >= first) & (F.col("_i") < first + (size if size is not None else 1 << 30)))
    if not compat:
        return rows.groupBy(*keys).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), (F.regr_syy(y, t) / F.count("*") - F.try_divide(F.pow(F.regr_sxy(y, t), 2), F.regr_sxx(y, t)) / F.count("*")).alias("mse"))
    late = F.col("_i") > first
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[((F.sum(F.when(late, F.col(c))) + (F.min(c) + F.max(c)) / 2) / F.count("*")).alias(m) for c, m in ((t, "_mt"), (y, "_my"))])
    both = rows.join(means, keys)
    dt, dy = F.col(t) - F.col("_mt"), F.col(y) - F.col("_my")
    sums = both.where(late).groupBy(*keys, "n", "_mt", "_my").agg(F.sum(dt * dy).alias("ty"), F.sum(dt * dt).alias("tt"), F.sum(dy * dy).alias("yy"))
    slope = F.when(F.col("tt") == 0, 0.0).otherwise(F.try_divide(F.col("ty"), F.col("tt")))
    out = sums.withColumn("slope", slope).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mt"))
    # sum of (dy - slope dt)^2
    return out.select(*keys, "slope", "intercept", ((F.col("yy") - 2 * F.col("slope") * F.col("ty") + F.pow("slope", F.lit(2)) * F.col("tt")) / F.col("n")).alias("mse"))


def entropy(p: Column) -> Column:
    """AG-14, as an aggregate."""
    return -F.sum(p * F.ln(F.greatest(p, F.lit(1e-6))))


def trapezoid(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """MA-22: integral of v over t."""
    w = Window.partitionBy(*keys).orderBy(t, v)
    area = (F.col(t) - F.lag(t).over(w)) * (F.col(v) + F.lag(v).over(w)) / 2
    return df.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("integral"))


def arc_length(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """MA-23: running length of a polyline."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("_s", step).withColumn("length", F.sum("_s").over(w)).drop("_s")
