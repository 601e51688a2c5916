"""Ordered analytics over each individual's time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def deltas(df: DataFrame, keys: list[str], order: list[str], **values: str) -> DataFrame:
    """WN-02, WN-03: change of each value against the row before; null in the first row."""
    w = _over(keys, order)
    return df.withColumns({to: F.col(c) - F.lag(c).over(w) for to, c in values.items()})


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, to: str) -> DataFrame:
    """WN-04, WN-09: mean of the rows from k before to k after."""
    return df.withColumn(to, F.avg(value).over(_over(keys, order).rowsBetween(-k, k)))


def islands(df: DataFrame, keys: list[str], order: list[str], fresh: Column, to: str = "island") -> DataFrame:
    """Numbers runs from 1: a row for which ``fresh`` holds begins the next one (the first row always does)."""
    w = _over(keys, order)
    begins = F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_begins", begins).withColumn(to, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def state_intervals(df: DataFrame, keys: list[str], order: list[str], time: str, state: str) -> DataFrame:
    """WN-07: entry and exit of each state of a sequence; exit is the next state's entry, null for the last."""
    w = _over(keys, order)
    runs = islands(df, keys, order, F.col(state) != F.lag(state).over(w))
    spans = runs.groupBy(*keys, "island", state).agg(F.min(time).alias("entered"), F.max(time).alias("last_seen"), F.count("*").alias("n"))
    return spans.withColumn("exited", F.lead("entered").over(_over(keys, ["island"])))


def stationary_fragments(df: DataFrame, keys: list[str], order: list[str], time: str, position: str, max_distance: float, max_gap: int, min_duration: int, max_missing: float, interval: int) -> DataFrame:
    """WN-05: runs without a step over ``max_distance`` or a gap over ``max_gap``; kept if they last ``min_duration`` and
    at most ``max_missing`` of their expected frames are missing."""
    w = _over(keys, order)
    moved = (F.abs(F.col(position) - F.lag(position).over(w)) > max_distance) | (F.col(time) - F.lag(time).over(w) > max_gap)
    runs = islands(df, keys, order, moved).groupBy(*keys, "island").agg(F.min(time).alias("begin"), F.max(time).alias("end"), F.count("*").alias("n"), F.min_by(position, F.struct(*order)).alias("first_position"), F.max_by(position, F.struct(*order)).alias("last_position"))
    expected = F.floor((F.col("end") - F.col("begin")) / interval) + 1
    return runs.where((F.col("end") - F.col("begin") >= min_duration) & (1 - F.col("n") / expected <= max_missing))


def stitched(fragments: DataFrame, keys: list[str], max_gap: int, max_overlap: int, max_distance: float, min_duration: int) -> DataFrame:
    """WN-06: fragments that follow each other within gap, overlap and distance are one path; short paths go. A path
    grows by its latest end so far, so one window pass reaches the fixed point."""
    w = _over(keys, ["begin", "end", "island"])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct("end", "last_position")).over(before)
    gap = F.col("begin") - reach["end"]
    apart = (gap > max_gap) | (-gap > max_overlap) | (F.abs(F.col("first_position") - reach["last_position"]) > max_distance)
    paths = islands(fragments.withColumn("_apart", apart), keys, ["begin", "end", "island"], F.col("_apart"), "path")
    out = paths.groupBy(*keys, "path").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("fragments"), F.sum("n").alias("n"))
    return out.where(F.col("end") - F.col("begin") >= min_duration)


def thirds(df: DataFrame, keys: list[str], order: list[str], to: str = "third") -> DataFrame:
    """WN-08: first, second and last third of each series by rows."""
    return df.withColumn(to, F.ntile(3).over(_over(keys, order)))


def heat_map(df: DataFrame, keys: list[str], order: list[str], bright: Column) -> DataFrame:
    """AG-15: how many frames of each third are bright, one column a third (red, green, blue)."""
    parts = thirds(df.withColumn("_bright", bright.cast("int")), keys, order)
    channel = lambda i: F.coalesce(F.sum(F.when(F.col("third") == i, F.col("_bright"))), F.lit(0))
    frames = lambda i: F.count(F.when(F.col("third") == i, 1))
    return parts.groupBy(*keys).agg(*[channel(i).alias(c) for i, c in ((1, "red"), (2, "green"), (3, "blue"))], *[frames(i).alias(f"n{i}") for i in (1, 2, 3)])


def static_mask(heat: DataFrame, share: float) -> DataFrame:
    """AG-16: bright for that share of one third, and bright at least once in both other thirds."""
    counts, sizes = ("red", "green", "blue"), ("n1", "n2", "n3")
    tests = []
    for i in range(3):
        others = [F.col(counts[j]) > 0 for j in range(3) if j != i]
        tests.append((F.col(counts[i]) >= share * F.col(sizes[i])) & others[0] & others[1])
    return heat.withColumn("static", tests[0] | tests[1] | tests[2])


def static_mask_near(heat: DataFrame, keys: list[str], x: str, y: str, share: float, radius: int = 1) -> DataFrame:
    """AG-16 over an image: a pixel that is bright for that share of one third, with a bright pixel within ``radius`` of it
    in each other third. Every pixel adds its counts to its neighbours, so it is one aggregation without a join."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    own = {c: F.max(F.when((F.col("_o.i") == 0) & (F.col("_o.j") == 0), F.col(c))).alias(c) for c in ("red", "green", "blue", "n1", "n2", "n3")}
    any_near = [F.max(c).alias(f"_{c}") for c in ("red", "green", "blue")]
    spread = heat.withColumn("_o", F.explode(near)).withColumns({x: F.col(x) + F.col("_o.i"), y: F.col(y) + F.col("_o.j")})
    seen = spread.groupBy(*keys, x, y).agg(*own.values(), *any_near).where("red is not null")  # places beyond the image go
    tests = [(F.col(a) >= share * F.col(n)) & (F.col(f"_{b}") > 0) & (F.col(f"_{c}") > 0) for a, n, b, c in (("red", "n1", "green", "blue"), ("green", "n2", "red", "blue"), ("blue", "n3", "red", "green"))]
    return seen.withColumn("static", tests[0] | tests[1] | tests[2]).drop("_red", "_green", "_blue")


def median_filtered(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int, to: str) -> DataFrame:
    """MA-29: element n // 2 of the n sorted values from ``radius`` rows before to as many after."""
    near = F.sort_array(F.collect_list(value).over(_over(keys, order).rowsBetween(-radius, radius)))
    return df.withColumn(to, F.get(near, F.floor(F.size(near) / 2).cast("int")))


def gap_filled(df: DataFrame, keys: list[str], time: str, interval: int, values: list[str]) -> DataFrame:
    """MD-04, AG-20: a row for each step of the grid from the first to the last time; values are carried forward and
    ``inferred`` marks the rows that weren't observed. Of rows in one step the latest counts."""
    step = F.floor(F.col(time) / interval)
    seen = df.withColumn("_s", step).groupBy(*keys, "_s").agg(F.max_by(F.struct(*values), time).alias("_v"))
    grid = seen.groupBy(*keys).agg(F.min("_s").alias("a"), F.max("_s").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(seen, [*keys, "_s"], "left").withColumn("inferred", F.col("_v").isNull()).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return out.select(*keys, (F.col("_s") * interval).alias(time), *[F.col(f"_v.{v}").alias(v) for v in values], "inferred")


def state_counts(df: DataFrame, time: str, state: str, states: list) -> DataFrame:
    """AG-17: individuals in each state at each time, and each state's share."""
    counts = df.groupBy(time).pivot(state, states).agg(F.count(time)).na.fill(0)
    total = sum((F.col(f"`{s}`") for s in states[1:]), F.col(f"`{states[0]}`"))
    return counts.withColumns({f"{s}_share": F.try_divide(F.col(f"`{s}`"), total) for s in states})
