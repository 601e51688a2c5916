"""Relational building blocks: joins with defined choices, rewrites that stand for updates, and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """WN-01: the first row of each key in the given order (descending time first, then a tie-breaker)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def exactly_one_row(df: DataFrame) -> DataFrame:
    """SC-02: ``df`` if it has one row; else the plan fails when it runs. Nothing is collected for it."""
    counted = df.agg(F.assert_true(F.count("*") == 1, F.lit("exactly one row was expected")).alias("_ok"), F.first(F.struct(*df.columns)).alias("_row"))
    return counted.where("_ok is null").select("_row.*")


def scalar(df: DataFrame) -> DataFrame:
    """SC-03: the first column of the only row."""
    return exactly_one_row(df).select(df.columns[0])


def first_match_join(left: DataFrame, right: DataFrame, key: str, value: str, *order: Column, missing="") -> DataFrame:
    """JN-04: left join to the first row of ``right`` for the key, and a value for no match."""
    first = latest_per_key(right, [key], *order).select(key, value)
    return left.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def lookup_or_id(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: Column, to: str) -> DataFrame:
    """JN-05, PF-08: a name by key, or the key itself as text if nothing is known of it. Spark broadcasts the lookup
    side if its measured size allows it."""
    known = right.select(F.col(right_key).alias("_key"), name.alias("_name"))
    return left.join(known, F.col(left_key) == F.col("_key"), "left").withColumn(to, F.coalesce("_name", F.col(left_key).cast("string"))).drop("_key", "_name")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, to: str) -> DataFrame:
    """JN-12: for each left row the value of the latest right row at or before it (of equal times the greatest value):
    one union and one window instead of a theta join."""
    columns = left.columns
    a = left.select("*", F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in (*keys, time) else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in columns], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(to, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*columns, to)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, width: int) -> DataFrame:
    """JN-10's join: right times within 0 to ``width`` after the left ones. Times fall into buckets of that width, a left
    row goes to its own and the next one, so the join is an equi-join and each pair matches once."""
    bucket = lambda t: F.floor(F.col(t) / width)
    a = left.withColumn("_b", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    b = right.withColumn("_b", bucket(right_time))
    gap = F.col(right_time) - F.col(left_time)
    return a.join(b, [*keys, "_b"]).where((gap >= 0) & (gap <= width)).drop("_b")


def merged_annotations(by_hand: DataFrame, machine: DataFrame, key: str, values: list[str]) -> DataFrame:
    """JN-15: full outer join; what was set by hand comes before what the machine found."""
    a, b = by_hand.alias("a"), machine.alias("b")
    chosen = [F.coalesce(f"a.{v}", f"b.{v}").alias(v) for v in values]
    source = F.when(F.col(f"a.{key}").isNotNull(), "hand").otherwise("machine").alias("source")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *chosen, source)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """DM-01, DM-02: the rewrite that stands for UPDATE ... WHERE; a null condition is no match."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def update_from(df: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """DM-03, JN-03: UPDATE ... FROM a source with one row a key."""
    new = source.select(*keys, F.col(column).alias("_new"))
    return df.join(new, keys, "left").select(*[F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in df.columns])


def delete_matching(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DM-04, DM-06: DELETE by key."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def latest_status(log: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """DM-05: the state of a queue that is kept as a log of appended status rows."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def fetch_jobs(jobs: DataFrame, n: int, priority: Column, *ties: str) -> DataFrame:
    """SO-07: the first n jobs, larger priority first; planned as a top-k, not as a whole sort."""
    return jobs.orderBy(priority.desc(), *ties).limit(n)


def updated_queue(log: DataFrame, key: str, priority: str, gone: Column, n: int, *order: str) -> DataFrame:
    """SO-09: the n least priorities of a queue that is kept as a log of inserts, updates and removals: each key's last
    row counts, and a top-k takes the least."""
    last = log.groupBy(key).agg(F.max_by(F.struct(F.col(priority), gone.alias("_gone")), F.struct(*order)).alias("_v"))
    return last.where("not _v._gone").select(key, F.col(f"_v.{priority}").alias(priority)).orderBy(priority, key).limit(n)


def same_region(a: str, b: str, unit: str) -> Column:
    """WN-10: equality of two temporal regions, structs of frame_start, frame_duration, real_start and real_duration, in
    ``frames`` or in ``real_time``."""
    part = {"frames": ("frame_start", "frame_duration"), "real_time": ("real_start", "real_duration")}[unit]
    return F.col(f"{a}.{part[0]}").eqNullSafe(F.col(f"{b}.{part[0]}")) & F.col(f"{a}.{part[1]}").eqNullSafe(F.col(f"{b}.{part[1]}"))


def next_page_size(n: Column) -> Column:
    """SO-03: 0 to 25; below 400 twice as many; then 0, all."""
    return F.when(n == 0, 25).when(n < 400, 2 * n).otherwise(0)


def newest(df: DataFrame, time: str, n: int, *ties: str) -> DataFrame:
    """SO-02: newest first, at most n rows; n = 0 means all."""
    out = df.orderBy(F.col(time).desc(), *ties)
    return out.limit(n) if n else out


def pivot_stats(df: DataFrame, row: str, column: str, values: list, **stats: Column) -> DataFrame:
    """AG-08: one row for each row key with the statistics of the listed column keys side by side."""
    return df.groupBy(row).pivot(column, values).agg(*[c.alias(n) for n, c in stats.items()])


def set_difference(names: DataFrame, excluded: list) -> DataFrame:
    """SE-01: rows of a one-column list that aren't excluded."""
    return names.where(~F.col(names.columns[0]).isin(excluded))


def disjoint_parts(df: DataFrame, **conditions: Column) -> DataFrame:
    """SE-03: the name of the first condition that holds, as ``part``; null if none does."""
    part = reduce(lambda out, x: out.when(x[1], F.lit(x[0])), list(conditions.items())[1:], F.when(list(conditions.values())[0], F.lit(list(conditions)[0])))
    return df.withColumn("part", part)


def fresh_results(kept: DataFrame, sources: DataFrame, key: str, made: str, changed: str) -> DataFrame:
    """MD-13: ``kept`` with ``fresh``: its result was made, and no source of its key has changed after that."""
    last = sources.groupBy(key).agg(F.max(changed).alias("_changed"))
    fresh = F.col(made).isNotNull() & (F.col("_changed").isNull() | (F.col(made) >= F.col("_changed")))
    return kept.join(last, key, "left").withColumn("fresh", fresh).drop("_changed")


def statement(spark, sql: str, values: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SC-04, ST-06: runs a statement with values as parameters (:name) and tables as {name}."""
    if not sql.strip():
        raise ValueError("a blank statement")
    return spark.sql(sql, args=values, **tables)


def chunk_number(position: Column, total: Column, tasks: Column) -> Column:
    """AR-03: item -> chunk with chunks of ceil(total / min(tasks, total)) items (not ntile)."""
    return F.floor(position / F.ceil(total / F.least(tasks, total)))


def stratified_subset(df: DataFrame, label: str, size: int, *order: Column) -> DataFrame:
    """MD-21: rare labels first, at least one row each, ceil(n_c * size / N) rows capped by what is left of ``size``."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_total"))
    # labels are few (classes of a training set): the running quota is one window over their counts
    quota = counts.join(total, F.lit(True)).withColumn("_want", F.ceil(F.col("_n") * size / F.col("_total")))
    before = F.coalesce(F.sum("_want").over(Window.orderBy("_n", label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = quota.withColumn("_quota", F.greatest(F.least("_want", F.lit(size) - before), F.lit(0))).select(label, "_quota")
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("_rank", rank).join(quota, label).where(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")


def keys_after(df: DataFrame, key: str, prefix: str, to: str) -> DataFrame:
    """PF-18: rows whose key begins with the prefix, and what follows it."""
    return df.where(F.col(key).startswith(prefix)).withColumn(to, F.substring(key, len(prefix) + 1, 1 << 30))
