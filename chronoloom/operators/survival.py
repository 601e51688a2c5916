"""Survival with censoring: curves, risk series, pooling and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kaplan_meier(df: DataFrame, keys: list[str], t: str, event: Column) -> DataFrame:
    """AG-18: per group and time: deaths, censored, at_risk, survival, hazard (cumulative, Nelson-Aalen). At equal times
    deaths come before censorings. Subjects are counted first, so windows run over distinct times only."""
    counts = df.groupBy(*keys, t).agg(F.sum(event.cast("int")).alias("deaths"), F.count("*").alias("n"))
    later = Window.partitionBy(*keys).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    risk = counts.withColumn("at_risk", F.sum("n").over(later))
    all_died = F.col("deaths") == F.col("at_risk")
    log = F.sum(F.when(all_died, 0.0).otherwise(F.log1p(-F.col("deaths") / F.col("at_risk")))).over(so_far)
    ended = F.max(all_died.cast("int")).over(so_far)
    survival = F.when(ended == 1, 0.0).otherwise(F.exp(log))
    return risk.select(*keys, t, "deaths", (F.col("n") - F.col("deaths")).alias("censored"), "at_risk", survival.alias("survival"), F.sum(F.col("deaths") / F.col("at_risk")).over(so_far).alias("hazard"))


def curves(df: DataFrame, keys: list[str], t: str, **events: Column) -> DataFrame:
    """AG-18: several curves of the same subjects (best guess, movement, expansion), tagged by name; one scan."""
    tagged = F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), e.cast("boolean").alias("event")) for n, e in events.items()]))
    rows = df.select(*keys, t, tagged.alias("_x")).select(*keys, t, "_x.curve", "_x.event")
    return kaplan_meier(rows, [*keys, "curve"], t, F.col("event"))


def pooled(df: DataFrame, metadata: DataFrame, region: str, strain: str, t: str, event: Column) -> DataFrame:
    """AG-19: one curve a strain over the regions that carry it."""
    return kaplan_meier(df.join(metadata.select(region, strain), region), [strain], t, event)


def risk_series(curve: DataFrame, keys: list[str], t: str, interval: int) -> DataFrame:
    """AG-20: the curve on a common grid, each time with the last value at or before it (1 before the first death)."""
    bounds = curve.groupBy(*keys).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    low, high = F.floor(F.col("a") / interval) * interval, F.ceil(F.col("b") / interval) * interval
    grid = bounds.select(*keys, F.explode(F.sequence(low.cast("long"), high.cast("long"), F.lit(interval).cast("long"))).alias(t), F.lit(None).cast("double").alias("survival"), F.lit(1).alias("_grid"))
    both = curve.select(*keys, F.col(t).cast("long").alias(t), "survival", F.lit(0).alias("_grid")).unionByName(grid)
    w = Window.partitionBy(*keys).orderBy(t, "_grid").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("survival", F.coalesce(F.last("survival", ignorenulls=True).over(w), F.lit(1.0))).where("_grid = 1").drop("_grid")


def median_survival(curve: DataFrame, keys: list[str], t: str) -> DataFrame:
    """First time at which survival is at most a half; null if it never is."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col(t))).alias("median"))


def device_normalised(df: DataFrame, device: str, strain: str, t: str, event: Column, identity: bool = False, ignore_censoring: bool = False) -> DataFrame:
    """AG-21: times multiplied by (mean of the strain / mean of the device in that strain). ``identity`` gives factor 1;
    censored subjects count in the means unless they are ignored."""
    if identity:
        return df.withColumn("factor", F.lit(1.0)).withColumn("normalised", F.col(t).cast("double"))
    used = F.when(event, F.col(t)) if ignore_censoring else F.col(t)
    by_device = df.groupBy(strain, device).agg(F.sum(used).alias("_s"), F.count(used).alias("_n"))
    by_strain = by_device.groupBy(strain).agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    factor = by_device.join(by_strain, strain).select(strain, device, F.coalesce(F.try_divide(F.col("_m"), F.try_divide(F.col("_s"), F.col("_n"))), F.lit(1.0)).alias("factor"))
    return df.join(factor, [strain, device]).withColumn("normalised", F.col(t) * F.col("factor"))


def compiled_annotations(df: DataFrame, individual: list[str], source: str, order: list[str], values: list[str]) -> DataFrame:
    """MD-12: one annotation for each individual: by hand before machine, then the latest."""
    by_hand = (F.col(source) == "hand").cast("int")
    return df.groupBy(*individual).agg(F.max_by(F.struct(*values), F.struct(by_hand, *order)).alias("_v")).select(*individual, "_v.*")
