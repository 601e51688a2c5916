"""Sources and sinks: delimited text, settings, sparse vectors, survival tables, directories, binary headers."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def catalog_table(spark: SparkSession, name: str, prefix: str = "") -> DataFrame:
    """SC-01, SC-06: a table of the central ('') or the buffered ('buffered_') database."""
    return spark.table(prefix + name)


def delimited(df: DataFrame, line: str, **columns: str) -> DataFrame:
    """SC-07, SC-08, SC-09: fields of a line parted by commas without quoting; \\r is kept; a missing field is ''. The
    types string, double and long read numeric prefixes."""
    parts = F.split(F.col(line), ",", -1)
    field = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    reader = {"string": lambda c: c, "double": X.prefix_double, "long": X.prefix_long}
    return df.select(*[reader[kind](field(i)).alias(name) for i, (name, kind) in enumerate(columns.items())])


def read_delimited(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """SC-10: plain or gzip text."""
    return delimited(spark.read.option("lineSep", "\n").text(path), "value", **columns)


def write_gzip(lines: DataFrame, path: str) -> None:
    """SC-11."""
    lines.write.option("compression", "gzip").text(path)


MEASUREMENTS = T.StructType(
    [T.StructField("path_id", T.LongType()), T.StructField("time", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("movement_sum", "total_foreground_area", "total_intensity_within_foreground", "total_stabilized_area", "total_region_area", "total_intensity_within_region", "total_intensity_within_stabilized_denoised", "total_intensity_within_stabilized", "total_alternate_worm_area", "total_intensity_within_alternate_worm", "change_in_total_foreground_intensity", "change_in_total_region_intensity")]
    + [T.StructField(n, T.DoubleType()) for n in ("movement_score", "denoised_movement_score", "spatial_averaged_movement_sum_uncropped", "intensity_normalization_scale_factor")]
)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """SC-12: time series of measurements with an explicit schema."""
    return spark.read.schema(MEASUREMENTS).option("header", True).csv(path)


def write_measurements(df: DataFrame, path: str) -> None:
    """SC-12."""
    df.select(*MEASUREMENTS.fieldNames()).write.option("header", True).csv(path)


def settings(lines: DataFrame, line: str = "value", known: list[str] | None = None) -> DataFrame:
    """SC-14: key = value lines; blank lines and lines that begin with # are comments; a key that isn't known fails."""
    raw = lines.select(F.trim(F.col(line)).alias("l")).where("l <> '' and not startswith(l, '#') and contains(l, '=')")
    out = raw.select(F.trim(F.substring_index("l", "=", 1)).alias("key"), F.trim(F.expr("substring(l, instr(l, '=') + 1)")).alias("value"))
    if known is not None:
        out = out.withColumn("key", F.when(F.col("key").isin(known), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unknown setting: "), "key")).cast("string")))
    return out


def setting_int(value: Column) -> Column:
    """SC-14's int getter."""
    return X.prefix_long(value)


def write_settings(pairs: DataFrame, path: str) -> None:
    """SC-14."""
    pairs.select(F.concat("key", F.lit(" = "), "value").alias("value")).write.text(path)


SURVIVAL_NAMES = {"extra": "_jmp_extra_metadata.csv", "detailed": "_detailed_jmp.csv", "simple": "_simple_jmp.csv"}


def survival_table(df: DataFrame, schema: str = "simple", controls: str | None = None) -> DataFrame:
    """SC-15, SC-16, SC-17, DT-02, DT-03: one row an individual, in days since birth, with 0 for a death and 1 for a
    censoring. ``df``: strain, device, birth, time (seconds) and event. detailed keeps the device and the event time;
    ``controls`` names a strain that the extra-metadata table leaves out."""
    days = ((F.col("time") - F.col("birth")) / 86400.0).alias("age_days")
    simple = [days, (~F.col("event")).cast("int").alias("censored"), "strain"]
    rows = df if controls is None else df.where(F.col("strain") != controls)
    return rows.select(*simple) if schema == "simple" else rows.select(*simple, "device", F.from_unixtime("time").alias("observed"))


def write_survival(df: DataFrame, base: str, schema: str) -> str:
    """SC-17, SC-18: a failed analysis leaves what was there (no empty file is made first)."""
    path = base + SURVIVAL_NAMES[schema]
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_survival(spark: SparkSession, path: str, schema: str = "simple") -> DataFrame:
    """SC-16: a survival table; the sink's columns, typed."""
    more = ", device string, observed timestamp_ntz" if schema == "detailed" else ""
    return spark.read.schema("age_days double, censored int, strain string" + more).option("header", True).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; on one machine without it, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="chronoloom-")
    return f"{shared.rstrip('/')}/chronoloom/{uuid.uuid4().hex}"


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """DM-06, MD-02: writes the partitions that ``df`` has rows of over those of the table, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def by_hand_table(spark: SparkSession, path: str) -> DataFrame:
    """SC-15: hand-annotated deaths, one row an individual."""
    return spark.read.option("header", True).csv(path)


IMAGE_KINDS = {"jpg": 0.8, "tif": 1.0, "tiff": 1.0, "jp2": 0.05, "jpk": 0.05}


def images(spark: SparkSession, path: str) -> DataFrame:
    """SC-20: image files as bytes, by lower-cased extension; another extension fails."""
    found = spark.read.format("binaryFile").load(path).withColumn("kind", X.extension(F.col("path")))
    known = F.col("kind").isin(list(IMAGE_KINDS))
    return found.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown image: "), "path")).cast("string")))


def output_kind(name: Column) -> Column:
    """SC-21: the extension is taken as it is written; upper case is unknown."""
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def jpeg_components(mode: Column) -> Column:
    """SC-22: 16-bit and float components fail."""
    return F.when(mode == "8-bit", mode).otherwise(F.raise_error(F.lit("JPEG holds 8-bit components only")).cast("string"))


HEADER = struct.Struct("<IIBd")


def pack_header(height: int, width: int, components: int, resolution: float, description: str) -> bytes:
    """SC-23: height, width, components, resolution and a description that a zero byte ends."""
    return HEADER.pack(height, width, components, resolution) + description.encode() + b"\0"


def unpack_header(raw: bytes) -> tuple[int, int, int, float, str]:
    """SC-23, each field read from its own bytes."""
    height, width, components, resolution = HEADER.unpack_from(raw)
    return height, width, components, resolution, raw[HEADER.size : raw.index(b"\0", HEADER.size)].decode()


def headers(df: DataFrame, raw: str) -> DataFrame:
    """SC-23 over a binary column."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([unpack_header(bytes(x)) for x in frame[raw]], columns=["height", "width", "components", "resolution", "description"])

    return df.select(raw).mapInPandas(run, "height int, width int, components int, resolution double, description string")


def listing(spark: SparkSession, path: str, mask: str = "*") -> DataFrame:
    """SC-28, SC-29: files with size and time; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", mask).option("recursiveFileLookup", "true").load(path).select("path", X.file_name(F.col("path")).alias("name"), "length", "modificationTime")


def directory_size(files: DataFrame) -> DataFrame:
    """AG-23."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


VOLATILE = ("processing_jobs", "processing_job_queue", "alerts", "host_event_log")


def dump(tables: dict[str, DataFrame], path: str, excluded=VOLATILE) -> list[str]:
    """SC-30: every table but the volatile ones."""
    names = [n for n in tables if n not in excluded]
    for n in names:
        tables[n].write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/{n}")
    return names


def read_sparse(lines: DataFrame, line: str = "value") -> DataFrame:
    """SC-35, PF-19: ``label index:value ...`` as label, indices, values and ``ok``: the label is a number, indices are
    whole, not negative and strictly ascending, values are finite. Rows that aren't are kept and flagged."""
    parts = F.filter(F.split(F.col(line), r"\s+"), lambda x: x != "")
    pairs = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    index = F.transform(pairs, lambda p: F.substring_index(p, ":", 1).try_cast("int"))
    value = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit(":")), F.substring_index(p, ":", -1).try_cast("double")))
    rows = lines.select(F.get(parts, F.lit(0)).try_cast("double").alias("label"), index.alias("indices"), value.alias("values"))
    finite = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ascending = F.forall(F.sequence(F.lit(1), F.greatest(F.size("indices") - 1, F.lit(1))), lambda i: F.coalesce(F.get("indices", i - 1) < F.get("indices", i), F.size("indices") < 2))
    whole = F.forall("indices", lambda i: i.isNotNull() & (i >= 0))
    return rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & finite & whole & ascending, F.lit(False)))


def sparse_lines(df: DataFrame, label: str, values: str) -> DataFrame:
    """SC-36: a dense array as a sparse line with places from 1; zeros are left out."""
    pairs = F.filter(F.transform(values, lambda v, i: F.struct((i + 1).alias("i"), v.cast("double").alias("v"))), lambda p: p["v"] != 0)
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(p["i"].cast("string"), F.lit(":"), p["v"].cast("string"))), " ")
    return df.select(F.concat_ws(" ", F.col(label).cast("string"), shown).alias("value"))


def read_wcon(spark: SparkSession, path: str) -> DataFrame:
    """SC-37: tracking files in JSON."""
    return spark.read.option("multiLine", True).json(path)


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """SC-39: external metadata by file name; files without any stay."""
    return files.join(metadata, "name", "left")
