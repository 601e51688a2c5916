"""Operator 4: exact dedup by content-defined chunk recipes. DataFrame functions only.

A normalised text is cut where its content says so (behind the first of _ENDS that follows a least number of characters), so an
insertion changes chunks up to where the cuts meet again; only a stretch without any of _ENDS is cut at a greatest length. Chunks are deduplicated once: each distinct
chunk moves once a map task and gets a 64-bit identifier that is verified, since chunks of different text that share a
hash are found and numbered. From then on only ordered lists of identifiers move, and two texts are equal when their
lists are.

Groups are counted by (list, salt) and then by list, so a list that a third of the rows have doesn't meet in one task.

Defined cases: a null text is empty; empty texts are equal to each other; a row that repeats an id and a text is
reported again and counts in ``group_size``; a null id is never the smallest, and a group that has no other id has a
null keep_id, of which each row is kept; very long texts are lists of many identifiers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import write_shared

#: Of a chunk: characters before which nothing ends it, and characters after those at most.
LEAST, MORE = 700, 3_000
SALTS = 64


def _every(step: int, at: int) -> str:
    """A class of the characters with a code of ``at`` modulo ``step``; beyond U+0370 it goes by blocks of 64 codes."""
    single = "".join(rf"\u{c:04X}" for c in range(0x21, 0x370) if c % step == at)
    return "[" + single + "".join(rf"\u{c * 64:04X}-\u{c * 64 + 63:04X}" for c in range(0xE, 0x400) if c % step == at and not 0xD800 <= c * 64 < 0xE000) + "]"


#: What a chunk ends with: a full stop; where none comes, one of other scripts; where none of these comes, a pair of
#: characters as one in 64 is in text without order.
_ENDS = rf"[^.]{{0,{MORE}}}\.", rf"[^。．！？।؟]{{0,{MORE}}}[。．！？।؟]", rf".{{0,{MORE}}}?{_every(8, 1)}{_every(8, 5)}"
_CHUNK = rf"(?s).{{1,{LEAST}}}(?:{'|'.join(_ENDS)}|.{{0,{MORE}}})"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def recipes(df: DataFrame, id_col: str, text_col: str, identify: Callable[[Column], Column]) -> DataFrame:
    """id, recipe (array of (hash, number among the distinct chunks of that hash)), text_sha256."""
    texts = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    pieces = texts.select(F.explode(chunks("norm")).alias("chunk")).select(identify(F.col("chunk")).alias("hash"), "chunk")
    distinct = pieces.distinct()
    shared = write_shared(distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        listed = F.transform(chunks("norm"), lambda c: F.struct(identify(c).alias("hash"), F.lit(1).alias("number")))
        return texts.select("id", listed.alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))
    numbered = distinct.join(shared, "hash").withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    whole = texts.select(F.sha2("norm", 256).alias("text_sha256"), "norm").distinct()
    placed = whole.select("text_sha256", F.posexplode(chunks("norm")).alias("at", "chunk")).withColumn("hash", identify(F.col("chunk")))
    placed = placed.join(numbered, ["hash", "chunk"], "left").select("text_sha256", "at", "hash", F.coalesce("number", F.lit(1)).alias("number"))
    listed = placed.groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "number"))).alias("parts"))
    listed = listed.select("text_sha256", F.transform("parts", lambda p: F.struct(p["hash"].alias("hash"), p["number"].alias("number"))).alias("recipe"))
    rows = texts.select("id", F.sha2("norm", 256).alias("text_sha256"))
    empty = F.expr("cast(array() as array<struct<hash:bigint,number:int>>)")
    return rows.join(listed, "text_sha256", "left").select("id", F.coalesce("recipe", empty).alias("recipe"), "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``df``: id, keep_id (smallest id of its equal texts), group_size, kept, text_sha256.
    ``identify``: hash of a chunk (bigint); any function gives right results."""
    rows = write_shared(recipes(df, id_col, text_col, identify).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "recipes")
    partly = rows.groupBy("recipe", "salt").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = partly.groupBy("recipe").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))
    found = partly.select("recipe", "salt").join(groups, "recipe")
    out = rows.join(found, ["recipe", "salt"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm"""
}
