"""Operator 5: benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur with up to k = n * EDIT_PERCENT // 100 edits. It is split into k + 1 pieces; with k
edits at least one piece stays whole, so exact hits of pieces (found with one Aho-Corasick automaton) give every place
where the item can be. Each place is verified with Myers' bit-parallel distance against the item, free at both ends of
the text.

Texts and items are compared lower-cased with each run of white space as one space. Defined cases: a null or empty text
matches nothing; null or blank items are left out; items that repeat are reported under each of their ids, of any type
and null ones too; rows that repeat, and null ids of documents, are reported each; other columns are not read. Texts are
read whole, a very long one by one task in time that grows with its length; there is no shuffle. Items are taken in blocks of BLOCK_CHARS characters as
expected, so the automaton that is sent to the executors has that bound at any size of the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import small_batches

EDIT_PERCENT, BLOCK_CHARS = 8, 1_000_000


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of the item and where they begin."""
    k = min(k, len(item) - 1)
    ends = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def least_edits(item: str, masks: dict[str, int], text: str, low: int, high: int) -> int:
    """Myers: the least edit distance of the item to a substring of text[low:high]."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score, best, get = full, 0, n, n, masks.get
    for c in text[low:high]:
        eq = get(c, 0)
        x = eq | minus
        d = ((eq & plus) + plus ^ plus) | eq
        h_plus = minus | ~(d | plus) & full
        h_minus = plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
            if score < best:
                best = score
        h_plus = h_plus << 1 & full
        h_minus = h_minus << 1 & full
        plus = h_minus | ~(x | h_plus) & full
        minus = h_plus & x
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], percent: int):
        by_text: dict[str, list[int]] = defaultdict(list)
        for i, text in items:
            if folded(text):
                by_text[folded(text)].append(i)
        self.items = [(text, ids, len(text) * percent // 100) for text, ids in sorted(by_text.items())]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (text, _, k) in enumerate(self.items):
            for begin, piece in pieces(text, k):
                places[piece].append((at, begin))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def _masks(self, at: int) -> dict[str, int]:
        if at not in self.masks:
            own: dict[str, int] = {}
            for i, c in enumerate(self.items[at][0]):
                own[c] = own.get(c, 0) | 1 << i
            self.masks[at] = own
        return self.masks[at]

    def find(self, text: str) -> list[dict]:
        """The items in this folded text and their least edits, in no order."""
        if not text or not self.items:
            return []
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, found) in self.automaton.iter(text):
            begin = end - size + 1
            for at, offset in found:
                item, _, k = self.items[at]
                spans[at].append((begin - offset - k, begin - offset + len(item) + k))
        out = []
        for at, own in spans.items():
            item, ids, k = self.items[at]
            best, merged = k + 1, []
            for low, high in sorted(own):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            for low, high in merged:
                if best:
                    best = min(best, least_edits(item, self._masks(at), text, max(low, 0), high))
            if best <= k:
                out += [{"item_id": i, "edits": best} for i in ids]
        return out


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_CHARS characters as expected."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-max(chars, 1) // BLOCK_CHARS)
    for block in range(blocks):
        yield [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toLocalIterator()]


def benchmark_matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = EDIT_PERCENT) -> DataFrame:
    """One row per row of ``df``: id and ``matches``, an array of (item_id, edits) in order, null ids first."""
    spark = df.sparkSession
    kind, item_kind = dict(df.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    found_kind = f"array<struct<item_id:{item_kind},edits:int>>"
    arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    found_arrow = pa.list_(pa.struct([("item_id", arrow), ("edits", pa.int32())]))
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.expr(f"cast(array() as {found_kind})").alias("matches"))
    for own in _blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, percent)
            for batch in batches:
                found = [before + matcher.find(folded(text)) for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, found_arrow)], ["id", "text", "matches"])

        out = out.mapInArrow(run, f"id {kind}, text string, matches {found_kind}")
    return out.select(F.col("id").alias(id_col), F.sort_array("matches").alias("matches"))


def drop_matches(df: DataFrame, benchmark: DataFrame, text_col: str = "text", percent: int = EDIT_PERCENT) -> DataFrame:
    """The rows of ``df`` that match no item, with its own columns; no shuffle."""
    out = df
    for matcher_items in _blocks(benchmark, "item_id", "text"):
        sent = df.sparkSession.sparkContext.broadcast(matcher_items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, percent)
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                yield batch.filter(pa.array([not matcher.find(folded(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, df.schema)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.col("matches.edits").alias("edits"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES: dict[str, str] = {}
