"""Operator 9: line dedup by a segment-partition edit join. DataFrame functions only.

A line (trimmed of blanks) is a duplicate if an equal line stands earlier, by (id, hash of the text, line number), or if a
different line whose first place is earlier is within the edit budget of the shorter one of both: one edit for each ``per``
characters, at least one and at most ``max_edits``; lines of fewer than ``least`` characters have no budget, since an edit in a very
short line makes another line (``least`` = 1 gives all lines one).

Segments. A line r with a budget of t edits is split into t + 1 segments. A line s within t edits, as long as r or by up to t
characters longer, has one of them whole, at a place that is moved by what edits before it have inserted or deleted. ``key_plan``
says which segments at which moves a longer line has to be probed for, so that each way of placing the edits is met by one key; keys
hold the length of r and the number of the segment, so the index is aware of lengths.
Equal lines meet as 128-bit hashes, never as text, and are pre-aggregated: near lines are looked for among distinct lines.
Lines that share a key with at most HOT_GROUP others are verified in pairs with a banded edit distance. The lines of
larger groups are split anew into twice as many segments, of which all but t are whole, which parts groups of lines that
have only a part in common; groups that are still large are compared in blocks: a line with the list of each block
of its group, one row for a block, never a row for a pair.

Hot lines: of a line that is more than the HOT_SHARE-th part of all lines (so at most HOT_SHARE lines, which are
broadcast) only the first place goes on to the keys. Key groups are found by counts that are aggregated before the
shuffle; only keys that lines share are joined.

Defined cases: null and empty texts have no lines; blank lines are never duplicates and stay; a document whose lines that
aren't blank all go is dropped by ``dedup_lines``; rows that share an id but not a text are documents of their own; of rows
repeated with id and text one keeps its lines, as the first, and all lines of the others are duplicates; null ids are ids
like others and come first; of equal texts under one id any row may be the one that stays; very long lines and texts are
read whole; other columns go through, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import write_shared

#: Budgets of op9 and the pipeline: an edit for each 50 characters (2 per cent), two at most; shorter lines have none.
CHARS_PER_EDIT, MAX_EDITS, LEAST_NEAR = 50, 2, 20
#: Lines of a key that are compared in pairs; lines of a block; bits of the filters of shared keys and lines.
HOT_GROUP, BLOCK_LINES, FILTER_BITS = 32, 64, 24
HOT_SHARE = 10_000
#: Characters up to which lines go to the built-in edit distance.
BUILT_IN = 2000
BLANKS = " \t\r\x0b\x0c"


def trimmed(line: Column) -> Column:
    """The built-in function looks at all characters, so it is called only where there is something to trim."""
    ends = [x for c in BLANKS for x in (line.startswith(c), line.endswith(c))]
    return F.when(reduce(lambda a, b: a | b, ends), F.btrim(line, F.lit(BLANKS))).otherwise(line)


def budget(n: Column, per: int, max_edits: int, least: int) -> Column:
    """Edits that a line of ``n`` characters may have."""
    steps = reduce(lambda x, e: F.when(n >= e * per, e).otherwise(x), range(2, max_edits + 1), F.lit(min(max_edits, 1)))
    return F.when(n < least, 0).otherwise(steps)


def key_plan(edits: int, longer: int, parts: int) -> list[tuple[int, tuple[tuple[int, int, int], ...]]]:
    """Keys by which a line that is by ``longer`` characters longer is probed for one with ``parts`` segments, ``edits`` of
    which may be hit: a number for the segments that are left out, and the runs (first segment, behind the last, move) of
    the others. For each way to spread up to ``edits`` edits over segments one of the keys fits."""
    def key(hit: dict[int, int], left_out: tuple[int, ...]):
        runs: list[tuple[int, int, int]] = []
        move = 0
        for p in range(parts):
            if p in left_out:
                move += hit.get(p, 0)
            elif runs and runs[-1][1] == p:
                runs[-1] = (runs[-1][0], p + 1, move)
            else:
                runs.append((p, p + 1, move))
        return sum(1 << p for p in left_out), tuple(runs)

    plan: list = []
    for n in range(edits, -1, -1):
        for segments in combinations(range(parts), n):
            for moves in product(range(-edits, edits + 1), repeat=n):
                if sum(moves) == longer and sum(max(1, abs(m)) for m in moves) <= edits:
                    hit, rest = dict(zip(segments, moves)), [p for p in range(parts) if p not in segments]
                    fit = [key(hit, tuple(sorted((*segments, *more)))) for more in combinations(rest, edits - n)]
                    if not any(k in plan for k in fit):
                        plan.append(fit[0])
    return plan


def line_keys(df: DataFrame, per: int, max_edits: int, least: int, times: int = 1) -> tuple[DataFrame, int]:
    """h, g, keys of the lines of ``df`` (h, g, line). Keys of a line: first those that it is found by (and that lines of its length are probed for), so many as is told, then
    those by which it looks for shorter or moved ones. ``times``: so many times the least number of segments.
    Substrings are taken from UTF-16, where a place is found at once; lines with characters of two units, and the few lines
    that are split anew, have theirs taken from the characters."""
    rows = df.select("h", "g", "line", F.length("line").alias("n"), F.encode("line", "UTF-16BE").alias("units"))
    line, n_chars, units = F.col("line"), F.col("n"), F.col("units")
    of_units = lambda begin, size: F.substring(units, 2 * begin + 1, 2 * size)
    of_chars = lambda begin, size: F.encode(line.substr(begin + 1, size), "UTF-16BE")

    def keys(piece) -> tuple[list[Column], list[Column]]:
        own, probes = [], []
        for edits in range(1, max_edits + 1):
            parts = (edits + 1) * times
            for longer in range(edits + 1):
                n = n_chars - longer
                begin = [F.call_function("div", n * p, F.lit(parts)).cast("int") for p in range(parts)] + [n]
                for number, runs in key_plan(edits, longer, parts):
                    pieces = [piece(F.greatest(begin[a] + move, F.lit(0)) if move < 0 else begin[a] + move, begin[b] - begin[a]) for a, b, move in runs]
                    key = F.when(budget(n, per, max_edits, least) == edits, F.xxhash64(F.lit(edits * 65536 + number), n, *pieces))
                    (probes if longer or any(move for *_, move in runs) else own).append(key)
        return own, probes

    own, probes = keys(of_chars)
    found = F.array(*own, *probes)
    if times == 1:
        found = F.when(F.octet_length(units) == 2 * n_chars, F.array(*(k for x in keys(of_units) for k in x))).otherwise(found)
    return rows.select("h", "g", found.alias("keys")), len(own)


def within_edits(a: Column, b: Column, max_edits: int | Column) -> Column:
    """Whether the edit distance is at most ``max_edits``. Short lines go to the built-in banded distance. It looks for each
    row of the band from the line's beginning on; so for longer ones the diagonals of the band are followed, each as far as
    the characters agree, which is found by comparing substrings of 2^24, 2^23 ... characters."""
    most = F.lit(max_edits) if isinstance(max_edits, int) else max_edits
    n, m = F.length(a), F.length(b)
    halves = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))

    def along(i: Column, d: Column) -> Column:
        """As far as the diagonal leads from row i."""
        same = lambda k, p: (i + k + p <= n) & (i + d + k + p <= m) & (F.substring(a, i + k + 1, p) == F.substring(b, i + d + k + 1, p))
        return i + F.aggregate(halves, F.lit(0), lambda k, p: F.when(same(k, p), k + p).otherwise(k))

    def step(rows: Column, e: Column) -> Column:
        """The furthest rows of the diagonals -e to e, from those with an edit less."""
        at = lambda d: F.coalesce(F.get(rows, d + e - 1), F.lit(-1))
        return F.transform(F.transform(F.sequence(-e, e), lambda d: F.struct(d.alias("d"), F.least(F.greatest(at(d) + 1, at(d - 1), at(d + 1) + 1), n, m - d).alias("i"))), lambda x: along(x["i"], x["d"]))

    zero = F.transform(F.array(F.lit(0)), lambda x: along(x, F.lit(0)))
    rows = F.aggregate(F.sequence(F.lit(1), most), zero, step)
    far = (F.abs(n - m) <= most) & F.when(most == 0, a == b).otherwise(F.get(rows, m - n + most) >= n)
    return F.when(F.greatest(n, m) <= BUILT_IN, F.call_function("levenshtein", a, b, most) >= 0).otherwise(far)


def _places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row (hash of the text), at (line number from 0), line, h, g (hashes of the line): lines that aren't blank."""
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    lines = lines.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    return lines.select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), F.col("line")).alias("g"))


def _place() -> Column:
    return F.struct("id", "row", "at")


def _let_through(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be one of ``keys``: by a filter of 2^FILTER_BITS bits, which is what is broadcast."""
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(place(key).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    words = write_shared(words, "filter")
    passed = df.withColumn("p", place(key)).join(F.broadcast(words), F.shiftright("p", 6) == F.col("word"))
    return passed.where("(bits & shiftleft(1L, cast(p & 63 as int))) <> 0").drop("p", "word", "bits")


def _shared_keys(keys: DataFrame, n_own: int) -> DataFrame:
    """key, h, g, own, c: of the keys that different lines share and one is found by; c counts lines, or more.
    ``keys``: h, g, keys (own ones in front)."""
    rows = keys.select("h", "g", F.posexplode("keys").alias("at", "key")).where("key is not null").select("key", "h", "g", (F.col("at") < n_own).alias("own"))
    shared = rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("found"), F.count("*").alias("c"))
    shared = write_shared(shared.where("low <> high and found").select("key", "c"), "shared-keys")
    return write_shared(_let_through(rows, "key", shared).join(shared, "key").distinct(), "line-keys")


class _Near:
    """Looks for lines with an earlier neighbour; ``texts``: h, g, place, n, line of the lines that may have one."""

    def __init__(self, texts: DataFrame, per: int, max_edits: int, least: int):
        self.texts, self.per, self.max_edits, self.least = texts, per, max_edits, least

    def alike(self, a: Column, n: Column, b: Column, m: Column) -> Column:
        most = budget(F.least(n, m), self.per, self.max_edits, self.least)
        return (F.abs(n - m) <= most) & within_edits(a, b, most)

    def of_pairs(self, shared: DataFrame) -> DataFrame:
        """h, g of the later lines of true pairs, for keys of few lines."""
        few = shared.where(F.col("c") <= HOT_GROUP)
        left = few.where("own").select("key", F.struct("h", "g").alias("x"))
        right = few.select("key", F.struct("h", "g").alias("y"), F.col("own").alias("also_own"))
        pairs = left.join(right, "key").where("x <> y and (not also_own or x < y)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        texts = self.texts.select(F.struct("h", "g").alias("x"), F.col("place").alias("place_x"), F.col("n").alias("n_x"), F.col("line").alias("line_x"))
        others = texts.select(*(F.col(c).alias(c.replace("x", "y")) for c in texts.columns))
        both = write_shared(pairs, "line-pairs").join(texts, "x").join(others, "y")
        later = F.when(F.col("place_x") < F.col("place_y"), F.col("y")).otherwise(F.col("x")).alias("later")
        return both.where(self.alike(F.col("line_x"), F.col("n_x"), F.col("line_y"), F.col("n_y"))).select(later).select("later.h", "later.g")

    def of_blocks(self, shared: DataFrame, settled: DataFrame) -> DataFrame:
        """h, g of lines with an earlier neighbour, for keys of many lines: a line with the list of a block at a time."""
        many = shared.where(F.col("c") > HOT_GROUP).select("key", "h", "g").distinct()
        seeds = [F.bit_xor(F.xxhash64(F.lit(i), "h", "g")).alias(f"x{i}") for i in (3, 5)]
        other = many.groupBy("key").agg(*seeds, F.count("*").alias("c")).groupBy("x3", "x5", "c").agg(F.min("key").alias("key"))  # of equal groups one
        many = many.join(other.select("key", F.ceil(F.col("c") / BLOCK_LINES).alias("blocks")), "key").join(self.texts, ["h", "g"])
        block = F.pmod(F.xxhash64("h"), F.col("blocks")).alias("block")
        lists = many.select("key", block, F.struct("place", "n", "line").alias("own")).groupBy("key", "block").agg(F.collect_list("own").alias("others"))
        asked = many.join(settled, ["h", "g"], "left_anti").select("key", "h", "g", "place", "n", "line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        found = F.exists("others", lambda x: (x["place"] < F.col("place")) & self.alike(x["line"], x["n"], F.col("line"), F.col("n")))
        return asked.join(lists, ["key", "block"]).where(found).select("h", "g")


def _written_in_parts(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, planned without whole-stage code: for expressions that don't fit one method.
    Spark runs these in parts anyway, after the driver has compiled the whole in vain, which takes it far more memory."""
    conf, key = df.sparkSession.conf, "spark.sql.codegen.wholeStage"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return write_shared(df, name)
    finally:
        conf.set(key, before)


def near_lines(df: DataFrame, first: DataFrame, id_col: str, text_col: str, per: int, max_edits: int, least: int) -> DataFrame:
    """h, g of the lines that have an earlier neighbour within the budget. ``first``: h, g, place, n (how often) of each line."""
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # what the JVM compiles; larger plans are run in smaller methods
    places = _places(df, id_col, text_col).where(F.length("line") >= least)
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = write_shared(first.where(F.col("n") > max(total / HOT_SHARE, 1)).select("h", "g", F.col("place").alias("hot_place")), "hot-lines")
    lines = places.join(F.broadcast(hot), ["h", "g"], "left").where(F.col("hot_place").isNull() | _place().eqNullSafe(F.col("hot_place")))
    keys, n_own = line_keys(lines, per, max_edits, least)
    shared = _shared_keys(write_shared(keys, "keys"), n_own)
    wanted = shared.select("h", "g").distinct()
    wanted = write_shared(wanted.join(first.select("h", "g", "place"), ["h", "g"]), "wanted-lines")
    texts = _let_through(places, "h", wanted).select("h", "g", _place().alias("place"), F.length("line").alias("n"), "line").join(wanted, ["h", "g", "place"])
    texts = write_shared(texts.dropDuplicates(["h", "g"]), "line-texts")
    look = _Near(texts, per, max_edits, least)
    settled = write_shared(look.of_pairs(shared).distinct(), "near-lines")
    many = write_shared(shared.where(F.col("c") > HOT_GROUP).select("h", "g").distinct(), "crowded-lines")
    if many.isEmpty():
        return settled
    if max_edits <= 2:  # more edits have too many ways to leave out segments
        keys, n_own = line_keys(texts.join(many, ["h", "g"], "left_semi"), per, max_edits, least, 2)
        shared = _shared_keys(_written_in_parts(keys, "keys"), n_own)
        settled = write_shared(settled.union(look.of_pairs(shared)).distinct(), "near-lines")
    return settled.union(look.of_blocks(shared, settled)).distinct()


def _first_removed(df: DataFrame, id_col: str, text_col: str, *budgets: int) -> DataFrame:
    """One row per distinct id and text that loses lines: id, row, removed, n_near, of its first copy."""
    places = _places(df, id_col, text_col).drop("line")
    first = write_shared(places.groupBy("h", "g").agg(F.min(_place()).alias("place"), F.count("*").alias("n")), "lines")
    near = near_lines(df, first, id_col, text_col, *budgets).withColumn("near", F.lit(True))
    marked = write_shared(first.join(near, ["h", "g"], "left").where("n > 1 or near").select("h", "g", "place", F.coalesce("near", F.lit(False)).alias("near")), "marked-lines")
    hits = _let_through(places, "h", marked).join(marked, ["h", "g"]).withColumn("gone", F.col("near") | ~_place().eqNullSafe(F.col("place"))).where("gone")
    own = hits.groupBy("id", "row").agg(F.sort_array(F.collect_set(F.struct("at", "near"))).alias("xs"))  # a document's own lines
    return own.select("id", "row", F.col("xs.at").alias("removed"), F.size(F.filter("xs", lambda x: x["near"])).alias("n_near"))


def _with_removed(df: DataFrame, id_col: str, text_col: str, *budgets: int) -> DataFrame:
    """All rows of ``df`` with the columns own_lines (numbers of the lines that aren't blank), gone_at (of those that go;
    null if none does) and gone_near."""
    key = lambda id_, row: F.xxhash64(F.lit(7), id_, row).alias("own_key")
    gone = _first_removed(df, id_col, text_col, *budgets).select("row", key(F.col("id"), F.col("row")), F.col("removed").alias("gone_at"), F.col("n_near").alias("gone_near"))
    numbers = F.array_compact(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x, i: F.when(trimmed(x) != "", i)))
    rows = df.select(*df.columns, numbers.alias("own_lines"), F.xxhash64(text_col).alias("own_row"))
    rows = rows.select(*df.columns, "own_lines", "own_row", key(F.col(id_col), F.col("own_row")))
    copy = F.row_number().over(Window.partitionBy("own_row", "own_key").orderBy(F.lit(0)))
    rows = rows.withColumn("own_copy", copy).join(gone.withColumnRenamed("row", "own_row"), ["own_row", "own_key"], "left")
    every = F.when(F.size("own_lines") > 0, F.col("own_lines"))
    return rows.select(*df.columns, "own_lines", F.when(F.col("own_copy") > 1, every).otherwise(F.col("gone_at")).alias("gone_at"), "gone_near")


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", per: int = CHARS_PER_EDIT, max_edits: int = MAX_EDITS, least: int = LEAST_NEAR) -> DataFrame:
    """One row per row of ``df`` that loses lines: id, removed (their numbers from 0, in order), n_near (how many of them
    are only near to an earlier line)."""
    rows = _with_removed(df.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1")), "c0", "c1", per, max_edits, least).where("gone_at is not null")
    return rows.select(F.col("c0").alias(id_col), F.col("gone_at").alias("removed"), F.coalesce("gone_near", F.lit(0)).alias("n_near"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", per: int = CHARS_PER_EDIT, max_edits: int = MAX_EDITS, least: int = LEAST_NEAR) -> DataFrame:
    """``df`` without the duplicate lines, in its own columns; documents of which nothing is left go."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}  # whatever they are, they don't clash with columns made here
    id_c, text_c, own = names[id_col], names[text_col], df.toDF(*names.values())
    gap = lambda at, i: at - F.when(i > 0, F.get("gone_at", i - 1)).otherwise(-1) - 1
    flags = F.flatten(F.transform("gone_at", lambda at, i: F.array_append(F.array_repeat(F.lit(False), gap(at, i)), F.lit(True))))
    rows = _with_removed(own, id_c, text_c, per, max_edits, least).withColumn("gone_flags", flags)
    kept = F.array_join(F.filter(F.split(text_c, "\n"), lambda _, i: ~F.coalesce(F.get("gone_flags", i), F.lit(False))), "\n")
    rows = rows.withColumn(text_c, F.when(F.col("gone_at").isNull(), F.col(text_c)).otherwise(kept))
    if count_col in names:
        n = names[count_col]
        rows = rows.withColumn(n, F.when(F.col("gone_at").isNull(), F.col(n)).otherwise(F.length(text_c).cast(dict(own.dtypes)[n])))
    rows = rows.where(F.col("gone_at").isNull() | (F.btrim(F.col(text_c), F.lit("\n" + BLANKS)) != ""))
    return rows.select(*(F.col(c).alias(name) for name, c in names.items()))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = _with_removed(docs.select("doc_id", "text"), "doc_id", "text", CHARS_PER_EDIT, MAX_EDITS, LEAST_NEAR)
    none = F.expr("cast(array() as array<int>)")
    return out.select("doc_id", F.size("own_lines").alias("n_lines"), F.coalesce(F.size("gone_at"), F.lit(0)).alias("n_removed"), F.coalesce("gone_near", F.lit(0)).alias("n_near"), F.coalesce("gone_at", none).alias("removed_lines"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES: dict[str, str] = {}
