import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from chronoloom.llm import exact_dedup, jaccard_join, line_dedup, suffix_dedup

SMALL = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_exact_dedup(spark, identify):
    """With three hash values nearly all chunks share one: the identifiers have to be told apart."""
    long = "word. " * 3000
    rows = [(5, "a  b"), (2, "a\tb"), (3, None), (4, ""), (1, long), (6, long), (7, long + "x"), (8, "x" + long), (9, " "), (10, "a b"), (10, "a b")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    got = exact_dedup.exact_dedup(df, identify=identify)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute_exact(rows)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_exact_dedup_of_null_ids(spark, identify):
    rows = [(None, "a b. " * 400), (None, "a b. " * 400), (3, "a  b. " * 400), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, identify=identify).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 3, False)] * 2 + [(3, 3, 3, True), (None, None, 1, True)], key=str)


@pytest.mark.parametrize("chars", ["abc. ", "0123456789abcdef", "文字の中に的。", "abcdefghijklmnopqrstuvwxyz", "{}|;=a1"])
def test_chunks_follow_the_content(spark, rng, chars):
    """Characters put in front change the first chunks and not the later ones; nothing is lost."""
    text = "".join(rng.choice(chars) for _ in range(60_000))
    df = spark.createDataFrame([("", text), ("in front ", text)], "head string, text string")
    a, b = (r.c for r in df.select(exact_dedup.chunks(F.concat("head", "text")).alias("c")).collect())
    assert "".join(a) == text and "".join(b) == "in front " + text
    assert len(set(a) & set(b)) > len(a) / 2


def test_exact_dedup_oracle(spark):
    compare(spark, connect(SMALL), exact_dedup.op4_exact_dedup, exact_dedup.ORACLES["op4_exact_dedup"], SMALL)


def brute_jaccard(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent,sizes", [(3, 90, {}), (3, 60, {"unit_shingles": 60, "leaders": 2}), (2, 40, {"unit_shingles": 200, "leaders": 1}), (3, 80, {"class_bits": 3})])
def test_jaccard_join(spark, rng, k, percent, sizes):
    """Also with units that are dealt to blocks, and with classes whose numbers clash."""
    words = [f"w{i}" for i in range(25)]
    base = [rng.choice(words) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b"), (6, "é É"), (7, " \n\t ")]
    for i in range(45):
        doc = list(base) if i % 3 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            doc[rng.randrange(len(doc))] = rng.choice(words)
        rows.append((100 - i, " ".join(doc)))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, cid long")
    got = sorted(map(tuple, jaccard_join.near_duplicates(df, k, percent, **sizes).collect()))
    assert got == brute_jaccard(rows, k, percent)
    if not sizes:
        keep = {d for d, _, c in got if d == c}
        assert {r.doc_id for r in jaccard_join.keep_one(df, k, percent).collect()} == keep
        assert jaccard_join.near_duplicates(df.limit(0), k, percent).count() == 0


def test_jaccard_join_of_words_with_equal_sums(spark):
    """Thue-Morse words and their complements: sums of powers of a base modulo 2^64 can't tell them apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


@pytest.mark.parametrize("sizes", [{}, {"unit_shingles": 3000, "leaders": 4}])
def test_jaccard_join_of_a_large_near_group(spark, rng, sizes):
    """Copies of one text with a changed word or three, repeated rows, null ids and a very long text."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(700):
        doc = list(base)
        for _ in range(rng.randrange(4)):
            doc[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(doc)))
    rows += [(5000, " ".join(base * 400)), (5001, " ".join(base * 401))] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.near_duplicates(df, 3, 90, **sizes).collect())) == brute_jaccard(rows, 3, 90)
    null = spark.createDataFrame([(None, "a b c d"), (None, "A b c d"), (7, "a b c D"), (None, "p q r")], "doc_id long, text string")
    assert sorted(map(str, (r.component_id for r in jaccard_join.near_duplicates(null, 3, 90).collect()))) == ["7", "7", "7", "None"]


def test_jaccard_join_collects_no_rows_by_class(spark, monkeypatch):
    """The driver gets the sketch's parts as rows, and the filter of the classes as Arrow batches."""
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(400)]
    rows = [(2 * i + j, t + " end" * j) for i, t in enumerate(texts) for j in (0, 1)]
    df, kind, most = spark.createDataFrame(rows, "doc_id long, text string"), type(spark.range(0)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: most.append(len(out := collect(self))) or out)
    result = jaccard_join.near_duplicates(df, 3, 90)
    monkeypatch.undo()
    assert max(most) <= jaccard_join.SKETCH_PARTS
    assert {(r.doc_id, r.component_id) for r in result.collect()} == {(i, i - i % 2) for i, _ in rows}


def test_filter_of_classes(spark):
    cids = [0, 1, -1, 63, 64, (1 << 23) - 1, 1 << 23, (5 << 23) + 127, -(1 << 63), 7, 7]
    places = {c & ((1 << jaccard_join.FILTER_BITS) - 1) for c in cids}
    packed = jaccard_join._filter(spark.createDataFrame([(c,) for c in cids], "cid long"), "cid")
    assert {64 * int(w) + b for w in np.flatnonzero(packed) for b in range(64) if int(packed[w]) >> b & 1} == places


def test_divide_skip(rng):
    universe = np.sort(np.array([rng.getrandbits(63) for _ in range(60)], np.uint64))
    for _ in range(60):
        sets = [np.sort(rng.sample(universe.tolist(), rng.randint(1, 40))).astype(np.uint64) for _ in range(12)]
        query = np.sort(rng.sample(universe.tolist(), rng.randint(1, 40))).astype(np.uint64)
        q = set(query.tolist())
        want = [i for i, s in enumerate(sets) if 100 * len(q & set(s.tolist())) >= 50 * len(q | set(s.tolist()))]
        assert jaccard_join.DivideSkip(sets).search(query, 50).tolist() == want


def test_merged_counts(rng):
    for n in (1, 5, 80):
        lists = [np.array(sorted(rng.sample(range(100), rng.randint(1, 40)))) for _ in range(n)]
        want = Counter(x for own in lists for x in own.tolist())
        found, count = jaccard_join.merged_counts(lists)
        assert dict(zip(found.tolist(), count.tolist())) == want and found.tolist() == sorted(want)


def test_components(spark, rng):
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r.node: r.comp for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)


def brute_spans(rows, length):
    seen, texts = Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for i, b in texts:
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        left = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,most", [(1, 1000), (2, 2)])
def test_suffix_dedup(spark, seed, most):
    import random

    r = random.Random(seed)
    words = ["abc", "de", "abcdefgh ijklmnop", "zzzzzzzzzz", "é"]
    rows = [(i, None if i == 3 else "".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(50)] + [(100, "q" * 90), (101, "x" * 30 + "ab" * 40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = suffix_dedup.remove_repeats(df, length=24, gram=8, most_contexts=most)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == brute_spans(rows, 24)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got.collect())
    assert suffix_dedup.remove_repeats(df.limit(0), length=24, gram=8).count() == 0


def test_suffix_dedup_of_a_text_longer_than_a_step(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    text = "".join(f"{i * 7919 % 1000:03d}" for i in range(400))
    rows = [(1, text), (2, "head" + text[500:900]), (3, "other" * 3)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=24, gram=8, keep_bytes=False)
    assert sorted(map(tuple, got.collect())) == brute_spans(rows, 24)


def one_edit(a, b):
    p = s = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def brute_lines(rows):
    first, lines = {}, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        for k, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\r\x0b\x0c")
            if x:
                lines.append((i, k, x))
                first.setdefault(x, (i, k))
    near, seen = set(), []
    for x in sorted(first, key=first.get):
        if len(x) >= line_dedup.LEAST_NEAR:
            if any(abs(len(x) - len(y)) < 2 and one_edit(x, y) for y in seen):
                near.add(x)
            seen.append(x)
    out = defaultdict(list)
    for i, k, x in lines:
        if x in near or first[x] != (i, k):
            out[i].append(k)
    return dict(out)


def test_line_dedup(spark, rng):
    base = ["the quick brown fox jumps", "éa quick brown fox jumps ov", "short", "", "  pad the quick brown fox jumps ", "a" * 28, "x" * 400]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if x:
                k, c, o = rng.randrange(len(x)), rng.choice("xyz"), rng.random()
                x[k : k + (o < 0.7)] = [] if 0.4 < o < 0.7 else [c]
        return "".join(x)

    rows = [(i, None if i == 4 else "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("removed", F.lit(1))
    want = brute_lines(rows)
    assert {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df, max_edits=1).collect()} == want
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(df, max_edits=1).collect()}
    for i, t in rows:
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in want.get(i, [])]
        if i in want and not any(x.strip() for x in left):
            assert i not in kept
        else:
            assert kept[i].text == (None if t is None else "\n".join(left)) and kept[i].n_chars == (None if t is None else len(kept[i].text))
    assert line_dedup.removed_lines(df.limit(0)).count() == 0


def test_within_edits(spark, rng, monkeypatch):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (2000, 0):
        monkeypatch.setattr(line_dedup, "BUILT_IN", most)
        for e in (1, 2, 3):
            got = df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), e).alias("ok")).collect()
            assert all(r.ok == (distance(r.a, r.b) <= e) for r in got)


def edit_distance(a, b, most):
    """Or a larger number where it is over ``most``; cells further from the diagonal than that aren't computed."""
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        row, old = {}, row
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            ways = [old.get(j, 99) + 1, row.get(j - 1, 99) + 1] + ([old.get(j - 1, 99) + (x != b[j - 1])] if j else [])
            row[j] = min(ways)
        if min(row.values(), default=99) > most:
            return 99
    return row.get(len(b), 99)


def brute_budget_lines(rows, per, most=99, least=line_dedup.LEAST_NEAR):
    """Numbers of the removed lines of each row; rows in order of their ids. Of rows with equal ids the first one is whole."""
    first, near, out = {}, set(), []
    for i, (_, t) in enumerate(rows):
        for k, x in enumerate((t or "").split("\n")):
            first.setdefault(x.strip(" \t\r\x0b\x0c"), (i, k))
    known = sorted((x for x in first if len(x) >= least), key=first.get)
    for j, x in enumerate(known):
        if any(abs(len(x) - len(y)) <= (e := min(most, max(1, min(len(x), len(y)) // per))) and edit_distance(x, y, e) <= e for y in known[:j]):
            near.add(x)
    for i, (_, t) in enumerate(rows):
        lines = [x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")]
        out.append([k for k, x in enumerate(lines) if x and (x in near or first[x] != (i, k))])
    return out


@pytest.mark.parametrize("per", [20, 50])
def test_line_dedup_budgets(spark, rng, per):
    """Budgets of one to four edits, at the edges of the length classes, with edits anywhere in the line."""
    base = ["".join(rng.choice("abcdé fgh") for _ in range(n)).strip() + "." for n in (per - 1, 2 * per, 2 * per + 1, 3 * per, 3 * per + 2, 4 * per, 4 * per + 1)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            k, o = rng.randrange(len(x)), rng.random()
            x[k : k + (o < 0.7)] = [] if 0.4 < o < 0.7 else [rng.choice("xyz")]
        return "".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 3)))) for i in range(60)]
    want = {i: gone for (i, _), gone in zip(rows, brute_budget_lines(rows, per)) if gone}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df, per=per, max_edits=4).collect()} == want


@pytest.mark.parametrize("edits", [1, 2, 3])
@pytest.mark.parametrize("crowd", [99, 2])
def test_line_dedup_thresholds(spark, rng, monkeypatch, edits, crowd):
    """Lines of one character and more, within a number of edits that depends on no length (from as many characters as edits on);
    with crowd = 2 nearly all keys are of larger groups, and lines are hot that are a tenth of all."""
    monkeypatch.setattr(line_dedup, "HOT_GROUP", crowd)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 10)
    base = ["ab", "abcdé", "the cat sat", "the cat sat on the", "a longer line of thirty letters or", "x", "0123456789" * 6]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k, o = rng.randrange(len(x) + 1), rng.random()
            x[k : k + (o < 0.7)] = [] if 0.4 < o < 0.7 else [rng.choice("xyz0 ")]
        return "".join(x)

    rows = [(i, "\n".join(rng.choice([line(), line(), "the very common line"]) for _ in range(rng.randint(0, 4)))) for i in range(70)]
    want = {i: gone for (i, _), gone in zip(rows, brute_budget_lines(rows, 1, edits, 1)) if gone}
    twice = [(i, t) for i, t in rows if i % 9 == 0]
    df = spark.createDataFrame(rows + twice, "doc_id long, text string")
    got = defaultdict(list)
    for r in line_dedup.removed_lines(df, per=1, max_edits=edits, least=1).collect():
        got[r.doc_id].append(list(r.removed))
    for i, t in rows:
        every = [k for k, x in enumerate(t.split("\n")) if x.strip()]
        copies = [every] if i % 9 == 0 and every else []
        assert sorted(got[i]) == sorted([x for x in [want.get(i)] if x] + copies), i


def test_line_dedup_of_a_large_group(spark, rng):
    """One template with a number in it, among it a very long line, a line of a third of all, and columns with names of its own."""
    long = "long " * 30_000
    lines = [f"entry {rng.randrange(10**5):05d} of the journal that every document carries, word for word" for _ in range(400)] + ["the most common line of all"] * 200
    rng.shuffle(lines)
    rows = [(i, x, i) for i, x in enumerate(lines)] + [(900, long + "x", 1), (901, long, 1), (902, "", 1), (903, None, 1)]
    want = {i: gone for (i, *_), gone in zip(rows, brute_budget_lines([(i, t) for i, t, _ in rows[:-4]], 50, 2)) if gone} | {901: [0]}
    df = spark.createDataFrame(rows, "doc_id long, gone_at string, own_lines int")
    assert {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df, text_col="gone_at").collect()} == want
    kept = line_dedup.dedup_lines(df, text_col="gone_at")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - set(want)


def test_line_dedup_compiles_no_plan_in_vain(spark, rng, monkeypatch):
    """Crowded lines have so many keys that whole-stage code would not compile: with the fallback off that is an error."""
    monkeypatch.setattr(line_dedup, "HOT_GROUP", 2)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(14)]
    rows = [(i, " ".join([*words, f"tail{i:02d}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert got == {i: x for (i, _), x in zip(rows, brute_budget_lines(rows, line_dedup.CHARS_PER_EDIT, line_dedup.MAX_EDITS)) if x}
    assert got and spark.conf.get("spark.sql.codegen.wholeStage") == "true"


def test_line_dedup_of_repeated_rows_and_ids(spark):
    """Of repeated rows one stays whole; rows that share an id but not a text keep their own line numbers."""
    a, b, c = "first line\nsecond line\n\nthird line", "another text\nthird line\nof the same id", " \n"
    rows = [(1, a), (1, a), (1, a), (2, b), (2, "of the same id\nand more"), (None, "no id"), (None, "no id"), (None, "no id either"), (3, c), (3, c), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    two = [r.text for r in df.where("doc_id = 2").orderBy(F.xxhash64("text")).collect()]
    rest = {b: "another text\nof the same id", "of the same id\nand more": "and more"} if two[0] == b else {b: "another text", "of the same id\nand more": "of the same id\nand more"}
    want = [(1, a), (2, rest[b]), (2, rest["of the same id\nand more"]), (None, "no id"), (None, "no id either"), (3, c), (3, c), (4, None), (4, None)]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    removed = Counter((r.doc_id, *r.removed) for r in line_dedup.removed_lines(df).collect())
    assert removed[1, 0, 1, 3] == 2 and removed[None, 0] == 1


def test_keep_one_of_repeated_and_null_ids(spark):
    a, b = "one two three four five six", "other words that are not like it"
    rows = [(1, a), (5, a), (5, b), (7, b + " x"), (2, "x y z"), (2, "x y z"), (None, "p q r s"), (None, "P q r s"), (None, "p q r s"), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_one(df, 3, 60).collect()]
    null = [t for i, t in got if i is None]
    assert len(null) == 1 and null[0].lower() == "p q r s"
    assert sorted(x for x in got if x[0] is not None) == [(1, a), (2, "x y z"), (3, ""), (3, ""), (5, b)]


def test_queries_with_their_own_parameters(spark):
    """op7, op8 and op9 over the smallest tables, against the plain versions with production parameters."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = jaccard_join.op7_jaccard_join(spark, SMALL).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_jaccard(rows, 3, 90)
    got = suffix_dedup.op8_suffix_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_spans(rows, 200)
    ordered = sorted(rows)
    want = {i: gone for (i, _), gone in zip(ordered, brute_budget_lines(ordered, line_dedup.CHARS_PER_EDIT, line_dedup.MAX_EDITS))}
    assert {r.doc_id: list(r.removed_lines) for r in line_dedup.op9_line_dedup(spark, SMALL).collect()} == want
