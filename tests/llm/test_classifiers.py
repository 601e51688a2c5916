import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import decontamination, language_id, quality, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.op2_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark):
    model = language_id.fit(spark.createDataFrame([("ein und der die das", "de"), ("the and of to in", "en"), (None, "en"), ("x", None)], "text string, lang string"))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !?", "c"), (4, "the and of", "d"), (4, "the and of", "d"), (5, "der die " * 40_000, "e")], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    empty = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_toxicity_on_rows_it_learns_from_and_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = toxicity.op10_toxicity(spark, DATA).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    clean, bad = [r.score for r in got if r.toxic == 0], [r.score for r in got if r.toxic == 1]
    assert np.mean([a > b for a in bad for b in clean]) > 0.9
    assert sum(x >= 0.5 for x in clean) <= 0.02 * len(clean)


def test_toxicity_edges(spark):
    learnt = spark.createDataFrame([("you idiot", 1), ("hello there", 0)] * 60 + [(None, 0)], "text string, label int")
    model = toxicity.fit(learnt)
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "such an IDIOT, really", 0), (4, "hello", 0), (4, "hello", 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got[1] == got[2] and got[3] > 0.5 > got[4]
    nothing = toxicity.fit(learnt.limit(0))
    assert all(0.49 < r.score < 0.5 for r in toxicity.score(df, nothing).collect())
    assert toxicity.score(df.limit(0), model).count() == 0


def test_quality_keeps_clean_rows(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = quality.op6_quality(spark, DATA).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, quality int")
    df = spark.createDataFrame([(1, None, None, None, None, 1.0), (2, "", "en", "s", 0, 1.0), (2, "", "en", "s", 0, 1.0)], "doc_id long, text string, lang string, source string, n_chars long, content_score double")
    model = quality.fit(df, labels)
    assert not model.trained
    assert quality.filter_quality(df, labels).count() == 3 and quality.filter_quality(df, labels).columns == df.columns
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] > 0).astype(float)
    taught = quality.CoTrained(x[:200], x[:200, :2], y[:200], quality.ask_arrays(x[200:], x[200:, :2]))
    assert ((taught.scores(x, x[:, :2])[0] > 0.5) == y).mean() > 0.93


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row, old = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_decontamination(spark, rng):
    items = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(5, 60)))) for i in range(6)] + [(6, None), (7, "  "), (8, "ab")]
    rows = [(1, None), (2, "")]
    for i in range(60):
        body = list(items[rng.randrange(6)][1])
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(body))
            body[k : k + rng.randint(0, 1)] = [] if rng.random() < 0.5 else [rng.choice("abcdX")]
        rows.append((10 + i, "".join(rng.choice("abcd ") for _ in range(20)) + "".join(body).upper() + " \n cd"))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, matches int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        text = decontamination.folded(t)
        found = []
        for k, x in items:
            item = decontamination.folded(x)
            edits = brute_edits(item, text) if item and text else None
            if edits is not None and edits <= len(item) * 8 // 100:
                found.append((k, edits))
        want[i] = found
    got = {r.doc_id: [(m.item_id, m.edits) for m in r.matches] for r in decontamination.benchmark_matches(df, bench).collect()}
    assert got == want
    assert {r.doc_id for r in decontamination.drop_matches(df, bench).collect()} == {i for i, f in want.items() if not f}
    assert decontamination.benchmark_matches(df.limit(0), bench).count() == 0
    assert all(not r.matches for r in decontamination.benchmark_matches(df, bench.limit(0)).collect())


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} of the test set") for i in range(20)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"x item number {i} of the test set y") for i in range(20)], "doc_id long, text string")
    whole = {r.doc_id: r.matches for r in decontamination.benchmark_matches(df, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    assert {r.doc_id: r.matches for r in decontamination.benchmark_matches(df, bench).collect()} == whole


def test_decontamination_of_null_and_other_ids(spark):
    items = [(None, "the quick brown fox jumps"), ("b", "the quick brown fox jumps"), ("a", "The quick  brown fox jumps!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(None, "see the quick brown fox jumps."), (1, "nothing"), (1, "nothing"), (2, "x" * 300_000 + " the quick brown fox jumps")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, [(m.item_id, m.edits) for m in r.matches]) for r in decontamination.benchmark_matches(df, bench).collect()]
    found = [(None, 0), ("a", 1), ("b", 0)]
    assert sorted(got, key=str) == sorted([(None, found), (1, []), (1, []), (2, found)], key=str)
    assert [r.doc_id for r in decontamination.drop_matches(df, bench).collect()] == [1, 1]


def test_language_id_of_many_copies(spark, monkeypatch):
    """Ten thousand copies of one labelled text teach once, and don't come to the driver."""
    monkeypatch.setattr(language_id, "MOST_TRAINING_ROWS", 20)
    rows = [("der die und das ein", "de")] * 10_000 + [(f"the and of {i}", "en") for i in range(100)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([(1, "the and of"), (2, "der und die")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()} == {1: "en", 2: "de"}
    assert len(model.middle) <= 20


def brute_ftrl(rows, buckets):
    """FTRL-proximal in plain Python over sets of buckets; the bias has no L1."""
    z, n = [0.0] * (buckets + 1), [0.0] * (buckets + 1)

    def weight(i):
        l1 = 0.0 if i == buckets else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for own, y in rows:
            own = [*own, buckets]
            w = [weight(i) for i in own]
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w))))) - y
            for i, x in zip(own, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * x
                n[i] += g * g
    return [weight(i) for i in range(buckets + 1)]


def test_ftrl_is_the_plain_one(rng):
    rows = [(sorted(rng.sample(range(30), rng.randint(1, 8))), rng.randint(0, 1)) for _ in range(60)]
    model = toxicity.Ftrl(30)
    for _ in range(toxicity.PASSES):
        for own, y in rows:
            model.learn(np.array([*own, 30]), y)
    assert np.allclose(model.weights(slice(None)), brute_ftrl(rows, 30))


def test_surest_rows_of_a_table(spark, rng, monkeypatch):
    """The table's answer is that of a plain sort over all rows, whatever the partitions; copies teach once."""
    monkeypatch.setattr(quality, "EACH_ROUND", 5)
    x = np.random.default_rng(1)
    content, metadata = x.normal(size=(60, quality.N_CONTENT)).astype(np.float32), x.integers(0, 2, (60, quality.N_METADATA)).astype(np.float32)
    weights = [x.normal(size=quality.N_CONTENT + 1), x.normal(size=quality.N_METADATA + 1)]
    rows = [(i, bytearray(c.tobytes()), bytearray(m.astype(np.uint8).tobytes())) for i, (c, m) in enumerate(zip(content, metadata))]
    table = spark.createDataFrame(rows + rows[:20], "key long, content binary, metadata binary").repartition(4)
    used = {3, 4, 5}
    got = [sorted(keys.tolist()) for *_, keys in quality._ask_table(table)(weights, used)]
    want = []
    for view, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
        p = 1 / (1 + np.exp(-np.clip(np.append((content, metadata)[view], np.ones((60, 1)), 1) @ weights[view], -35, 35)))
        sure = p if label else 1 - p
        order = sorted((i for i in range(60) if i not in used and sure[i] >= quality.SURE), key=lambda i: (-sure[i], i))
        want.append(sorted(order[:5]))
    assert got == want and [sorted(k.tolist()) for *_, k in quality.ask_arrays(content, metadata)(weights, used)] == want
