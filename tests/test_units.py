"""Edge rows and quirks that the oracle queries don't reach."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from chronoloom.functions import distributions as D
from chronoloom.functions import image as I
from chronoloom.functions import jsonx as J
from chronoloom.functions import measures
from chronoloom.functions import text as X
from chronoloom.operators import models as M
from chronoloom.operators import ordered as O
from chronoloom.operators import relational as R
from chronoloom.operators import statistics as S
from chronoloom.operators import survival as V
from chronoloom.plans import catalog
from chronoloom.sources import readers as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n", [1, 3, 4, 8, 20])
def test_ag01_percentiles_by_place(spark, n):
    v = sorted(random.Random(n).random() * 100 for _ in range(n))
    r = S.robust_stats(spark.createDataFrame([("a", x) for x in v], "k string, v double"), ["k"], F.col("v")).first()
    f = [float(np.float32(x)) for x in v]
    assert (r.median, r.p75, r.p95) == (f[n // 2], f[int(0.75 * n)], f[int(0.95 * n)])


def test_ag01_no_values(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    r = S.robust_stats(df, ["k"], F.col("v")).first()
    assert (r.avg, r.median, r.sum) == (0, 0, 0) and r.max < 0 and r.min > 3e38
    assert S.robust_stats(df, ["k"], F.col("v"), compat=False).first().median is None


def test_ag03_compat_and_native(spark):
    t, y = [0.0, 1.0, 2.0, 5.0], [3.0, 1.0, 4.0, 9.0]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(t, y)], "k int, t double, y double")
    mt, my = (sum(t[1:]) + 2.5) / 4, (sum(y[1:]) + 5.0) / 4
    tt, ty = sum((a - mt) ** 2 for a in t[1:]), sum((a - mt) * (b - my) for a, b in zip(t[1:], y[1:]))
    r = S.regression(df, ["k"], "t", "y", ["t"]).first()
    assert math.isclose(r.slope, ty / tt) and math.isclose(r.intercept, my - ty / tt * mt)
    assert math.isclose(r.mse, sum((b - my - ty / tt * (a - mt)) ** 2 for a, b in zip(t[1:], y[1:])) / 4)
    flat = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 5.0)], "k int, t double, y double")
    assert S.regression(flat, ["k"], "t", "y", ["y"]).first().slope == 0
    assert math.isclose(S.regression(df, ["k"], "t", "y", ["t"], compat=False).first().slope, np.polyfit(t, y, 1)[0])


def test_erfc_and_tails(spark):
    for x in (-3.0, -0.5, 0.0, 0.7, 2.5):
        assert math.isclose(one(spark, D.erfc_chebyshev(F.lit(x))), math.erfc(x), abs_tol=1e-14)
        assert math.isclose(one(spark, D.erfc_closed(F.lit(x))), math.erfc(x), abs_tol=2e-7)
    assert math.isclose(one(spark, D.two_sided_tail(F.lit(0.0))), 1)
    assert one(spark, D.lognormal_tail(F.lit(-1.0), 0.0, 1.0)) is None and one(spark, D.lognormal_tail(F.lit(0.0), 0.0, 1.0)) is None
    assert one(spark, D.lognormal_tail(F.lit(0.0), 0.0, 1.0, compat=True)) == 0 and math.isnan(one(spark, D.lognormal_tail(F.lit(-1.0), 0.0, 1.0, compat=True)))
    for p in (0.01, 0.3, 0.5, 0.9):
        assert math.isclose(one(spark, D.normal_cdf(D.normal_quantile(F.lit(p)))), p, abs_tol=1e-6)


def test_measures(spark):
    assert one(spark, measures.mean_intensity(F.lit(3), F.lit(0))) is None
    assert one(spark, measures.mean_intensity(F.lit(3), F.lit(0), True)) == float("inf")
    assert math.isnan(one(spark, measures.mean_intensity(F.lit(0), F.lit(0), True)))
    v = spark.range(1).select(*measures.death_time_measures(F.lit(1.0), F.array(F.lit(4.0), F.lit(5.0), F.lit(6.0)), F.lit(2.0))).first()
    assert tuple(v) == (1.0, 5.0, 2.0)
    assert one(spark, measures.elementwise(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(5)), "-")) == [-2, -3]


def test_pixels_and_colours(spark):
    assert one(spark, I.nearest_bar(F.lit(10.0), [5.0, 15.0, 40.0])) == 0 and one(spark, I.nearest_bar(F.lit(1.0), [5.0, 15.0, 40.0])) == 0
    assert one(spark, I.hex_channel(F.lit(""), 0)) == 0 and one(spark, I.hex_channel(F.lit("1gff00"), 0)) == 1
    with pytest.raises(Exception, match="six digits"):
        one(spark, I.hex_channel(F.lit("fff"), 0))
    assert one(spark, I.rgb_to_hex(F.lit(255), F.lit(0), F.lit(16))) == "ff0010"
    assert len(I.wheel()) == 55 and math.isclose(sum(map(sum, I.gaussian_kernel_2d(2, 1.0))), 1)
    assert one(spark, I.flow_colour(F.lit(2e9), F.lit(0.0), 0)) == 0
    assert I.gaussian_kernel(1, 0.5, compat=True)[0] != I.gaussian_kernel(1, 0.5)[0]


@pytest.mark.parametrize("text,value", [("12abc", 12), (" -3.5e2x", -350), ("abc", 0), ("", 0), (".5", 0.5), ("7.", 7), ("1e5", 1e5)])
def test_sc08_numeric_prefix(spark, text, value):
    assert one(spark, X.prefix_double(F.lit(text))) == value


def test_sc07_fields(spark):
    df = spark.createDataFrame([("a,,7x\r",), ("",)], "l string")
    assert [tuple(r) for r in Q.delimited(df, "l", a="string", b="double", c="long", d="string").collect()] == [("a", 0.0, 7, ""), ("", 0.0, 0, "")]


@pytest.mark.parametrize("raw,text", [("a&lt;b&gt;&amp;", "a<b>&"), ("&apos;x", "&x"), ("&#39;y", "y"), ("&qx", "&qx"), ("&&lt;", "&&lt;"), ("a&ltb", "a<"), ("", "")])
def test_st04_entities(spark, raw, text):
    assert one(spark, X.unescaped(F.lit(raw))) == text


def test_text_rules(spark):
    assert one(spark, X.embedded_description(F.lit("<x/>"))) == "" and one(spark, X.embedded_description(F.lit(f"<dc:description>{X.MARKER}abc<b>"))) == "abc"
    assert one(spark, X.sample_ids(F.lit("12o34o56"))) == [12, 34, 56]
    with pytest.raises(Exception, match="unknown type"):
        one(spark, X.label_of(F.lit("other"), X.TRANSITION_TYPES))


def test_relational_choices(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", "x", 2), ("a", "y", 1)], "k string, v string, o int")
    assert sorted(map(tuple, R.first_match_join(left, right, "k", "v", F.col("o")).collect())) == [("a", "y"), ("b", "")]
    with pytest.raises(Exception, match="exactly one row"):
        R.exactly_one_row(left).collect()
    a = spark.createDataFrame([(1, t) for t in (0, 5, 9)], "k int, t int")
    b = spark.createDataFrame([(1, u) for u in (0, 3, 8, 14, 15)], "k int, u int")
    assert sorted((r.t, r.u) for r in R.band_join(a, b, ["k"], "t", "u", 5).collect()) == sorted((t, u) for t in (0, 5, 9) for u in (0, 3, 8, 14, 15) if 0 <= u - t <= 5)
    v = spark.createDataFrame([(1, 3, "p"), (1, 3, "q"), (1, 8, "r")], "k int, t int, v string")
    assert sorted(map(tuple, R.as_of_join(a, v, ["k"], "t", "v", "last").select("t", "last").collect())) == [(0, None), (5, "q"), (9, "r")]
    rows = spark.createDataFrame([(i, "x" if i < 97 else "rare") for i in range(100)], "i int, label string")
    picked = R.stratified_subset(rows, "label", 10, F.col("i")).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in picked} == {"x": 9, "rare": 1}


def test_survival_properties(spark):
    rng = random.Random(3)
    rows = [("a", rng.randint(1, 20), rng.random() < 0.6) for _ in range(200)] + [("b", 5, True), ("b", 5, True), ("c", 4, False)]
    curve = V.kaplan_meier(spark.createDataFrame(rows, "k string, t int, e boolean"), ["k"], "t", F.col("e")).orderBy("k", "t").collect()
    s = 1.0
    for r in [r for r in curve if r.k == "a"]:
        at_risk = sum(1 for k, t, _ in rows if k == "a" and t >= r.t)
        dead = sum(1 for k, t, e in rows if k == "a" and t == r.t and e)
        s *= 1 - dead / at_risk
        assert r.at_risk == at_risk and r.deaths == dead and math.isclose(r.survival, s, abs_tol=1e-9)
    assert [r.survival for r in curve if r.k == "b"] == [0.0] and [r.survival for r in curve if r.k == "c"] == [1.0]


def test_wn06_stitching_against_a_loop(spark):
    rng = random.Random(4)
    parts, island, t = [], 0, 0
    for _ in range(40):
        island += 1
        t += rng.randint(0, 20)
        parts.append((1, island, t, t + rng.randint(0, 10), 1, rng.random() * 9, rng.random() * 9))
    df = spark.createDataFrame(parts, "k int, island long, begin long, end long, n long, first_position double, last_position double")
    got = [(r.begin, r.end, r.fragments) for r in O.stitched(df, ["k"], 10, 3, 6.0, 0).orderBy("path").collect()]
    want, reach = [], None
    for _, _, b, e, _, f, last in sorted(parts, key=lambda p: (p[2], p[3], p[1])):
        if reach and b - reach[0] <= 10 and reach[0] - b <= 3 and abs(f - reach[1]) <= 6.0:
            want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
        else:
            want.append((b, e, 1))
        reach = max([x for x in (reach, (e, last)) if x])
    assert got == want


def test_gap_filling(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 25, "b")], "k int, t long, v string")
    assert [tuple(r) for r in O.gap_filled(df, ["k"], "t", 10, ["v"]).orderBy("t").collect()] == [(1, 0, "a", False), (1, 10, "a", True), (1, 20, "b", False)]


def test_jn11_assignment_is_the_cheapest():
    rng = np.random.default_rng(0)
    for rows, cols in ((3, 3), (4, 4), (2, 5), (5, 3)):
        for maximise in (False, True):
            cost = rng.integers(0, 20, (rows, cols)).astype(float)
            to = M.assignment(cost, maximise)
            got = sum(cost[i, j] for i, j in enumerate(to) if j >= 0)
            n = max(rows, cols)
            padded = np.zeros((n, n))
            padded[:rows, :cols] = cost
            every = [sum(padded[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))]
            assert got == (max(every) if maximise else min(every)) and len({j for j in to if j >= 0}) == (to >= 0).sum()
    demo = np.array([[100, 1, 1], [100, 2, 2], [1, 0, 0], [0, 2, 0]], float)
    assert sum(demo[i, j] for i, j in enumerate(M.assignment(demo)) if j >= 0) == 1.0


def test_md07_viterbi_beats_random_paths():
    rng = np.random.default_rng(1)
    step, emit = np.log(rng.dirichlet(np.ones(3), 3)), rng.normal(size=(12, 3))
    start = np.log(np.ones(3) / 3)
    path, score = M.viterbi(start, step, emit)
    value = lambda p: start[p[0]] + emit[0, p[0]] + sum(step[p[t - 1], p[t]] + emit[t, p[t]] for t in range(1, 12))
    assert math.isclose(value(path), score) and all(value(rng.integers(0, 3, 12)) <= score + 1e-9 for _ in range(200))
    ordered, _ = M.viterbi(start, step + M.order_mask(3, "strict"), emit)
    assert all(b - a in (0, 1) for a, b in zip(ordered, ordered[1:]))


def test_md07_and_md18_em_find_their_sources():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(8, 1, 300)])
    mean, var, step, _ = M.baum_welch(x, np.array([-1.0, 5.0]), np.array([4.0, 4.0]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), 15)
    assert abs(mean[0]) < 0.3 and abs(mean[1] - 8) < 0.3 and np.allclose(step.sum(1), 1)
    weight, centre, _, score = M.diagonal_em(x[:, None], np.array([[0.0], [5.0]]))
    assert abs(sorted(centre[:, 0])[1] - 8) < 0.3 and abs(weight[0] - 0.5) < 0.05
    assert M.bic(score, len(x), 2, 1) < M.bic(M.diagonal_em(x[:, None], np.array([[0.0]]))[3], len(x), 1, 1)


def test_md18_over_a_table_equals_one_machine(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (80, 2)), rng.normal(6, 1, (80, 2))])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>").repartition(3)
    a, b = M.mixture(df, "v", [[0.0, 0.0], [5.0, 5.0]], 20), M.diagonal_em(x, np.array([[0.0, 0.0], [5.0, 5.0]]), 20)
    assert np.allclose(a[1], b[1], atol=1e-4) and np.allclose(a[0], b[0], atol=1e-4)


def test_json_documents():
    doc = {"answer": {"everything": 42}, "happy": True, "list": [1, 0, 2], "empty": {}, "a/b": {"m~n": None}}
    flat = J.flatten(doc)
    assert flat["/answer/everything"] == 42 and flat["/list/2"] == 2 and "/a~1b/m~0n" in flat and flat["/empty"] is None
    assert J.unflatten({k: v for k, v in flat.items() if k != "/empty"}) == {k: v for k, v in doc.items() if k != "empty"}
    rng = random.Random(6)

    def value(depth):
        k = rng.randint(0, 5 if depth else 3)
        return [None, rng.random() < 0.5, rng.randint(0, 9), "s"][k] if k < 4 else ([value(depth - 1) for _ in range(rng.randint(0, 3))] if k == 4 else {c: value(depth - 1) for c in "ab/~"[: rng.randint(0, 4)]})

    for _ in range(200):
        a, b = value(3), value(3)
        assert J.patched(a, J.difference(a, b)) == b
    assert J.merge_patched({"a": "b", "c": {"d": "e", "f": "g"}}, {"a": "z", "c": {"f": None}}) == {"a": "z", "c": {"d": "e"}}
    with pytest.raises(ValueError, match="106"):
        J.pointer_path("/a/01")


def test_json_pointers_in_plans(spark):
    v = spark.sql("""SELECT parse_json('{"array":["A","B"],"n":1,"a/b":2}') AS v""")
    assert v.select(J.at_pointer(F.col("v"), "/array/1", "string").alias("x")).first().x == "B"
    assert v.select(J.at_pointer(F.col("v"), "/a~1b", "int").alias("x")).first().x == 2
    with pytest.raises(Exception, match="403"):
        v.select(J.at_pointer(F.col("v"), "/none", "int")).collect()
    assert v.select(J.kind_rank(F.col("v")).alias("x")).first().x == 4


def test_sources_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("a,1.5x",), ("b,",)], "value string")
    Q.write_gzip(lines, str(tmp_path / "z"))
    assert sorted(map(tuple, Q.read_delimited(spark, str(tmp_path / "z"), name="string", n="double").collect())) == [("a", 1.5), ("b", 0.0)]
    pairs = spark.createDataFrame([("port", "10 x"), ("name", "a=b")], "key string, value string")
    Q.write_settings(pairs, str(tmp_path / "ini"))
    found = Q.settings(spark.read.text(str(tmp_path / "ini")))
    assert {r.key: r.value for r in found.collect()} == {"port": "10 x", "name": "a=b"}
    with pytest.raises(Exception, match="unknown setting"):
        Q.settings(spark.read.text(str(tmp_path / "ini")), known=["port"]).collect()
    raw = Q.pack_header(3, 700, 4, 1.25, "fine é")
    assert Q.unpack_header(raw) == (3, 700, 4, 1.25, "fine é")
    assert Q.headers(spark.createDataFrame([(raw,)], "b binary"), "b").first().width == 700
    people = spark.createDataFrame([("n2", "d1", 0, 86400, True), ("ctl", "d1", 0, 43200, False)], "strain string, device string, birth long, time long, event boolean")
    path = Q.write_survival(Q.survival_table(people, "detailed", controls="ctl"), str(tmp_path / "out"), "detailed")
    assert path.endswith("_detailed_jmp.csv") and Q.by_hand_table(spark, path).first().age_days == "1.0"
    assert Q.dump({"hosts": people, "alerts": people}, str(tmp_path / "dump")) == ["hosts"]
    assert Q.directory_size(Q.listing(spark, str(tmp_path / "dump"), "*.parquet")).first().bytes > 0


def test_streams(spark, tmp_path):
    from chronoloom.streaming import ingest as G

    folder = str(tmp_path / "in")
    rows = spark.sql("SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-01 00:00:00', 7L, 'view', 1.0D), (1L, timestamp_ntz'2024-01-01 00:00:00', 7L, 'view', 1.0D), (2L, timestamp_ntz'2024-01-01 00:01:00', 7L, 'purchase', 2.0D) AS t(event_id, ts, user_id, event_type, value)")
    rows.write.parquet(folder)
    out = str(tmp_path / "out")
    G.on_arrival(G.without_duplicates(G.arriving(spark, folder), ["event_id"], "ts", "1 hour"), str(tmp_path / "c1"), G.idempotent_sink(out)).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    q = G.region_stages(G.arriving(spark, folder), "user_id", "event_type", "ts", "1 minute", 60_000).writeStream.outputMode("update").format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.stage, r.events) for r in spark.table("stages").collect()} >= {("mask pending", 3)}


def test_mixture_query_takes_whole_vectors(spark, tmp_path):
    from chronoloom.plans import modelling

    r = np.random.default_rng(3)
    x = np.where(np.arange(90)[:, None] % 3 == 0, 3.0, -1.0) * (np.arange(12)[None] > 5) + r.normal(size=(90, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(np.float32).astype(float)
    for row in modelling.md18_mixture(spark, str(tmp_path)).collect():
        weight, _, _, score = M.diagonal_em(x, x[: row.components])
        assert np.allclose(row.weights, weight, atol=1e-6) and np.isclose(row.loglikelihood, score) and np.isclose(row.bic, M.bic(score, 90, row.components, 12))


def test_flow_colours_of_every_row(spark):
    from chronoloom.plans import statistics

    small = "/root/testdata/sf0.001"
    assert statistics.ma25_flow_colours(spark, small).count() == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_linear_svm_returns_the_searched_parameter(spark):
    from chronoloom.plans import modelling

    small = "/root/testdata/sf0.001"
    got = modelling.md16_linear_svm(spark, small).collect()
    label = {r.vec_id: int(r.label < 5) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    assert len(got) == len(label) and len({(r.reg_param, r.cv_accuracy, r.accuracy) for r in got}) == 1
    assert got[0].reg_param in (0.001, 0.01, 0.1, 1.0) and 0 < got[0].cv_accuracy <= 1
    assert got[0].accuracy == pytest.approx(sum(r.prediction == label[r.vec_id] for r in got) / len(got))


@pytest.mark.parametrize("values", [[float(i) for i in range(5000)], [1.0] * 3000 + [2.0] * 3000, [None, None], [-3.0, None, float("nan"), 7.5], [float(i % 7) for i in range(4001)]])
def test_ag01_against_sorting(spark, values):
    """Groups with ties, nulls, NaN and a null key; the places are exact whatever the sketch says."""
    rows = [(k, v) for k in ("a", None) for v in values]
    out = S.robust_stats(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), compat=False).collect()
    seen = sorted((abs(v) for v in values if v is not None), key=lambda v: (v != v, v))
    want = [str(seen[int(len(seen) * p)]) if seen else "None" for p in (0.5, 0.75, 0.95)]
    assert sorted(str(r.k) for r in out) == ["None", "a"]
    assert all([str(r["median"]), str(r.p75), str(r.p95)] == want for r in out)


def test_ag01_widens_a_bracket_that_misses(spark, monkeypatch):
    monkeypatch.setattr(S.F, "percentile_approx", lambda *_: F.array(*[F.max(F.lit(9999.0)).cast("float")] * 6))
    out = S.robust_stats(spark.createDataFrame([(1, float(i)) for i in range(100)], "k int, v double"), ["k"], F.col("v")).first()
    assert (out["median"], out.p75, out.p95) == (50.0, 75.0, 95.0)


@pytest.mark.parametrize("digits", [2, 6])
def test_fixed_is_the_printf_of_c(spark, digits):
    rng = random.Random(digits)
    v = [0.0, 1e-9, 25.0078125, -25.0078125, 0.125, 0.375, 1.005, 0.1234565, 25.0015625, 9.9999995, 1e15 / 3, 1e9 - 2**-24, 1e10 + 0.5, -(2.0**40) - 0.0078125, 2.0**53, float("nan"), float("inf"), -float("inf")]
    v += [rng.randrange(64000) / rng.choice([128, 640, 10_000_000]) for _ in range(500)]
    shown = spark.createDataFrame(list(enumerate(v)), "i int, x double").select("i", X.fixed(F.col("x"), digits).alias("s"))
    assert {r.i: r.s for r in shown.collect()} == {i: f"{x:.{digits}f}" for i, x in enumerate(v)}


def test_ag08_ties_and_nulls(spark, tmp_path):
    """Averages of 128 rows can end in a five at the seventh place; a cell without quantities is null."""
    rows = [(s, 1, float(i == 0) * s + 25.0) for s in range(1, 40) for i in range(128)] + [(50, 2, None), (None, 3, 1.0), (None, 3, None), (51, 9, 4.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert compare(spark, con, catalog.queries()["ag08_pivot"], catalog.oracles()["ag08_pivot"], str(tmp_path)) == 42


def test_ag01_parts_keep_the_order_and_are_bounded(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(0, 0x7F800001, 20000).astype(np.uint32).view(np.float32), np.float32(2.0) ** np.arange(-149, 128, dtype=np.float32), [0.0, 1e-45, np.inf]]).astype(np.float32)
    v = np.unique(np.concatenate([v, np.nextafter(v[v > 0], np.float32(0)), np.float32(1) + np.arange(70000, dtype=np.float32) / np.float32(1 << 23)]))
    got = S._with_part(spark.createDataFrame([(float(x),) for x in v] + [(float("nan"),)], "_v float")).orderBy("_v").toPandas()
    part = got["_part"].to_numpy()
    assert (np.diff(part) >= 0).all() and part[-1] > part[-2]
    assert max(np.unique(part, return_counts=True)[1]) <= 1 << 15


def test_ag01_no_rows_are_joined_by_their_group_alone(spark, monkeypatch):
    plain, most = S._with_group, []

    def counted(df, groups, keys, how="inner"):
        most.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(df, groups, keys, how)

    monkeypatch.setattr(S, "_with_group", counted)
    df = spark.range(50000).select(F.lit("a").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    out = S.robust_stats(df, ["k"], F.col("v")).first()
    assert (out["median"], out.p75, out.p95) == (3.0, 5.0, 6.0) and max(most) <= 7


def test_ag24_sketches_are_not_kept_by_pair(spark):
    plan = catalog.queries()["ag24_approx_error"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketches and not any("l_partkey" in line.split("functions=")[0] for line in sketches)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 17])
def test_jn11_many_at_once_equal_one_by_one(n):
    rng = np.random.default_rng(n)
    for c in (rng.integers(0, 9, (40, n, n)).astype(float), rng.normal(size=(40, n, n))):
        to = M.assignments(lambda p, i: c[p, i], 40, n)
        assert (np.sort(to, 1) == np.arange(n)).all()
        got = np.take_along_axis(c, to[:, :, None], 2)[:, :, 0].sum(1)
        assert np.allclose(got, [m[np.arange(n), M.assignment(m)].sum() for m in c])


def test_jn11_keys_go_to_python_together(spark, monkeypatch):
    """Few calls for many keys, with one key of many rows and a null one, in pieces too; the sorted order costs least."""
    rng = random.Random(1)
    rows = [(k, rng.random() * 100, rng.random() * 100) for k in range(300) for _ in range(k % 5 + 1)] + [(None, 1.0, 3.0)] + [(-1, rng.random(), rng.random()) for _ in range(150)]
    want = {}
    for k in {r[0] for r in rows}:
        x, y = (sorted(r[i] for r in rows if r[0] == k) for i in (1, 2))
        want[k] = (len(x), pytest.approx(sum(abs(a - b) for a, b in zip(x, y))))
    df = spark.createDataFrame(rows, "k long, x double, y double")
    assert {r.k: (r.n, r.cost) for r in M.assigned(df, "k", "x", "y").collect()} == want
    assert "FlatMapGroupsInPandas" not in catalog.queries()["jn11_assignment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    monkeypatch.setattr(M, "AT_ONCE", 8)
    assert {r.k: (r.n, r.cost) for r in M.assigned(df, "k", "x", "y").collect()} == want
    odd = spark.createDataFrame([(1, None, 3.0), (1, 5.0, 4.0), (1, float("inf"), None)], df.schema)
    assert [tuple(r) for r in M.assigned(odd, "k", "x", "y").collect()] == [(1, 3, 1.0)]
