"""Movement analyses against brute force, and sources without a query of their own."""

import itertools
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import distributions as D
from chronoloom.operators import models as M
from chronoloom.operators import movement as A
from chronoloom.sources import readers as S


def is_chain(edges):
    nodes = {n for e in edges for n in e}
    degree = [sum(n in e for e in edges) for n in nodes]
    reached, grown = set(edges[0]), True
    while grown:
        more = {n for e in edges if set(e) & reached for n in e}
        grown, reached = not more <= reached, reached | more
    return reached == nodes and len(nodes) == len(edges) + 1 and max(degree) <= 2


def divisions(items):
    if not items:
        yield []
        return
    for rest in divisions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


@pytest.mark.parametrize("seed", range(12))
def test_md14_against_all_divisions(seed):
    rng = np.random.default_rng(seed)
    pairs = list(itertools.combinations(range(5), 2))
    ends = [pairs[i] for i in rng.choice(len(pairs), 6, replace=False)]
    lengths = rng.integers(1, 60, 6).tolist()
    want = {}
    for parts in divisions(list(range(6))):
        if all(is_chain([ends[i] for i in part]) for part in parts):
            cost = sum(abs(sum(lengths[i] for i in part) - 50) for part in parts)
            want[len(parts)] = min(cost, want.get(len(parts), cost))
    got = A.best_by_count(ends, lengths, 50, 6)
    assert {k: cost for k, (cost, _) in got.items()} == want
    for k, (_, masks) in got.items():
        assert len(masks) == k and sum(masks) == 63


def test_md14_table(spark):
    rows = [("a", 1, 0, 1, 30.0), ("a", 2, 1, 2, 20.0), ("b", 1, 0, 0, 9.0)]  # b is a loop: no chain covers it
    out = A.disambiguated(spark.createDataFrame(rows, "c string, s int, x int, y int, q double"), "c", "s", "x", "y", "q", 50.0, 3)
    assert sorted((r.c, r.individuals, r.cost, r.members) for r in out.collect()) == [("a", 1, 0.0, [[1, 2]]), ("a", 2, 50.0, [[1], [2]])]


def test_md14_many_clusters_at_once():
    """Costs of clusters of one arrangement equal those one by one; of equal costs the least chains are taken."""
    ends = ((0, 1), (1, 2), (2, 3), (3, 1), (3, 4))
    lengths = np.random.default_rng(4).integers(1, 4, (200, 5)) * 10.0
    found = A.divided(ends, lengths, 30.0, 4)
    for r, row in enumerate(lengths.tolist()):
        want = {}
        for parts in divisions(list(range(5))):
            if all(is_chain([ends[i] for i in part]) for part in parts):
                masks = sorted((sum(1 << i for i in part) for part in parts), key=lambda m: m & -m)
                entry = sum(abs(sum(row[i] for i in part) - 30) for part in parts), masks
                want[len(parts)] = min(entry, want.get(len(parts), entry))
        assert {k: (cost[r], masks[r].tolist()) for k, (cost, masks) in found.items()} == {k: v for k, v in want.items() if k <= 4}
    long = tuple((i, i + 1) for i in range(70))
    assert A.best_by_count(list(long), [1.0] * 70, 35.0, 2)[2] == (0.0, ((1 << 35) - 1, (1 << 70) - (1 << 35)))


def test_md14_table_of_several_arrangements(spark):
    rng = np.random.default_rng(8)
    shapes = [["xy", "yz", "zw"], ["yx", "zy", "zw"], ["xy", "xz", "xw"], ["xx", "xy"], ["ab"]]
    clusters = {c: [(i + 5, *p, float(q)) for i, (p, q) in enumerate(zip(shapes[c % 5], rng.integers(1, 60, 3)))] for c in range(60)}
    rows = [(c if c else None, *row) for c, members in clusters.items() for row in members]
    out = A.disambiguated(spark.createDataFrame(rows, "c long, s int, x string, y string, q double"), "c", "s", "x", "y", "q", 50.0, 3)
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # a batch of clusters is divided at once
    got = {(r.c or 0, r.individuals): (r.cost, r.members) for r in out.collect()}
    want = {}
    for c, members in clusters.items():
        for k, (cost, masks) in A.best_by_count([m[1:3] for m in members], [m[3] for m in members], 50.0, 3).items():
            want[c, k] = cost, [[m[0] for i, m in enumerate(members) if mask >> i & 1] for mask in masks]
    assert got == want


@pytest.mark.parametrize("level", range(4))
def test_ma24_is_least_squares(spark, level):
    rng = np.random.default_rng(level)
    x = np.sort(rng.uniform(2, 9, 80))
    y = np.sin(x) + rng.normal(0, 0.2, 80)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)] + [("one", 3.0, 4.0), ("one", None, 1.0)], "k string, x double, y double")
    fit = A.spline_fit(df, ["k"], "x", "y", level)
    got = df.where("k = 'k'").join(fit, "k").select("x", A.spline_value(F.col("x"), F.col("low"), F.col("high"), F.col("controls"), level).alias("v")).orderBy("x").collect()
    n = A.SMOOTHNESS[level]
    knots = np.arange(-3, n + 1) / (n - 3)
    u = (x - x[0]) / (x[-1] - x[0])
    basis = [np.where((knots[:-1] <= u[:, None]) & (u[:, None] < knots[1:]), 1.0, 0.0)]
    for p in (1, 2, 3):  # the recurrence of the definition
        b = basis[-1]
        basis.append(np.stack([(u - knots[j]) / (knots[j + p] - knots[j]) * b[:, j] + (knots[j + p + 1] - u) / (knots[j + p + 1] - knots[j + 1]) * b[:, j + 1] for j in range(b.shape[1] - 1)], 1))
    full = basis[-1][:, :n]
    want = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    assert np.allclose([r.v for r in got], want, atol=1e-3)
    assert fit.where("k = 'one'").count() == 1


def test_ma20_draws(spark):
    k = F.col("id")
    df = spark.range(20000).select(D.uniform_draw(k, 1).alias("u"), D.gaussian_draw(k, 1).alias("g"), D.density_draw(k, 1, [1.0, 0.0, 3.0]).alias("p"))
    r = df.agg(F.avg("u").alias("u"), F.avg("g").alias("g"), F.stddev("g").alias("s"), F.avg((F.col("p") == 2).cast("int")).alias("p"), F.sum((F.col("p") == 1).cast("int")).alias("none"), F.corr("u", "g").alias("c")).first()
    assert abs(r.u - 0.5) < 0.01 and abs(r.g) < 0.03 and abs(r.s - 1) < 0.03 and abs(r.p - 0.75) < 0.02 and r.none == 0
    again = spark.range(20000).repartition(7).select(D.uniform_draw(k, 1).alias("u"), D.gaussian_draw(k, 1).alias("g"), D.density_draw(k, 1, [1.0, 0.0, 3.0]).alias("p"))
    assert sorted(df.collect()) == sorted(again.collect())


def test_md08_dispatch(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([200.0, 190.0, 5.0, 4.0])], "u int, t int, v double")
    model = {"means": [10.0, 200.0], "sds": [20.0, 20.0], "step": [[0.9, 0.1], [0.1, 0.9]]}
    assert [r.state for r in M.analyse("hybrid", df, "u", ["t"], "v", 50.0, 150.0, **model).orderBy("t").collect()] == [1, 1, -1, -1]
    with pytest.raises(ValueError):
        M.analyse("none")


def test_files(spark, tmp_path):
    names = S.MEASUREMENTS.fieldNames()
    rows = [tuple(range(i, i + 14)) + (0.5, None, 1.25, -2.0) for i in range(3)]
    table = spark.createDataFrame(rows, S.MEASUREMENTS)
    S.write_measurements(table, f"{tmp_path}/m")
    back = S.read_measurements(spark, f"{tmp_path}/m")
    assert back.columns == names and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)

    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.JPG").write_bytes(b"x")
    (tmp_path / "i" / "b.tiff").write_bytes(b"yy")
    found = S.images(spark, f"{tmp_path}/i")
    assert sorted((r.kind, r.length) for r in found.select("kind", "length").collect()) == [("jpg", 1), ("tiff", 2)]
    (tmp_path / "i" / "c.gif").write_bytes(b"z")
    with pytest.raises(Exception, match="unknown image"):
        S.images(spark, f"{tmp_path}/i").collect()
    shown = spark.createDataFrame([("a.JPG", "8-bit")], "n string, m string")
    assert shown.select(S.output_kind(F.col("n")), S.jpeg_components(F.col("m"))).first()[:] == ("JPG", "8-bit")
    with pytest.raises(Exception, match="8-bit components only"):
        shown.select(S.jpeg_components(F.lit("16-bit"))).collect()

    (tmp_path / "w.json").write_text(json.dumps({"units": {"t": "s"}, "data": [{"id": "1", "t": [0, 1], "x": [1.5, 2.5]}]}))
    wcon = S.read_wcon(spark, f"{tmp_path}/w.json").select(F.explode("data").alias("d")).select("d.id", "d.x").first()
    assert wcon.id == "1" and wcon.x == [1.5, 2.5]
    with_meta = S.with_metadata(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", 7)], "name string, v int"))
    assert sorted((r.name, r.v) for r in with_meta.collect()) == [("a", 7), ("b", None)]
    assert S.unpack_header(struct.pack("<IIBd", 2, 3, 1, 0.5) + b"d\0") == (2, 3, 1, 0.5, "d")
    with pytest.raises(ValueError):
        from chronoloom.operators.relational import statement
        statement(spark, "  ")
