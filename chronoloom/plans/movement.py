"""Queries for whole movement analyses, the hidden Markov model, clusters, images, draws and tables of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import image as I
from ..operators import models as M
from ..operators import movement as A
from ..operators import ordered as O
from ..operators import relational as R
from ..sources import readers as S
from .registering import Plans, table
from .series import events, subjects

plans = Plans()
query, QUERIES, ORACLES = plans.query, plans.queries, plans.oracles

_E = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t, value FROM events"
_PATHS = f"""e AS MATERIALIZED ({_E}),
m AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR abs(value - lag(value) OVER w) > 80 OR t - lag(t) OVER w > 400000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
f AS (SELECT user_id, island, min(t) AS b, max(t) AS e, count(*) AS n, first(value ORDER BY t, event_id) AS p0, last(value ORDER BY t, event_id) AS p1 FROM i GROUP BY 1, 2),
k AS (SELECT *, max({{'e': e, 'p': p1}}) OVER (PARTITION BY user_id ORDER BY b, e, island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
a AS (SELECT *, CASE WHEN reach IS NULL OR b - reach.e > 900000 OR reach.e - b > 0 OR abs(p0 - reach.p) > 120 THEN 1 ELSE 0 END AS fresh FROM k),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY b, e, island ROWS UNBOUNDED PRECEDING) AS path FROM a),
paths AS (SELECT user_id, path::BIGINT AS path, min(b) AS b, max(e) AS e, count(*) AS fragments, sum(n)::BIGINT AS n FROM g GROUP BY 1, 2 HAVING max(e) - min(b) >= 3600)"""


def _paths(spark, d):
    return A.paths(events(spark, d), ["user_id"], ["t", "event_id"], "t", "value", 80, 400_000, 20_000, 900_000, 120.0, 3600)


@query("wn06_stitched", f'WITH {_PATHS} SELECT user_id, path, b AS "begin", e AS "end", fragments, n FROM paths')
def wn06_stitched(spark, d):
    """WN-06, MD-03: detections to fragments to paths."""
    return _paths(spark, d)


@query("md01_survival", f"""
WITH {_PATHS},
s AS (SELECT p.user_id, p.path, p.b, max(e.t) FILTER (e.value >= 60) AS death, max(e.t) AS seen FROM paths p JOIN e ON e.user_id = p.user_id AND e.t BETWEEN p.b AND p.e GROUP BY 1, 2, 3),
y AS (SELECT user_id % 5 AS region, (coalesce(death, seen) - b) // 3600 AS age, death IS NOT NULL AND death <> seen AS died FROM s),
c AS (SELECT region, age, count(*) FILTER (died) AS deaths, count(*) AS n FROM y GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY region ORDER BY age DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM c)
SELECT region, age, deaths, (n - deaths)::BIGINT AS censored, at_risk::BIGINT AS at_risk,
 round(CASE WHEN max((deaths = at_risk)::INTEGER) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN deaths = at_risk THEN 0 ELSE ln(1 - deaths / at_risk) END) OVER w) END, 6) AS survival,
 round(sum(deaths / at_risk) OVER w, 6) AS hazard FROM r WINDOW w AS (PARTITION BY region ORDER BY age ROWS UNBOUNDED PRECEDING)""")
def md01_survival(spark, d):
    """MD-01, MD-23: observations to paths, states, deaths and one survival curve a region."""
    e = events(spark, d)
    found = A.analysed(e, _paths(spark, d), ["user_id"], "t", "value", 60.0, 150.0)
    out = A.survival_of(found.withColumn("region", F.col("user_id") % 5), "region", 3600)
    return out.withColumns({c: F.round(c, 6) for c in ("survival", "hazard")})


def _viterbi(source: str, score: str) -> str:
    """CTEs v and best over ``source`` (user_id, r, e0..e2, a00..a22 in logarithms): the best path of each individual."""
    before = lambda j: [f"s{i} + a{i}{j}" for i in range(3)]
    came = lambda j: "CASE WHEN {0} >= {1} AND {0} >= {2} THEN p0 WHEN {1} >= {2} THEN p1 ELSE p2 END".format(*before(j))
    step = ", ".join([f"greatest({', '.join(before(j))}) + x.e{j}" for j in range(3)] + [f"list_append({came(j)}, {j})" for j in range(3)])
    return f"""v AS (SELECT user_id, r, e0 - ln(3) AS s0, e1 - ln(3) AS s1, e2 - ln(3) AS s2, [0] AS p0, [1] AS p1, [2] AS p2 FROM {source} WHERE r = 1
UNION ALL SELECT x.user_id, x.r, {step} FROM v JOIN {source} x ON x.user_id = v.user_id AND x.r = v.r + 1),
best AS (SELECT user_id, greatest(s0, s1, s2) AS {score}, CASE WHEN s0 >= s1 AND s0 >= s2 THEN p0 WHEN s1 >= s2 THEN p1 ELSE p2 END AS p FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1)"""


_MEANS, _SDS, _STEP = [10.0, 60.0, 150.0], [20.0, 30.0, 50.0], [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
_FIXED = "WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r, " + ", ".join(
    [f"-0.5 * (ln(2 * pi() * {s * s}) + (value - {m}) ** 2 / {s * s}) AS e{i}" for i, (m, s) in enumerate(zip(_MEANS, _SDS))] + [f"ln({p}) AS a{i}{j}" for i, row in enumerate(_STEP) for j, p in enumerate(row)]
) + f" FROM ({_E})), " + _viterbi("e", "loglikelihood")


@query("md07_hmm_states", _FIXED + " SELECT e.user_id, e.t, e.event_id, e.value, p[r]::INTEGER AS state, round(loglikelihood, 5) AS loglikelihood FROM e JOIN best USING (user_id)")
def md07_hmm_states(spark, d):
    """MD-07, WN-11: best state path of each individual and its log score."""
    return M.hmm_states(events(spark, d), "user_id", ["t", "event_id"], "value", _MEANS, _SDS, _STEP, loglikelihood=True).withColumn("loglikelihood", F.round("loglikelihood", 5))


@query("md08_hybrid_states", _FIXED + """, l AS (SELECT user_id, max(t) FILTER (value >= 60) AS death, max(t) AS seen FROM e GROUP BY 1)
SELECT e.user_id, e.t, e.event_id, e.value, CASE WHEN death <> seen AND t > death THEN -1 ELSE p[r] END::INTEGER AS state FROM e JOIN best USING (user_id) JOIN l USING (user_id)""")
def md08_hybrid_states(spark, d):
    """MD-08: the registered hybrid of threshold and hidden Markov model."""
    return M.analyse("hybrid", events(spark, d), "user_id", ["t", "event_id"], "value", 60.0, 150.0, means=_MEANS, sds=_SDS, step=_STEP)


_GAUSS = ", ".join([f"-0.5 * (ln(2 * pi() * s{i} ** 2) + (value - m{i}) ** 2 / s{i} ** 2) AS e{i}" for i in range(3)] + [f"a{i}{j}" for i in range(3) for j in range(3)])


@query("md09_hmm_folds", f"""
WITH RECURSIVE z AS MATERIALIZED (SELECT *, CASE WHEN value < 15 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS truth, user_id % 3 AS fold, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM ({_E})),
q AS (SELECT *, lag(truth) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM z),
f AS (SELECT unnest([0, 1, 2]) AS fold),
m AS (SELECT f.fold, {", ".join(f"avg(value) FILTER (truth = {i}) AS m{i}, stddev_pop(value) FILTER (truth = {i}) AS s{i}, " + ", ".join(f"ln((1 + count(*) FILTER (prev = {i} AND truth = {j})) / (3 + count(*) FILTER (prev = {i}))) AS a{i}{j}" for j in range(3)) for i in range(3))} FROM f JOIN q ON q.fold <> f.fold GROUP BY 1),
x AS MATERIALIZED (SELECT user_id, r, z.fold, truth, {_GAUSS} FROM z JOIN m USING (fold)), {_viterbi("x", "score")}
SELECT x.fold::INTEGER AS fold, count(*) AS n, round(avg((p[r] = truth)::INTEGER), 6) AS accuracy FROM x JOIN best USING (user_id) GROUP BY 1""")
def md09_hmm_folds(spark, d):
    """MD-09: a hidden Markov model trained on the other folds, and its accuracy on the held-out subjects."""
    state = F.when(F.col("value") < 15, 0).when(F.col("value") < 60, 1).otherwise(2)
    e = events(spark, d).select("user_id", "t", "event_id", "value", state.alias("known"))
    return A.hmm_folds(e, "user_id", ["t", "event_id"], "value", "known", 3, F.col("user_id") % 3, 3).withColumn("accuracy", F.round("accuracy", 6))


@query("md14_clusters", """
WITH RECURSIVE s AS MATERIALIZED (SELECT l_orderkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, CAST(l_quantity AS DOUBLE) AS q FROM lineitem),
r AS (SELECT c, i, 1 AS k, q AS piece, 0.0::DOUBLE AS cost FROM s WHERE i = 1
 UNION ALL SELECT r.c, s.i, r.k + b.cut, CASE WHEN b.cut = 1 THEN q ELSE piece + q END, CASE WHEN b.cut = 1 THEN cost + abs(piece - 50) ELSE cost END FROM r JOIN s ON s.c = r.c AND s.i = r.i + 1, (VALUES (0), (1)) b(cut)),
n AS (SELECT c, max(i) AS i FROM s GROUP BY 1)
SELECT c AS l_orderkey, k::INTEGER AS individuals, round(min(cost + abs(piece - 50)), 4) AS cost FROM r JOIN n USING (c, i) WHERE k <= 4 GROUP BY 1, 2""")
def md14_clusters(spark, d):
    """MD-14: for one to four individuals the best division of each cluster of touching segments."""
    at = O._over(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    s = table(spark, d, "lineitem").withColumn("i", F.row_number().over(at)).select("l_orderkey", "i", (F.col("i") - 1).alias("a"), F.col("i").alias("b"), "l_quantity")
    return A.disambiguated(s, "l_orderkey", "i", "a", "b", "l_quantity", 50.0, 4).select("l_orderkey", "individuals", F.round("cost", 4).alias("cost"))


_WORDS = [f"('0x' || substr(md5(concat_ws('|', event_id::VARCHAR, '7', '{i // 4}')), {8 * (i % 4) + 1}, 8))::BIGINT / 4294967296.0::DOUBLE" for i in range(12)]


@query("ma20_draws", f"""SELECT event_id, round({_WORDS[0]}, 9) AS uniform, round({" + ".join(_WORDS)} - 6, 7) AS gaussian,
CASE WHEN {_WORDS[0]} < 0.2 THEN 0 WHEN {_WORDS[0]} < 0.7 THEN 1 ELSE 2 END::INTEGER AS place FROM events""")
def ma20_draws(spark, d):
    """MA-20: uniform, Gaussian and discrete-density draws that a lost task repeats."""
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(D.uniform_draw(k, 7), 9).alias("uniform"), F.round(D.gaussian_draw(k, 7), 7).alias("gaussian"), D.density_draw(k, 7, [2.0, 5.0, 3.0]).alias("place"))


@query("ma24_spline_of_cubic", "SELECT event_id, round(x * x * x - 2 * x, 4) + 0.0 AS smooth FROM (SELECT event_id, value / 100 AS x FROM events)")
def ma24_spline_of_cubic(spark, d):
    """MA-24: a spline of the smoothest level gives back a cubic (fits of other data are tested against least squares)."""
    x = F.col("value") / 100
    e = table(spark, d, "events").select("event_id", "user_id", x.alias("x"), (x * x * x - 2 * x).alias("y"))
    fit = A.spline_fit(e, ["user_id"], "x", "y", 0, ridge=1e-13)
    return e.join(fit, "user_id").select("event_id", (F.round(A.spline_value(F.col("x"), F.col("low"), F.col("high"), F.col("controls")), 4) + 0.0).alias("smooth"))


@query("ma29_median_filter", f"SELECT event_id, s[len(s) // 2 + 1] AS median FROM (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS s FROM ({_E}))")
def ma29_median_filter(spark, d):
    """MA-29."""
    return O.median_filtered(events(spark, d), ["user_id"], ["t", "event_id"], "value", 2, "median").select("event_id", "median")


_PIXELS = "SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1) % 8 AS x, (generate_subscripts(embedding, 1) - 1) // 8 AS y, unnest(embedding)::DOUBLE AS v FROM embeddings"


def _pixels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).select("vec_id", "label", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


@query("pf20_masked_pixels", f"SELECT vec_id, count(*) AS n, round(sum(v), 5) AS total FROM ({_PIXELS}) WHERE v > 0.02 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1")
def pf20_masked_pixels(spark, d):
    """PF-20: a threshold mask and a border crop."""
    kept = _pixels(spark, d).where(I.included(F.col("x"), F.col("y"), 8, 8, 1, F.col("v") > 0.02))
    return kept.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("total"))


@query("ag16_static_mask_near", f"""
WITH p AS (SELECT label, x, y, (v > 0.22)::INTEGER AS bright, ntile(3) OVER (PARTITION BY label, x, y ORDER BY vec_id) AS third FROM ({_PIXELS})),
h AS MATERIALIZED (SELECT label, x, y, {", ".join(f"coalesce(sum(bright) FILTER (third = {i}), 0) AS c{i}, count(*) FILTER (third = {i}) AS n{i}" for i in (1, 2, 3))} FROM p GROUP BY 1, 2, 3),
w AS (SELECT a.label, a.x, a.y, a.c1, a.c2, a.c3, a.n1, a.n2, a.n3, max(b.c1) AS m1, max(b.c2) AS m2, max(b.c3) AS m3 FROM h a JOIN h b ON a.label = b.label AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT label, x::INTEGER AS x, y::INTEGER AS y, (c1 >= 0.1 * n1 AND m2 > 0 AND m3 > 0) OR (c2 >= 0.1 * n2 AND m1 > 0 AND m3 > 0) OR (c3 >= 0.1 * n3 AND m1 > 0 AND m2 > 0) AS static FROM w""")
def ag16_static_mask_near(spark, d):
    """AG-16, AG-15: the static mask of an image, with the neighbourhood of each pixel."""
    heat = O.heat_map(_pixels(spark, d), ["label", "x", "y"], ["vec_id"], F.col("v") > 0.22)
    return O.static_mask_near(heat, ["label"], "x", "y", 0.1).select("label", "x", "y", "static")


@query("js10_members", """SELECT event_id, json_extract_string(o, '$.k') AS found, (json_extract(o, '$.missing') IS NOT NULL)::INTEGER AS n_missing, len(json_keys(o))::INTEGER AS size, '{"type":"' || event_type || '"}' AS erased, false AS is_empty
FROM (SELECT event_id, event_type, json_merge_patch(props::JSON, json_object('type', event_type)) AS o FROM events)""")
def js10_members(spark, d):
    """JS-10: find, count, size, erase and empty of an object's members."""
    o = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    e = table(spark, d, "events").select("event_id", o.alias("o"))
    erased = F.to_json(F.map_filter("o", lambda k, v: k != "k"))
    return e.select("event_id", F.try_element_at("o", F.lit("k")).alias("found"), F.map_contains_key("o", "missing").cast("int").alias("n_missing"), F.size("o").alias("size"), erased.alias("erased"), (F.size("o") == 0).alias("is_empty"))


@query("so09_updated_queue", f"SELECT user_id, value FROM (SELECT user_id, value, event_type FROM ({_E}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1) WHERE event_type <> 'error' ORDER BY value, user_id LIMIT 20")
def so09_updated_queue(spark, d):
    """SO-09: the 20 least of a queue with updates and removals (the limit is the feature)."""
    return R.updated_queue(events(spark, d), "user_id", "value", F.col("event_type") == "error", 20, "t", "event_id")


@query("wn10_equal_regions", f"""
WITH g AS (SELECT event_type, count(*) AS n, min(t) AS a, max(t) - min(t) AS span, user_id FROM ({_E}) GROUP BY event_type, user_id),
h AS (SELECT user_id, event_type, n, a, span, lag(n) OVER w AS pn, lag(a) OVER w AS pa, lag(span) OVER w AS ps, lag(user_id) OVER w AS pu FROM g WINDOW w AS (PARTITION BY event_type ORDER BY user_id))
SELECT user_id, event_type, n = pn AS same_frames, a = pa AND span = ps AS same_time FROM h WHERE pu IS NOT NULL""")
def wn10_equal_regions(spark, d):
    """WN-10: temporal regions of consecutive individuals, equal in frames or in real time."""
    own = F.struct(F.lit(0).alias("frame_start"), F.count("*").alias("frame_duration"), F.min("t").alias("real_start"), (F.max("t") - F.min("t")).alias("real_duration"))
    g = events(spark, d).groupBy("event_type", "user_id").agg(own.alias("a"))
    h = g.withColumn("b", F.lag("a").over(O._over(["event_type"], ["user_id"]))).where("b is not null")
    return h.select("user_id", "event_type", R.same_region("a", "b", "frames").alias("same_frames"), R.same_region("a", "b", "real_time").alias("same_time"))


@query("dm06_replaced_partition", "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN value * 2 ELSE value END AS value FROM events")
def dm06_replaced_partition(spark, d):
    """DM-06, MD-02: one region is computed again and its partition written over; the others stay as they are."""
    at = S.shared_folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    S.replace_partitions(e, at, "event_type")
    S.replace_partitions(e.where("event_type = 'error'").withColumn("value", F.col("value") * 2), at, "event_type")
    return spark.read.schema("event_id long, value double, event_type string").parquet(at)


@query("sc16_survival_file", """SELECT strain, censored, count(*) AS n, round(sum(age_days), 3) AS days FROM (
SELECT o_orderpriority AS strain, (l_returnflag <> 'R')::INTEGER AS censored, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::DOUBLE AS age_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)) GROUP BY 1, 2""")
def sc16_survival_file(spark, d):
    """SC-16, SC-17, SC-18: a survival file written and read again."""
    s = subjects(spark, d).select("strain", "device", F.lit(0).alias("birth"), (F.col("t") * 86400).alias("time"), "event")
    at = S.write_survival(S.survival_table(s), S.shared_folder(spark), "simple")
    return S.read_survival(spark, at).groupBy("strain", "censored").agg(F.count("*").alias("n"), F.round(F.sum("age_days"), 3).alias("days"))
