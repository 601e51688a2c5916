"""Queries for ordered analytics and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import ordered as O
from ..operators import survival as V
from .registering import Plans, epoch, table

plans = Plans()
query, QUERIES, ORACLES = plans.query, plans.queries, plans.oracles

_E = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t, value FROM events"
_SUBJECTS = "SELECT o_orderpriority AS strain, l_suppkey AS device, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::BIGINT AS t, l_returnflag = 'R' AS event, l_linestatus = 'F' AS moved FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", epoch("ts").alias("t"), "value")


def subjects(spark, d):
    """strain, device, t in days, event and moved for each individual."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    joined = items.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long")
    return joined.select(F.col("o_orderpriority").alias("strain"), F.col("l_suppkey").alias("device"), days.alias("t"), (F.col("l_returnflag") == "R").alias("event"), (F.col("l_linestatus") == "F").alias("moved")).where("t >= 0")


@query("wn02_deltas", f"SELECT event_id, t - lag(t) OVER w AS dt, round(value - lag(value) OVER w, 4) AS dv FROM ({_E}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def wn02_deltas(spark, d):
    """WN-02, WN-03, MA-30."""
    return O.deltas(events(spark, d), ["user_id"], ["t", "event_id"], dt="t", dv="value").select("event_id", "dt", F.round("dv", 4).alias("dv"))


@query("wn04_smoothed", f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM ({_E})")
def wn04_smoothed(spark, d):
    """WN-04, WN-09."""
    return O.smoothed(events(spark, d), ["user_id"], ["t", "event_id"], "value", 2, "smooth").select("event_id", F.round("smooth", 4).alias("smooth"))


@query("wn05_fragments", f"""
WITH m AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR abs(value - lag(value) OVER w) > 80 OR t - lag(t) OVER w > 400000 THEN 1 ELSE 0 END AS b FROM ({_E}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, island::BIGINT AS island, min(t) AS "begin", max(t) AS "end", count(*) AS n FROM i GROUP BY 1, 2 HAVING max(t) - min(t) >= 3600 AND 1 - count(*) / ((max(t) - min(t)) // 20000 + 1)::DOUBLE <= 0.9""")
def wn05_fragments(spark, d):
    """WN-05."""
    return O.stationary_fragments(events(spark, d), ["user_id"], ["t", "event_id"], "t", "value", 80, 400_000, 3600, 0.9, 20_000).select("user_id", "island", "begin", "end", "n")


@query("wn07_state_intervals", f"""
WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM ({_E}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT user_id, island, event_type, min(t) AS entered, max(t) AS last_seen, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT user_id, island::BIGINT AS island, event_type, entered, last_seen, n, lead(entered) OVER (PARTITION BY user_id ORDER BY island) AS exited FROM g""")
def wn07_state_intervals(spark, d):
    """WN-07."""
    return O.state_intervals(events(spark, d), ["user_id"], ["t", "event_id"], "t", "event_type")


@query("wn08_thirds", f"SELECT event_id, ntile(3) OVER (PARTITION BY user_id ORDER BY t, event_id)::INTEGER AS third FROM ({_E})")
def wn08_thirds(spark, d):
    """WN-08."""
    return O.thirds(events(spark, d), ["user_id"], ["t", "event_id"]).select("event_id", "third")


_HEAT = f"""WITH p AS (SELECT user_id, (value > 60)::INTEGER AS bright, ntile(3) OVER (PARTITION BY user_id ORDER BY t, event_id) AS third FROM ({_E})),
h AS (SELECT user_id, coalesce(sum(bright) FILTER (third = 1), 0)::BIGINT AS red, coalesce(sum(bright) FILTER (third = 2), 0)::BIGINT AS green, coalesce(sum(bright) FILTER (third = 3), 0)::BIGINT AS blue,
 count(*) FILTER (third = 1) AS n1, count(*) FILTER (third = 2) AS n2, count(*) FILTER (third = 3) AS n3 FROM p GROUP BY 1)"""


@query("ag15_heat_map", _HEAT + " SELECT user_id, red, green, blue FROM h")
def ag15_heat_map(spark, d):
    """AG-15."""
    return O.heat_map(events(spark, d), ["user_id"], ["t", "event_id"], F.col("value") > 60).select("user_id", "red", "green", "blue")


@query("ag16_static_mask", _HEAT + " SELECT user_id, (red >= 0.3 * n1 AND green > 0 AND blue > 0) OR (green >= 0.3 * n2 AND red > 0 AND blue > 0) OR (blue >= 0.3 * n3 AND red > 0 AND green > 0) AS static FROM h")
def ag16_static_mask(spark, d):
    """AG-16."""
    return O.static_mask(O.heat_map(events(spark, d), ["user_id"], ["t", "event_id"], F.col("value") > 60), 0.3).select("user_id", "static")


@query("ag17_state_counts", """
WITH c AS (SELECT (epoch_us(ts) // 1000000) // 86400 AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error,
count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) AS n FROM events GROUP BY 1)
SELECT day, click, view, error, signup, purchase, round(click / n, 6) AS click_share, round(view / n, 6) AS view_share, round(error / n, 6) AS error_share, round(signup / n, 6) AS signup_share, round(purchase / n, 6) AS purchase_share FROM c""")
def ag17_state_counts(spark, d):
    """AG-17."""
    states = ["click", "view", "error", "signup", "purchase"]
    out = O.state_counts(events(spark, d).select(F.floor(F.col("t") / 86400).alias("day"), "event_type"), "day", "event_type", states)
    return out.select("day", *states, *[F.round(f"{s}_share", 6).alias(f"{s}_share") for s in states])


@query("md04_gap_filled", f"""
WITH s AS (SELECT user_id, t // 86400 AS s, arg_max(event_id, struct_pack(a := t, b := event_id)) AS v FROM ({_E}) GROUP BY 1, 2), b AS (SELECT user_id, min(s) AS a, max(s) AS z FROM s GROUP BY 1),
g AS (SELECT user_id, unnest(range(a, z + 1)) AS s FROM b), j AS (SELECT g.user_id, g.s, s.v FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.s = g.s)
SELECT user_id, s * 86400 AS t, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s) AS event_id, v IS NULL AS inferred FROM j""")
def md04_gap_filled(spark, d):
    """MD-04, AG-20."""
    e = events(spark, d).select("user_id", "t", "event_id")
    latest = e.groupBy("user_id", "t").agg(F.max("event_id").alias("event_id"))
    return O.gap_filled(latest, ["user_id"], "t", 86400, ["event_id"])


_KM = f"""WITH s AS ({_SUBJECTS}), c AS (SELECT strain, t, sum(event::INTEGER)::BIGINT AS deaths, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY strain ORDER BY t DESC)::BIGINT AS at_risk FROM c),
k AS (SELECT strain, t, deaths, n - deaths AS censored, at_risk, CASE WHEN max((deaths = at_risk)::INTEGER) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN deaths = at_risk THEN 0 ELSE ln(1 - deaths / at_risk) END) OVER w) END AS survival, sum(deaths / at_risk) OVER w AS hazard FROM r WINDOW w AS (PARTITION BY strain ORDER BY t))"""


@query("ag18_kaplan_meier", _KM + " SELECT strain, t, deaths, censored, at_risk, round(survival, 6) AS survival, round(hazard, 6) AS hazard FROM k")
def ag18_kaplan_meier(spark, d):
    """AG-18."""
    curve = V.kaplan_meier(subjects(spark, d), ["strain"], "t", F.col("event"))
    return curve.withColumns({"survival": F.round("survival", 6), "hazard": F.round("hazard", 6)})


@query("ag18_three_curves", f"""
WITH s AS (SELECT strain, t, unnest([struct_pack(curve := 'best_guess', e := event OR moved), struct_pack(curve := 'movement', e := moved), struct_pack(curve := 'expansion', e := event)]) AS x FROM ({_SUBJECTS})),
c AS (SELECT strain, x.curve AS curve, t, sum(x.e::INTEGER)::BIGINT AS deaths, count(*) AS n FROM s GROUP BY ALL)
SELECT strain, curve, t, deaths, sum(n) OVER (PARTITION BY strain, curve ORDER BY t DESC)::BIGINT AS at_risk FROM c""")
def ag18_three_curves(spark, d):
    """AG-18: the three curve types."""
    s = subjects(spark, d)
    return V.curves(s, ["strain"], "t", best_guess=F.col("event") | F.col("moved"), movement=F.col("moved"), expansion=F.col("event")).select("strain", "curve", "t", "deaths", "at_risk")


@query("ag19_pooled", f"""
WITH s AS (SELECT s_nationkey AS pool, t, event FROM ({_SUBJECTS}) JOIN supplier ON s_suppkey = device), c AS (SELECT pool, t, sum(event::INTEGER)::BIGINT AS deaths, count(*) AS n FROM s GROUP BY 1, 2)
SELECT pool, t, deaths, n - deaths AS censored, sum(n) OVER (PARTITION BY pool ORDER BY t DESC)::BIGINT AS at_risk FROM c""")
def ag19_pooled(spark, d):
    """AG-19."""
    meta = table(spark, d, "supplier").select(F.col("s_suppkey").alias("device"), F.col("s_nationkey").alias("pool"))
    return V.pooled(subjects(spark, d), meta, "device", "pool", "t", F.col("event")).select("pool", "t", "deaths", "censored", "at_risk")


@query("ag20_risk_series", _KM + """, g AS (SELECT strain, unnest(range((min(t) // 10) * 10, CAST(ceil(max(t) / 10.0) * 10 AS BIGINT) + 1, 10)) AS t FROM k GROUP BY strain)
SELECT g.strain, g.t, round(coalesce((SELECT arg_max(k.survival, k.t) FROM k WHERE k.strain = g.strain AND k.t <= g.t), 1), 6) AS survival FROM g""")
def ag20_risk_series(spark, d):
    """AG-20."""
    curve = V.kaplan_meier(subjects(spark, d), ["strain"], "t", F.col("event"))
    return V.risk_series(curve, ["strain"], "t", 10).select("strain", "t", F.round("survival", 6).alias("survival"))


@query("ag20_median", _KM + " SELECT strain, min(t) FILTER (survival <= 0.5) AS median FROM k GROUP BY 1")
def ag20_median(spark, d):
    """Median survival of each strain."""
    return V.median_survival(V.kaplan_meier(subjects(spark, d), ["strain"], "t", F.col("event")), ["strain"], "t")


@query("ag21_device_normalised", f"""
WITH s AS ({_SUBJECTS}), f AS (SELECT strain, device, avg(t) AS m FROM s GROUP BY 1, 2), a AS (SELECT strain, avg(t) AS m FROM s GROUP BY 1)
SELECT f.strain, f.device, round(a.m / f.m, 6) AS factor FROM f JOIN a ON a.strain = f.strain""")
def ag21_device_normalised(spark, d):
    """AG-21."""
    out = V.device_normalised(subjects(spark, d), "device", "strain", "t", F.col("event"))
    return out.groupBy("strain", "device").agg(F.round(F.max("factor"), 6).alias("factor"))


@query("md12_compiled_annotations", f"""
SELECT user_id, arg_max(value, struct_pack(a := (event_type = 'purchase')::INTEGER, b := t, c := event_id)) AS value FROM ({_E}) GROUP BY 1""")
def md12_compiled_annotations(spark, d):
    """MD-12: purchases play what was set by hand."""
    e = events(spark, d).withColumn("source", F.when(F.col("event_type") == "purchase", "hand").otherwise("machine"))
    return V.compiled_annotations(e, ["user_id"], "source", ["t", "event_id"], ["value"])


@query("md06_threshold_states", f"""
SELECT user_id, max(t) FILTER (value >= 150) AS vigorous_until, max(t) FILTER (value >= 60) AS death_time, max(t) AS last_seen, max(t) FILTER (value >= 60) IS NULL OR max(t) FILTER (value >= 60) = max(t) AS censored FROM ({_E}) GROUP BY 1""")
def md06_threshold_states(spark, d):
    """MD-06."""
    return M.threshold_states(events(spark, d), ["user_id"], "t", "value", 60.0, 150.0)


@query("md10_transitions", f"""
WITH p AS (SELECT event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM ({_E})), c AS (SELECT prev, cur, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2)
SELECT prev, cur, n, round(n / sum(n) OVER (PARTITION BY prev), 6) AS p FROM c""")
def md10_transitions(spark, d):
    """MD-10."""
    return M.transitions(events(spark, d), ["user_id"], ["t", "event_id"], "event_type").withColumn("p", F.round("p", 6))


@query("md11_best_threshold", f"""
WITH g AS (SELECT unnest(range(10, 210, 10))::DOUBLE AS threshold), p AS (SELECT user_id, max(t) AS truth FROM ({_E}) WHERE event_type <> 'error' GROUP BY 1),
f AS (SELECT g.threshold, e.user_id, max(e.t) FILTER (e.value >= g.threshold) AS found FROM g, ({_E}) e GROUP BY 1, 2)
SELECT threshold, round(avg(abs(coalesce(found, 0) - truth)), 2) AS error FROM f JOIN p ON p.user_id = f.user_id GROUP BY 1 ORDER BY 2, 1 LIMIT 1""")
def md11_best_threshold(spark, d):
    """MD-11: the grid's best threshold (the search's own result, one row)."""
    e = events(spark, d)
    truth = e.where("event_type <> 'error'").groupBy("user_id").agg(F.max("t").alias("truth"))
    return M.best_threshold(e, truth, "user_id", "t", "value", [float(x) for x in range(10, 210, 10)]).select("threshold", F.round("error", 2).alias("error"))
