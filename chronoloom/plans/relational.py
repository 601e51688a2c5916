"""Queries for joins, projections, sorts, set operations and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from .registering import Plans, epoch, table

plans = Plans()
query, QUERIES, ORACLES = plans.query, plans.queries, plans.oracles


@query("wn01_latest_per_key", """
SELECT l_suppkey, supplier_name, nation_name, l_orderkey, l_linenumber, shipped, age_rank_value FROM (
 SELECT l.l_suppkey, coalesce(s.s_name, CAST(l.l_suppkey AS VARCHAR)) AS supplier_name, coalesce(n.n_name, '') AS nation_name, l.l_orderkey, l.l_linenumber,
  epoch_us(l.l_shipdate) // 1000000 AS shipped, round(l.l_extendedprice * (1 - l.l_discount), 4) AS age_rank_value,
  row_number() OVER (PARTITION BY l.l_suppkey ORDER BY l.l_shipdate DESC, l.l_orderkey, l.l_linenumber) AS rn
 FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 500 LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
 WHERE l.l_quantity > 0) WHERE rn = 1""")
def wn01_latest_per_key(spark, d):
    """WN-01, JN-05, PF-02, PF-08, SO-01, SC-01: latest observation of each device, its name or else its id."""
    rows = table(spark, d, "lineitem").where("l_quantity > 0").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount")
    last = R.latest_per_key(rows, ["l_suppkey"], F.col("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber"))
    known = table(spark, d, "supplier").where("s_acctbal > 500").select("s_suppkey", "s_name", "s_nationkey")
    out = last.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select("l_suppkey", F.coalesce("s_name", F.col("l_suppkey").cast("string")).alias("supplier_name"), F.coalesce("n_name", F.lit("")).alias("nation_name"), "l_orderkey", "l_linenumber", epoch("l_shipdate").alias("shipped"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("age_rank_value")).orderBy("l_suppkey")


@query("sc03_scalar", "SELECT count(*) AS n FROM orders")
def sc03_scalar(spark, d):
    """SC-02, SC-03: one row is asserted in the plan, and its first column is the value."""
    return R.scalar(table(spark, d, "orders").agg(F.count("*").alias("n")))


@query("sc05_generated_ids", """
SELECT n_name, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY n_name) AS new_id FROM nation WHERE n_regionkey = 1""")
def sc05_generated_ids(spark, d):
    """SC-05: ids that follow the greatest one."""
    from pyspark.sql import Window

    nation = table(spark, d, "nation")
    top = nation.agg(F.max("n_nationkey").cast("long").alias("top"))
    new = nation.where("n_regionkey = 1").select("n_name")  # rows of one insert
    return new.join(top, F.lit(True)).select("n_name", (F.col("top") + F.row_number().over(Window.orderBy("n_name"))).alias("new_id"))


@query("jn01_distinct_triple", """
SELECT DISTINCT n.n_name, r.r_name, c.c_mktsegment FROM customer c, nation n, region r
WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND c.c_mktsegment <> ''""")
def jn01_distinct_triple(spark, d):
    """JN-01, AG-10, PF-03: inner equi-joins up the hierarchy, without empty labels, distinct."""
    c = table(spark, d, "customer").where("c_mktsegment <> ''").select("c_nationkey", "c_mktsegment")
    joined = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name", "c_mktsegment").distinct()


@query("jn02_sample_of_experiment", """
SELECT o.o_orderkey, c.c_name || '::' || CAST(o.o_orderkey AS VARCHAR) AS label, c.c_acctbal <> 0 AS has_balance FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3""")
def jn02_sample_of_experiment(spark, d):
    """JN-02, PF-02, PF-07, PF-11: equi-join, a concatenated label and a boolean from a number."""
    c = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey", "c_name", "c_acctbal")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat("c_name", F.lit("::"), F.col("o_orderkey").cast("string")).alias("label"), (F.col("c_acctbal") != 0).alias("has_balance"))


@query("jn03_update_join", """
SELECT c.c_custkey, round(coalesce(s.t, c.c_acctbal), 4) AS c_acctbal FROM customer c LEFT JOIN
(SELECT s_nationkey, max(s_acctbal) AS t FROM supplier WHERE s_nationkey < 12 GROUP BY s_nationkey) s ON s.s_nationkey = c.c_nationkey""")
def jn03_update_join(spark, d):
    """JN-03, DM-03: UPDATE ... FROM as a left join and a coalesce."""
    new = table(spark, d, "supplier").where("s_nationkey < 12").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("c_acctbal"))
    out = R.update_from(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), new, ["c_nationkey"], "c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("jn04_first_match", """
SELECT n.n_nationkey, n.n_name, coalesce(c.c_name, '') AS c_name FROM nation n LEFT JOIN (
 SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer WHERE c_acctbal > 9000) c ON c.c_nationkey = n.n_nationkey AND c.rn = 1""")
def jn04_first_match(spark, d):
    """JN-04: the first match of each key only; '' for none."""
    right = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_name", "c_custkey")
    return R.first_match_join(table(spark, d, "nation").select("n_nationkey", "n_name"), right, "n_nationkey", "c_name", F.col("c_custkey"))


@query("jn05_lookup_or_id", """
SELECT e.event_id, coalesce(c.c_name || '@' || c.c_mktsegment || ' ( ' || CAST(c.c_nationkey AS VARCHAR) || ' )', CAST(e.user_id AS VARCHAR)) AS host
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0""")
def jn05_lookup_or_id(spark, d):
    """JN-05, PF-07, PF-08: composed name by key, else the raw id."""
    name = F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(" ( "), F.col("c_nationkey").cast("string"), F.lit(" )"))
    return R.lookup_or_id(table(spark, d, "events").select("event_id", "user_id"), table(spark, d, "customer").where("c_acctbal > 0"), "user_id", "c_custkey", name, "host").select("event_id", "host")


@query("jn06_rows_of_hosts", """
SELECT s.s_suppkey, l.l_linenumber AS operation, count(*) AS n FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY ALL""")
def jn06_rows_of_hosts(spark, d):
    """JN-06: what one query a host would fetch, as one join."""
    return table(spark, d, "supplier").select("s_suppkey").join(table(spark, d, "lineitem").select("l_suppkey", "l_linenumber"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey", F.col("l_linenumber").alias("operation")).agg(F.count("*").alias("n"))


@query("jn07_any_one_value", """
WITH one AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS t FROM orders GROUP BY o_custkey)
SELECT c.c_nationkey, round(arg_max(one.t, c.c_custkey), 4) AS temperature FROM one JOIN customer c ON c.c_custkey = one.o_custkey GROUP BY c.c_nationkey""")
def jn07_any_one_value(spark, d):
    """JN-07, SO-04, AG-11: one value of each sample (that of the smallest id) and the last sample of each device."""
    one = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("t"))
    joined = one.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.round(F.max_by("t", "c_custkey"), 4).alias("temperature"))


@query("jn08_hierarchy", """
SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_name, n.n_name, r.r_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""")
def jn08_hierarchy(spark, d):
    """JN-08: a record's ids and names up to the top of the hierarchy."""
    t = lambda n: table(spark, d, n)
    return (t("lineitem").select("l_orderkey", "l_linenumber").join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(t("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
            .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "n_name", "r_name"))


@query("jn09_composite_key", """
SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity AS other_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber""")
def jn09_composite_key(spark, d):
    """JN-09: equality of both parts of a key."""
    rows = table(spark, d, "lineitem")
    a = rows.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") + 1).alias("next"))
    b = rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("other_quantity"))
    return a.join(b, (F.col("l_orderkey") == F.col("k")) & (F.col("next") == F.col("n"))).select("l_orderkey", "l_linenumber", "l_quantity", "other_quantity")


@query("jn10_band_join", """
SELECT a.user_id, count(*) AS pairs, sum((epoch_us(b.ts) // 1000000) - (epoch_us(a.ts) // 1000000))::BIGINT AS gap FROM events a JOIN events b ON a.user_id = b.user_id
AND (epoch_us(b.ts) // 1000000) - (epoch_us(a.ts) // 1000000) BETWEEN 0 AND 7200 AND a.event_id <> b.event_id GROUP BY a.user_id""")
def jn10_band_join(spark, d):
    """JN-10: interval join in buckets."""
    e = table(spark, d, "events").select("user_id", "event_id", epoch("ts").alias("t"))
    b = e.select("user_id", F.col("event_id").alias("other"), F.col("t").alias("u"))
    return R.band_join(e, b, ["user_id"], "t", "u", 7200).where("event_id <> other").groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.col("u") - F.col("t")).alias("gap"))


@query("jn12_as_of", """
SELECT c.event_id, (SELECT max_by(v.value, struct_pack(a := v.ts, b := v.value)) FROM events v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND v.ts <= c.ts) AS last_value FROM events c WHERE c.event_type = 'click'""")
def jn12_as_of(spark, d):
    """JN-12: as-of join by union and window."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return R.as_of_join(left, e.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value", "last_value").select("event_id", "last_value")


@query("jn13_overlay", """
SELECT 'plate' AS curve, o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 'strain', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def jn13_overlay(spark, d):
    """JN-13: two series on their own axes, under a tag."""
    o = table(spark, d, "orders")
    series = lambda df, tag: df.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n")).select(F.lit(tag).alias("curve"), "k", "n")
    return series(o.where("o_orderstatus = 'F'"), "plate").unionByName(series(o, "strain"))


@query("jn14_same_time", """
SELECT event_type, epoch_us(ts) // 3600000000 AS t, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def jn14_same_time(spark, d):
    """JN-14: rows of one time point (an hour), kept together."""
    return table(spark, d, "events").groupBy("event_type", F.floor(epoch("ts") / 3600).alias("t")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n > 1")


@query("jn15_merge_annotations", """
WITH h AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), m AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(h.k, m.k) AS k, round(coalesce(h.v, m.v), 4) AS v, CASE WHEN h.k IS NOT NULL THEN 'hand' ELSE 'machine' END AS source FROM h FULL JOIN m ON h.k = m.k""")
def jn15_merge_annotations(spark, d):
    """JN-15: full outer join with precedence."""
    o = table(spark, d, "orders")
    side = lambda s, f: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(f("o_totalprice").alias("v"))
    return R.merged_annotations(side("O", F.max), side("F", F.min), "k", ["v"]).withColumn("v", F.round("v", 4))


@query("jn_semi_anti", """
SELECT 'semi' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def jn_semi_anti(spark, d):
    """Semi- and anti-join (engine surface of section 2.3)."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    side = lambda how: c.join(o, F.col("c_custkey") == F.col("o_custkey"), f"left_{how}").agg(F.count("*").alias("n")).select(F.lit(how).alias("side"), "n")
    return side("semi").unionByName(side("anti"))


@query("pf04_quality_predicate", """
SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE value > 0 AND event_type <> 'error' AND epoch_us(ts) // 1000000 > (SELECT max(epoch_us(ts) // 1000000) FROM events) - 6048000 GROUP BY event_type""")
def pf04_quality_predicate(spark, d):
    """PF-01, PF-04, PF-05: projection, conjunctive quality filter and recency against a given now."""
    e = table(spark, d, "events").select("event_type", "value", epoch("ts").alias("t"))
    now = e.agg(F.max("t").alias("now"))
    return e.where("value > 0 and event_type <> 'error'").join(now, F.col("t") > F.col("now") - 6048000).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def open_alerts(df, show_acknowledged: int):
    """PF-06: the filter is in the plan only if it's wanted."""
    return df if show_acknowledged == 1 else df.where("o_orderstatus = 'O'")


@query("pf06_optional_predicate", "SELECT 0 AS shown, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 1, count(*) FROM orders")
def pf06_optional_predicate(spark, d):
    """PF-06."""
    o = table(spark, d, "orders")
    return open_alerts(o, 0).agg(F.count("*").alias("n")).select(F.lit(0).alias("shown"), "n").unionByName(open_alerts(o, 1).agg(F.count("*").alias("n")).select(F.lit(1).alias("shown"), "n"))


@query("pf09_preference", """
SELECT c.c_custkey, coalesce((SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice < 50000), (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey), 0) AS image_id FROM customer c""")
def pf09_preference(spark, d):
    """PF-09: the preferred id, else the other one, else 0."""
    ids = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_totalprice") < 50000, F.col("o_orderkey"))).alias("small"), F.max("o_orderkey").alias("whole"))
    return table(spark, d, "customer").select("c_custkey").join(ids, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("small", "whole", F.lit(0)).alias("image_id"))


@query("pf10_unit_scaling", """
SELECT p_size, CASE WHEN p_size IN (30, 31) THEN 'ms' ELSE 's' END AS unit, printf('%.2f', avg(p_retailprice) * CASE WHEN p_size IN (30, 31) THEN 1000 ELSE 1 END) AS shown FROM part GROUP BY p_size""")
def pf10_unit_scaling(spark, d):
    """PF-10, ST-09: factor and unit by code, shown with two decimals."""
    fast = F.col("p_size").isin(30, 31)
    return table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m")).select("p_size", F.when(fast, "ms").otherwise("s").alias("unit"), X.fixed(F.col("m") * F.when(fast, 1000).otherwise(1), 2).alias("shown"))


@query("pf12_ratios", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity - 10, 0), 9) AS mean_intensity FROM lineitem""")
def pf12_ratios(spark, d):
    """PF-12: totals by area; null where the area is 0 (the compat form gives inf or NaN)."""
    from ..functions.measures import mean_intensity

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(mean_intensity(F.col("l_extendedprice"), F.col("l_quantity") - 10), 9).alias("mean_intensity"))


@query("pf13_selectors", "SELECT event_id, value AS v1, value * 2 AS v2_cropped, CAST(user_id AS DOUBLE) AS v2_uncropped FROM events")
def pf13_selectors(spark, d):
    """PF-13: the three death-time measures of a row."""
    from ..functions.measures import death_time_measures

    v = F.col("value")
    return table(spark, d, "events").select("event_id", *death_time_measures(v, F.array(v, v * 2, v * 3), F.col("user_id").cast("double")))


@query("pf14_rescaled", "SELECT l_orderkey, l_linenumber, round(l_quantity * (1 + l_tax), 6) AS quantity, round(l_extendedprice * (1 + l_tax), 6) AS price FROM lineitem")
def pf14_rescaled(spark, d):
    """PF-14: intensities times a factor of the row."""
    from ..functions.measures import rescaled

    quantity, price = rescaled([F.col("l_quantity"), F.col("l_extendedprice")], 1 + F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(quantity, 6).alias("quantity"), F.round(price, 6).alias("price"))


@query("pf15_elementwise", """
SELECT p_partkey, round(p_retailprice + p_size, 6) AS plus, round(p_retailprice - p_size, 6) AS minus, round(p_retailprice / 3, 6) AS third, round(p_retailprice * p_retailprice, 4) AS square,
round(sqrt(p_retailprice), 6) AS root, CAST(0 AS DOUBLE) AS zero FROM part""")
def pf15_elementwise(spark, d):
    """PF-15: sums, differences and powers of arrays by element."""
    from ..functions.measures import elementwise, elementwise_scalar

    a, b = F.array(F.lit(1.0), F.col("p_retailprice")), F.array(F.lit(2.0), F.col("p_size").cast("double"))
    second = lambda x, digits=6: F.round(F.element_at(x, 2), digits)
    scalars = {"third": ("/", 6), "square": ("square", 4), "root": ("sqrt", 6), "zero": ("zero", 6)}
    return table(spark, d, "part").select("p_partkey", second(elementwise(a, b, "+")).alias("plus"), second(elementwise(a, b, "-")).alias("minus"), *[second(elementwise_scalar(a, op, 3), n).alias(c) for c, (op, n) in scalars.items()])


@query("pf16_event_predicates", """
SELECT event_type, event_type IN ('signup', 'purchase') AS is_transition, event_type NOT IN ('signup', 'purchase') AS is_observation,
CASE event_type WHEN 'view' THEN 'stationary' WHEN 'click' THEN 'posture' WHEN 'error' THEN 'machine_excluded' WHEN 'signup' THEN 'posture' ELSE 'fast' END AS state, count(*) AS n FROM events GROUP BY event_type""")
def pf16_event_predicates(spark, d):
    """PF-16: event dimension joined to the facts after these are aggregated."""
    dimension = spark.createDataFrame([("view", False, "stationary"), ("click", False, "posture"), ("error", False, "machine_excluded"), ("signup", True, "posture"), ("purchase", True, "fast")], "event_type string, is_transition boolean, state string")
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(dimension, "event_type").select("event_type", "is_transition", (~F.col("is_transition")).alias("is_observation"), "state", "n")


@query("pf18_keys_by_prefix", "SELECT DISTINCT substr(p_name, 2) AS device, 'b' || substr(p_name, 2) AS rebuilt FROM part WHERE starts_with(p_name, 'b')")
def pf18_keys_by_prefix(spark, d):
    """PF-18."""
    return R.keys_after(table(spark, d, "part").select("p_name"), "p_name", "b", "device").select("device", F.concat(F.lit("b"), "device").alias("rebuilt")).distinct()


@query("so01_multi_key_sort", "SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders")
def so01_multi_key_sort(spark, d):
    """SO-01, SO-05."""
    return table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey").orderBy("o_orderpriority", "o_orderstatus", "o_orderkey")


@query("so02_newest", "SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events ORDER BY ts DESC, event_id LIMIT 25")
def so02_newest(spark, d):
    """SO-02: the newest 25, the report's own page size."""
    return R.newest(table(spark, d, "events").select("event_id", "ts"), "ts", 25, "event_id").select("event_id", epoch("ts").alias("t"))


@query("so03_page_ladder", "SELECT p_size, CASE WHEN p_size - 1 = 0 THEN 25 WHEN (p_size - 1) * 12 < 400 THEN 2 * (p_size - 1) * 12 ELSE 0 END AS next_size FROM (SELECT DISTINCT p_size FROM part)")
def so03_page_ladder(spark, d):
    """SO-03."""
    return table(spark, d, "part").select("p_size").distinct().select("p_size", R.next_page_size((F.col("p_size") - 1) * 12).alias("next_size"))


@query("so07_fetch_jobs", """
SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 50 WHEN '2' THEN 25 WHEN '3' THEN 20 WHEN '4' THEN 15 ELSE 5 END AS priority FROM orders WHERE o_orderstatus <> 'F' ORDER BY 2 DESC, 1 LIMIT 100""")
def so07_fetch_jobs(spark, d):
    """SO-07: the next 100 jobs, larger priority first."""
    p = F.substring("o_orderpriority", 1, 1)
    priority = F.when(p == "1", 50).when(p == "2", 25).when(p == "3", 20).when(p == "4", 15).otherwise(5)
    jobs = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", priority.alias("priority"))
    return R.fetch_jobs(jobs, 100, F.col("priority"), "o_orderkey")


@query("so08_best_per_group", """
SELECT l_suppkey, l_linenumber, round(min(l_extendedprice), 4) AS cost, arg_min(l_orderkey, struct_pack(a := l_extendedprice, b := l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1, 2""")
def so08_best_per_group(spark, d):
    """SO-08: arg-best of each group without a sort."""
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.round(F.min("l_extendedprice"), 4).alias("cost"), F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("l_orderkey"))


@query("se01_excluded_names", "SELECT r_name FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def se01_excluded_names(spark, d):
    """SE-01."""
    return R.set_difference(table(spark, d, "region").select("r_name"), ["ASIA", "EUROPE"])


@query("se02_modified_ids", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100")
def se02_modified_ids(spark, d):
    """SE-02."""
    return table(spark, d, "events").where("event_type = 'purchase' and value > 100").select("user_id").distinct()


@query("se03_disjoint_parts", """
SELECT CASE WHEN l_returnflag = 'R' THEN 'worms' WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 'censored' ELSE 'non_worms' END AS part, count(*) AS n FROM lineitem GROUP BY 1""")
def se03_disjoint_parts(spark, d):
    """SE-03."""
    parts = R.disjoint_parts(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), worms=F.col("l_returnflag") == "R", censored=(F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25), non_worms=F.lit(True))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


@query("se04_exclusive_groups", """
SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey""")
def se04_exclusive_groups(spark, d):
    """SE-04: groups without a member of the other kind."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return R.delete_matching(o, o.where("o_orderstatus = 'P'"), ["o_custkey"]).groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("se05_transfer", """
SELECT l.doc_id, coalesce(n.quality, l.quality) AS quality FROM labels l LEFT JOIN (SELECT doc_id, max(1 - quality) AS quality FROM labels WHERE toxic = 1 GROUP BY doc_id) n ON n.doc_id = l.doc_id""")
def se05_transfer(spark, d):
    """SE-05: annotations of one set carried over to another."""
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    new = labels.where("toxic = 1").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("quality"))
    return R.update_from(labels, new, ["doc_id"], "quality").select("doc_id", "quality")


@query("se_set_operations", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0) UNION ALL
SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def se_set_operations(spark, d):
    """Set operations (engine surface of section 2.7)."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    key = lambda df, name: df.select(F.col(name).alias("k"))
    found = {"union": key(s, "s_nationkey").union(key(c, "c_nationkey")).distinct(), "intersect": key(s, "s_nationkey").intersect(key(c.where("c_acctbal < 0"), "c_nationkey")), "except": key(c, "c_nationkey").subtract(key(s.where("s_acctbal > 5000"), "s_nationkey"))}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("se06_set_members", """
SELECT o_custkey, len(list_distinct(list(o_orderstatus))) AS size, list_contains(list(o_orderstatus), 'P') AS has_p, coalesce(list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'F')), []) AS without_f FROM orders GROUP BY 1""")
def se06_set_members(spark, d):
    """SE-06: a set of each key: inserted once, looked up, erased from (states are few)."""
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return own.select("o_custkey", F.size("s").alias("size"), F.array_contains("s", "P").alias("has_p"), F.sort_array(F.array_remove("s", "F")).alias("without_f"))


@query("se07_tuple_order", """
SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity, l_suppkey) < (25, 5) AS before, (l_quantity, l_suppkey) = (25, 5) AS same FROM lineitem""")
def se07_tuple_order(spark, d):
    """SE-07: tuples in lexicographic order."""
    own, other = F.struct(F.col("l_quantity"), F.col("l_suppkey")), F.struct(F.lit(25.0), F.lit(5).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (own < other).alias("before"), (own == other).alias("same"))


@query("md13_fresh_results", """
WITH s AS (SELECT l_orderkey, max(l_shipdate) AS changed FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderdate IS NOT NULL AND (changed IS NULL OR o_orderdate + INTERVAL 60 DAY >= changed) AS fresh FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def md13_fresh_results(spark, d):
    """MD-13: a kept result is fresh if none of its sources has changed since."""
    kept = table(spark, d, "orders").select("o_orderkey", (epoch("o_orderdate") + 60 * 86400).alias("made"))
    sources = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), epoch("l_shipdate").alias("changed"))
    return R.fresh_results(kept, sources, "o_orderkey", "made", "changed").select("o_orderkey", "fresh")


@query("st06_parameters", "SELECT p_brand, count(*) AS n FROM part WHERE p_name <> 'it''s; -- \\' AND p_size >= 10 GROUP BY 1")
def st06_parameters(spark, d):
    """ST-06, SC-04: values of a statement are parameters, never parts of its text; a blank statement is refused."""
    return R.statement(spark, "SELECT p_brand, count(*) AS n FROM {part} WHERE p_name <> :name AND p_size >= :size GROUP BY p_brand", {"name": "it's; -- \\", "size": 10}, part=table(spark, d, "part"))


@query("dm01_acknowledge", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1700000000 ELSE 0 END AS acknowledged FROM events")
def dm01_acknowledge(spark, d):
    """DM-01, DM-02, DT-01: set where it isn't set yet; now is given."""
    alerts = table(spark, d, "events").select("event_id", "event_type", F.lit(0).alias("acknowledged"))
    return R.update_where(alerts, (F.col("acknowledged") == 0) & (F.col("event_type") == "error"), acknowledged=F.lit(1700000000)).select("event_id", "acknowledged")


@query("dm04_conditional_reset", """
SELECT o_orderkey, CASE WHEN o_custkey < 50 THEN 0 ELSE o_custkey END AS interpolated_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def dm04_conditional_reset(spark, d):
    """DM-04, MD-05: some rows are deleted, others lose a reference (0)."""
    left = R.delete_matching(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    return R.update_where(left, F.col("o_custkey") < 50, o_custkey=F.lit(0)).select("o_orderkey", F.col("o_custkey").alias("interpolated_id"))


@query("dm05_queue_state", """
SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY user_id""")
def dm05_queue_state(spark, d):
    """DM-05: state from an appended log."""
    return R.latest_status(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", "ts", "event_id")


@query("dm06_delete_partition", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey <> 3 GROUP BY l_suppkey")
def dm06_delete_partition(spark, d):
    """DM-06: what stays after one key's analysis is deleted."""
    return table(spark, d, "lineitem").where("l_suppkey <> 3").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("ar03_chunks", """
SELECT n_nationkey // CAST(ceil(25.0 / least(7, 25)) AS INTEGER) AS chunk, count(*) AS n FROM nation GROUP BY 1""")
def ar03_chunks(spark, d):
    """AR-03."""
    return table(spark, d, "nation").groupBy(R.chunk_number(F.col("n_nationkey"), F.lit(25), F.lit(7)).alias("chunk")).agg(F.count("*").alias("n"))


@query("md21_stratified_subset", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), q AS (SELECT label, n, ceil(n * 60.0 / (SELECT count(*) FROM embeddings)) AS want FROM c),
r AS (SELECT label, greatest(least(want, 60 - coalesce(sum(want) OVER (ORDER BY n, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS quota FROM q)
SELECT vec_id, e.label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) e JOIN r ON r.label = e.label AND e.rn <= r.quota""")
def md21_stratified_subset(spark, d):
    """MD-21: the subset of 60 that the operator is for."""
    return R.stratified_subset(table(spark, d, "embeddings").select("vec_id", "label"), "label", 60, F.col("vec_id"))
