"""Queries for text, JSON and source parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import text as X
from ..sources import readers as S
from .registering import Plans, epoch, table

plans = Plans()
query, QUERIES, ORACLES = plans.query, plans.queries, plans.oracles

_NUM = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'"


@query("sc07_delimited", rf"""
WITH l AS (SELECT event_id, event_type || ',' || CAST(user_id AS VARCHAR) || 'px, ' || CAST(value AS VARCHAR) || 'e' AS s FROM events)
SELECT event_id, split_part(s, ',', 1) AS kind, CAST(regexp_extract(split_part(s, ',', 2), '^[+-]?[0-9]+') AS BIGINT) AS user_id, CAST(regexp_extract(ltrim(split_part(s, ',', 3)), {_NUM}) AS DOUBLE) AS value FROM l""")
def sc07_delimited(spark, d):
    """SC-07, SC-08, SC-09: fields without quoting; numbers by prefix."""
    rows = table(spark, d, "events").select(F.concat("event_type", F.lit(","), F.col("user_id").cast("string"), F.lit("px, "), F.col("value").cast("string"), F.lit("e,"), F.col("event_id").cast("string")).alias("line"))
    return S.delimited(rows, "line", kind="string", user_id="long", value="double", event_id="long").select("event_id", "kind", "user_id", "value")


@query("sc14_settings", """
SELECT c_name AS key, CAST(c_custkey AS VARCHAR) || ' # ' || c_mktsegment AS value, c_custkey AS number FROM customer""")
def sc14_settings(spark, d):
    """SC-14, SC-09."""
    lines = table(spark, d, "customer").select(F.concat(F.lit("  "), "c_name", F.lit(" = "), F.col("c_custkey").cast("string"), F.lit(" # "), "c_mktsegment").alias("value"))
    return S.settings(lines).withColumn("number", S.setting_int(F.col("value")))


@query("sc17_survival_table", """
SELECT o_orderpriority AS strain, round((epoch_us(l_shipdate) // 1000000 - epoch_us(o_orderdate) // 1000000) / 86400.0, 6) AS age_days, (l_returnflag <> 'R')::INTEGER AS censored FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'""")
def sc17_survival_table(spark, d):
    """SC-16, SC-17, DT-02, DT-03."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", epoch("l_shipdate").alias("time"), (F.col("l_returnflag") == "R").alias("event"))
    rows = items.join(table(spark, d, "orders").select("o_orderkey", epoch("o_orderdate").alias("birth"), F.col("o_orderpriority").alias("strain")), F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("l_suppkey", "device")
    return S.survival_table(rows, controls="5-LOW").select("strain", F.round("age_days", 6).alias("age_days"), "censored")


@query("sc24_metadata_round_trip", "SELECT page_id, replace(url, ']]>', '') AS description FROM pages")
def sc24_metadata_round_trip(spark, d):
    """SC-24, SC-25: what was embedded is extracted again."""
    p = table(spark, d, "pages").select("page_id", F.replace("url", F.lit("]]>"), F.lit("")).alias("u"))
    return p.select("page_id", X.embedded_description(X.encoded_description(F.col("u"))).alias("description"))


@query("sc26_tiff_tags", "SELECT p_partkey, p_size AS orientation, CAST(p_size * 1.5 AS DOUBLE) AS resolution, CAST(0 AS DOUBLE) AS missing FROM part")
def sc26_tiff_tags(spark, d):
    """SC-26."""
    xmp = F.concat(F.lit("<rdf:Description tiff:Orientation='"), F.col("p_size").cast("string"), F.lit("' tiff:XResolution='"), (F.col("p_size") * F.lit(1.5).cast("double")).cast("string"), F.lit("/1'/>"))
    p = table(spark, d, "part").select("p_partkey", xmp.alias("x"))
    return p.select("p_partkey", X.tiff_tag(F.col("x"), "Orientation").cast("int").alias("orientation"), X.tiff_tag(F.col("x"), "XResolution").alias("resolution"), X.tiff_tag(F.col("x"), "YResolution").alias("missing"))


@query("sc28_listing")
def sc28_listing(spark, d):
    """SC-28, SC-29, AG-23: the tables' own files by name and size."""
    return S.directory_size(S.listing(spark, d, "*.parquet"))


@query("sc35_sparse_rows", """
SELECT vec_id, label::DOUBLE AS label, 3 AS n, vec_id % 2 = 0 AS ok FROM embeddings""")
def sc35_sparse_rows(spark, d):
    """SC-35, PF-19: lines with ascending places are good, others are flagged."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    lines = e.select("vec_id", F.concat(F.col("label").cast("string"), F.when(F.col("vec_id") % 2 == 0, " 1:0.5 3:1e-3 7:2").otherwise(" 1:0.5 7:2 3:1")).alias("value"))
    return S.read_sparse(lines.select(F.concat("value", F.lit(" "), (F.col("vec_id") + 100).cast("string"), F.lit(":1")).alias("value"))).select((F.element_at("indices", -1) - 100).cast("long").alias("vec_id"), "label", (F.size("indices") - 1).alias("n"), "ok")


@query("sc36_sparse_lines", "SELECT vec_id, CAST(label AS VARCHAR) || ' 1:1.0 3:2.0' AS value FROM embeddings WHERE label >= 0")
def sc36_sparse_lines(spark, d):
    """SC-36."""
    e = table(spark, d, "embeddings").where("label >= 0").select("vec_id", "label", F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)).alias("v"))
    written = S.sparse_lines(e.select(F.concat_ws("|", F.col("vec_id").cast("string"), F.col("label").cast("string")).alias("both"), "v"), "both", "v")
    return written.select(F.substring_index("value", "|", 1).cast("long").alias("vec_id"), F.substring_index("value", "|", -1).alias("value"))


@query("st02_paths", r"""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1)) AS extension, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory FROM pages""")
def st02_paths(spark, d):
    """ST-01, ST-02."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.file_name(u).alias("name"), X.extension(u).alias("extension"), X.stem(u).alias("stem"), X.directory(u).alias("directory"))


@query("st03_storage_paths", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '/store' ELSE '/store/' || p_brand || '/' || p_type || '/' || p_name END AS path FROM part""")
def st03_storage_paths(spark, d):
    """ST-03."""
    relative = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", X.storage_path(F.lit("/store"), F.col("p_brand"), relative, F.col("p_name")).alias("path"))


@query("st04_unescaped", "SELECT c_custkey, '<' || c_mktsegment || '>&' || c_name AS text FROM customer")
def st04_unescaped(spark, d):
    """ST-04: the state machine over well-formed entities (quirks are in the unit tests)."""
    raw = F.concat(F.lit("&lt;"), "c_mktsegment", F.lit("&#39;&gt;&amp;"), "c_name")
    return table(spark, d, "customer").select("c_custkey", X.unescaped(raw).alias("text"))


@query("st05_sample_ids", "SELECT n_nationkey, [n_nationkey::BIGINT, n_regionkey::BIGINT, 7] AS ids FROM nation")
def st05_sample_ids(spark, d):
    """ST-05, AR-01."""
    text = F.concat(F.col("n_nationkey").cast("string"), F.lit("o"), F.col("n_regionkey").cast("string"), F.lit("oo7"))
    return table(spark, d, "nation").select("n_nationkey", X.sample_ids(text).alias("ids"))


@query("st07_labels", "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS padded, CAST(n_nationkey AS VARCHAR) || '/25' AS frame FROM nation")
def st07_labels(spark, d):
    """ST-07, ST-10."""
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", X.padded(n, 4).alias("padded"), X.frame_label(n, F.lit(25)).alias("frame"))


@query("st08_enumerations", """
SELECT n_nationkey, ['flexible', 'strict', 'simultaneous'][n_nationkey % 3 + 1] AS estimator FROM nation""")
def st08_enumerations(spark, d):
    """ST-08."""
    codes = F.array(*[F.lit(k) for k in X.ESTIMATORS])
    return table(spark, d, "nation").select("n_nationkey", X.label_of(F.element_at(codes, F.col("n_nationkey") % 3 + 1), {k: v[0] for k, v in X.ESTIMATORS.items()}).alias("estimator"))


@query("pf17_transitions", "SELECT DISTINCT o_orderstatus AS from_state, l_linestatus AS to_state, false AS is_state FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def pf17_transitions(spark, d):
    """PF-17."""
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus").join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderstatus", "l_linestatus").distinct()
    coded = pairs.select(X.transition_text(F.col("o_orderstatus"), F.col("l_linestatus")).alias("s"))
    return coded.select(X.transition_parts(F.col("s")).alias("p"), X.is_state(F.col("s")).alias("is_state")).select("p.from_state", "p.to_state", "is_state")


@query("ar02_maps", "SELECT n_regionkey, max(n_nationkey) FILTER (n_name LIKE '%A%') AS last_a, count(*) AS n FROM nation GROUP BY 1")
def ar02_maps(spark, d):
    """AR-02: map built, filtered and read."""
    m = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return m.select("n_regionkey", F.array_max(F.map_values(F.map_filter("m", lambda k, _: k.contains("A")))).alias("last_a"), F.size("m").cast("long").alias("n"))


@query("js01_values", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing, json_type(props) AS kind FROM events""")
def js01_values(spark, d):
    """JS-01, JS-04, JS-05, JS-11: parse, read by pointer, default, kind."""
    v = table(spark, d, "events").select("event_id", F.parse_json("props").alias("v"))
    return v.select("event_id", J.value_or(F.col("v"), "/k", "long", None).alias("k"), J.value_or(F.col("v"), "/missing", "long", -1).alias("missing"), J.kind_of(F.col("v")).alias("kind"))


@query("js02_filtered", """SELECT event_id, CASE WHEN event_type = 'view' THEN '{}' ELSE '{"k":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || '}' END AS kept FROM events""")
def js02_filtered(spark, d):
    """JS-02: keys are dropped while a text is parsed; here the key to drop is named by a column."""
    dropped = F.when(F.col("event_type") == "view", "k").otherwise("Thumbnail")
    return table(spark, d, "events").select("event_id", J.without_key(F.col("props"), dropped).alias("kept"))


@query("js03_events", "SELECT event_id, k.key AS key, CAST(k.value AS VARCHAR) AS value FROM events, json_each(props) k")
def js03_events(spark, d):
    """JS-03, JS-10: one row an entry."""
    return table(spark, d, "events").selectExpr("event_id", "parse_json(props) AS v").selectExpr("event_id", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("event_id", "key", F.to_json("value").alias("value"))


@query("js06_flattened", "SELECT event_id, '/k' AS pointer, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def js06_flattened(spark, d):
    """JS-06."""
    return table(spark, d, "events").select("event_id", F.explode(J.flattened(F.col("props"))).alias("pointer", "value"))


@query("js08_merge_patch", """SELECT event_id, '{"new":1}' AS merged FROM events""")
def js08_merge_patch(spark, d):
    """JS-07, JS-08."""
    return table(spark, d, "events").select("event_id", J.with_merge_patch(F.col("props"), F.lit('{"k": null, "new": 1}')).alias("merged"))


@query("js07_difference", """SELECT event_id, '{"k":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) || '}' AS patched FROM events""")
def js07_difference(spark, d):
    """JS-07: a difference, applied, gives the other document."""
    next_props = F.concat(F.lit('{"k": '), (F.get_json_object("props", "$.k").cast("long") + 1).cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", J.with_patch(F.col("props"), J.differences(F.col("props"), next_props)).alias("patched"))


@query("js09_update", "SELECT n_nationkey, n_name AS left_name, 'x' AS shared FROM nation")
def js09_update(spark, d):
    """JS-09: shallow, the right side wins."""
    a, b = F.create_map(F.lit("name"), F.col("n_name"), F.lit("shared"), F.lit("y")), F.create_map(F.lit("shared"), F.lit("x"))
    joined = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return table(spark, d, "nation").select("n_nationkey", F.element_at(joined, "name").alias("left_name"), F.element_at(joined, "shared").alias("shared"))
