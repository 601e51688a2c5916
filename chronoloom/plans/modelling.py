"""Queries for models, path linking and incremental processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..sources.readers import shared_folder
from ..streaming import ingest as G
from .registering import Plans, epoch, table
from .series import events

plans = Plans()
query, QUERIES, ORACLES = plans.query, plans.queries, plans.oracles

_E = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t, value FROM events"


@query("jn10_linked_objects", f"""
WITH e AS ({_E}), p AS (SELECT a.user_id, a.event_id AS a, b.event_id AS b, abs(a.value - b.value) AS distance, b.t - a.t AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.t - a.t <= 86400 AND abs(a.value - b.value) <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, a ORDER BY distance, gap, a, b) AS ra, row_number() OVER (PARTITION BY user_id, b ORDER BY distance, gap, a, b) AS rb FROM p)
SELECT user_id, a, b, round(distance, 4) AS distance, gap FROM r WHERE ra = 1 AND rb = 1""")
def jn10_linked_objects(spark, d):
    """JN-10, MD-03: one-to-one links of mutual best candidates."""
    return M.linked_objects(events(spark, d), "user_id", "t", "value", "event_id", 86400, 30.0).withColumn("distance", F.round("distance", 4))


@query("jn11_assignment", """
WITH o AS (SELECT o_custkey, o_totalprice AS x, 1000.0 * (o_orderkey % 400) AS y, o_orderkey FROM orders),
a AS (SELECT o_custkey, x, row_number() OVER (PARTITION BY o_custkey ORDER BY x) AS i FROM o), b AS (SELECT o_custkey, y, row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS i FROM o)
SELECT o_custkey, count(*) AS n, round(sum(abs(x - y)), 2) AS cost FROM a JOIN b USING (o_custkey, i) GROUP BY 1""")
def jn11_assignment(spark, d):
    """JN-11: least-cost one-to-one assignment of each customer's orders to as many targets, a customer in one task. On a
    line the sorted order costs least, which the SQL uses."""
    o = table(spark, d, "orders").where("o_custkey is not null").select("o_custkey", "o_totalprice", (1000.0 * (F.col("o_orderkey") % 400)).alias("target"))
    return M.assigned(o, "o_custkey", "o_totalprice", "target").withColumn("cost", F.round("cost", 2))


@query("md09_cross_validation")
def md09_cross_validation(spark, d):
    """MD-09, MD-11: for each fold the best threshold of the others and its error on the held-out subjects."""
    def score(train, held):
        truth = lambda df: df.where("event_type <> 'error'").groupBy("user_id").agg(F.max("t").alias("truth"))
        best = M.best_threshold(train, truth(train), "user_id", "t", "value", [20.0, 60.0, 120.0])
        last = held.join(best.select("threshold"), F.col("value") >= F.col("threshold")).groupBy("user_id").agg(F.max("t").alias("found"), F.first("threshold").alias("threshold"))
        return truth(held).join(last, "user_id").agg(F.avg(F.abs(F.col("found") - F.col("truth"))).alias("error"), F.first("threshold").alias("threshold"))

    return M.cross_validated(events(spark, d), "user_id", 3, score)


@query("md09_folds", "SELECT 4 AS folds, count(DISTINCT user_id) AS subjects FROM events")
def md09_folds(spark, d):
    """MD-09: each subject is in one fold."""
    e = events(spark, d).select("user_id", M.folds(F.col("user_id"), 4).alias("fold")).distinct()
    return e.agg(F.countDistinct("fold").cast("int").alias("folds"), F.count("user_id").alias("subjects"))


@query("md18_mixture")
def md18_mixture(spark, d):
    """MD-18, MD-19: EM over all vectors, whole, until the likelihood stops rising or for 250 rounds; BIC of one to three components."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    start = [list(r.v) for r in e.orderBy("vec_id").limit(3).collect()]  # the means to start from
    rows = []
    for k in (1, 2, 3):
        weight, _, _, score, n = M.mixture(e, "v", start[:k])
        rows.append((k, float(score), float(M.bic(score, n, k, len(start[0]))), [float(w) for w in weight]))
    return spark.createDataFrame(rows, "components int, loglikelihood double, bic double, weights array<double>")


def _rounds_of_means(rounds: int) -> str:
    """CTEs c0 to c(rounds), the centres after each round of k-means from the first three vectors, by component."""
    gaps = "(SELECT p.vec_id, k, sum((p.v - c.v) ** 2) AS gap FROM p JOIN c{0} c USING (i) GROUP BY 1, 2)"
    near = "SELECT vec_id, arg_min(k, {{'gap': gap, 'k': k}}) AS k FROM " + gaps + " GROUP BY 1"
    parts = ["p AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)", "c0 AS (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS k, i, v FROM p WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3))"]
    for n in range(rounds):
        parts += [f"n{n} AS MATERIALIZED ({near.format(n)})", f"c{n + 1} AS MATERIALIZED (SELECT k, i, avg(v) AS v FROM n{n} JOIN p USING (vec_id) GROUP BY 1, 2)"]
    return f"WITH {', '.join(parts)}, near AS ({near.format(rounds)})"


@query("md20_clusters", _rounds_of_means(5) + " SELECT vec_id, k::INTEGER AS cluster FROM near")
def md20_clusters(spark, d):
    """MD-20: k-means over all vectors, labelled with built-in functions."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    start = e.orderBy("vec_id").limit(3).collect()
    centres = M.lloyd(e, "v", [list(r.v) for r in start], 5)
    return M.nearest_centre(e, "v", centres).select("vec_id", "cluster")


@query("md16_linear_svm")
def md16_linear_svm(spark, d):
    """MD-16, MD-17: scaled features, a grid search with five folds over the whole table, a linear support vector machine
    with the best parameter; with each prediction that parameter, its mean accuracy over the folds and the training
    accuracy."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("raw"), (F.col("label") < 5).cast("double").alias("label"))
    scaled = StandardScaler(inputCol="raw", outputCol="features").fit(e).transform(e)
    machine, accuracy = LinearSVC(), MulticlassClassificationEvaluator(metricName="accuracy")
    grid = ParamGridBuilder().addGrid(machine.regParam, [0.001, 0.01, 0.1, 1.0]).build()
    search = CrossValidator(estimator=machine, estimatorParamMaps=grid, evaluator=accuracy, numFolds=5, seed=7, parallelism=4).fit(scaled)
    best = search.bestModel
    out = best.transform(scaled)
    fit = {"reg_param": best.getRegParam(), "cv_accuracy": max(search.avgMetrics), "accuracy": accuracy.evaluate(out)}
    return out.select("vec_id", F.col("prediction").cast("int").alias("prediction"), *[F.lit(float(x)).alias(c) for c, x in fit.items()])


def _ran(spark, stream, name: str):
    """Runs a stream over what is there into a table of files, in the folder that driver and executors share, and reads it."""
    at = f"{shared_folder(spark)}-{name}"
    sink = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/checkpoint")
    sink.trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("ss05_stream_without_duplicates", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ss05_stream_without_duplicates(spark, d):
    """SS-01, SS-05: the events table as a stream, each event once."""
    stream = spark.readStream.schema(G.EVENTS).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    seen = G.without_duplicates(stream, ["event_id"], "ts", "10 minutes").select("event_id", "user_id", "event_type")
    return _ran(spark, seen, "ss05").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("ss06_sessions", """
WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS begin_s, epoch_us(max(ts)) // 1000000 + 21600 AS end_s, count(*) AS n FROM i GROUP BY user_id, s""")
def ss06_sessions(spark, d):
    """SS-06: session windows (the same plan runs on a stream)."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return s.select("user_id", F.timestamp_diff("SECOND", zero, F.col("w.start")).alias("begin_s"), F.timestamp_diff("SECOND", zero, F.col("w.end")).alias("end_s"), "n")


@query("ss_windows", "SELECT (epoch_us(ts) // 1000000) // 86400 AS day, count(*) AS n FROM events GROUP BY 1")
def ss_windows(spark, d):
    """Tumbling windows of a day over the stream."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.floor(F.timestamp_diff("SECOND", zero, F.col("w.start")) / 86400).alias("day"), "n")
