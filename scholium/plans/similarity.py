"""Queries over embeddings and events: similarity, sampling, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import audit, vectors
from scholium.plans.registry import query, table
from scholium.runtime import cut
from scholium.streaming import state


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return e.where("label < 5").drop("label"), e.where("label >= 5").drop("label")


_COS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.label < 5 AND b.label >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 12) DESC, id) AS rank FROM s)"


@query("cosine_topk", f"WITH {_COS} SELECT query, id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    q, c = _sides(spark, d)
    return vectors.top_k(q, c, 5).select("query", "id", F.round("sim", 6).alias("sim"), "rank")


@query("novelty", f"WITH {_COS} SELECT query AS id, id AS best, round(sim, 6) AS sim, sim < 0.4 AS novel FROM r WHERE rank = 1")
def novelty(spark: SparkSession, d: str) -> DataFrame:
    q, c = _sides(spark, d)
    return vectors.novelty(q, c, 0.4).select("id", "best", F.round("sim", 6).alias("sim"), "novel")


_CENT = "c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label), ca AS (SELECT vec_id AS pmid, e.label AS cluster_id, 1 - list_cosine_similarity(embedding::DOUBLE[], c) AS dist FROM embeddings e JOIN c ON c.label = e.label WHERE embedding[1] <= 0.2)"


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), F.col("label").alias("cluster_id"), F.col("embedding").alias("vec"))
    a = vectors.centroid_distance(e, "cluster_id").select("cluster_id", "pmid", F.col("distance").alias("distance_to_centroid"))
    return a, e.where("vec[0] > 0.2").select("pmid")


def _level(name: str, sql: str):
    @query(f"sample_{name}", f"WITH {_CENT} {sql}")
    def sample(spark: SparkSession, d: str) -> DataFrame:
        a, ex = _assigned(spark, d)
        return audit.sample_level(a, name, ex).select("cluster_id", "pmid", "rank_in_cluster")


_RANKED = ", o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, pmid) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM ca)"
_level("L0", f"{_RANKED} SELECT cluster_id, pmid, i::INTEGER AS rank_in_cluster FROM o WHERE i < 1")
_level("L1", f"{_RANKED}, k AS (SELECT range AS j FROM range(5)) SELECT cluster_id, pmid, (CASE WHEN n <= 5 THEN i ELSE j END)::INTEGER AS rank_in_cluster FROM o LEFT JOIN k ON n > 5 AND i = floor(j * n / 5) WHERE n <= 5 OR j IS NOT NULL")
_level("L2", ", o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(pmid || ':42'), pmid) - 1 AS i FROM ca) SELECT cluster_id, pmid, i::INTEGER AS rank_in_cluster FROM o WHERE i < 20")
_level("L4", f"{_RANKED} SELECT cluster_id, pmid, i::INTEGER AS rank_in_cluster FROM o")


@query("continuity", "WITH p AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings) SELECT label, vec_id, round(CASE WHEN w IS NULL THEN 0 ELSE list_cosine_similarity(v, w) END, 6) AS continuity FROM p")
def continuity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))
    return vectors.continuity(e, "label", "vec_id").select("label", "vec_id", F.round("continuity", 6).alias("continuity"))


@query("argument_graph", f"WITH {_COS}, j AS (SELECT r.*, x.label AS f, y.label AS t FROM s r JOIN e x ON x.vec_id = r.query JOIN e y ON y.vec_id = r.id WHERE sim > 0.2 AND x.label <> y.label), b AS (SELECT *, row_number() OVER (PARTITION BY f, t ORDER BY round(sim, 12) DESC, query, id) AS rn FROM j) SELECT f AS from_paper, t AS to_paper, query AS conclusion, id AS premise, round(sim, 6) AS sim FROM b WHERE rn = 1")
def argument_graph(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("paper"), F.col("embedding").alias("vec"))
    g = vectors.argument_edges(e.where("paper < 5"), e.where("paper >= 5"), 0.2)
    return g.select(F.col("from_paper").cast("int").alias("from_paper"), F.col("to_paper").cast("int").alias("to_paper"), "conclusion", "premise", F.round("sim", 6).alias("sim"))


@query("journal_fit", "WITH c AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label >= 5) GROUP BY i)), s AS (SELECT list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, c WHERE label < 5) SELECT round(avg(s), 6) AS mean_fit, round(min(s), 6) AS min_fit, round(max(s), 6) AS max_fit, round(stddev_pop(s), 6) AS std_fit FROM s")
def journal_fit(spark: SparkSession, d: str) -> DataFrame:
    q, c = _sides(spark, d)
    return vectors.fit(q, c).select(*[F.round(x, 6).alias(x) for x in ("mean_fit", "min_fit", "max_fit", "std_fit")])


@query("clusters", "SELECT count(*) AS n_rows, 10::BIGINT AS n_clusters, true AS nearest, true AS heads FROM embeddings WHERE embedding IS NOT NULL")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a clustering, whichever it is: every vector has a cluster, all but one in a hundred at most are nearest its mean, as iterations are bounded, and each cluster's head is a member."""
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    a = cut(vectors.kmeans(e, k=10), "clusters")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    u = e.withColumn("u", F.transform("vec", lambda x: x.cast("double") / norm)).join(a, "id")
    means = vectors.centroid(u, "u", ["cluster_id"])
    far = F.aggregate(F.zip_with("u", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = u.select("id", "u", F.col("cluster_id").alias("own")).crossJoin(F.broadcast(means)).groupBy("id").agg(F.min(F.when(F.col("cluster_id") == F.col("own"), far)).alias("own"), F.min(far).alias("least"))  # ten means
    heads = vectors.cluster_heads(a).join(a.select(F.col("id").alias("centroid"), F.col("cluster_id").alias("c")), "centroid").agg(F.min(F.col("c") == F.col("cluster_id")).alias("heads"))
    n = a.agg(F.count("*").alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"))
    return n.crossJoin(near.agg((F.avg((F.col("own") - F.col("least") < 1e-3).cast("double")) > 0.99).alias("nearest"))).crossJoin(heads)  # one row each


# --- events as attempts and sightings


@query("seen_set", "SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id")
def seen_set(spark: SparkSession, d: str) -> DataFrame:
    return state.seen(table(spark, d, "events"), "user_id", "ts")


@query("hourly_counts", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return state.windowed_counts(table(spark, d, "events"), "ts", ["event_type"])


@query(
    "outcome_state",
    """WITH a AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
    b AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM a)
    SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS successes, count(*) FILTER (run = last AND event_type = 'error') AS consecutive, count(*) FILTER (run = last AND event_type = 'error') >= 2 AS needs_headed FROM b GROUP BY user_id""",
)
def outcome_state(spark: SparkSession, d: str) -> DataFrame:
    return state.outcome_state(table(spark, d, "events"), "user_id", "event_id", "event_type", "purchase", "error")


@query("permanent_failures", "WITH m AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS ok, max(event_id) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id) SELECT user_id, 'error' AS permanent_outcome FROM m WHERE bad IS NOT NULL AND (ok IS NULL OR bad > ok)")
def permanent_failures(spark: SparkSession, d: str) -> DataFrame:
    return state.skipped(table(spark, d, "events"), "user_id", "event_id", "event_type", "purchase", ("error",))


@query("asof_stat", "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), e AS (SELECT * FROM events WHERE event_type = 'error') SELECT p.event_id, coalesce(max(e.event_id), -1) AS last_error FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.event_id < p.event_id AND e.event_id >= p.event_id - 500 GROUP BY p.event_id")
def asof_stat(spark: SparkSession, d: str) -> DataFrame:
    """The last error of the same user in the 500 events before each purchase, by one window instead of a range join."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-500, -1)
    e = table(spark, d, "events").withColumn("last_error", F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w))
    return e.where("event_type = 'purchase'").select("event_id", F.coalesce("last_error", F.lit(-1)).alias("last_error"))


@query("band_join", "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), e AS (SELECT * FROM events WHERE event_type = 'error') SELECT p.event_id, min(e.event_id) AS first_near FROM p JOIN e ON abs(e.event_id - p.event_id) <= 20 GROUP BY p.event_id")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """The first error within 20 events of each purchase: both sides meet in buckets of the band's width."""
    e = table(spark, d, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 20).alias("b"))
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("p"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    j = p.join(e.where("event_type = 'error'").select("event_id", "b"), "b").where("abs(event_id - p) <= 20")
    return j.groupBy(F.col("p").alias("event_id")).agg(F.min("event_id").alias("first_near"))
