"""Queries over an audit store: ratings (pmid, rubric_version, dimension, rating), clusters, assignments and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATINGS = "good acceptable suspect missing unclear n/a".split()
#: Level: papers of each cluster, and how they are picked.
LEVELS = {"L0": (1, "nearest"), "L1": (5, "spread"), "L2": (20, "random"), "L3": (50, "random"), "L4": (None, "all")}


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in a custom order, from 1; null outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0))


def without(df: DataFrame, exclusions: DataFrame | None, key: str = "pmid") -> DataFrame:
    """df without excluded papers. A null among the exclusions excludes nothing."""
    return df if exclusions is None else df.join(exclusions.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def prevalence(ratings: DataFrame, exclusions: DataFrame | None = None, version: str | None = None) -> DataFrame:
    r = without(ratings, exclusions)
    if version is not None:
        r = r.where(F.col("rubric_version") == version)
    return r.groupBy("dimension", "rating").agg(F.count_distinct("pmid").alias("n"))


def by_cluster(ratings: DataFrame, assignments: DataFrame, clusters: DataFrame, dimension: str, run: str, exclusions: DataFrame | None = None) -> DataFrame:
    """Ratings of one dimension by cluster; unnamed clusters stay apart by their id."""
    r = without(ratings.where(F.col("dimension") == dimension), exclusions)
    j = r.join(assignments.where(F.col("cluster_run_id") == run), "pmid").join(clusters.where(F.col("cluster_run_id") == run).select("cluster_id", "cluster_name"), "cluster_id")
    return j.groupBy("cluster_id", "cluster_name", "rating").agg(F.count_distinct("pmid").alias("n"))


def drift(ratings: DataFrame, old: str, new: str) -> DataFrame:
    """Papers rated under both versions, and how many ratings changed, by dimension. Exclusions don't matter here."""
    a, b = (ratings.where(F.col("rubric_version") == v).select("pmid", "dimension", F.col("rating").alias(k)) for v, k in ((old, "a"), (new, "b")))
    return a.join(b, ["pmid", "dimension"]).groupBy("dimension").agg(F.count("*").alias("n_papers"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("n_changed"))


def rated_papers(ratings: DataFrame) -> DataFrame:
    """Distinct papers by version, and over all in the row without one."""
    return ratings.rollup("rubric_version").agg(F.count_distinct("pmid").alias("n_papers"))


def coverage(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("pmid").agg(F.count_distinct("dimension").alias("dims_rated")).groupBy("dims_rated").agg(F.count("*").alias("n_papers"))


def latest_run(runs: DataFrame, run: str = "cluster_run_id", seq: str = "seq") -> DataFrame:
    return runs.agg(F.max_by(run, seq).alias(run))


def sample_level(assignments: DataFrame, level: str, exclusions: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(cluster_id, pmid, rank_in_cluster from 0, distance_to_centroid) of a sampling level.

    nearest: least distance first. spread: places i * n / k in that order. random: least md5 of pmid and seed. Ties go to the smaller pmid.
    """
    k, how = LEVELS[level]
    a = without(assignments, exclusions)
    order = [F.md5(F.concat_ws(":", F.col("pmid").cast("string"), F.lit(str(seed)))), F.col("pmid")] if how == "random" else [F.col("distance_to_centroid"), F.col("pmid")]
    w = Window.partitionBy("cluster_id").orderBy(*order)
    a = a.withColumn("i", F.row_number().over(w) - 1)
    if how == "spread":
        n = F.count("*").over(Window.partitionBy("cluster_id"))
        # place i is the j-th chosen if floor(j n / k) = i for j = ceil(i k / n)
        a = a.withColumn("n", n).withColumn("j", F.when(F.col("n") <= k, F.col("i")).otherwise(F.ceil(F.col("i") * k / F.col("n"))).cast("int"))
        a = a.where((F.col("j") < k) & (F.when(F.col("n") <= k, F.col("i")).otherwise(F.floor(F.col("j") * F.col("n") / k)) == F.col("i"))).withColumn("i", F.col("j"))
    elif k is not None:
        a = a.where(F.col("i") < k)
    return a.select("cluster_id", "pmid", F.col("i").cast("int").alias("rank_in_cluster"), "distance_to_centroid")


def record_sampling(assignments: DataFrame, level: str, run: str, exclusions: DataFrame | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(runs, picks) of a level's sampling, to be appended to the store: one row with its parameters and size, and the papers picked under the run's name."""
    picks = sample_level(assignments, level, exclusions, seed).withColumn("sampling_run_id", F.lit(run))
    k, how = LEVELS[level]
    runs = picks.agg(F.lit(run).alias("sampling_run_id"), F.lit(level).alias("level"), F.lit(how).alias("strategy"), F.lit(k).cast("int").alias("per_cluster"), F.lit(seed).alias("seed"), F.count("*").alias("n_picked"), F.count_distinct("cluster_id").alias("n_clusters"))
    return runs, picks


def load_exclusions(log: DataFrame) -> DataFrame:
    """(pmid, reason) of an append-only log of exclusions (pmid, reason, seq): the last entry of a paper counts; rows without a paper go."""
    return log.where(F.coalesce("pmid", F.lit("")) != "").groupBy("pmid").agg(F.max_by("reason", "seq").alias("reason"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of new in place of those with the same keys."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def checked_ratings(ratings: DataFrame, dimensions: list[str]) -> DataFrame:
    """ratings with `problems`: unknown dimension or rating, or no evidence where the rating needs some."""
    needs = F.col("rating").isin("suspect", "missing") & (F.trim(F.coalesce("evidence_quote", F.lit(""))) == "")
    return ratings.withColumn("problems", F.array_compact(F.array(F.when(~F.col("dimension").isin(dimensions), "dimension"), F.when(~F.col("rating").isin(RATINGS), "rating"), F.when(needs, "evidence"))))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exact agreement of two raters by dimension."""
    j = a.select("pmid", "dimension", F.col("rating").alias("x")).join(b.select("pmid", "dimension", F.col("rating").alias("y")), ["pmid", "dimension"])
    return j.groupBy("dimension").agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))
