"""Everything known of each audited paper in one row, and what the rows say of clusters and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = "construct_adequacy construct_validity novelty reproducibility statistical_hygiene transparency".split()
VOICE = "construct_adequacy"


def star(ratings: DataFrame, papers: DataFrame, records: DataFrame, assignments: DataFrame, clusters: DataFrame, exclusions: DataFrame, scans: DataFrame, funding: DataFrame, salami: DataFrame, run: str) -> DataFrame:
    """A row for each rated paper, with what the other tables have of it; all joins are left ones by pmid, clusters by their id.

    ratings become a map by dimension (the last rubric version's), salami pairs a list of siblings.
    """
    one = F.struct("rating", "paper_type", "rubric_version")
    last = ratings.groupBy("pmid", "dimension").agg(F.max_by(one, F.struct("rubric_version", "rating")).alias("r"))
    rated = last.groupBy("pmid").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "r"))).alias("ratings"), F.max(F.coalesce((F.col("dimension") == VOICE) & (F.col("r.rating") == "good"), F.lit(False))).alias("is_voice"))  # an entry a dimension
    siblings = salami.select(F.col("pmid_a").alias("pmid"), F.col("pmid_b").alias("other"), "n_shared").unionByName(salami.select(F.col("pmid_b").alias("pmid"), F.col("pmid_a").alias("other"), "n_shared"))
    siblings = siblings.groupBy("pmid").agg(F.array_sort(F.collect_list(F.struct("other", "n_shared"))).alias("siblings"))
    own = assignments.where(F.col("cluster_run_id") == run).select("pmid", "cluster_id", "distance_to_centroid")
    c = clusters.where(F.col("cluster_run_id") == run).select("cluster_id", "cluster_name", "centroid_pmid")
    out = rated.join(papers, "pmid", "left").join(records.select("pmid", F.col("title").alias("__t"), F.col("year").alias("__y"), F.col("journal").alias("__j"), "authors", "doi"), "pmid", "left")
    out = out.join(own, "pmid", "left").join(c, "cluster_id", "left").join(exclusions.select("pmid", F.col("reason").alias("exclusion_reason")), "pmid", "left")
    out = out.join(scans, "pmid", "left").join(funding, "pmid", "left").join(siblings, "pmid", "left")
    filled = {k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.col(s).cast("string")) for k, s in (("title", "__t"), ("year", "__y"), ("journal", "__j"))}
    return out.withColumns(filled).withColumn("is_centroid", F.coalesce(F.col("centroid_pmid") == F.col("pmid"), F.lit(False))).drop("__t", "__y", "__j", "centroid_pmid")


def compact(meta: DataFrame) -> DataFrame:
    """The star's rows flat: a column for each main dimension's rating, the first paper type by name, three authors, defaults in place of nulls."""
    types = F.array_min(F.filter(F.transform(F.map_values("ratings"), lambda r: r["paper_type"]), lambda t: F.coalesce(t, F.lit("")) != ""))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return meta.select(
        "pmid", text("title"), F.col("year").try_cast("int").alias("year"), text("journal"), F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 3).alias("authors"), "cluster_id", text("cluster_name"), "is_voice", "is_centroid",
        F.coalesce(F.col("exclusion_reason") != "", F.lit(False)).alias("excluded"), "exclusion_reason", F.coalesce(types, F.lit("")).alias("paper_type"), *[F.try_element_at("ratings", F.lit(x))["rating"].alias(x) for x in DIMENSIONS],
        F.coalesce("n_pvalues", F.lit(0)).alias("n_pvalues"), F.coalesce("n_effects", F.lit(0)).alias("n_effects"), "positivity_ratio", text("funding_classification"), F.coalesce("industry_linked", F.lit(False)).alias("industry_linked"),
    )


def _share(part, whole):
    return F.try_divide(100.0 * part, whole)


def cluster_stats(papers: DataFrame) -> DataFrame:
    """By cluster: audited, valid (rated and not excluded), excluded, voices, the ratings' counts, and the share of suspect ones among the valid; null without any."""
    valid = ~F.col("excluded") & F.col(VOICE).isNotNull()
    a = papers.groupBy("cluster_id").agg(F.max("cluster_name").alias("cluster_name"), F.count("*").alias("n_audited"), F.count_if(valid).alias("n_valid"), F.count_if("excluded").alias("n_excluded"), F.count_if(F.col("is_voice") & ~F.col("excluded")).alias("n_voices"), F.count_if(valid & (F.col(VOICE) == "suspect")).alias("n_suspect"))
    return a.withColumn("suspect_pct", _share(F.col("n_suspect"), F.col("n_valid")))


def corpus_summary(papers: DataFrame, diagnostic: list[int]) -> DataFrame:
    """One row: audited, valid, excluded, voices, industry-linked papers, and the suspect share in the diagnostic clusters of those rated."""
    d = F.coalesce(F.col("cluster_id").isin(diagnostic), F.lit(False)) & ~F.col("excluded")
    rated = d & F.coalesce(F.col(VOICE) != "n/a", F.lit(False))
    a = papers.agg(F.count("*").alias("n_audited"), F.count_if(~F.col("excluded")).alias("n_valid"), F.count_if("excluded").alias("n_excluded"), F.count_if(F.col("is_voice") & ~F.col("excluded")).alias("n_voices"), F.count_if("industry_linked").alias("n_industry"), F.count_if(rated).alias("diagnostic_n"), F.count_if(d & (F.col(VOICE) == "suspect")).alias("diagnostic_suspect"))
    return a.withColumn("diagnostic_pct", _share(F.col("diagnostic_suspect"), F.col("diagnostic_n")))


def cluster_index(papers: DataFrame, most: int = 50) -> DataFrame:
    """(cluster_id, place, pmid, year, title, more): each cluster's newest papers, place from 1, and how many follow."""
    w = Window.partitionBy("cluster_id")
    p = papers.withColumn("place", F.row_number().over(w.orderBy(F.desc(F.coalesce("year", F.lit(0))), "pmid"))).where(F.col("place") <= most)
    n = papers.groupBy("cluster_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    title = F.when(F.length("title") > 90, F.concat(F.substring("title", 1, 90), F.lit("…"))).otherwise(F.col("title"))
    return p.join(n.withColumnRenamed("cluster_id", "__c"), F.col("cluster_id").eqNullSafe(F.col("__c"))).select("cluster_id", "place", "pmid", "year", title.alias("title"), "more")
