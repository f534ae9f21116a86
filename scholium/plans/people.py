"""Queries of collections, authors, methods and calibrated batteries, over the driver's tables in such roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import battery, people
from scholium.plans.registry import query, table


@query(
    "citation_uptake",
    """WITH o AS (SELECT p_partkey AS paper, p_brand AS author FROM part), c AS (SELECT l_partkey AS paper, l_orderkey AS id, list(DISTINCT p_brand) AS who FROM lineitem JOIN part ON p_partkey = (l_suppkey % 40) + 1 GROUP BY ALL)
    SELECT paper, count(*) AS n_citing, count(*) FILTER (list_contains(who, author)) AS n_self, count(*) FILTER (NOT list_contains(who, author)) AS n_independent, count(*) FILTER (NOT list_contains(who, author)) < 3 AS low_uptake FROM c JOIN o USING (paper) GROUP BY paper""",
)
def citation_uptake(spark: SparkSession, d: str) -> DataFrame:
    """Parts as papers, brands as authors, order lines as citing works."""
    part = table(spark, d, "part")
    o = part.select(F.col("p_partkey").alias("paper"), F.array("p_brand").alias("authors"))
    by = part.select(F.col("p_partkey").alias("k"), "p_brand")
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("paper"), F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 40 + 1).alias("k")).join(by, "k").groupBy("paper", "id").agg(F.collect_set("p_brand").alias("authors"))
    return people.citation_uptake(o, c)


@query("shared_works", "SELECT l_orderkey AS work, list_sort(list(DISTINCT l_suppkey))::VARCHAR AS authors FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) >= 2")
def shared_works(spark: SparkSession, d: str) -> DataFrame:
    w = people.shared_works(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("author")))
    return w.select("work", F.concat(F.lit("["), F.array_join(F.transform("authors", lambda x: x.cast("string")), ", "), F.lit("]")).alias("authors"))


@query("self_validation", "SELECT l_orderkey AS paper, count(*) FILTER (l_returnflag = 'R') AS n_developers, CASE WHEN count(*) FILTER (l_returnflag = 'R') >= 2 THEN 'high' WHEN count(*) FILTER (l_returnflag = 'R') = 1 THEN 'medium' ELSE 'low' END AS risk FROM lineitem GROUP BY l_orderkey")
def self_validation(spark: SparkSession, d: str) -> DataFrame:
    return people.self_validation(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), (F.col("l_returnflag") == "R").alias("developer")))


@query("collection_status", "SELECT source, count(*) AS n_refs, count(*) FILTER (lang = 'en') AS with_doi, count(*) FILTER (n_chars > 1000) AS with_pdf, count(*) FILTER (length(text) > 0) AS with_text FROM documents GROUP BY source")
def collection_status(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("source", F.when(F.col("lang") == "en", F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("doi"), (F.col("n_chars") > 1000).alias("has_pdf"), (F.length("text") > 0).alias("has_text"))
    return people.collection_status(r, "source")


@query("pre_submit", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))) AS n_missing, count(*) AS n_refs, CAST(floor(100.0 * count(*) FILTER (p_size > 10) / count(*)) AS BIGINT) AS doi_percent, count(*) FILTER (trim(p_name) = '') AS n_untitled, (SELECT count(*) FROM (SELECT p_size % 25 AS k FROM part WHERE p_size > 10 GROUP BY k HAVING count(*) > 1)) AS n_shared_dois FROM part")
def pre_submit(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    doi = F.when(F.col("p_size") > 10, F.concat(F.lit("doi:10.5/"), (F.col("p_size") % 25).cast("string")))
    refs = p.select(F.col("p_partkey").cast("string").alias("cite_key"), F.array().cast("array<string>").alias("alternate_keys"), F.col("p_name").alias("title"), doi.alias("doi"))
    return people.pre_submit(refs, table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("cite_key")))
