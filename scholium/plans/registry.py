"""Named queries over a folder of parquet tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "exclusion_counts"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) as the query `name`."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "venue_profile",
    """SELECT source, lang, COUNT(*) AS n_docs, CAST(SUM(n_chars) AS BIGINT) AS total_chars, MIN(n_chars) AS min_chars, MAX(n_chars) AS max_chars,
    COUNT(DISTINCT text) AS n_distinct FROM documents GROUP BY source, lang""",
)
def venue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, lengths and distinct texts by source and language; texts are compared by their 256-bit hash, so that none is shuffled."""
    from pyspark.sql import functions as F

    d = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    return d.groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"), F.sum("n_chars").alias("total_chars"), F.min("n_chars").alias("min_chars"),
        F.max("n_chars").alias("max_chars"), F.count_distinct("h").alias("n_distinct"),
    )


from scholium.plans import analyses, bibliography, corpus, discovery, papers, people, reported, reviews, similarity, statistics  # noqa: E402, F401
