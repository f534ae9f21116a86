"""A library of texts: search, statistics, scores of what to keep, and acquisition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import norm_doi

#: Weights of age, size, demand and cost of a copy.
WEIGHTS = {"age": 1.0, "size": 0.5, "demand": 0.6, "cost": 0.8}
NEVER = 1e9


def age_days(when: Column, today: Column) -> Column:
    """Days since; NEVER where unknown."""
    return F.coalesce(F.datediff(today, when).cast("double"), F.lit(NEVER))


def min_max_score(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """df with the weighted sum of its columns, each stretched from 0 to 1 over all rows; a column with one value counts 0. Least and largest come as one row."""
    ends = df.agg(*[f(c).alias(f"__{p}_{c}") for c in weights for p, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).otherwise(1.0))
    total = sum((w * part(c) for c, w in weights.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, total).select(*df.columns, name)  # one row


def stats(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def search(catalog: DataFrame, query: str, k: int = 10, key: str = "key", text: str = "text", first: int = 20_000) -> DataFrame:
    """(key, sim) of the k texts whose first characters are nearest to a query, by cosine of term weights; texts that share no term don't count."""
    from scholium.operators.vectors import tfidf

    both = catalog.select(F.col(key).cast("string").alias("key"), F.substring(F.col(text), 1, first).alias("t")).unionByName(catalog.sparkSession.createDataFrame([("\0query", query)], "key string, t string"))
    w = tfidf(both, "key", "t")
    q = w.where(F.col("key") == "\0query").select("term", F.col("weight").alias("q"))  # as many rows as the query has terms
    sims = w.where(F.col("key") != "\0query").join(F.broadcast(q), "term").groupBy("key").agg(F.sum(F.col("weight") * F.col("q")).alias("sim"))
    return sims.orderBy(F.desc(F.round("sim", 12)), "key").limit(k)


def coverage(records: DataFrame, downloaded: DataFrame, key: str = "pmid") -> DataFrame:
    """One row: records, those with a DOI, those whose text is there, and the percentages; null without records."""
    have = downloaded.select(key).distinct().withColumn("__have", F.lit(True))
    a = records.join(have, key, "left").agg(F.count("*").alias("n_records"), F.count(norm_doi(F.col("doi"))).alias("with_doi"), F.count_if(F.coalesce("__have", F.lit(False))).alias("downloaded"))
    return a.withColumn("doi_pct", F.round(F.try_divide(100.0 * F.col("with_doi"), F.col("n_records")), 1)).withColumn("downloaded_pct", F.round(F.try_divide(100.0 * F.col("downloaded"), F.col("n_records")), 1))
