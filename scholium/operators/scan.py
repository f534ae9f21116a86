"""The whole scan of a corpus for reported statistics: everything found, a row a paper, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.operators import extract, summaries
from scholium.runtime import cut
from scholium.sources.sinks import write_jsonl


def scan(df: DataFrame, key: str = "pmid", text: str = "text") -> dict[str, DataFrame]:
    """papers (a row a text, with counts of what was found), pvalues, effects, triples, funding and salami. Each kind is found once and written, so that the others reuse it."""
    found = {"pvalues": cut(extract.pvalues(df, key, text), "pvalues"), "effects": cut(extract.effects(df, key, text), "effects"), "triples": cut(extract.triples(df, key, text), "triples")}
    per = cut(extract.papers(df, key, text), "papers")
    counts = found["pvalues"].groupBy(key).agg(F.count("*").alias("n_pvalues"))
    e = found["effects"].groupBy(key).agg(F.count("*").alias("n_effects"), F.count_if("implausibly_wide").alias("n_wide_ci"), F.count_if(~F.col("ci_consistent")).alias("n_ci_inconsistent"))
    t = found["triples"].groupBy(key).agg(F.count("*").alias("n_triples"))
    papers = per.join(counts, key, "left").join(e, key, "left").join(t, key, "left").fillna(0, ["n_pvalues", "n_effects", "n_wide_ci", "n_ci_inconsistent", "n_triples"])
    found["papers"] = cut(papers, "scanned")
    found["funding"] = found["papers"].select(key, "funding_classification", "industry_linked")
    found["salami"] = summaries.salami(found["papers"].select(F.col(key).alias("pmid"), "cohort_size", "authors"))
    return found


def summary(found: dict[str, DataFrame], key: str = "pmid") -> DataFrame:
    """One row: counts, the curve and last digits of p-values, positivity, and its difference by industry links."""
    p = found["papers"].withColumnRenamed(key, "pmid") if key != "pmid" else found["papers"]
    n = lambda d, name: d.agg(F.count("*").alias(name))
    parts = [n(p, "n_papers"), n(found["pvalues"], "n_pvalues"), n(found["effects"], "n_effects"), n(found["triples"], "n_triples"), n(found["salami"], "n_salami")]
    curve, digits = summaries.p_curve(found["pvalues"]), summaries.last_digit_test(found["pvalues"])
    parts += [curve.select(F.struct("*").alias("p_curve")), digits.select(F.struct("*").alias("last_digit")), summaries.positivity(p).select(F.struct("*").alias("positivity")), summaries.industry_positivity(p, p).select(F.struct("*").alias("industry"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.crossJoin(x)  # one row each
    return out


def write(found: dict[str, DataFrame], folder: str, key: str = "pmid") -> list[str]:
    """Six record files and the summary's, in a folder."""
    out = [write_jsonl(found[k], f"{folder.rstrip('/')}/{k}") for k in ("papers", "pvalues", "effects", "triples", "funding", "salami")]
    return [*out, write_jsonl(summary(found, key), f"{folder.rstrip('/')}/summary")]
