"""Screening, charting and validation of records, with the caller's own functions where judgement is needed."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import record_id

DECISIONS = "include exclude maybe".split()


def undecided(batch: pd.DataFrame) -> pd.DataFrame:
    """A screener that decides nothing."""
    return pd.DataFrame({"pmid": batch["pmid"], "decision": "maybe", "reason": "not screened"})


def screen(records: DataFrame, screener: Callable[[pd.DataFrame], pd.DataFrame] = undecided) -> DataFrame:
    """(pmid, decision, reason, warnings): the screener's answers over batches of records, and what is wrong with them."""

    def run(batches):
        for pdf in batches:
            yield screener(pdf)[["pmid", "decision", "reason"]]

    d = records.mapInPandas(run, "pmid string, decision string, reason string")
    wrong = F.array_compact(F.array(F.when(F.coalesce(F.col("pmid"), F.lit("")) == "", "no pmid"), F.when(~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False)), "unknown decision"), F.when((F.col("decision") == "exclude") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no reason")))
    return d.withColumn("warnings", wrong)


def chart(records: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The extractor's rows over batches of records, in the schema given at run time."""

    def run(batches):
        for pdf in batches:
            yield extractor(pdf)

    return records.mapInPandas(run, schema)


def review_queue(decisions: DataFrame, records: DataFrame, audits: DataFrame) -> DataFrame:
    """(pmid, decision, title, flag, confidence): decisions with their records and audits, to be ordered by flag first and least confidence; without an audit it counts 1."""
    j = decisions.join(records.select("pmid", "title"), "pmid", "left").join(audits.select(F.col("record_id").alias("pmid"), "flag", "confidence"), "pmid", "left")
    return j.select("pmid", "decision", F.coalesce("title", F.lit("(no record)")).alias("title"), F.coalesce("flag", F.lit(False)).alias("flag"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def unaudited(batch: pd.DataFrame) -> pd.DataFrame:
    """A self-auditor that judges nothing: every decision is flagged, with no confidence."""
    return pd.DataFrame({"record_id": batch["record_id"], "confidence": 0.0, "flag": True, "reasoning": "no self-auditor is set", "dimension": None})


def self_audit(decisions: DataFrame, records: DataFrame, auditor: Callable[[pd.DataFrame], pd.DataFrame] = unaudited) -> DataFrame:
    """(record_id, confidence, flag, reasoning, dimension): the auditor's answers over batches of decisions with their records' title and abstract, null where there is no record."""
    d = decisions.withColumn("record_id", record_id(F.col("pmid"))).join(records.select(F.col("pmid").alias("record_id"), "title", "abstract"), "record_id", "left")

    def run(batches):
        for pdf in batches:
            yield auditor(pdf)[["record_id", "confidence", "flag", "reasoning", "dimension"]]

    return d.mapInPandas(run, "record_id string, confidence double, flag boolean, reasoning string, dimension string")


def reconcile(decisions: DataFrame, human: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, requeue): the human answers (record_id, reviewed, flip, note) beside the decisions they are about; flips are queued again."""
    d = decisions.select(record_id(F.col("pmid")).alias("record_id"), F.col("decision").alias("original"))
    o = human.join(d, "record_id", "left").select("record_id", F.when(F.coalesce("flip", F.lit(False)), "flip").otherwise("agree").alias("human"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"), "note", "original")
    return o, o.where("human = 'flip'").select("record_id", F.lit("human flip on validation").alias("reason"), "note", "original")


def rating_tallies(human: DataFrame) -> DataFrame:
    """(dimension, value, n) of a map column `ratings`."""
    return human.select(F.explode("ratings").alias("dimension", "value")).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def missing_fields(charted: DataFrame, required: list[str], known: list[str]) -> DataFrame:
    """charted with `problems`: required fields that are empty, and columns outside the schema."""
    empty = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"missing {c}") for c in required]
    extra = [F.lit(f"unknown {c}") for c in charted.columns if c not in known]
    return charted.withColumn("problems", F.array_compact(F.array(*empty, *extra)))
