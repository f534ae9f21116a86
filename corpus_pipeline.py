"""From raw documents to packed sequences: quality, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import mixing, packing, quality, secrets_scan, setjoin
from scholium.llm._tables import read
from scholium.runtime import cut, drop, keep, scratch

#: No source is repeated more often than this; none loses a document.
MAX_REPEAT = 2.0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones."""
    return setjoin.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, in wrapped layers too; n_chars follows the text."""
    names = docs.columns
    own = {c: f"__c{i}" for i, c in enumerate(names) if c != "text"}  # so that no name can clash with the scan's
    renamed = docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in names])
    found = secrets_scan.find_secrets(renamed, "text", keep=list(own.values()), redact=True)
    cols = {c: F.col(k) for c, k in own.items()} | {"text": F.col("redacted")}
    if "n_chars" in own:
        cols["n_chars"] = F.when(F.col("spans") != "", F.length("redacted").cast("long")).otherwise(F.col(own["n_chars"]))
    return found.select(*[cols[c].alias(c) for c in names])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture's order, small sources repeated."""
    return mixing.in_order(mixing.mix(docs, max_repeat=MAX_REPEAT))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, by sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("near duplicates", without_copies), ("secrets", without_secrets), ("mixture", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is written
            docs = keep(cut(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
