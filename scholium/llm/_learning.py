"""A bounded labelled sample, and scoring of whole texts by a fitted model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm._tables import freeing, give_back
from scholium.runtime import cut, ship

#: Rows whose id's checksum leaves this remainder are held out of all learning.
FOLDS, HELD_OUT = 5, 0
STEP = 200  # texts handled at a time


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is divisible by 5. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: tuple[int, int]) -> tuple[DataFrame, float]:
    """A written table (y, text, calibrates) of at most per_class[y] documents of each class, those with the least hash of their key,
    and the share of class 1 among all labelled documents outside the held-out fold.

    calibrates marks a third of the texts, by hash: dictionaries are built from the others, else the calibration would
    see texts that the dictionaries hold. Labels other than 0 and 1 and null keys are left out; a key with several labels takes their rounded mean, and of a key
    with several texts the least one is learned from. The bound is on learning only: scoring covers every row.
    """
    ship(docs.sparkSession)
    lab = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    lab = lab.where(~held_out(F.col("__k")))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    ids = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64(F.col("__k").cast("string")), "__k").limit(per_class[y])
        ids = part if ids is None else ids.unionByName(part)
    # at most the two bounds of rows, so it may be broadcast
    got = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(F.broadcast(ids), "__k").groupBy("__k", "y").agg(F.min("text").alias("text"))
    got = got.select("y", "text", (F.pmod(F.xxhash64(F.col("text")), F.lit(3)) == 0).alias("calibrates"))
    return cut(got, "sample"), (n1 / (n0 + n1) if n0 + n1 else 0.5)


def features_of(sample: DataFrame, model) -> tuple[np.ndarray, np.ndarray]:
    """The model's features of the whole sampled texts, and their classes, of those texts that calibrate."""
    width = model.WIDTH

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                x = np.array([model.features(t) for t in part.column(1).to_pylist()], dtype=float).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = sample.where("calibrates").select("y", "text").repartition(12).mapInArrow(freeing(run), "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, width)
    order = np.lexsort(x.T)  # sums don't depend on the order in which tasks end
    return x[order], got["y"].to_numpy()[order]


def score_with(df: DataFrame, text: str, model, keep: list[Column], name: str = "score") -> DataFrame:
    """The kept columns and a score from 0 to 1 of each whole text; null counts as empty."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [model.scores(texts.iloc[at : at + STEP]) for at in range(0, len(texts), STEP)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        give_back()

    return df.select(*keep, score(F.col(f"`{text}`")).alias(name))
