"""Quality by compression: one zstandard dictionary is built from labelled good text, another from bad text, and a whole
text's normalised difference of compressed sizes becomes a calibrated score.

Junk that repeats itself is short under either dictionary, so the calibration also takes the ratios themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import _learning as L
from scholium.llm import _zdict as Z
from scholium.llm._tables import read

WINDOW, DICTIONARY = 1024, 65536
#: Bound of the labelled rows learned from: bad, good.
SAMPLE = (3000, 3000)
#: Windows of all sampled texts of a class together that its dictionary is trained on: every one, or in larger samples those of least hash.
TRAIN_WINDOWS = 16_384
THRESHOLD = 0.3


class Model:
    WIDTH = 4

    def __init__(self, good: bytes, bad: bytes):
        self.pair, self.calibrated = Z.Pair(good, bad), None

    def features(self, text: str | None) -> list[float]:
        parts = Z.windows(text or "", WINDOW)
        if not parts:
            return [0.0] * self.WIDTH
        good, bad, plain, n = self.pair.lengths(parts).sum(0)
        return [(bad - good) / max(good, bad), plain / n, good / n, bad / n]

    def scores(self, texts) -> np.ndarray:
        return self.calibrated(np.array([self.features(t) for t in texts], dtype=float).reshape(-1, self.WIDTH))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: tuple[int, int] = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows a class outside the held-out fold. Without labels of both classes, all scores are 0.5."""
    rows, _ = L.labelled_sample(docs, labels, key, text, label, sample)

    def pick(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if parts := Z.windows(t or "", WINDOW):
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["y", "w"])

    got = rows.where("NOT calibrates").select("y", "text").mapInArrow(L.freeing(pick), "y int, w binary")
    parts = [[bytes(r["w"]) for r in got.where(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(TRAIN_WINDOWS).select("w").toLocalIterator()] for y in (0, 1)]
    model = Model(Z.dictionary(parts[1], DICTIONARY), Z.dictionary(parts[0], DICTIONARY))
    model.calibrated = Z.Calibrated(*L.features_of(rows, model))
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) for each row of df.

    An empty or null text has the score of all-zero features. Repeated rows score alike; a null key is held out. Empty
    tables give no rows. Other columns of df are left aside.
    """
    out = L.score_with(df, text, model, [F.col(key).alias("__key")])
    return out.select(F.col("__key").alias(key), L.held_out(F.col("__key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text scores at least the threshold, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # so that no name clashes with the score's
    return L.score_with(df, text, model, [whole.alias("row")], "quality").where(F.col("quality") >= threshold).select("row.*")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op5_compression_quality": op5_compression_quality}
