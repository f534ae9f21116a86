"""Toxicity by compression distance: two zstandard dictionaries, one of the byte sequences that recur in toxic text and are rare in
ordinary text and one the other way round, compress each window of a text; how much shorter windows get under the toxic one is calibrated.

Dictionaries trained on the texts as they are share most of their content, and the few toxic words drown in chance
matches (measured: area under the curve 0.84). So each is trained on its class's distinguishing n-grams, chained into segments, and matches
shorter than an n-gram are not taken.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.llm import _learning as L
from scholium.llm import _zdict as Z
from scholium.llm._tables import read
from scholium.runtime import cut, drop

WINDOW, GRAM, DICTIONARY = 192, 6, 32768
#: Bound of the labelled rows learned from: ordinary, toxic.
SAMPLE = (6000, 3000)
#: A distinguishing n-gram occurs in this many sampled texts at least, and in a share of them this many times the other class's. Ordinary text has little that
#: toxic text hasn't: its dictionary stays small, and at a low ratio fills with chance. The ratio is chosen on the learning rows that calibrate.
RECUR, RATIOS = 3, (5, 10, 20, 40)
#: Codes of n-grams counted in one go.
FLUSH = 1 << 20
THRESHOLD = 0.5
_OTHER = re.compile(rb"[^a-z\x80-\xff]+")


def normal(text: str | None) -> bytes:
    """The lower-case letters of a text; runs of anything else become one space."""
    return b" " + _OTHER.sub(b" ", (text or "").lower().encode("utf-8", "replace")).strip() + b" " if text else b""


def _codes(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    n = len(a) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    found = []
    for at in range(0, n, FLUSH):
        m = min(FLUSH, n - at)
        out = np.zeros(m, np.int64)
        for i in range(GRAM):
            out = (out << 8) | a[at + i : at + i + m]
        found.append(np.unique(out))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def segments(counts: dict[bytes, int], size: int) -> list[bytes]:
    """n-grams chained where they overlap, the most frequent first, up to `size` bytes in all."""
    left, out, n = dict(counts), [], 0
    heads: dict[bytes, set] = {}
    tails: dict[bytes, set] = {}
    for g in left:
        heads.setdefault(g[:-1], set()).add(g)
        tails.setdefault(g[1:], set()).add(g)
    for g in sorted(counts, key=lambda g: (-counts[g], g)):
        if g not in left:
            continue
        s = g
        del left[g]
        while nxt := [x for x in heads.get(s[1 - GRAM :], ()) if x in left]:
            best = max(nxt, key=lambda x: (left[x], x))
            del left[best]
            s += best[-1:]
        while nxt := [x for x in tails.get(s[: GRAM - 1], ()) if x in left]:
            best = max(nxt, key=lambda x: (left[x], x))
            del left[best]
            s = best[:1] + s
        if n + len(s) + 1 > size:
            break
        out.append(s)
        n += len(s) + 1
    return out


class Model:
    WIDTH = 7

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        # zero bytes part the segments, and occur in no window; the most frequent come last, where offsets are short
        self.dicts = [b"\0" + b"\0".join(reversed(x)) + b"\0" * 8 for x in (toxic, ordinary)]
        self.calibrated, self._ready = None, None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            prm = zstandard.ZstdCompressionParameters(
                min_match=GRAM, strategy=zstandard.STRATEGY_BTLAZY2, window_log=18, hash_log=16, chain_log=16, search_log=4, target_length=64,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            self._ready = []
            for d in self.dicts:
                d = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=prm)
                self._ready.append(zstandard.ZstdCompressor(dict_data=d, compression_params=prm))
        return self._ready

    def features(self, text: str | None) -> list[float]:
        parts = Z.windows(normal(text).decode("utf-8", "replace"), WINDOW)
        if not parts:
            return [0.0] * self.WIDTH
        toxic, ordinary = self._compressors()
        d = np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts])
        s = np.sort(d)[::-1]
        return [d.mean(), s[0], s[:3].mean(), (d >= 1).mean(), (d >= 2).mean(), np.maximum(d, 0).mean(), np.log1p(len(d))]

    def scores(self, texts) -> np.ndarray:
        return self.calibrated(np.array([self.features(t) for t in texts], dtype=float).reshape(-1, self.WIDTH))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows a class outside the held-out fold. Scores follow the classes' shares; without labels of both, all are 0.5."""
    rows, share = L.labelled_sample(docs, labels, key, text, label, sample)

    def count(batches):
        got: tuple[list, list] = ([], [])
        n, size = [0, 0], 0

        def flush():
            for y in (0, 1):
                codes, c = np.unique(np.concatenate(got[y]), return_counts=True) if got[y] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                codes, c = np.append(codes, -1), np.append(c, n[y])  # -1 carries the number of texts
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), y), pa.int32()), pa.array(codes, pa.int64()), pa.array(c, pa.int64())], ["y", "code", "n"])

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = _codes(normal(t))
                n[y] += 1
                got[y].append(codes)
                size += len(codes)
                if size > FLUSH:
                    yield from flush()
                    got, n, size = ([], []), [0, 0], 0
        yield from flush()

    n = [F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    grams = rows.where("NOT calibrates").select("y", "text").repartition(12).mapInArrow(L.freeing(count), "y int, code long, n long").groupBy("code").agg(*n).where("n0 >= {0} OR n1 >= {0} OR code = -1".format(RECUR))
    grams = cut(grams, "grams")
    total = grams.where("code = -1").first()
    n0, n1 = (max(1, total["n0"]), max(1, total["n1"])) if total else (1, 1)
    # for each class and ratio, the most frequent n-grams; each takes a byte of the dictionary at least, so no more of them can be used
    stronger = lambda a, b, na, nb, ratio: (F.col(a) >= RECUR) & (F.col(a) / na > ratio * (F.col(b) + 0.5) / nb)
    sides = [F.when(stronger(*c, r), F.struct(F.lit(y).alias("y"), F.lit(r).alias("ratio"), F.col(c[0]).alias("n"))) for y, c in ((1, ("n1", "n0", n1, n0)), (0, ("n0", "n1", n0, n1))) for r in RATIOS]
    own = grams.where("code >= 0").select("code", F.explode(F.array_compact(F.array(*sides))).alias("x")).select("code", "x.*")
    best = Window.partitionBy("y", "ratio").orderBy(F.desc("n"), "code")
    own = own.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= DICTIONARY).select("y", "ratio", "code", "n").toPandas()
    models = []
    for ratio in RATIOS:
        picked = []
        for y in (1, 0):
            mine = own[(own["y"] == y) & (own["ratio"] == ratio)]
            picked.append(segments({int(c).to_bytes(8, "big")[8 - GRAM :]: int(k) for c, k in zip(mine["code"], mine["n"])}, DICTIONARY))
        models.append(Model(*picked))
    drop(grams)
    share = min(0.95, max(0.05, share))
    x, y = L.features_of(rows, Several(models))
    x = x.reshape(len(x), len(models), Model.WIDTH)
    best = min(range(len(models)), key=lambda i: (loss(x[:, i], y, share), -i))
    model = models[best]
    model.calibrated = Z.Calibrated(x[:, best], y, share=share)
    model.ratio = RATIOS[best]
    return model


class Several:
    """The features of several models side by side."""

    def __init__(self, models: list[Model]):
        self.models, self.WIDTH = models, Model.WIDTH * len(models)

    def features(self, text: str | None) -> list[float]:
        return [v for m in self.models for v in m.features(text)]


def loss(x: np.ndarray, y: np.ndarray, share: float, folds: int = 4) -> float:
    """Mean log loss of classes weighted by their shares, over folds of the rows whose calibration hasn't seen them; 0 if a class is lacking."""
    if not len(y) or y.sum() < folds or len(y) - y.sum() < folds:
        return 0.0
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    total = 0.0
    for k in range(folds):
        out = np.zeros(len(y), bool)
        for c in (0, 1):  # each class is dealt out in turn
            out[np.flatnonzero(y == c)[k::folds]] = True
        p = np.clip(Z.Calibrated(x[~out], y[~out], share)(x[out]), 1e-6, 1 - 1e-6)
        total -= float((weight[out] * np.where(y[out] == 1, np.log(p), np.log(1 - p))).sum())
    return total


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) for each row of df.

    An empty or null text has the score of all-zero features. Repeated rows score alike; a null key is held out. Empty
    tables give no rows. Other columns of df are left aside.
    """
    out = L.score_with(df, text, model, [F.col(key).alias("__key")])
    return out.select(F.col("__key").alias(key), L.held_out(F.col("__key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op8_compression_toxicity": op8_compression_toxicity}
