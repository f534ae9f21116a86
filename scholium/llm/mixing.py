"""Mixing sources to target weights by temperature.

A source with a share p of all tokens gets a weight in proportion to p ** a. The exponent a is bisected to the flattest mixture (least a) that
a repetition limit allows, or to a target entropy. A budget of tokens makes a weight a quota. A quota is realised in
epochs: each is a permutation of the source's documents by hash, whole epochs first, and of the last one the part whose tokens fill
the quota. The permutations are laid out along the budget, which is cut into blocks, so that each block holds every source in its weight.

Documents aren't moved to decide: the last epoch of a source ends at a hash value, found exactly from a histogram of its hash
and the one bucket in which the quota runs out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.llm._tables import read
from scholium.operators.numbering import number_rows
from scholium.runtime import BROADCAST_ROWS, cut, drop, small_join

#: Words of a block of the mixture; buckets of a source's hash.
BLOCK_TOKENS, BUCKETS = 1_000_000, 4096
SEED = 5
#: The largest exponent tried for an entropy below that of the shares themselves.
SHARPEST = 16.0
MAX_REPEAT = 4.0


def words_in(text: Column) -> Column:
    """Words between ASCII white space; a null or wordless text counts one, so that each document costs something."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).cast("long")


def source_key(source: Column) -> Column:
    """Sources as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


class Shares:
    """Sums over the sources' shares for many exponents at once: here if there are few sources, else by Spark."""

    def __init__(self, stats: DataFrame, rows: int):
        head = stats.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
        self.total = int(head["t"] or 0)
        self.rows = rows
        self.low, self.high = (head["lo"] / self.total, head["hi"] / self.total) if self.total else (1.0, 1.0)
        self.stats = stats
        self.p = np.sort(np.array([r["tokens"] for r in stats.select("tokens").collect()], float)) / max(1, self.total) if rows <= BROADCAST_ROWS else None

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """(sum of p ** a, sum of p ** a * ln p) for each exponent."""
        if self.p is not None:
            return [(float((self.p**a).sum()), float((self.p**a * np.log(self.p)).sum())) for a in exponents]
        ln = F.log(F.col("tokens") / self.total)
        aggs = [f(F.exp(ln * a)) for a in exponents for f in (F.sum, lambda x: F.sum(x * ln))]
        row = self.stats.agg(*[x.alias(f"x{i}") for i, x in enumerate(aggs)]).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]

    def entropy(self, exponents: list[float]) -> list[float]:
        """Of the weights, in nats."""
        return [math.log(z) - a * s / z for a, (z, s) in zip(exponents, self.sums(exponents))]


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: int
    normaliser: float
    total: int


def _bisect(good, hi: float = 1.0, rounds: int = 16) -> float:
    """The least exponent from 0 to hi that is good, hi if none is; good takes several at once, and stays good beyond one that is."""
    lo = 0.0
    if good([0.0])[0]:
        return 0.0
    for _ in range(rounds):  # eight sections at a time
        at = [lo + (hi - lo) * i / 8 for i in range(1, 8)]
        ok = good(at)
        first = next((i for i, x in enumerate(ok) if x), 7)
        lo, hi = (lo if first == 0 else at[first - 1]), (at[first] if first < 7 else hi)
    return hi


def temperature(shares: Shares, max_repeat: float | None = None, entropy: float | None = None, budget: int | None = None) -> Mixture:
    """The mixture for one of two targets. Without a budget, it is the least that has each document at least once.

    max_repeat: no source is repeated more often. entropy: of the weights, in nats; the nearest that exponents from 0 to SHARPEST give. Above 1 they sharpen.
    """
    if (max_repeat is None) == (entropy is None):
        raise ValueError("give max_repeat or entropy")
    if not shares.total:
        return Mixture(1.0, 0, 1.0, 0)
    if entropy is not None:
        # entropy falls as the exponent grows
        a = _bisect(lambda xs: [h <= entropy for h in shares.entropy(xs)], SHARPEST)
    elif budget is None:
        a = _bisect(lambda xs: [(shares.low / shares.high) ** (x - 1) <= max_repeat for x in xs])  # of the rarest source; the commonest comes once
    else:
        a = _bisect(lambda xs: [budget / shares.total * shares.low ** (x - 1) / z <= max_repeat for x, (z, _) in zip(xs, shares.sums(xs))])
    z = shares.sums([a])[0][0]
    if budget is None:
        budget = math.ceil(shares.total * z * max(shares.high ** (1 - a), shares.low ** (1 - a)) - 1e-6)
    return Mixture(a, budget, z, shares.total)


def _rank(epoch: Column) -> Column:
    """A document's place in an epoch's permutation, from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), epoch.cast("long"), F.col("__h")), 2)


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """df's rows, each as often as its source's quota takes it, with all their columns and, in `__mix`, a struct: epoch
    (from 0), block, rank (order by block and rank is the mixture's), weight of the source and quota in tokens.

    Tokens are words between ASCII white space; a null or empty text counts one. A null source is one of its own. Rows equal in
    key and text share a place; each is taken as often as the other. Empty tables give no rows. Without a budget no document is lost.
    The quotas exceed or miss the weights by one document of a source at most. Columns may have any names but __mix, which is an error. The mixture is in the attribute `mixture` of the result.
    """
    names = df.columns
    if "__mix" in (c.lower() for c in names):
        raise ValueError("a column __mix is there already")
    own = {c: f"c{i}" for i, c in enumerate(names)}  # so that no name clashes with those used here
    rows = df.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    source, text, key = own[source], own[text], own[key]
    h = F.xxhash64(F.col(key).cast("string"), F.col(text))
    narrow = cut(rows.select(source_key(F.col(source)).alias("__s"), h.alias("__h"), words_in(F.col(text)).alias("tokens")), "tokens")
    stats = cut(narrow.groupBy("__s").agg(F.sum("tokens").alias("tokens")), "sources")
    n = stats.count()
    m = temperature(Shares(stats, n), max_repeat, entropy, budget)
    weight = F.exp(F.log(F.col("tokens") / max(1, m.total)) * m.exponent) / m.normaliser
    quota = F.floor(weight * m.budget + 1e-6).cast("long")
    quotas = stats.select("__s", F.col("tokens").alias("__t"), weight.alias("__w"), (F.greatest(quota, F.col("tokens")) if budget is None else quota).alias("__q"))
    quotas = cut(quotas.withColumn("__full", F.floor(F.col("__q") / F.col("__t")).cast("long")).withColumn("__rest", F.col("__q") - F.col("__full") * F.col("__t")), "quotas")
    # where the last epoch ends: first the bucket of the hash in which the quota runs out, then the hash
    part = small_join(narrow, quotas.where("__rest > 0").select("__s", "__full", "__rest"), ["__s"], rows=n).withColumn("__r", _rank(F.col("__full")))
    part = part.withColumn("__b", F.floor(F.col("__r") / (2**62 // BUCKETS)).cast("int"))
    hist = part.groupBy("__s", "__b").agg(F.sum("tokens").alias("n"), F.first("__rest").alias("__rest"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("__before < __rest AND __before + n >= __rest")
    hist = cut(hist.select("__s", "__b", "__before"), "ends")
    last = small_join(part, hist, ["__s", "__b"], rows=n)
    run = Window.partitionBy("__s", "__b").orderBy("__r").rangeBetween(Window.unboundedPreceding, -1)
    ends = last.withColumn("__at", F.col("__before") + F.coalesce(F.sum("tokens").over(run), F.lit(0))).where("__at < __rest").groupBy("__s").agg(F.max("__r").alias("__end"))
    quotas = cut(quotas.join(ends, "__s", "left"), "quotas")
    drop(hist)
    blocks = max(1, -(-m.budget // BLOCK_TOKENS))
    full = small_join(rows.withColumn("__s", source_key(F.col(source))).withColumn("__h", h), quotas.select("__s", "__t", "__w", "__q", "__full", "__end"), ["__s"], rows=n)
    copies = F.col("__full") + F.when(F.col("__end").isNotNull() & (_rank(F.col("__full")) <= F.col("__end")), 1).otherwise(0)
    # a document taken no time at all gets an empty sequence, and explode drops it
    full = full.withColumn("__copies", copies).withColumn("__epoch", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).otherwise(F.array().cast("array<long>"))))
    along = (F.col("__epoch") + _rank(F.col("__epoch")) / float(2**62)) * F.col("__t") / F.col("__q")
    block = F.least(F.lit(blocks - 1), F.floor(along * blocks)).cast("int")
    out = full.withColumn("__mix", F.struct(F.col("__epoch").cast("int").alias("epoch"), block.alias("block"), F.xxhash64(F.lit(SEED + 1), "__epoch", "__h").alias("rank"), F.col("__w").alias("weight"), F.col("__q").alias("quota")))
    out = out.select(*[F.col(o).alias(c) for c, o in own.items()], "__mix")
    drop(narrow)
    out.mixture = m
    return out


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in the mixture's order, spread over partitions by range of blocks; without `__mix`."""
    return mixed.repartitionByRange("__mix.block", "__mix.rank").sortWithinPartitions("__mix.block", "__mix.rank").drop("__mix")


def op2_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, epoch, block, position, weight, quota): position is the place in the whole mixture, from 0."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mix(docs).select("doc_id", "source", "__mix.*")
    return number_rows(m, ["block", "rank", "doc_id"], number="position").drop("rank")


QUERIES = {"op2_temperature_mixture": op2_temperature_mixture}
