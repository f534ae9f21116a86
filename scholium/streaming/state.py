"""Incremental state as Structured Streaming, with batch twins that give the same final rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Batch: each key's first appearance."""
    return events.groupBy(key).agg(F.min(ts).alias("first_seen"))


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def seen_stream(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Stream: each key once, within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums in windows of time, for a stream (with `late`) or a table."""
    e = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def outcome_state(attempts: DataFrame, by: str, order: str, outcome: str = "outcome", success: str = "success", trouble: str = "cloudflare_challenge", streak: int = 2) -> DataFrame:
    """(by, attempts, successes, consecutive, needs_headed): troubles since the last success; other failures don't reset them."""
    w = Window.partitionBy(by).orderBy(order)
    a = attempts.withColumn("__run", F.sum((F.col(outcome) == success).cast("int")).over(w))
    last = F.max("__run").over(Window.partitionBy(by))
    a = a.withColumn("__last", last)
    return a.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if(F.col(outcome) == success).alias("successes"), F.count_if((F.col("__run") == F.col("__last")) & (F.col(outcome) == trouble)).alias("consecutive")).withColumn("needs_headed", F.col("consecutive") >= streak)


def skipped(attempts: DataFrame, key: str, order: str, outcome: str = "outcome", success: str = "success", permanent: tuple[str, ...] = ("publisher_no_access", "paywall_unauth")) -> DataFrame:
    """(key, permanent_outcome) of keys with a permanent failure after their last success."""
    mark = F.struct(F.col(order), F.col(outcome))
    a = attempts.groupBy(key).agg(F.max(F.when(F.col(outcome) == success, F.col(order))).alias("ok"), F.max(F.when(F.col(outcome).isin(*permanent), mark)).alias("bad"))
    return a.where(F.col("bad").isNotNull() & (F.col("ok").isNull() | (F.col(f"bad.{order}") > F.col("ok")))).select(key, F.col(f"bad.{outcome}").alias("permanent_outcome"))


def outcome_stream(attempts: DataFrame, by: str, outcome: str = "outcome", success: str = "success", trouble: str = "cloudflare_challenge", streak: int = 2) -> DataFrame:
    """Stream: the state after each micro-batch, in update mode. Rows of a key within a batch come in the order of `order` only if the source keeps it."""
    import pandas as pd

    def update(key, frames, state):
        n, ok, run = state.get if state.exists else (0, 0, 0)
        for pdf in frames:
            for o in pdf[outcome]:
                n += 1
                ok, run = (ok + 1, 0) if o == success else (ok, run + (o == trouble))
        state.update((n, ok, run))
        yield pd.DataFrame([(*key, n, ok, run, run >= streak)], columns=[by, "attempts", "successes", "consecutive", "needs_headed"])

    kind = attempts.schema[by].dataType.simpleString()
    return attempts.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, attempts long, successes long, consecutive long, needs_headed boolean", "n long, ok long, run long", "update", "NoTimeout")
