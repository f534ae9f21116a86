"""Consecutive numbers and running totals over rows too many for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.runtime import cut


def number_rows(df: DataFrame, order: list[str], group: list[str] | None = None, number: str = "number", total_of: str | None = None, total: str = "total_before") -> DataFrame:
    """Adds `number`: each row's place from 0 within its group by `order`; with `total_of`, also the sum of that column over the rows before it.

    Rows are range-partitioned by group and order, and by their present place, so that neither a hot group nor
    equal rows fall to one task. Only one row for each task and group is kept in common: it holds the group's count there.
    Ties are numbered in an arbitrary order. Nulls sort first; a null `total_of` counts 0. No rows give no rows.
    """
    group = group or []
    # range partitioning reads its input twice, once to sample it, so it gets a written table
    base = cut(df.withColumn("__tie", F.monotonically_increasing_id()), "unnumbered")
    keys = [*group, *order, "__tie"]
    placed = base.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    placed = placed.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__at"))
    placed = cut(placed.drop("__tie"), "numbered")
    aggs = [F.count("*").alias("__n"), F.min("__at").alias("__first")]
    if total_of:
        aggs.append(F.sum(F.coalesce(F.col(total_of).cast("long"), F.lit(0))).alias("__sum"))
    parts = placed.groupBy(*group, "__part").agg(*aggs)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as tasks and groups together; groups number far fewer than rows, or this gains nothing
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total_of:
        parts = parts.withColumn("__sum_before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    gk = [f"__g{i}" for i in range(len(group))]
    parts = parts.select(*[F.col(g).alias(k) for g, k in zip(group, gk)], F.col("__part").alias("__p"), "__first", "__before", *(["__sum_before"] if total_of else []))
    cond = F.col("__part") == F.col("__p")
    for g, k in zip(group, gk):
        cond = cond & F.col(g).eqNullSafe(F.col(k))
    out = placed.join(parts, cond).withColumn(number, F.col("__at") - F.col("__first") + F.col("__before"))
    if total_of:
        within = Window.partitionBy(*group, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        run = F.coalesce(F.sum(F.coalesce(F.col(total_of).cast("long"), F.lit(0))).over(within), F.lit(0))
        out = out.withColumn(total, run + F.col("__sum_before"))
    return out.drop("__part", "__at", "__p", "__first", "__before", "__sum_before", *gk)
