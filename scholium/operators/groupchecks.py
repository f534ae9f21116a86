"""Checks of reported statistics over groups of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import special
from scholium.functions.checks import decimals, grim
from scholium.operators.numbering import number_rows
from scholium.runtime import small_join


def grim_column(df: DataFrame, by: list[str], mean: str, n: str, scale: float = 1.0) -> DataFrame:
    """GRIM with the precision that is the largest printed in each column of a table (`by`)."""
    dp = F.max(decimals(F.col(mean))).over(Window.partitionBy(*by))
    return df.withColumn("column_dp", dp).withColumn("grim", grim(F.col(mean), F.col(n), scale, F.col("column_dp")))


def anova(df: DataFrame, by: list[str], mean: str, sd: str, n: str) -> DataFrame:
    """One-way F of groups' means, SDs and sizes. Null without two groups or variance; a negative SD gives null too, with `impossible`."""
    m, s, k = F.col(mean), F.col(sd), F.col(n)
    a = df.groupBy(*by).agg(F.count("*").alias("groups"), F.sum(k).alias("total"), F.sum(m * k).alias("__mn"), F.sum(m * m * k).alias("__mmn"), F.sum((k - 1) * s * s).alias("__w"), F.coalesce(F.max(s < 0), F.lit(False)).alias("impossible"))
    between = (F.col("__mmn") - F.col("__mn") * F.col("__mn") / F.col("total")) / (F.col("groups") - 1)
    within = F.col("__w") / (F.col("total") - F.col("groups"))
    a = a.withColumn("f", F.when((F.col("groups") > 1) & ~F.col("impossible") & (F.col("total") > F.col("groups")) & (within > 0), between / within))
    return a.withColumn("p", special.f_tail(F.col("f"), (F.col("groups") - 1).cast("double"), (F.col("total") - F.col("groups")).cast("double"))).drop("__mn", "__mmn", "__w")


def chi_squared(df: DataFrame, by: list[str], row: str, col: str, count: str) -> DataFrame:
    """Pearson's statistic of each table, and Yates's for two by two. A table with an empty row or column gives null."""
    cells = df.groupBy(*by, row, col).agg(F.sum(count).cast("double").alias("o"))
    r = cells.groupBy(*by, row).agg(F.sum("o").alias("r"))
    c = cells.groupBy(*by, col).agg(F.sum("o").alias("c"))
    t = r.groupBy(*by).agg(F.sum("r").alias("t"), F.count("*").alias("rows"), F.min("r").alias("r0"))
    t2 = c.groupBy(*by).agg(F.count("*").alias("cols"), F.min("c").alias("c0"))
    # every cell of the grid counts, those without rows as zero
    cross = (lambda a, b: a.join(b, by)) if by else (lambda a, b: a.crossJoin(b))
    grid = cross(r, c)
    grid = grid.join(cells, [*by, row, col], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    grid = cross(cross(grid, t), t2)
    e = F.col("r") * F.col("c") / F.col("t")
    dev = F.abs(F.col("o") - e)
    out = grid.groupBy(*by, "rows", "cols", "t", "r0", "c0").agg(F.sum(dev * dev / F.when(e > 0, e)).alias("chi2"), F.sum(F.pow(F.greatest(dev - 0.5, F.lit(0.0)), 2) / F.when(e > 0, e)).alias("yates"))
    ok = (F.col("r0") > 0) & (F.col("c0") > 0)
    df_ = (F.col("rows") - 1) * (F.col("cols") - 1)
    out = out.select(*by, F.col("t").alias("total"), df_.alias("df"), F.when(ok, F.col("chi2")).alias("chi2"), F.when(ok & (F.col("rows") == 2) & (F.col("cols") == 2), F.col("yates")).alias("chi2_yates"))
    return out.withColumn("p", special.chi2_tail(F.col("chi2"), F.col("df").cast("double")))


def variance_ratio(df: DataFrame, by: list[str], sd: str, n: str, label: str) -> DataFrame:
    """Largest over smallest variance of the groups, with its two-tailed p; similar if suspiciously near 1. Of equal SDs, the largest, or smallest, n and label count."""
    key = F.when(F.col(sd).isNotNull(), F.struct(F.col(sd), F.col(n), F.col(label)))
    a = df.groupBy(*by).agg(F.max(key).alias("hi"), F.min(key).alias("lo"), F.sum(n).alias("total"), F.count("*").alias("groups"))
    f = F.when((F.col("groups") > 1) & (F.col(f"lo.{sd}") > 0), F.pow(F.col(f"hi.{sd}"), 2) / F.pow(F.col(f"lo.{sd}"), 2))
    a = a.withColumn("f_ratio", f)
    a = a.withColumn("p", 2 * special.f_tail(F.col("f_ratio"), (F.col(f"hi.{n}") - 1).cast("double"), (F.col(f"lo.{n}") - 1).cast("double")))
    similar = (F.col("f_ratio") < 1.05) & (F.col("total") < 100) & (F.col("groups") >= 3)
    return a.select(*by, "f_ratio", "p", F.col(f"hi.{label}").alias("max_group"), F.col(f"lo.{label}").alias("min_group"), similar.alias("similar"), (F.col(f"lo.{sd}") == 0).alias("zero_sd"))


def frozen_sds(df: DataFrame, series: list[str], sd: str, by: list[str] | None = None) -> DataFrame:
    """How many series of at least two SDs never change; suspicious if more than half or at least five."""
    by = by or []
    s = df.groupBy(*series).agg(((F.count(sd) >= 2) & (F.count_distinct(sd) == 1)).cast("int").alias("frozen"))
    a = s.groupBy(*by).agg(F.sum("frozen").alias("n_frozen"), F.count("*").alias("n_total"))
    frac = F.try_divide(F.col("n_frozen"), F.col("n_total"))
    return a.withColumn("frozen_fraction", frac).withColumn("suspicious", (frac > 0.5) | (F.col("n_frozen") >= 5))


def first_digits(df: DataFrame, value: str) -> DataFrame:
    """(digit, n, expected) from 1 to 9 of the values that aren't zero, against Benford's law."""
    v = F.abs(F.col(value).cast("double"))
    power = F.floor(F.log10(v))
    d = F.floor(v / F.pow(F.lit(10.0), power) + 1e-12).cast("int")
    d = F.when(d >= 10, 1).when(d < 1, 9).otherwise(d)
    c = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(d.alias("digit")).agg(F.count("*").alias("n"))
    digits = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    out = digits.join(F.broadcast(c), "digit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("expected", F.log10(1 + F.lit(1.0) / F.col("digit")) * F.sum("n").over(Window.partitionBy()))  # nine rows


def benford(df: DataFrame, value: str, least: int = 50) -> DataFrame:
    """Chi-squared of the first digits, and whether they conform; null below `least` values."""
    a = first_digits(df, value).agg(F.sum("n").alias("n"), F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.when(F.col("expected") > 0, F.col("expected"))).alias("chi2"))
    a = a.withColumn("chi2", F.when(F.col("n") >= least, F.col("chi2")))
    return a.withColumn("p", special.chi2_tail(F.col("chi2"), F.when(F.col("chi2").isNotNull(), 8.0))).withColumn("conforms", F.col("p") > 0.05)


def carlisle(df: DataFrame, by: str, p: str, kind: str | None = None) -> DataFrame:
    """Stouffer's combination of baseline p-values of each study, for each kind of variable and combined; needs three. A p of 0 or 1 gives null."""
    cols = [F.col(by).cast("string").alias("study"), F.col(p).cast("double").alias("p"), (F.col(kind) if kind else F.lit("all")).alias("kind")]
    rows = df.select(*cols).where("p IS NOT NULL")
    both = rows.unionByName(rows.withColumn("kind", F.lit("combined"))) if kind else rows

    # places by p within a study and kind, over ranges, so that no task holds a study
    placed = number_rows(both, ["p"], ["study", "kind"], number="i")
    size = both.groupBy("study", "kind").agg(F.count("*").alias("k"))
    n = F.col("k").cast("double")
    gap = F.greatest((F.col("i") + 1) / n - F.col("p"), F.col("p") - F.col("i") / n)

    @F.pandas_udf("double")
    def deviate(x: pd.Series) -> pd.Series:
        return pd.Series(special.normal_ppf(1 - np.clip(x.to_numpy(), 1e-300, 1 - 1e-16)))

    @F.pandas_udf("double")
    def ks(d: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else special.ks_tail(a, int(b)) for a, b in zip(d, k)], dtype=float)

    placed = small_join(placed.withColumn("s", deviate(F.col("p"))), size, ["study", "kind"])
    at = F.col("i") == F.floor(F.col("k") / 2)
    a = placed.groupBy("study", "kind").agg(F.max("k").cast("int").alias("k"), F.sum("s").alias("s"), F.max(gap).alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean_p"), F.max(F.when(at, F.col("p"))).alias("median_p"))
    ok = (F.col("k") >= 3) & (F.col("lo") > 0) & (F.col("hi") < 1)
    a = a.withColumn("z", F.when(ok, F.col("s") / F.sqrt("k"))).withColumn("d", F.when(ok, F.col("d")))
    return a.select("study", "kind", "k", "z", (2 * special.normal_tail(F.abs("z"))).alias("p_combined"), F.when(F.col("d").isNotNull(), ks(F.col("d"), F.col("k"))).alias("ks_p"), "mean_p", "median_p")
