"""Statistical checks on known cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from scholium.functions import checks, special
from scholium.operators import extract, groupchecks


def one(spark, rows, schema, col):
    return [r["c"] for r in spark.createDataFrame(rows, schema).select(col.alias("c")).collect()]


def test_tails():
    assert abs(float(special.t_sf(2.0, 10)) - 0.03669401738537018) < 1e-12
    assert abs(float(special.chi2_sf(3.841458820694124, 1)) - 0.05) < 1e-12
    assert abs(float(special.f_sf(3.5, 2, 20)) - 0.04973502207609712) < 1e-10
    assert abs(special.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-8
    assert abs(special.binomial_sf(15, 20) - 0.020694732666015625) < 1e-12
    d, p = special.ks_uniform_p(np.array([0.1, 0.2, 0.35, 0.7, 0.9]))
    assert abs(d - 0.25) < 1e-12 and 0.8 < p < 0.9


def test_grim(spark):
    out = one(spark, [("18.72", 22), ("26.90", 10), ("3.5", 0), (None, 5), ("bad", 5)], "m string, n int", checks.grim(F.col("m"), F.col("n"))["possible"])
    assert out == [False, True, None, None, None]


def test_grimmer_and_sprite(spark):
    rows = [("4.57", "2.00", 7), ("4.43", "1.51", 7), ("3.0", "-1.0", 5), (None, "1.0", 5), ("3.0", "1.0", 1)]
    assert one(spark, rows, "m string, s string, n int", checks.grimmer(F.col("m"), F.col("s"), F.col("n"))["possible"]) == [False, True, False, None, None]
    assert one(spark, [("3.5", "1.2", 10)], "m string, s string, n int", checks.sprite(F.col("m"), F.col("s"), F.col("n"), F.lit(1), F.lit(7))["possible"]) == [True]


def test_correlation_bound(spark):
    rows = [("0.10", "0.30", "0.05"), ("1.0", "1.0", "1.0"), ("0", "1.0", "1.0"), ("-1", "1", "1")]
    assert one(spark, rows, "a string, b string, c string", checks.correlation_bound(F.col("a"), F.col("b"), F.col("c"))["possible"]) == [False, True, None, False]


def test_verdicts(spark):
    rows = [(True, "PASS"), (False, "FLAG: soft"), (False, "FAIL: hard"), (False, ""), (None, "")]
    assert one(spark, rows, "o boolean, d string", checks.verdict("possible", F.col("o"), F.col("d"))) == ["PASS", "FLAG", "FAIL", "FAIL", "UNDETERMINED"]
    assert one(spark, [([],), (["x"],), (["IMPOSSIBLE x"],)], "f array<string>", checks.verdict("flags", F.col("f"))) == ["PASS", "FLAG", "FAIL"]


def test_t_tests(spark):
    d = spark.createDataFrame([(5.0, 10.0, 25, 0.02), (5.0, 0.0, 25, 0.02), (5.0, -1.0, 25, 0.02)], "m double, s double, n int, p double")
    got = d.select(checks.t_paired(F.col("m"), F.col("s"), F.col("n"), F.col("p")).alias("c")).collect()
    assert [r.c.plausible for r in got] == [True, None, False]
    assert abs(got[0].c.t - 2.5) < 1e-12


def test_reported_tests(spark):
    texts = ["t(28) = 2.20, p = .04.", "t(28) = 2.20, p = .36", "r(10) = 1.20, p < .05", "F(2, 20) = 3.50, p = .050", "z = 1.96, p = .05; chi2(1) = 3.84, p = .05", "t(0) = 1.0, p = .5", "z = 1.2, p = 1.5", None, ""]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "pmid string, text string")
    got = {(r.pmid, r.stat): r.verdict for r in extract.reported_tests(d).collect()}
    assert got == {("0", "t"): "PASS", ("1", "t"): "FAIL", ("2", "r"): "FAIL", ("3", "F"): "PASS", ("4", "z"): "PASS", ("4", "chi2"): "PASS", ("5", "t"): "FAIL", ("6", "z"): "UNDETERMINED"}


def test_pvalues(spark):
    d = spark.createDataFrame([("a", "We saw t(20) = 2.10 and p = 0.040, but p ≤ .5 later. p = 0"), ("b", None)], "pmid string, text string")
    rows = extract.pvalues(d).orderBy("p_reported").collect()
    assert [(r.p_str, r.op, r.test_type) for r in rows] == [("0.040", "=", "t"), (".5", "≤", "t")]


def test_carlisle_needs_three(spark):
    d = spark.createDataFrame([("s", 0.2), ("s", 0.4), ("u", 0.1), ("u", 0.5), ("u", 0.9)], "study string, p double")
    got = {r.study: r.z for r in groupchecks.carlisle(d, "study", "p").collect()}
    assert got["s"] is None and math.isclose(got["u"], 0.0, abs_tol=1e-6)


def test_sample_size(spark):
    d = spark.createDataFrame([(2.0, "0.055", 30), (2.0, "0.5", 30), (2.0, "0.05", 1)], "t double, p string, n int")
    assert [r.c.plausible for r in d.select(checks.sample_size_from_t(F.col("t"), F.col("p"), F.col("n")).alias("c")).collect()] == [True, False, None]


def test_sample_sizes_and_checks_of_nothing(spark):
    d = spark.createDataFrame([(2.0, "0.18", 3), (2.0, "0.05", 61), (0.0, "1.0", 5), (2.0, None, 3), (3.0, "0.9", 4)], "t double, p string, n int")
    got = [tuple(r.c) for r in d.select(checks.sample_size_from_t(F.col("t"), F.col("p"), F.col("n")).alias("c")).collect()]
    assert got[0][0] is True and got[0][2] == got[0][3] == 3 and got[1][0] is True and got[1][2] <= 61 <= got[1][3]
    assert got[2][0] is True and got[3] == (None, None, None, None) and got[4][0] is False and got[4][2] is None
    none = spark.createDataFrame([(n, s) for n in (None, 0, 1, 2) for s in (None, -1.0, 0.0, 1.0)], "n int, s double")
    n, s, x = F.col("n"), F.col("s"), F.lit(1.0)
    every = [checks.grim(F.lit("1.5"), n), checks.grim_percentage(x, n), checks.quick_sd(s, n, x, x + 1), checks.sd_se_confusion(s, n, x, x + 1), checks.t_paired(x, s, n, x), checks.t_welch(x, s, n, x, s, n, x), checks.effect_size(x, s, n, x, s, n, x, x, x, x), checks.grimmer(F.lit("1.5"), s.cast("string"), n), checks.sample_size_from_t(s, F.lit("0.5"), n), checks.chi2_cells(F.array(F.array(s, s), F.array(s, x))), checks.anova_groups(F.array(F.struct(n.alias("n"), x.alias("mean"), s.alias("sd")), F.struct(n.alias("n"), x.alias("mean"), s.alias("sd"))))]
    assert none.select(*[c.alias(f"c{i}") for i, c in enumerate(every)]).count() == 16 and len(none.select(*[c.alias(f"c{i}") for i, c in enumerate(every)]).collect()) == 16
