"""Queries of statistical checks over numeric tables; printed numbers are made from the tables' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import checks
from scholium.operators import extract, groupchecks, summaries
from scholium.plans.registry import query, table


def _groups(spark: SparkSession, d: str, *by: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(*by).agg(F.round(F.avg(q), 2).alias("mean"), F.round(F.stddev_samp(q), 3).alias("sd"), F.count("*").alias("n"), F.min(q).alias("lo"), F.max(q).alias("hi"))


_G = "g AS (SELECT {by}, round(avg(l_quantity), 2) AS mean, round(stddev_samp(l_quantity), 3) AS sd, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY {by})"
_ORDERS = _G.format(by="l_orderkey")
_DP = "CASE WHEN instr({s}, '.') > 0 THEN length(split_part({s}, '.', 2)) ELSE 0 END"


@query(
    "grim",
    f"""WITH {_ORDERS}, p AS (SELECT l_orderkey, n, printf('%.2f', mean) AS s, mean AS m FROM g)
    SELECT l_orderkey, least(abs(floor(m * n) / n - m), abs(ceil(m * n) / n - m)) <= 0.005 + 1e-9 AS possible FROM p""",
)
def grim(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "l_orderkey")
    return g.select("l_orderkey", checks.grim(F.format_string("%.2f", "mean"), F.col("n"))["possible"].alias("possible"))


@query("grim_percentage", "WITH s AS (SELECT o_custkey, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS pct FROM orders GROUP BY o_custkey) SELECT o_custkey, abs(pct / 100.0::DOUBLE * n - round_even(pct / 100.0::DOUBLE * n, 0)) <= 0.5::DOUBLE * 0.1::DOUBLE / 100.0::DOUBLE * n AS possible FROM s")
def grim_percentage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    pct = F.round(100.0 * F.col("k") / F.col("n"), 1)
    return s.select("o_custkey", checks.grim_percentage(pct, F.col("n"), 1)["possible"].alias("possible"))


@query(
    "quick_sd",
    f"""WITH {_ORDERS} SELECT l_orderkey, sd > (hi - lo) * CASE WHEN n >= 2 THEN sqrt(floor(n / 2) * (n - floor(n / 2)) / (n * (n - 1.0::DOUBLE))) ELSE 0.5 END + 1e-9 AS impossible,
    sd > (hi - lo) / sqrt(12.0::DOUBLE) * 1.5 AS wide FROM g""",
)
def quick_sd(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "l_orderkey").withColumn("c", checks.quick_sd(F.col("sd"), F.col("n"), F.col("lo"), F.col("hi")))
    return g.select("l_orderkey", F.col("c.impossible").alias("impossible"), F.col("c.wide").alias("wide"))


@query("sd_se", f"WITH {_ORDERS} SELECT l_orderkey, sd > hi - lo AS exceeds_range, n > 10 AND sd < (hi - lo) * 0.05::DOUBLE AS may_be_se FROM g")
def sd_se(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "l_orderkey").withColumn("c", checks.sd_se_confusion(F.col("sd"), F.col("n"), F.col("lo"), F.col("hi")))
    return g.select("l_orderkey", F.col("c.exceeds_range").alias("exceeds_range"), F.col("c.may_be_se").alias("may_be_se"))


@query("change_arithmetic", "SELECT l_orderkey, l_linenumber, abs(round_even((l_extendedprice - l_discount) - l_extendedprice, 4) + l_tax) <= 0.05::DOUBLE AS consistent FROM lineitem")
def change_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", checks.change_arithmetic(e, e - F.col("l_discount"), -F.col("l_tax"), 0.05)["consistent"].alias("consistent"))


_CB = """WITH t AS (SELECT l_suppkey, printf('%.1f', stddev_samp(l_quantity)) AS a, printf('%.1f', stddev_samp(l_tax * 100)) AS b, printf('%.1f', stddev_samp(l_discount * 500)) AS c FROM lineitem GROUP BY l_suppkey),
    v AS (SELECT *, a::DOUBLE AS x, b::DOUBLE AS y, c::DOUBLE AS z FROM t WHERE a IS NOT NULL),
    w AS (SELECT *, greatest(0, x - .05) AS x0, x + .05::DOUBLE AS x1, greatest(0, y - .05) AS y0, y + .05::DOUBLE AS y1, greatest(0, z - .05) AS z0, z + .05::DOUBLE AS z1 FROM v)
    SELECT l_suppkey, CASE WHEN x < 0 OR y < 0 OR z < 0 THEN false WHEN x * y <> 0 THEN z1 >= greatest(x0 - y1, y0 - x1, 0) - 1e-9 AND z0 <= x1 + y1 + 1e-9 END AS possible FROM w"""


@query("correlation_bound", _CB)
def correlation_bound(spark: SparkSession, d: str) -> DataFrame:
    f = lambda c, k: F.format_string("%.1f", F.stddev_samp(F.col(c) * k))
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(f("l_quantity", 1).alias("a"), f("l_tax", 100).alias("b"), f("l_discount", 500).alias("c"), F.stddev_samp("l_quantity").alias("ok"))
    return t.where("ok IS NOT NULL").select("l_suppkey", checks.correlation_bound(F.col("a"), F.col("b"), F.col("c"))["possible"].alias("possible"))


_ANOVA = f"""WITH {_G.format(by='l_returnflag, l_linestatus')}, a AS (SELECT l_returnflag, count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, sum(mean * n) AS mn, sum(mean * mean * n) AS mmn, sum((n - 1) * sd * sd) AS w FROM g GROUP BY l_returnflag)
    SELECT l_returnflag, groups, total, round(CASE WHEN groups > 1 AND total > groups AND w > 0 THEN ((mmn - mn * mn / total) / (groups - 1)) / (w / (total - groups)) END, 4) AS f FROM a"""


@query("anova", _ANOVA)
def anova(spark: SparkSession, d: str) -> DataFrame:
    a = groupchecks.anova(_groups(spark, d, "l_returnflag", "l_linestatus"), ["l_returnflag"], "mean", "sd", "n")
    return a.select("l_returnflag", "groups", "total", F.round("f", 4).alias("f"))


_CHI = """WITH o AS (SELECT l_shipmode2 AS r, l_linenumber AS c, count(*)::DOUBLE AS o FROM (SELECT l_returnflag AS l_shipmode2, l_linenumber FROM lineitem) GROUP BY ALL),
    r AS (SELECT r, sum(o) AS r_n FROM o GROUP BY r), c AS (SELECT c, sum(o) AS c_n FROM o GROUP BY c), t AS (SELECT sum(o) AS t FROM o),
    x AS (SELECT coalesce(o, 0) AS o, r_n * c_n / t AS e FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.r = r.r AND o.c = c.c)
    SELECT (SELECT t FROM t) AS total, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS df, round(sum((o - e) * (o - e) / e), 6) AS chi2 FROM x"""


@query("chi_squared", _CHI)
def chi_squared(spark: SparkSession, d: str) -> DataFrame:
    x = groupchecks.chi_squared(table(spark, d, "lineitem").withColumn("k", F.lit(1)), [], "l_returnflag", "l_linenumber", "k")
    return x.select("total", "df", F.round("chi2", 6).alias("chi2"))


@query("variance_ratio", f"WITH {_G.format(by='l_linenumber')}, h AS (SELECT *, row_number() OVER (ORDER BY sd DESC, n DESC, l_linenumber DESC) AS a, row_number() OVER (ORDER BY sd, n, l_linenumber) AS b FROM g) SELECT round((SELECT sd * sd FROM h WHERE a = 1) / (SELECT sd * sd FROM h WHERE b = 1), 6) AS f_ratio, (SELECT l_linenumber FROM h WHERE a = 1) AS max_group, (SELECT l_linenumber FROM h WHERE b = 1) AS min_group")
def variance_ratio(spark: SparkSession, d: str) -> DataFrame:
    v = groupchecks.variance_ratio(_groups(spark, d, "l_linenumber"), [], "sd", "n", "l_linenumber")
    return v.select(F.round("f_ratio", 6).alias("f_ratio"), "max_group", "min_group")


@query("frozen_sds", "WITH s AS (SELECT l_suppkey, (count(l_tax) >= 2 AND count(DISTINCT l_tax) = 1)::INT AS frozen FROM lineitem GROUP BY l_suppkey) SELECT CAST(sum(frozen) AS BIGINT) AS n_frozen, count(*) AS n_total FROM s")
def frozen_sds(spark: SparkSession, d: str) -> DataFrame:
    return groupchecks.frozen_sds(table(spark, d, "lineitem"), ["l_suppkey"], "l_tax").select("n_frozen", "n_total")


@query("benford_digits", "WITH v AS (SELECT CAST(substring(printf('%e', abs(value)), 1, 1) AS INTEGER) AS digit FROM events WHERE value <> 0) SELECT r.range::INTEGER AS digit, count(v.digit) AS n FROM range(1, 10) r LEFT JOIN v ON v.digit = r.range GROUP BY r.range")
def benford_digits(spark: SparkSession, d: str) -> DataFrame:
    return groupchecks.first_digits(table(spark, d, "events"), "value").select("digit", "n")


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    p = F.round((F.col("l_extendedprice") % 100) / 1000, 3)
    op = F.when(F.col("l_linenumber") % 3 == 0, "<").when(F.col("l_linenumber") % 3 == 1, "=").otherwise("≤")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), p.alias("p_reported"), F.format_string("%.3f", p).alias("p_str"), op.alias("op"))


_PV = "pv AS (SELECT l_orderkey AS pmid, round((l_extendedprice % 100) / 1000, 3) AS p, CASE l_linenumber % 3 WHEN 0 THEN '<' WHEN 1 THEN '=' ELSE '≤' END AS op FROM lineitem)"


@query("p_curve", f"WITH {_PV}, s AS (SELECT * FROM pv WHERE p < 0.05 AND op IN ('=', '<')) SELECT count(*) AS n_significant, " + ", ".join(f"count(*) FILTER (p >= {i / 100} AND p < {(i + 1) / 100}) AS bin_{i + 1:02d}" for i in range(5)) + ", count(*) FILTER (p < 0.025) AS n_low, count(*) FILTER (p >= 0.025) AS n_high, count(*) FILTER (p >= 0.04)::DOUBLE / nullif(count(*) FILTER (p >= 0.01 AND p < 0.02), 0) AS hacking_ratio FROM s")
def p_curve(spark: SparkSession, d: str) -> DataFrame:
    return summaries.p_curve(_pvalues(spark, d))


@query("last_digits", f"WITH {_PV} SELECT r.range::INTEGER AS digit, count(pv.p) AS n FROM range(10) r LEFT JOIN pv ON pv.op = '=' AND right(printf('%.3f', pv.p), 1)::INT = r.range GROUP BY r.range")
def last_digits(spark: SparkSession, d: str) -> DataFrame:
    return summaries.last_digits(_pvalues(spark, d))


def _prose(spark: SparkSession, d: str) -> DataFrame:
    """Reports made of line items: a t test, a mean with its SD, a cohort and a ratio each."""
    li = table(spark, d, "lineitem")
    q, t = F.col("l_quantity"), F.round(F.col("l_extendedprice") % 4 + 0.1, 2)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pmid"),
        F.format_string("n = %d patients\nThe score was %.2f (%.2f) overall.\nt(%d) = %.2f, p = %.3f. HR 1.%02d (95%% CI 0.%02d-2.%02d). It was not significant.", q.cast("int") + 10, F.col("l_tax") * 100 + 1, F.col("l_discount") * 20 + 0.5, q.cast("int") + 3, t, F.round((q % 40) / 400 + 0.001, 3), F.col("l_linenumber") * 7, q.cast("int") + 40, F.col("l_linenumber") * 9).alias("text"),
    )


@query("scan_pvalues", "SELECT l_orderkey || '-' || l_linenumber AS pmid, round((l_quantity % 40) / 400 + 0.001, 3) AS p_reported, '=' AS op, 't' AS test_type, printf('%.3f', round((l_quantity % 40) / 400 + 0.001, 3)) AS p_str FROM lineitem")
def scan_pvalues(spark: SparkSession, d: str) -> DataFrame:
    return extract.pvalues(_prose(spark, d)).select("pmid", "p_reported", "op", "test_type", "p_str")


@query("scan_triples", "SELECT round(l_tax * 100 + 1, 2) AS mean, round(l_discount * 20 + 0.5, 2) AS sd, CAST(l_quantity AS INTEGER) + 10 AS n_used, 2 AS decimals, count(*) AS n FROM lineitem GROUP BY ALL")
def scan_triples(spark: SparkSession, d: str) -> DataFrame:
    return extract.triples(_prose(spark, d)).groupBy("mean", "sd", "n_used", "decimals").agg(F.count("*").alias("n"))


_SAL = """p AS (SELECT user_id AS pmid, count(*) % 9 AS cohort_size, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY user_id), k AS (SELECT cohort_size FROM p GROUP BY 1 HAVING count(*) >= 3)"""


@query("salami", f"WITH {_SAL} SELECT x.pmid AS pmid_a, y.pmid AS pmid_b, x.cohort_size, len(list_intersect(x.a, y.a)) AS n_shared FROM p x JOIN p y ON x.cohort_size = y.cohort_size AND x.pmid < y.pmid JOIN k ON k.cohort_size = x.cohort_size WHERE len(list_intersect(x.a, y.a)) >= 3")
def salami(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("pmid")).agg((F.count("*") % 9).alias("cohort_size"), F.collect_set("event_type").alias("authors"))
    return summaries.salami(p).select("pmid_a", "pmid_b", "cohort_size", "n_shared")
