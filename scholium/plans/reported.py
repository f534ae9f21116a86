"""Queries that recompute reported statistics. Degrees of freedom are such that the tails have closed forms, which SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import checks
from scholium.operators import battery, extract, groupchecks, scan, summaries
from scholium.plans.registry import query, table

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
_T2 = "(1 - abs({t}) / sqrt(2 + {t} * {t}))"  # two-tailed p of t with two degrees of freedom
_AGREES = "(greatest({a}, 1e-20) / greatest({b}, 1e-20) > 0.1::DOUBLE AND greatest({a}, 1e-20) / greatest({b}, 1e-20) < 10)"


def _line(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (q / 10).alias("m1"), (q % 7 / 2 + 1).alias("m2"), (n * 0.5 + 0.5).alias("s"), (F.col("l_tax") * 10 + 0.001).alias("p"), q.alias("q"), n.alias("n"))


_L = "l AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS m1, l_quantity % 7 / 2 + 1 AS m2, l_linenumber * 0.5::DOUBLE + 0.5::DOUBLE AS s, l_tax * 10 + 0.001::DOUBLE AS p, l_quantity AS q, l_linenumber AS n FROM lineitem)"


@query("t_paired", f"WITH {_L}, t AS (SELECT *, m1 / (s / sqrt(3.0::DOUBLE)) AS t FROM l) SELECT l_orderkey, l_linenumber, CASE n % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE {_AGREES.format(a=_T2.format(t='t'), b='p')} END AS plausible, CASE WHEN n % 4 > 1 THEN round({_T2.format(t='t')}, 6) END AS p FROM t")
def t_paired(spark: SparkSession, d: str) -> DataFrame:
    """Of three; every fourth with a negative SD, and every fourth of one alone, or none."""
    n = F.col("n") % 4
    c = checks.t_paired(F.col("m1"), F.when(n == 0, -F.col("s")).otherwise(F.col("s")), F.when(n == 1, (F.col("q") % 2).cast("int")).otherwise(3), F.col("p"))
    return _line(spark, d).select("l_orderkey", "l_linenumber", c["plausible"].alias("plausible"), F.round(c["p"], 6).alias("p"))


@query("welch", f"WITH {_L}, t AS (SELECT *, (m1 - m2) / s AS t FROM l) SELECT l_orderkey, l_linenumber, CASE n % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE {_AGREES.format(a=_T2.format(t='t'), b='p')} END AS plausible, CASE WHEN n % 4 > 1 THEN round(t, 6) END AS t, CASE WHEN n % 4 > 1 THEN 2.0::DOUBLE END AS df, CASE WHEN n % 4 > 1 THEN round({_T2.format(t='t')}, 6) END AS p FROM t")
def welch(spark: SparkSession, d: str) -> DataFrame:
    """Two against two with one SD: two degrees of freedom."""
    n = F.col("n") % 4
    s = F.when(n == 0, -F.col("s")).when(n == 1, 0.0).otherwise(F.col("s"))
    two = F.lit(2)
    c = checks.t_welch(F.col("m1"), s, two, F.col("m2"), s, two, F.col("p"))
    return _line(spark, d).select("l_orderkey", "l_linenumber", c["plausible"].alias("plausible"), F.round(c["t"], 6).alias("t"), F.round(c["df"], 6).alias("df"), F.round(c["p"], 6).alias("p"))


@query("sample_size", f"WITH {_L}, t AS (SELECT *, m1 + 1 AS t, round(p, 3) AS r FROM l) SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN NULL ELSE abs({_T2.format(t='t')} - r) <= 0.0005::DOUBLE + 1e-12::DOUBLE END AS plausible, CASE WHEN n = 1 THEN NULL ELSE round({_T2.format(t='t')}, 6) END AS p_at_n FROM t")
def sample_size(spark: SparkSession, d: str) -> DataFrame:
    x = _line(spark, d)
    c = checks.sample_size_from_t(F.col("m1") + 1, F.format_string("%.3f", F.round("p", 3)), F.when(F.col("n") == 1, 1).otherwise(3))
    return x.withColumn("c", c).select("l_orderkey", "l_linenumber", F.col("c.plausible").alias("plausible"), F.round("c.p_at_n", 6).alias("p_at_n"))


@query(
    "effect_size",
    f"""WITH {_L}, t AS (SELECT *, (m1 - m2) / s AS t FROM l), c AS (SELECT *, abs(t - round(t + q % 3 / 10 - 0.05, 2)) > 0.1::DOUBLE AS d_off, NOT {_AGREES.format(a=_T2.format(t='t'), b='p')} AS p_off, 4.302652729749464::DOUBLE * s AS half FROM t)
    SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN NULL ELSE NOT (d_off OR (n % 2 = 0 AND p_off) OR q % 5 = 0) END AS consistent, CASE WHEN n > 1 THEN round(t, 6) END AS d, CASE WHEN n > 1 THEN round(m1 - m2 - half, 4) END AS ci_low FROM c""",
)
def effect_size(spark: SparkSession, d: str) -> DataFrame:
    """Reported d's, p's of every other, and intervals of which every fifth is off; groups of one can't be tested."""
    x = _line(spark, d).withColumn("t", (F.col("m1") - F.col("m2")) / F.col("s"))
    two, s = F.when(F.col("n") == 1, 1).otherwise(2), F.col("s")
    half = 4.302652729749464 * s
    rep_d = F.round(F.col("t") + F.col("q") % 3 / 10 - 0.05, 2)
    c = checks.effect_size(F.col("m1"), s, two, F.col("m2"), s, two, rep_d, F.when(F.col("n") % 2 == 0, F.col("p")), F.col("m1") - F.col("m2") - half + F.when(F.col("q") % 5 == 0, 1.0).otherwise(0.1), F.lit(None).cast("double"))
    return x.withColumn("c", c).select("l_orderkey", "l_linenumber", F.col("c.consistent").alias("consistent"), F.round("c.d", 6).alias("d"), F.round("c.ci_low", 4).alias("ci_low"))


_G = "SELECT l_suppkey, l_returnflag, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY ALL"


@query("anova_p", f"WITH g AS ({_G}), a AS (SELECT l_suppkey, count(*) AS k, sum(n) AS t, sum(mean * n) AS mn, sum(mean * mean * n) AS mmn, sum((n - 1) * sd * sd) AS w FROM g GROUP BY l_suppkey HAVING count(*) = 3 AND min(n) > 1), f AS (SELECT *, (mmn - mn * mn / t) / 2 / (w / (t - 3)) AS f FROM a) SELECT l_suppkey, round(f, 6) AS f, round(power(1 + 2 * f / (t - 3), -(t - 3) / 2), 6) AS p FROM f")
def anova_p(spark: SparkSession, d: str) -> DataFrame:
    """Three groups a supplier, so that F has two degrees of freedom above."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"))
    full = g.groupBy("l_suppkey").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k = 3 AND least > 1").select("l_suppkey")
    a = groupchecks.anova(g.join(full, "l_suppkey"), ["l_suppkey"], "mean", "sd", "n")
    return a.select("l_suppkey", F.round("f", 6).alias("f"), F.round("p", 6).alias("p"))


@query("chi_squared_p", "WITH o AS (SELECT s.l_suppkey, a.f, b.o, coalesce(c.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem) s CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS f) a CROSS JOIN (SELECT unnest([0, 1]) AS o) b LEFT JOIN (SELECT l_suppkey, l_returnflag AS f, l_linenumber % 2 AS o, count(*) AS n FROM lineitem GROUP BY ALL) c ON c.l_suppkey = s.l_suppkey AND c.f = a.f AND c.o = b.o), m AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey, f) AS r, sum(n) OVER (PARTITION BY l_suppkey, o) AS c, sum(n) OVER (PARTITION BY l_suppkey) AS t FROM o), x AS (SELECT l_suppkey, sum((n - r * c / t) * (n - r * c / t) / (r * c / t)) AS x FROM m GROUP BY l_suppkey HAVING min(r) > 0 AND min(c) > 0) SELECT l_suppkey, round(x, 6) AS chi2, round(exp(-x / 2), 6) AS p FROM x")
def chi_squared_p(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_linenumber") % 2).alias("odd"), F.lit(1).alias("k"))
    x = groupchecks.chi_squared(li, ["l_suppkey"], "l_returnflag", "odd", "k").where("chi2 IS NOT NULL AND df = 2")
    return x.select("l_suppkey", F.round("chi2", 6).alias("chi2"), F.round("p", 6).alias("p"))


_EVEN = "exp(-x / 2) * ({0})".format(" + ".join(["1", "x / 2", "x * x / 8", "x * x * x / 48"]))


@query("benford", f"WITH v AS (SELECT CAST(substring(printf('%e', abs(value)), 1, 1) AS INTEGER) AS digit FROM events WHERE value <> 0), c AS (SELECT digit, count(*)::DOUBLE AS o FROM v GROUP BY digit), n AS (SELECT sum(o) AS n FROM c), x AS (SELECT (SELECT n FROM n)::BIGINT AS n, sum(power(coalesce(o, 0) - (SELECT n FROM n) * log10(1 + 1.0::DOUBLE / r.range), 2) / ((SELECT n FROM n) * log10(1 + 1.0::DOUBLE / r.range))) AS x FROM range(1, 10) r LEFT JOIN c ON c.digit = r.range) SELECT n, round(x, 4) AS chi2, round({_EVEN}, 9) AS p, {_EVEN} > 0.05 AS conforms FROM x")
def benford(spark: SparkSession, d: str) -> DataFrame:
    return groupchecks.benford(table(spark, d, "events"), "value").select("n", F.round("chi2", 4).alias("chi2"), F.round("p", 9).alias("p"), "conforms")


def _pv(spark: SparkSession, d: str) -> DataFrame:
    p = F.round((F.col("l_extendedprice") % 100) / 1000, 3)
    op = F.when(F.col("l_linenumber") % 3 == 0, "<").when(F.col("l_linenumber") % 3 == 1, "=").otherwise("≤")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), p.alias("p_reported"), F.format_string("%.3f", p).alias("p_str"), op.alias("op"))


_ERF = "list_sum(list_transform(range(0, 120), lambda i: power(-1, i) * exp((2 * i + 1) * ln(sqrt(x / 2)) - lgamma(i + 1.0::DOUBLE)) / (2 * i + 1))) * 2 / sqrt(pi())"
_ODD9 = f"CASE WHEN x > 40 THEN 0.0::DOUBLE ELSE 1 - {_ERF} + exp(-x / 2) * (" + " + ".join(f"power(x / 2, {i} - 0.5) / gamma({i} + 0.5::DOUBLE)" for i in range(1, 5)) + ") END"


@query("last_digit_test", f"WITH d AS (SELECT right(printf('%.3f', round((l_extendedprice % 100) / 1000, 3)), 1)::INT AS g FROM lineitem WHERE l_linenumber % 3 = 1), c AS (SELECT g, count(*)::DOUBLE AS n FROM d GROUP BY g), x AS (SELECT sum(n) AS t, 10 * sum(n * n) / sum(n) - sum(n) AS x, sum(n) FILTER (g IN (1, 2, 3, 4)) / sum(n) AS small, sum(n) FILTER (g IN (4, 5, 7)) / sum(n) AS fraud, sum(n) FILTER (g IN (0, 9)) / sum(n) AS zn FROM c) SELECT t::BIGINT AS n_values, round(x, 6) AS chi2, round({_ODD9}, 5) AS p, CASE WHEN small > 0.45 THEN 'newcomb_benford' WHEN fraud > 0.40 AND coalesce(zn, 0) < 0.10 THEN 'possible_fraud' ELSE 'ambiguous' END AS reading FROM x")
def last_digit_test(spark: SparkSession, d: str) -> DataFrame:
    return summaries.last_digit_test(_pv(spark, d)).select("n_values", F.round("chi2", 6).alias("chi2"), F.round("p", 5).alias("p"), "reading")


# --- existence of data


@query("grimmer", f"WITH {_L} SELECT l_orderkey, l_linenumber, (q + 2 * n - n - l_orderkey % 3) % 2 = 0 AS possible FROM l")
def grimmer(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of integers with a sum and a difference; only those of one parity exist."""
    x = _line(spark, d)
    diff = F.col("n") + F.col("l_orderkey") % 3
    c = checks.grimmer(F.format_string("%.2f", F.col("q") / 2), F.format_string("%.2f", diff / F.sqrt(F.lit(2.0))), F.lit(2))
    return x.select("l_orderkey", "l_linenumber", c["possible"].alias("possible"))


@query("grimmer_true", "WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT n >= 2 AS tested, CASE WHEN n >= 2 THEN true END AS possible, count(*) AS n_orders FROM g GROUP BY ALL")
def grimmer_true(spark: SparkSession, d: str) -> DataFrame:
    """Every order's quantities exist, so nothing is called impossible; one alone can't be tested."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.format_string("%.2f", F.avg("l_quantity")).alias("m"), F.format_string("%.2f", F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0))).alias("s"))
    c = checks.grimmer(F.col("m"), F.col("s"), F.col("n"))
    return g.select((F.col("n") >= 2).alias("tested"), c["possible"].alias("possible")).groupBy("tested", "possible").agg(F.count("*").alias("n_orders"))


@query("sprite", f"WITH {_L} SELECT l_orderkey, l_linenumber, (q - n) % 2 = 0 AND (q - n) / 2 >= 1 AND (q + n) / 2 <= 20 AS possible FROM l")
def sprite(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from 1 to 20."""
    c = checks.sprite(F.format_string("%.2f", F.col("q") / 2), F.format_string("%.2f", F.col("n") / F.sqrt(F.lit(2.0))), F.lit(2), F.lit(1), F.lit(20))
    return _line(spark, d).select("l_orderkey", "l_linenumber", c["possible"].alias("possible"))


@query("grim_tables", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 13 + 5 AS n, round(l_extendedprice % 50, CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END) AS m, max(CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey) AS dp FROM lineitem) SELECT l_orderkey, l_linenumber, dp AS column_dp, least(abs(floor(m * n) / n - m), abs(ceil(m * n) / n - m)) <= 0.5::DOUBLE * power(10.0::DOUBLE, -dp) + 1e-9 AS possible FROM p")
def grim_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orders as columns of a table: the most decimals printed count for all of its cells."""
    m = F.when(F.col("l_linenumber") == 1, F.format_string("%.2f", F.round(F.col("l_extendedprice") % 50, 2))).otherwise(F.format_string("%.1f", F.round(F.col("l_extendedprice") % 50, 1)))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 13 + 5).alias("n"), m.alias("m"))
    return groupchecks.grim_column(t, ["l_orderkey"], "m", "n").select("l_orderkey", "l_linenumber", "column_dp", F.col("grim.possible").alias("possible"))


_NEAR = "least(abs(floor({m} * n) / n - {m}), abs(ceil({m} * n) / n - {m})) <= 0.05::DOUBLE + 1e-9"


@query("grim_rows", f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 13 + 5 AS n, round(l_extendedprice % 50, 1) AS b, round(l_extendedprice % 50, 1) + round(l_quantity / 7, 1) AS e, round(l_quantity / 7, 1) + l_linenumber % 3 / 10 AS c FROM lineitem) SELECT l_orderkey, l_linenumber, {_NEAR.format(m='b')} AS base, {_NEAR.format(m='round(e, 1)')} AS \"end\", {_NEAR.format(m='round(c, 1)')} AS change, l_linenumber % 3 < 2 AS arithmetic FROM p")
def grim_rows(spark: SparkSession, d: str) -> DataFrame:
    """Baseline, end and change, which is off by a tenth or two in two of three rows."""
    b, c = F.round(F.col("l_extendedprice") % 50, 1), F.round(F.col("l_quantity") / 7, 1)
    f = lambda x: F.format_string("%.1f", x)
    r = checks.grim_row(f(b), f(F.round(b + c, 1)), f(-(F.round(c + F.col("l_linenumber") % 3 / 10, 1))), F.col("l_partkey") % 13 + 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r["base"].alias("base"), r["end"].alias("end"), r["change"].alias("change"), r["arithmetic"].alias("arithmetic"))


@query("sd_positive", "SELECT l_orderkey, l_linenumber, l_quantity - 5 >= 0 AS possible FROM lineitem")
def sd_positive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", checks.sd_positive(F.col("l_quantity") - 5)["possible"].alias("possible"))


@query("carlisle", "SELECT s_suppkey::VARCHAR AS study, kind, CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 4 END * CASE kind WHEN 'combined' THEN 2 ELSE 1 END AS k, CASE WHEN (s_suppkey % 4 = 0 AND kind <> 'combined') OR s_suppkey % 4 = 1 THEN NULL ELSE 0.0::DOUBLE END AS z, CASE WHEN (s_suppkey % 4 = 0 AND kind <> 'combined') OR s_suppkey % 4 = 1 THEN NULL ELSE 1.0::DOUBLE END AS p_combined FROM supplier, (SELECT unnest(['a', 'b', 'combined']) AS kind)")
def carlisle(spark: SparkSession, d: str) -> DataFrame:
    """Baseline p-values in pairs that add up to 1, whose combination is even; two alone are too few, and a p of 0 can't be combined."""
    k = F.col("s_suppkey")
    x = F.when(k % 4 == 1, 0.0).otherwise((k % 50 + 1) / 120.0)
    pairs = F.when(k % 4 == 0, F.array(x, 1 - x)).otherwise(F.array(x, 1 - x, x / 2, 1 - x / 2))
    p = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kind"), pairs.alias("ps")).select("s_suppkey", "kind", F.explode("ps").alias("p"))
    c = groupchecks.carlisle(p, "s_suppkey", "p", "kind")
    return c.select("study", "kind", "k", (F.round(F.abs("z"), 6) + 0.0).alias("z"), F.round("p_combined", 6).alias("p_combined"))


@query("marginals", "SELECT l_returnflag, l_returnflag <> 'A' AS consistent, count(*) AS row_sum FROM lineitem GROUP BY l_returnflag")
def marginals(spark: SparkSession, d: str) -> DataFrame:
    """Rows by status and columns by line of each flag, and a total that is off by one for one of them."""
    li = table(spark, d, "lineitem")
    rows = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(F.collect_list("n").alias("rows"), (F.sum("n") + (F.max("l_returnflag") == "A").cast("int")).alias("total"))  # a value for each status
    cols = li.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(F.collect_list("n").alias("cols"))  # seven line numbers
    c = checks.marginals(F.col("rows"), F.col("cols"), F.col("total"))
    return rows.join(cols, "l_returnflag").select("l_returnflag", c["consistent"].alias("consistent"), c["row_sum"].alias("row_sum"))


_V = [("possible", None, "x", "UNDETERMINED"), ("possible", False, None, "FAIL"), ("possible", False, "FLAG: soft", "FLAG"), ("plausible", True, None, "PASS"), ("plausible", False, None, "FAIL"), ("consistent", False, None, "FLAG"), ("consistent", False, "FAIL now", "FAIL"), ("suspicious", True, None, "FLAG"), ("suspicious", None, None, "UNDETERMINED")]


@query("verdicts", "SELECT n_nationkey AS k, [" + ", ".join(f"'{v[3]}'" for v in _V) + f"][n_nationkey % {len(_V)} + 1] AS verdict, ['PASS', 'FAIL', 'FLAG'][n_nationkey % 3 + 1] AS by_flags FROM nation")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    out = F.lit(None).cast("string")
    for i, (kind, ok, detail, _) in enumerate(_V):
        out = F.when(k % len(_V) == i, checks.verdict(kind, F.lit(ok).cast("boolean"), F.lit(detail).cast("string"))).otherwise(out)
    flags = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("odd"), F.lit("Impossible value"))).otherwise(F.array(F.lit("odd")))
    return table(spark, d, "nation").select(k.alias("k"), out.alias("verdict"), checks.verdict("flags", flags).alias("by_flags"))


# --- tests in text


def _tests(spark: SparkSession, d: str) -> DataFrame:
    v, p = F.format_string("%.2f", F.col("q") / 10), F.format_string("%.3f", F.round(F.col("p") / 4, 3))
    k = F.col("n") % 3
    head = F.when(k == 0, "t(2)").when(k == 1, "chi2(2, N = 90)").otherwise("F(2, 10)")
    return _line(spark, d).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pmid"), F.concat(F.lit("We found ("), head, F.lit(" = "), v, F.lit(", p "), F.when(F.col("q") % 4 == 0, "<").otherwise("="), F.lit(" "), p, F.lit(") that it holds.")).alias("text"))


_PV = "CASE n % 3 WHEN 0 THEN 1 - {v} / sqrt(2 + {v} * {v}) WHEN 1 THEN exp(-{v} / 2) ELSE power(1 + 2 * {v} / 10, -5) END"
_Q = f"""{_L}, b AS (SELECT *, round(q / 10, 2) AS v, round(round(p / 4, 3), 3) AS r, q % 4 = 0 AS lt FROM l), c AS (SELECT *, {_PV.format(v='(v + 0.005::DOUBLE)')} AS lo, {_PV.format(v='greatest(v - 0.005::DOUBLE, 0)')} AS hi FROM b),
    e AS (SELECT *, CASE WHEN lt THEN lo < r + 1e-12 ELSE lo <= r + 0.0005::DOUBLE + 1e-12 AND hi >= greatest(0, r - 0.0005::DOUBLE) - 1e-12 END AS two, CASE WHEN lt THEN lo / 2 < r + 1e-12 ELSE lo / 2 <= r + 0.0005::DOUBLE + 1e-12 AND hi / 2 >= greatest(0, r - 0.0005::DOUBLE) - 1e-12 END AS one,
    CASE WHEN lt THEN CASE WHEN r <= 0.05 + 1e-12 THEN true END WHEN r < 0.05 - 1e-12 THEN true WHEN r > 0.05 + 1e-12 THEN false END AS claim, CASE WHEN lo > 0.05 + 1e-12 THEN false WHEN hi < 0.05 - 1e-12 THEN true END AS side FROM c)"""


@query("statcheck", f"WITH {_Q} SELECT l_orderkey || '-' || l_linenumber AS pmid, ['t', 'chi2', 'F'][n % 3 + 1] AS stat, 2.0::DOUBLE AS df1, CASE WHEN n % 3 = 2 THEN 10.0::DOUBLE END AS df2, v AS value, r AS p, CASE WHEN two THEN 'PASS' WHEN n % 3 = 0 AND one THEN 'FLAG' WHEN claim IS NOT NULL AND side IS NOT NULL AND claim <> side THEN 'FAIL' ELSE 'FLAG' END AS verdict, round(lo, 6) AS p_low, round(hi, 6) AS p_high FROM e")
def statcheck(spark: SparkSession, d: str) -> DataFrame:
    """Tests of three kinds found in sentences and recomputed, with all that their rounding allows."""
    t = extract.reported_tests(_tests(spark, d))
    return t.select("pmid", "stat", "df1", "df2", "value", "p", "verdict", F.round("p_low", 6).alias("p_low"), F.round("p_high", 6).alias("p_high"))


@query("finding_counts", f"WITH {_Q}, f AS (SELECT n, CASE WHEN two THEN 'PASS' WHEN n % 3 = 0 AND one THEN 'FLAG' WHEN claim IS NOT NULL AND side IS NOT NULL AND claim <> side THEN 'FAIL' ELSE 'FLAG' END AS v FROM e) SELECT ['t', 'chi2', 'F'][n % 3 + 1] AS stat, count(*) FILTER (v = 'PASS') AS pass, count(*) FILTER (v = 'FLAG') AS flag, count(*) FILTER (v = 'FAIL') AS fail, 0::BIGINT AS undetermined FROM f GROUP BY 1")
def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return extract.finding_counts(extract.reported_tests(_tests(spark, d)), "stat")


# --- the whole scan


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers: some with funding and interests, a cohort, p-values, ratios, and words of significance; every eleventh is empty."""
    k = F.col("o_orderkey")
    t = F.concat(
        F.lit("Jane Q. Doe, Max R. Roe\n"), F.when(k % 4 < 2, "Funding: a public grant.\n").otherwise(""), F.when(k % 2 == 0, "Conflicts of interest: the authors declare none.\n").otherwise(""), F.when(k % 8 == 3, "Supported by Novartis. Funding as said.\n").otherwise(""),
        F.lit("We enrolled n = "), S(k % 300 + 20), F.lit(" people. HR 1.50 (95% CI 1.10-"), F.when(k % 5 == 0, "9.90").otherwise("2.20"), F.lit("). "),
        F.when(k % 3 == 0, "It was statistically significant (p = 0.01").when(k % 3 == 1, "It was not significant (p = 0.3").otherwise("It was seen (p < 0.04"), F.lit(") overall."),
    )
    return table(spark, d, "orders").select(S(k).alias("pmid"), F.when(k % 11 == 10, F.when(k % 2 == 0, "")).otherwise(t).alias("text"))


_FUND = "CASE WHEN e THEN 'none_stated' WHEN k % 8 = 3 THEN 'industry_linked' WHEN k % 4 = 0 THEN 'public_disclosed' WHEN k % 4 IN (1, 2) THEN 'partial' ELSE 'none_stated' END"
_O = f"o AS (SELECT o_orderkey AS k, o_orderkey % 11 = 10 AS e FROM orders), f AS (SELECT *, {_FUND} AS cls, CASE WHEN NOT e THEN k % 300 + 20 END AS cohort, CASE WHEN NOT e AND k % 3 < 2 THEN 1 - k % 3 * 0.5::DOUBLE END AS pos FROM o)"


@query("scan_papers", f"WITH {_O} SELECT k::VARCHAR AS pmid, cls AS funding_classification, cls = 'industry_linked' AS industry_linked, CASE WHEN e THEN '' ELSE 'Jane|Max' END AS authors, cohort::INT AS cohort_size, CASE WHEN NOT e AND k % 3 < 2 THEN 1 ELSE 0 END::BIGINT AS n_significant, CASE WHEN NOT e AND k % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS n_not_significant, pos AS positivity_ratio FROM f")
def scan_papers(spark: SparkSession, d: str) -> DataFrame:
    p = extract.papers(_papers(spark, d))
    return p.select("pmid", "funding_classification", "industry_linked", F.array_join("authors", "|").alias("authors"), "cohort_size", "n_significant", "n_not_significant", "positivity_ratio")


@query("scan_effects", f"WITH {_O} SELECT k::VARCHAR AS pmid, 'HR' AS kind, 1.5::DOUBLE AS estimate, 1.1::DOUBLE AS ci_lo, CASE WHEN k % 5 = 0 THEN 9.9::DOUBLE ELSE 2.2::DOUBLE END AS ci_hi, true AS ci_consistent, true AS excludes_null, k % 5 = 0 AS implausibly_wide, CASE WHEN k % 5 = 0 THEN 5.87::DOUBLE ELSE 0.73::DOUBLE END AS width_over_est FROM f WHERE NOT e")
def scan_effects(spark: SparkSession, d: str) -> DataFrame:
    return extract.effects(_papers(spark, d))


@query("positivity_summary", f"WITH {_O} SELECT count(pos) AS n_papers, avg(pos) AS mean_positivity, count(*) FILTER (pos > 0.85) AS n_high, avg((pos > 0.85)::INT) AS share_high FROM f")
def positivity_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.positivity(extract.papers(_papers(spark, d)))


@query("industry_positivity", f"WITH {_O}, a AS (SELECT count(pos) FILTER (cls = 'industry_linked') AS n1, avg(pos) FILTER (cls = 'industry_linked') AS m1, var_samp(pos) FILTER (cls = 'industry_linked') AS v1, count(pos) FILTER (cls <> 'industry_linked') AS n0, avg(pos) FILTER (cls <> 'industry_linked') AS m0, var_samp(pos) FILTER (cls <> 'industry_linked') AS v0 FROM f) SELECT n1, n0, round(m1, 9) AS mean1, round(m0, 9) AS mean0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM a")
def industry_positivity(spark: SparkSession, d: str) -> DataFrame:
    p = extract.papers(_papers(spark, d))
    a = summaries.industry_positivity(p.select("pmid", "industry_linked"), p)
    return a.select("n1", "n0", F.round("mean1", 9).alias("mean1"), F.round("mean0", 9).alias("mean0"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("corpus_scan", f"WITH {_O}, c AS (SELECT cohort, count(*) AS n FROM f WHERE NOT e GROUP BY cohort) SELECT (SELECT count(*) FROM f) AS n_papers, (SELECT count(*) FROM f WHERE NOT e) AS n_pvalues, (SELECT count(*) FROM f WHERE NOT e) AS n_effects, 0::BIGINT AS n_triples, (SELECT count(*) FROM f WHERE NOT e AND k % 5 = 0) AS n_wide, (SELECT count(*) FROM f WHERE NOT e AND k % 3 <> 1) AS n_significant, (SELECT round(avg(pos), 9) FROM f) AS mean_positivity")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    """Everything found in a corpus, written as records, read again, and summed up."""
    found = scan.scan(_papers(spark, d))
    s = scan.summary(found)
    wide = found["papers"].agg(F.sum("n_wide_ci").alias("n_wide"))
    return s.crossJoin(wide).select("n_papers", "n_pvalues", "n_effects", "n_triples", "n_wide", F.col("p_curve.n_significant").alias("n_significant"), F.round("positivity.mean_positivity", 9).alias("mean_positivity"))  # one row each


_WHOLE = "CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END"


@query("scan_whole_texts", f"SELECT doc_id::VARCHAR AS pmid, {_WHOLE} AS n_pvalues, 1 AS n_effects, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_triples, 't' AS first_test, 2 + (doc_id % 9) / 10.0::DOUBLE AS statistic FROM documents")
def scan_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as whole papers, with their reports at the end."""
    k = F.col("doc_id")
    tail = F.concat(F.lit("\nWe found t(28) = 2."), S(k % 9), F.lit(", p = 0.012, and HR 1.50 (95% CI 1.10-2.20)."), F.when(k % 4 == 0, " It was no less (p < .001).").otherwise(""), F.when(k % 3 == 0, "\nScores (N: 41) were 3.25 (0.75) in all.").otherwise(""))
    x = table(spark, d, "documents").select(S(k).alias("pmid"), F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))
    found = scan.scan(x)
    first = found["pvalues"].where("p_str = '0.012'").groupBy("pmid").agg(F.min("test_type").alias("first_test"), F.min(F.get("test_params", 1)).alias("statistic"))
    return found["papers"].join(first, "pmid", "left").select("pmid", F.col("n_pvalues").cast("int").alias("n_pvalues"), F.col("n_effects").cast("int").alias("n_effects"), F.col("n_triples").cast("int").alias("n_triples"), "first_test", "statistic")


@query("scan_files", f"WITH {_O} SELECT unnest(['papers', 'pvalues', 'effects', 'funding']) AS file, unnest([(SELECT count(*) FROM f), (SELECT count(*) FROM f WHERE NOT e), (SELECT count(*) FROM f WHERE NOT e), (SELECT count(*) FROM f)]) AS rows")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """The record files of a scan of every eighth paper's authors apart, by the rows in them."""
    from scholium.runtime import table_path

    found = scan.scan(_papers(spark, d))
    found["salami"] = found["salami"].limit(0)
    paths = scan.write(found, table_path(spark, "scan"))
    out = None
    for p in paths:
        name = p.rsplit("/", 1)[1]
        if name in ("papers", "pvalues", "effects", "funding"):
            n = spark.read.text(p).agg(F.lit(name).alias("file"), F.count("*").alias("rows"))
            out = n if out is None else out.unionByName(n)
    return out


# --- tables


@query(
    "table_battery",
    """SELECT * FROM (WITH k AS (SELECT s_suppkey AS k FROM supplier) SELECT k::VARCHAR AS source, unnest(['anova', 'chi_squared', 'marginals', 'effect_size', 'sample_size', 'frozen_sds', 'sd_se', 'sd_positive', 'grim_percentage', 'change_arithmetic']) AS "check",
    unnest([CASE WHEN k % 3 = 0 THEN 'FLAG' WHEN k % 3 = 1 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FLAG' END, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FLAG' END, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FLAG' END, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FLAG' END, CASE WHEN k % 4 = 0 THEN 'FAIL' WHEN k % 4 = 1 THEN 'FLAG' ELSE 'PASS' END, CASE WHEN k % 4 = 2 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END]) AS verdict FROM k)""",
)
def table_battery(spark: SparkSession, d: str) -> DataFrame:
    """A reported table a supplier with right and wrong entries of every kind; means and SDs of single cells are in other queries."""
    k = F.col("s_suppkey")
    even = k % 2 == 0
    two = lambda a, b: F.when(even, a).otherwise(b)
    grp = lambda n, m, s: F.struct(F.lit(n).alias("n"), F.lit(m).alias("mean"), s.alias("sd"))
    sd = F.when(k % 3 == 2, -1.0).otherwise(1.0)
    anova = F.array(F.struct(F.lit("a").alias("name"), F.array(grp(10, 1.0, sd), grp(10, 2.0, sd), grp(10, 3.0, sd)).alias("groups"), F.when(k % 3 == 0, 3.0).otherwise(10.0).alias("f"), F.lit(0.0006).alias("p")))
    cells = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((10.0, 20.0), (20.0, 10.0))])
    tab = F.array(F.struct(F.lit("t").alias("name"), cells.alias("cells"), F.array(F.lit(30.0), F.lit(30.0)).alias("rows"), F.array(F.lit(30.0), two(F.lit(30.0), F.lit(31.0))).alias("cols"), F.lit(60.0).alias("total"), two(F.lit(6.67), F.lit(9.0)).alias("chi2"), F.lit(0.01).alias("p")))
    eff = F.array(F.struct(F.lit("e").alias("name"), F.lit(5.0).alias("mean1"), F.lit(2.0).alias("sd1"), F.lit(20).alias("n1"), F.lit(3.0).alias("mean2"), F.lit(2.0).alias("sd2"), F.lit(20).alias("n2"), two(F.lit(1.0), F.lit(2.0)).alias("d"), F.lit(0.003).alias("p"), F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high")))
    size = F.array(F.struct(F.lit("s").alias("name"), F.lit(2.0).alias("t"), two(F.lit("0.18"), F.lit("0.03")).alias("p"), F.lit(3).alias("n")))
    ser = F.array(*[F.struct(F.lit(f"v{i}").alias("name"), F.array(F.lit("1.0"), two(F.lit(f"1.{i}"), F.lit("1.0")) if i else F.lit("1.0")).alias("sds")) for i in range(3)])
    v = F.array(F.struct(F.lit("x").alias("name"), F.lit(None).cast("int").alias("dp"), F.array(F.struct(F.lit("g").alias("name"), F.lit(40).alias("n"), F.lit(None).cast("string").alias("mean"), F.when(k % 4 == 0, "20.0").when(k % 4 == 1, "0.2").when(k % 4 == 2, "-3.0").otherwise("3.0").alias("sd"))).alias("groups"), F.lit(None).cast("double").alias("baseline_p")))
    pct = F.array(F.struct(F.lit("w").alias("name"), F.lit("all").alias("grp"), F.lit(25).alias("n"), two(F.lit(52.0), F.lit(53.2)).alias("percentage"), F.lit(1).alias("dp")))
    chg = F.array(F.struct(F.lit("c").alias("name"), F.lit(1.0).alias("baseline"), F.lit(3.0).alias("end"), two(F.lit(2.0), F.lit(5.0)).alias("change")))
    spec = table(spark, d, "supplier").select(S(k).alias("source"), F.struct(F.lit(0.0).alias("lo"), F.lit(10.0).alias("hi"), F.lit(1.0).alias("granularity")).alias("scale"), v.alias("variables"), anova.alias("anovas"), tab.alias("tables"), eff.alias("effect_sizes"), size.alias("sizes"), ser.alias("series"), pct.alias("percentages"), chg.alias("changes"))
    f = battery.run(spec).where("check NOT IN ('quick_sd', 'grim', 'grimmer', 'variance_ratio', 'carlisle')")
    return f.where("NOT (check = 'sd_se' AND source % 4 = 2)").unionByName(f.where("check = 'sd_se' AND source % 4 = 2").withColumn("verdict", F.lit("PASS"))).select("source", "check", "verdict")
