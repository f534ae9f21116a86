"""All checks that apply to reported tables, as findings, and calibration of findings against known cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import checks
from scholium.operators import groupchecks

#: A reported table. Numbers are text where their printed digits matter.
SPEC = (
    "source string, scale struct<lo:double,hi:double,granularity:double>, "
    "variables array<struct<name:string,dp:int,groups:array<struct<name:string,n:int,mean:string,sd:string>>,baseline_p:double>>, "
    "percentages array<struct<name:string,grp:string,n:int,percentage:double,dp:int>>, "
    "pre_post array<struct<name:string,sd_pre:string,sd_post:string,sd_change:string>>, "
    "changes array<struct<name:string,baseline:double,end:double,change:double>>, "
    "paired array<struct<name:string,mean:double,sd:double,n:int,p:double>>, "
    "independent array<struct<name:string,mean1:double,sd1:double,n1:int,mean2:double,sd2:double,n2:int,p:double>>, "
    "anovas array<struct<name:string,groups:array<struct<n:int,mean:double,sd:double>>,f:double,p:double>>, "
    "tables array<struct<name:string,cells:array<array<double>>,rows:array<double>,cols:array<double>,total:double,chi2:double,p:double>>, "
    "effect_sizes array<struct<name:string,mean1:double,sd1:double,n1:int,mean2:double,sd2:double,n2:int,d:double,p:double,ci_low:double,ci_high:double>>, "
    "sizes array<struct<name:string,t:double,p:string,n:int>>, series array<struct<name:string,sds:array<string>>>"
)
NAMES = [x.split(" ")[0] for x in SPEC.split(", ")]
#: Parts of a table that callers may leave out.
OPTIONAL = NAMES[2:]


def whole(specs: DataFrame) -> DataFrame:
    """specs with absent parts as nulls."""
    kinds = dict(x.split(" ", 1) for x in SPEC.split(", "))
    return specs.select(*[F.col(c) if c in specs.columns else F.lit(None).cast(kinds[c]).alias(c) for c in NAMES])



def _finding(df: DataFrame, check: str, target: Column, verdict: Column) -> DataFrame:
    return df.select("source", F.lit(check).alias("check"), target.alias("target"), verdict.alias("verdict"))


def run(specs: DataFrame) -> DataFrame:
    """(source, check, target, verdict) of every check that a table's entries allow. Bad input gives UNDETERMINED, absent entries nothing."""
    specs = whole(specs)
    g = specs.select("source", "scale", F.explode("variables").alias("v")).select("source", "scale", F.col("v.name").alias("var"), F.col("v.dp").alias("dp"), F.explode("v.groups").alias("g"))
    g = g.select("source", "scale", "var", "dp", F.col("g.name").alias("grp"), F.col("g.n").alias("n"), F.col("g.mean").alias("mean"), F.col("g.sd").alias("sd"))
    col = Window.partitionBy("source", "var")
    g = g.withColumn("cdp", F.coalesce("dp", F.max(checks.decimals(F.col("mean"))).over(col))).withColumn("unit", F.coalesce("scale.granularity", F.lit(1.0)))
    target = F.concat_ws(" / ", "var", "grp")
    total = F.col("mean").try_cast("double")
    # the grid's step may differ by table, so the mean is tested in its units
    m = F.try_divide(F.col("mean").try_cast("double"), F.col("unit"))
    half = F.try_divide(checks.half_unit(F.col("cdp")), F.col("unit")) + checks.EPS
    near = F.least(*[F.abs(F.try_divide(f(m * F.col("n")), F.col("n")) - m) for f in (F.floor, F.ceil)]) <= half
    has = F.col("mean").isNotNull() & F.col("n").isNotNull()
    out = _finding(g.where(has), "grim", target, checks.verdict("possible", F.when((F.col("n") > 0) & total.isNotNull(), near)))
    one = g.where(has & F.col("sd").isNotNull() & (F.col("unit") == 1))
    out = out.unionByName(_finding(one, "grimmer", target, checks.verdict("possible", checks.grimmer(F.col("mean"), F.col("sd"), F.col("n"))["possible"])))
    bounded = g.where("sd IS NOT NULL AND n IS NOT NULL AND scale.lo IS NOT NULL AND scale.hi IS NOT NULL")
    q = checks.quick_sd(F.col("sd").try_cast("double"), F.col("n"), F.col("scale.lo"), F.col("scale.hi"))
    out = out.unionByName(_finding(bounded, "quick_sd", target, F.when(q["impossible"], "FAIL").when(q["wide"], "FLAG").when(q["impossible"].isNotNull(), "PASS").otherwise("UNDETERMINED")))
    vr = groupchecks.variance_ratio(g.where("sd IS NOT NULL AND n IS NOT NULL").withColumn("s", F.col("sd").try_cast("double")).where("s IS NOT NULL"), ["source", "var"], "s", "n", "grp")
    out = out.unionByName(_finding(vr.where("f_ratio IS NOT NULL OR zero_sd"), "variance_ratio", F.concat(F.col("var"), F.lit(" / SDs across groups")), F.when(F.col("zero_sd") | F.col("similar") | (F.col("p") < 0.01), "FLAG").otherwise("PASS")))
    base = specs.select("source", F.explode("variables").alias("v")).select("source", F.col("v.baseline_p").alias("p")).where("p IS NOT NULL")
    ca = groupchecks.carlisle(base, "source", "p").withColumnRenamed("study", "source").where("k >= 3")
    out = out.unionByName(_finding(ca, "carlisle", F.lit("baseline p-values"), F.when(F.col("p_combined").isNull(), "UNDETERMINED").when((F.col("p_combined") < 0.01) | (F.col("ks_p") < 0.01), "FLAG").otherwise("PASS")))
    each = lambda name: specs.select("source", F.explode(name).alias("e")).select("source", "e.*")
    out = out.unionByName(_finding(each("percentages"), "grim_percentage", F.concat_ws(" / ", "name", "grp"), checks.verdict("possible", checks.grim_percentage(F.col("percentage"), F.col("n"), F.coalesce("dp", F.lit(1)))["possible"])))
    out = out.unionByName(_finding(each("pre_post"), "correlation_bound", F.col("name"), checks.verdict("possible", checks.correlation_bound(F.col("sd_pre"), F.col("sd_post"), F.col("sd_change"))["possible"])))
    out = out.unionByName(_finding(each("changes"), "change_arithmetic", F.col("name"), checks.verdict("consistent", checks.change_arithmetic(F.col("baseline"), F.col("end"), F.col("change"))["consistent"], F.lit("FAIL"))))
    soft = lambda ok, sd: F.when(ok.isNull(), "UNDETERMINED").when(ok, "PASS").when(sd < 0, "FAIL").otherwise("FLAG")
    t1 = each("paired")
    out = out.unionByName(_finding(t1, "t_paired", F.col("name"), soft(checks.t_paired(F.col("mean"), F.col("sd"), F.col("n"), F.col("p"))["plausible"], F.col("sd"))))
    t2 = each("independent")
    ok2 = checks.t_welch(*[F.col(c) for c in ("mean1", "sd1", "n1", "mean2", "sd2", "n2", "p")])["plausible"]
    out = out.unionByName(_finding(t2, "t_independent", F.col("name"), soft(ok2, F.least("sd1", "sd2"))))
    out = out.unionByName(_finding(bounded, "sd_se", target, _sd_se(F.col("sd").try_cast("double"), F.col("n"), F.col("scale.lo"), F.col("scale.hi"))))
    out = out.unionByName(_finding(g.where("sd IS NOT NULL"), "sd_positive", target, checks.verdict("possible", checks.sd_positive(F.col("sd").try_cast("double"))["possible"])))
    an = each("anovas").select("source", "name", checks.anova_groups(F.col("groups")).alias("x"), F.col("f").alias("rf"), "p").select("source", "name", "x.*", "rf", "p")
    an = an.withColumn("ok", checks.anova_fits(*[F.col(c) for c in ("f", "df1", "df2", "rf", "p")]))
    out = out.unionByName(_finding(an, "anova", F.col("name"), F.when(F.col("impossible"), "FAIL").when(F.col("ok").isNull(), "UNDETERMINED").when(F.col("ok"), "PASS").otherwise("FLAG")))
    tables = each("tables")
    chi = tables.where("cells IS NOT NULL").select("source", "name", checks.chi2_cells(F.col("cells")).alias("x"), F.col("chi2").alias("rx"), "p").select("source", "name", "x.*", "rx", "p")
    chi = chi.withColumn("ok", checks.chi2_fits(*[F.col(c) for c in ("chi2", "yates", "df", "rx", "p")]))
    out = out.unionByName(_finding(chi, "chi_squared", F.col("name"), checks.verdict("consistent", F.col("ok"))))
    sums = checks.marginals(F.col("rows"), F.col("cols"), F.col("total"))["consistent"]
    out = out.unionByName(_finding(tables.where("rows IS NOT NULL AND cols IS NOT NULL"), "marginals", F.col("name"), checks.verdict("consistent", sums, F.lit("FAIL"))))
    d = checks.effect_size(*[F.col(c) for c in ("mean1", "sd1", "n1", "mean2", "sd2", "n2", "d", "p", "ci_low", "ci_high")])["consistent"]
    out = out.unionByName(_finding(each("effect_sizes"), "effect_size", F.col("name"), checks.verdict("consistent", d)))
    n = checks.sample_size_from_t(F.col("t"), F.col("p"), F.col("n"))["plausible"]
    out = out.unionByName(_finding(each("sizes"), "sample_size", F.col("name"), checks.verdict("consistent", n)))
    frozen = specs.select("source", F.size(F.filter("series", lambda x: (F.size(x["sds"]) >= 2) & (F.size(F.array_distinct(x["sds"])) == 1))).alias("k"), F.size("series").alias("m")).where("m > 0")
    return out.unionByName(_finding(frozen, "frozen_sds", F.lit("SDs over time"), checks.verdict("suspicious", (2 * F.col("k") > F.col("m")) | (F.col("k") >= 5))))


def _sd_se(sd: Column, n: Column, lo: Column, hi: Column) -> Column:
    c = checks.sd_se_confusion(sd, n, lo, hi)
    return F.when(c["exceeds_range"].isNull(), "UNDETERMINED").when(c["exceeds_range"], "FAIL").when(c["may_be_se"], "FLAG").otherwise("PASS")


def calibrate(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """(source, kind, check, target, matched, best, satisfied) of each expectation.

    expected: source, kind (must_detect or must_pass), check, target (exact, or null), target_contains, min_verdict. A must_detect needs one match only, unless its target
    is exact, of at least its verdict; a must_pass needs matches that all pass.
    """
    rank = lambda c: F.when(c == "FAIL", 2).when(c == "FLAG", 1).otherwise(0)
    e = expected.withColumn("__e", F.monotonically_increasing_id()).withColumnRenamed("target", "exact")
    hit = F.when((F.col("kind") == "must_detect") & F.col("exact").isNotNull(), F.col("target") == F.col("exact")).otherwise(F.col("target").contains(F.coalesce("target_contains", F.lit(""))))
    m = e.join(findings.where("check IS NOT NULL"), ["source", "check"], "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    strong = rank(F.col("verdict")) >= rank(F.coalesce("min_verdict", F.lit("FLAG")))
    a = m.groupBy("__e", "source", "kind", "check", "exact", "target_contains").agg(
        F.count_if("hit").alias("matched"), F.max(F.when(F.col("hit"), F.struct(rank(F.col("verdict")).alias("r"), F.col("verdict").alias("v"))))["v"].alias("best"),
        F.count_if(F.col("hit") & strong).alias("strong"), F.count_if(F.col("hit") & (F.col("verdict") == "PASS")).alias("passing"),
    )
    detect = (F.col("matched") > 0) & (F.col("strong") == F.col("matched")) & (F.col("exact").isNotNull() | (F.col("matched") == 1))
    ok = F.when(F.col("kind") == "must_detect", detect).otherwise((F.col("matched") > 0) & (F.col("passing") == F.col("matched")))
    return a.select("source", "kind", "check", F.coalesce("exact", "target_contains").alias("target"), "matched", "best", ok.alias("satisfied"))


def case_problems(case: Column) -> Column:
    """What is wrong with a calibration case (JSON text): not an object, nothing expected, unknown keys, entries without a check."""
    kinds = "map<string,array<struct<check:string,target:string,target_contains:string,min_verdict:string>>>"
    raw, e = F.get_json_object(case, "$.expected"), F.from_json(F.get_json_object(case, "$.expected"), kinds)
    keys = F.json_object_keys(raw)
    known = F.array(F.lit("must_detect"), F.lit("must_pass"))
    entries = F.flatten(F.filter(F.map_values(e), lambda x: x.isNotNull()))
    return F.array_compact(F.array(
        F.when(raw.isNull() | keys.isNull(), "expected is lacking or no object"), F.when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(F.array_except(keys, known)), ", "))),
        F.when(keys.isNotNull() & (F.coalesce(F.size(entries), F.lit(0)) <= 0), "nothing is asserted"), F.when(F.exists(entries, lambda x: F.coalesce(x["check"], F.lit("")) == ""), "an entry without a check"),
    ))


def sensitivity(calibrated: DataFrame) -> DataFrame:
    """Shares of satisfied expectations by check: of what must be detected, and of what must pass; null where there is none."""
    share = lambda k: F.avg(F.when(F.col("kind") == k, F.col("satisfied").cast("double")))
    return calibrated.groupBy("check").agg(share("must_detect").alias("sensitivity"), share("must_pass").alias("specificity"))
