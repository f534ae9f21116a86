"""Checks of reported statistics, as columns.

Every check is a struct with a three-valued outcome: true, false, or null where the input can't be tested. `verdict` maps it to
PASS, FLAG, FAIL or UNDETERMINED; possible data are never called impossible.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from scholium.functions import special

EPS = 1e-9


def decimals(printed: Column) -> Column:
    """Digits after the point of a printed number; a number without a point has none."""
    s = F.trim(printed)
    return F.when(F.instr(s, ".") > 0, F.length(F.substring_index(s, ".", -1))).otherwise(F.when(s.isNotNull(), 0))


def half_unit(dp: Column) -> Column:
    return F.lit(0.5) * F.pow(F.lit(10.0), -dp)


def _num(printed: Column) -> Column:
    return F.trim(printed).try_cast("double")


def grim(mean: Column, n: Column, scale: float = 1.0, dp: Column | None = None) -> Column:
    """Whether a mean, printed as text, is possible for n values in steps of `scale`."""
    m = _num(mean)
    total = m * n / scale
    low, high = (F.try_divide(f(total) * scale, n) for f in (F.floor, F.ceil))
    near = F.least(F.abs(low - m), F.abs(high - m)) <= half_unit(decimals(mean) if dp is None else dp) + EPS
    return F.when(n > 0, F.struct(near.alias("possible"), low.alias("lower"), high.alias("upper"))).otherwise(F.struct(F.lit(None).cast("boolean").alias("possible"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")))


def grim_row(base: Column, end: Column, change: Column, n: Column, scale: float = 1.0) -> Column:
    """GRIM on three cells at their common precision, and whether end minus base is the change in either sign."""
    dp = F.greatest(*[decimals(c) for c in (base, end, change)])
    b, e, c = (_num(x) for x in (base, end, change))
    tol = F.lit(1.5) * F.pow(F.lit(10.0), -dp)
    parts = [grim(x, n, scale, dp)["possible"].alias(k) for x, k in ((base, "base"), (end, "end"), (change, "change"))]
    return F.struct(*parts, ((F.abs(e - b - c) <= tol) | (F.abs(b - e - c) <= tol)).alias("arithmetic"), dp.alias("dp"))


def grim_percentage(pct: Column, n: Column, dp: Column | int = 1) -> Column:
    """Whether a percentage of n is that of a whole count; ties of the count round half to even."""
    dp = F.lit(dp) if isinstance(dp, int) else dp
    count = pct / 100.0 * n
    ok = F.abs(count - F.rint(count)) <= F.lit(0.5) * F.pow(F.lit(10.0), -dp) / 100.0 * n
    return F.struct(F.when(n > 0, ok).alias("possible"), F.when(n > 0, count).alias("implied_count"))


def correlation_bound(pre: Column, post: Column, change: Column) -> Column:
    """The correlation of pre and post that three printed SDs imply; impossible only if no values within their rounding allow one."""
    a, b, c = (_num(x) for x in (pre, post, change))
    lo = [F.greatest(F.lit(0.0), v - half_unit(decimals(x))) for v, x in ((a, pre), (b, post), (c, change))]
    hi = [v + half_unit(decimals(x)) for v, x in ((a, pre), (b, post), (c, change))]
    gap = F.greatest(lo[0] - hi[1], lo[1] - hi[0], F.lit(0.0))
    ok = (hi[2] >= gap - EPS) & (lo[2] <= hi[0] + hi[1] + EPS)
    negative = (a < 0) | (b < 0) | (c < 0)
    r = F.when(~negative & (a * b != 0), (a * a + b * b - c * c) / (2 * a * b))
    return F.struct(F.when(negative, F.lit(False)).when(a * b != 0, ok).alias("possible"), r.alias("implied_r"))


def change_arithmetic(base: Column, end: Column, change: Column, tolerance: float = 0.15) -> Column:
    expected = F.bround(end - base, 4)
    return F.struct((F.abs(expected - change) <= tolerance).alias("consistent"), expected.alias("expected"))


def sd_positive(sd: Column) -> Column:
    return F.struct((sd >= 0).alias("possible"))


def quick_sd(sd: Column, n: Column, lo: Column, hi: Column) -> Column:
    """An SD against the largest that values from lo to hi can have, and against 1.5 times a uniform distribution's."""
    half = F.floor(n / 2)
    top = (hi - lo) * F.when(n >= 2, F.sqrt(F.try_divide(half * (n - half), n * (n - 1.0)))).otherwise(F.lit(0.5))
    uniform = (hi - lo) / math.sqrt(12)
    return F.struct(top.alias("max_sd"), uniform.alias("uniform_sd"), (sd > top + EPS).alias("impossible"), (sd > uniform * 1.5).alias("wide"))


def sd_se_confusion(sd: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Whether an SD exceeds the range, or is so small that it may be a standard error."""
    return F.struct((sd > hi - lo).alias("exceeds_range"), ((n > 10) & (sd < (hi - lo) * 0.05)).alias("may_be_se"), F.try_divide(sd, F.sqrt(n)).alias("se_if_sd"), (sd * F.sqrt(n)).alias("sd_if_se"))


def marginals(rows: Column, cols: Column, total: Column) -> Column:
    """Whether a contingency table's row and column totals agree with each other and with the reported total, where there is one."""
    zero = F.lit(0).cast("long")
    r, c = (F.aggregate(x, zero, lambda s, v: s + v.cast("long")) for x in (rows, cols))
    return F.struct(((r == c) & (total.isNull() | ((r == total) & (c == total)))).alias("consistent"), r.alias("row_sum"), c.alias("col_sum"))


def p_agrees(calculated: Column, reported: Column) -> Column:
    """Within a factor of ten; both are taken as 1e-20 at least. Null if either is."""
    ratio = F.greatest(calculated, F.lit(1e-20)) / F.greatest(reported, F.lit(1e-20))
    return F.when(calculated.isNotNull() & reported.isNotNull(), (ratio > 0.1) & (ratio < 10))


def t_paired(mean: Column, sd: Column, n: Column, p: Column) -> Column:
    """A paired t test recomputed. A negative SD is impossible; no variance or n below 2 can't be tested."""
    ok = (sd > 0) & (n > 1)
    t = F.when(ok, F.try_divide(mean, F.try_divide(sd, F.sqrt(n))))
    calc = 2 * special.t_tail(F.abs(t), (n - 1).cast("double"))
    return F.struct(F.when(sd < 0, False).when(ok, p_agrees(calc, p)).alias("plausible"), t.alias("t"), calc.alias("p"))


def t_welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column, p: Column) -> Column:
    """An independent t test of unequal variances recomputed."""
    v1, v2 = F.try_divide(s1 * s1, n1), F.try_divide(s2 * s2, n2)
    ok = (s1 >= 0) & (s2 >= 0) & (n1 > 1) & (n2 > 1) & (v1 + v2 > 0)
    t = F.when(ok, F.try_divide(m1 - m2, F.sqrt(v1 + v2)))
    df = F.when(ok, F.try_divide((v1 + v2) * (v1 + v2), F.try_divide(v1 * v1, n1 - 1) + F.try_divide(v2 * v2, n2 - 1)))
    calc = 2 * special.t_tail(F.abs(t), df)
    return F.struct(F.when((s1 < 0) | (s2 < 0), False).when(ok, p_agrees(calc, p)).alias("plausible"), t.alias("t"), df.alias("df"), calc.alias("p"))


def effect_size(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column, d: Column, p: Column, ci_low: Column, ci_high: Column) -> Column:
    """Cohen's d, p and 95 % interval against reported ones, each where reported."""
    safe = F.try_divide
    pooled = F.sqrt(safe((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, n1 + n2 - 2))
    v1, v2 = safe(s1 * s1, n1), safe(s2 * s2, n2)
    se = F.sqrt(v1 + v2)
    df = F.when((n1 > 1) & (n2 > 1), safe((v1 + v2) * (v1 + v2), safe(v1 * v1, n1 - 1) + safe(v2 * v2, n2 - 1)))
    calc_d = F.when(pooled > 0, safe(m1 - m2, pooled))
    calc_p = 2 * special.t_tail(F.abs(safe(m1 - m2, se)), df)

    @F.pandas_udf("double")
    def critical(x: pd.Series) -> pd.Series:
        known = {v: special.t_ppf(0.975, v) for v in x.dropna().round(6).unique()}
        return x.round(6).map(known)

    half = critical(df) * se
    bad = [F.coalesce(F.abs(calc_d - d) > 0.1, F.lit(False)), F.coalesce(~p_agrees(calc_p, p), F.lit(False)), F.coalesce((F.abs(m1 - m2 - half - ci_low) > 0.5) | (F.abs(m1 - m2 + half - ci_high) > 0.5), F.lit(False))]
    return F.struct(F.when(pooled > 0, ~(bad[0] | bad[1] | bad[2])).otherwise(F.when(pooled == 0, False)).alias("consistent"), calc_d.alias("d"), calc_p.alias("p"), (m1 - m2 - half).alias("ci_low"), (m1 - m2 + half).alias("ci_high"))


_DFS = range(1, 10_001)


def _sizes_of(tests: pd.DataFrame) -> dict[str, np.ndarray]:
    t, n = tests["t"].to_numpy(float), tests["n"].to_numpy(float)
    p = tests["p"].astype(float).to_numpy()
    half = np.array([0.5 * 10.0 ** -(len(x.strip().split(".")[-1]) if "." in x else 0) + 1e-12 for x in tests["p"]], float)

    def at(df):
        return np.where(t == 0, 1.0, special.beta_inc(df / 2, 0.5, df / (df + t * t)))

    def first(holds):  # p falls as df grows, so that the fitting ones are neighbours
        lo, hi = np.zeros(len(t), int), np.full(len(t), len(_DFS))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            yes = holds(at(np.minimum(mid, len(_DFS) - 1) + float(_DFS[0])))
            hi, lo = np.where((lo < hi) & yes, mid, hi), np.where((lo < hi) & ~yes, mid + 1, lo)
        return lo

    low, high = first(lambda x: x <= p + half), first(lambda x: x < p - half)
    own = at(n - 1)
    some = low < high
    return {"plausible": np.abs(own - p) <= half, "p_at_n": own, "n_low": pd.array([int(x) + 2 if s else None for x, s in zip(low, some)], "Int32"), "n_high": pd.array([int(x) + 1 if s else None for x, s in zip(high, some)], "Int32")}


_KNOWN: dict[tuple, tuple] = {}
_KNOWN_AT_MOST = 100_000


def _known(tests: pd.DataFrame) -> pd.DataFrame:
    """_sizes_of, where a worker keeps its last results."""
    keys = list(zip(tests["t"].tolist(), tests["p"].tolist(), tests["n"].tolist()))
    new = [i for i, k in enumerate(keys) if k not in _KNOWN]
    got = {}
    if new:
        r = _sizes_of(tests.iloc[new])
        got = dict(zip([keys[i] for i in new], zip(*(list(v) for v in r.values()))))
    rows = [got[k] if k in got else _KNOWN[k] for k in keys]
    if len(_KNOWN) + len(got) > _KNOWN_AT_MOST:
        _KNOWN.clear()
    if len(got) <= _KNOWN_AT_MOST:
        _KNOWN.update(got)
    out = pd.DataFrame(rows, columns=["plausible", "p_at_n", "n_low", "n_high"]).astype({"plausible": "boolean", "n_low": "Int32", "n_high": "Int32"})
    return tests.reset_index(drop=True).join(out)


def sample_size_from_t(t: Column, p: Column, n: Column) -> Column:
    """Whether the exact two-tailed p at n rounds to the printed p; and the least and largest n up to 10001 that would."""

    @F.pandas_udf("plausible boolean, p_at_n double, n_low int, n_high int")
    def check(ts: pd.Series, ps: pd.Series, ns: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame({"t": ts, "p": ps, "n": ns})
        ok = rows["t"].notna() & rows["p"].notna() & (rows["n"] > 1)
        one = rows[ok].drop_duplicates().reset_index(drop=True)  # each different test once, all at once
        one = _known(one)
        out = rows.merge(one, "left", ["t", "p", "n"])[["plausible", "p_at_n", "n_low", "n_high"]]
        return out.astype({"plausible": "boolean", "n_low": "Int32", "n_high": "Int32"})

    return check(t, p, n)


def anova_groups(groups: Column) -> Column:
    """One-way F of an array of groups (n, mean, sd) with its degrees of freedom; null without two groups or variance, or with a negative SD, which is impossible."""
    add = lambda f: F.aggregate(groups, F.lit(0.0), lambda s, g: s + f(g))
    n, mn = add(lambda g: g["n"].cast("double")), add(lambda g: g["n"] * g["mean"])
    between = add(lambda g: g["n"] * g["mean"] * g["mean"]) - F.try_divide(mn * mn, n)
    within = add(lambda g: (g["n"] - 1) * g["sd"] * g["sd"])
    k = F.size(groups)
    bad = F.exists(groups, lambda g: g["sd"] < 0)
    f = F.when((k > 1) & (n > k) & (within > 0) & ~bad, F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k)))
    return F.struct(f.alias("f"), (k - 1).cast("double").alias("df1"), (n - k).alias("df2"), bad.alias("impossible"))


def chi2_cells(cells: Column) -> Column:
    """Pearson's statistic of a table (array of rows), Yates's of two by two, and the degrees of freedom; null with an empty row or column."""
    rows = F.transform(cells, lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + v))
    cols = F.transform(F.sequence(F.lit(0), F.size(cells[0]) - 1), lambda j: F.aggregate(cells, F.lit(0.0), lambda s, r: s + F.get(r, j)))
    total = F.aggregate(rows, F.lit(0.0), lambda s, v: s + v)

    def stat(off: float) -> Column:
        def cell(i: Column, j: Column) -> Column:
            e = F.try_divide(F.get(rows, i) * F.get(cols, j), total)
            dev = F.greatest(F.abs(F.get(F.get(cells, i), j) - e) - off, F.lit(0.0))
            return F.try_divide(dev * dev, e)

        at = lambda n: F.sequence(F.lit(0), n - 1)
        return F.aggregate(at(F.size(rows)), F.lit(0.0), lambda s, i: s + F.aggregate(at(F.size(cols)), F.lit(0.0), lambda t, j: t + cell(i, j)))

    ok = (F.size(rows) > 1) & (F.size(cols) > 1) & (F.array_min(rows) > 0) & (F.array_min(cols) > 0)
    two = (F.size(rows) == 2) & (F.size(cols) == 2)
    return F.struct(F.when(ok, stat(0.0)).alias("chi2"), F.when(ok & two, stat(0.5)).alias("yates"), ((F.size(rows) - 1) * (F.size(cols) - 1)).cast("double").alias("df"))


def _near(value, reported, least: float, share: float) -> bool:
    return pd.isna(reported) or abs(value - reported) <= max(least, share * abs(reported))


def _p_near(p: float, reported) -> bool:
    return pd.isna(reported) or 0.1 < max(p, 1e-20) / max(reported, 1e-20) < 10


@F.pandas_udf(BooleanType())
def anova_fits(f: pd.Series, df1: pd.Series, df2: pd.Series, reported: pd.Series, p: pd.Series) -> pd.Series:
    """Whether an F is within 0.1 or a tenth of the reported one, and its p within a factor of ten; each where reported."""
    rows = zip(f, df1, df2, reported, p)
    return pd.Series([None if pd.isna(x) else _near(x, r, 0.1, 0.1) and _p_near(special.beta_inc1(b / 2, a / 2, b / (b + a * x)), q) for x, a, b, r, q in rows], dtype="boolean")


@F.pandas_udf(BooleanType())
def chi2_fits(chi2: pd.Series, yates: pd.Series, df: pd.Series, reported: pd.Series, p: pd.Series) -> pd.Series:
    """Whether either statistic is within 0.1 or a twentieth of the reported one, with its p within a factor of ten; each where reported."""
    fits = lambda x, d, r, q: not pd.isna(x) and _near(x, r, 0.1, 0.05) and _p_near(float(special.chi2_sf(x, d)), q)
    return pd.Series([None if pd.isna(x) else bool(fits(x, d, r, q) or fits(y, d, r, q)) for x, y, d, r, q in zip(chi2, yates, df, reported, p)], dtype="boolean")


# --- exact existence of integer data


def integers_exist(k, s, q, lo, hi, *, budget: int = 200_000) -> bool | None:
    """Whether k integers from lo to hi have the sum s and the sum of squares q; None once the budget of states is spent.

    The last two are solved for; of the others, the one tried next is as near the mean of what is left as its spread allows.
    """
    dead: set[tuple[int, int, int]] = set()

    def search(k: int, s: int, q: int) -> bool | None:
        if s < k * lo or s > k * hi or q * k < s * s or q > (lo + hi) * s - k * lo * hi or (q - s) % 2:
            return False
        if k < 2:
            return q == s * s
        if k == 2:
            r = math.isqrt(max(0, 2 * q - s * s))
            return r * r == 2 * q - s * s and (s + r) % 2 == 0 and lo <= (s - r) // 2 and (s + r) // 2 <= hi
        if (k, s, q) in dead:
            return False
        if len(dead) >= budget:
            return None
        spread = math.sqrt(max(0.0, (k - 1) / k * (q - s * s / k))) + 1
        # the largest value left is at least one deviation above the mean
        for v in range(min(hi, math.floor(s / k + spread)), max(lo, math.ceil(s / k)) - 1, -1):
            got = search(k - 1, s - v, q - v * v)
            if got is not False:
                return got
        dead.add((k, s, q))
        return False

    return search(k, s, q)


def grimmer_one(mean: str, sd: str, n: int, scale: float = 1.0) -> bool | None:
    """Whether a printed mean and SD are possible for n integers times scale; None if that can't be told."""
    if n is None or n < 2:
        return None
    dps = [len(x.strip().split(".")[-1]) if "." in x else 0 for x in (mean, sd)]
    m, s = float(mean) / scale, float(sd) / scale
    if s < 0:
        return False
    hm, hs = 0.5 * 10.0 ** -dps[0] / scale, 0.5 * 10.0 ** -dps[1] / scale
    sums = range(math.ceil((m - hm) * n - EPS * n), math.floor((m + hm) * n + EPS * n) + 1)
    unknown = False
    for total in sums:
        lo = max(0.0, s - hs) ** 2 * (n - 1) + total * total / n
        hi = (s + hs) ** 2 * (n - 1) + total * total / n
        for q in range(math.ceil(lo - EPS), math.floor(hi + EPS) + 1):
            if (q - total) % 2 or q * n < total * total:
                continue
            if n > 30:  # so many integers reach any sum of squares of the right parity
                return True
            center, dev = total // n, math.isqrt(max(0, q - total * total // n)) + 1
            got = integers_exist(n, total - center * n, q - 2 * center * total + n * center * center, -dev, dev + 1)
            if got:
                return True
            unknown |= got is None
    return None if unknown else False


def sprite_one(mean: str, sd: str, n: int, lo: int, hi: int) -> bool | None:
    """Whether n integers from lo to hi have the printed mean and SD: exact, so nothing is searched at random."""
    if n is None or n < 2:
        return None
    dps = [len(x.strip().split(".")[-1]) if "." in x else 0 for x in (mean, sd)]
    m, s = float(mean), float(sd)
    if s < 0:
        return False
    hm, hs = 0.5 * 10.0 ** -dps[0], 0.5 * 10.0 ** -dps[1]
    unknown = False
    for total in range(max(math.ceil((m - hm) * n - EPS), lo * n), min(math.floor((m + hm) * n + EPS), hi * n) + 1):
        a = max(0.0, s - hs) ** 2 * (n - 1) + total * total / n
        b = (s + hs) ** 2 * (n - 1) + total * total / n
        for q in range(math.ceil(a - EPS), math.floor(b + EPS) + 1):
            if (q - total) % 2 == 0:
                got = integers_exist(n, total, q, lo, hi)
                if got:
                    return True
                unknown |= got is None
    return None if unknown else False


def _bool_udf(f, *cols: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(*xs: pd.Series) -> pd.Series:
        out = []
        for row in zip(*xs):
            out.append(None if any(v is None or v != v for v in row) else f(*[int(v) if isinstance(v, (np.integer, float)) else v for v in row]))
        return pd.Series(out, dtype="boolean")

    return check(*cols)


def grimmer(mean: Column, sd: Column, n: Column, scale: float = 1.0) -> Column:
    return F.struct(_bool_udf(lambda a, b, c: grimmer_one(a, b, c, scale), mean, sd, n).alias("possible"))


def sprite(mean: Column, sd: Column, n: Column, lo: Column, hi: Column) -> Column:
    return F.struct(_bool_udf(sprite_one, mean, sd, n, lo, hi).alias("possible"))


# --- verdicts


def verdict(kind: str, outcome: Column, detail: Column | None = None) -> Column:
    """PASS, FLAG, FAIL or UNDETERMINED. kind: possible, plausible, consistent (three-valued), suspicious (boolean) or flags (array of text).

    A detail that says FLAG or FAIL itself decides what false means.
    """
    if kind == "suspicious":
        return F.when(outcome, "FLAG").when(~outcome, "PASS").otherwise("UNDETERMINED")
    if kind == "flags":
        hard = F.exists(outcome, lambda x: F.upper(x).contains("IMPOSSIBLE"))
        return F.when(outcome.isNull() | (F.size(outcome) == 0), "PASS").when(hard, "FAIL").otherwise("FLAG")
    default = {"possible": "FAIL", "plausible": "FAIL", "consistent": "FLAG"}[kind]
    bad = F.lit(default) if detail is None else F.when(detail.startswith("FLAG"), "FLAG").when(detail.startswith("FAIL"), "FAIL").otherwise(default)
    return F.when(outcome.isNull(), "UNDETERMINED").when(outcome, "PASS").otherwise(bad)
