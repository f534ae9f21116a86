"""Extraction of reported statistics from text into rows. Offsets are needed, so Python's regular expressions run over Arrow batches."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import special
from scholium.runtime import ship


def _loose(*parts: str, flags: int = re.I) -> re.Pattern:
    """The parts one after the other, with any white space between them."""
    return re.compile(r"\s*".join(parts), flags)


_COUNT, _REAL, _POINT = r"(\d+)", r"(\d+(?:\.\d+)?)", r"(\d+\.\d+)"
_PLACES = "{1,3}"
_CELL = rf"(\d{_PLACES}\.\d{_PLACES})"  # as tables print them
_RATIO = rf"(\d+\.\d{_PLACES})"
_TOTAL = r"(?:,\s*N" + r"\s*=\s*\d+)?"
_OPEN, _CLOSE, _IS = r"\(", r"\)", "[≈=]"
_P = _loose(r"\bp[-\s]?(?:value)?[-\s]?([≤≥<=>])", r"(\d+\.\d+e" + r"[-+]?\d+|0?\.\d+)")
#: Adjacent test statistics, later kinds only where they end later.
_STATS = [
    ("t", _loose(r"\bt", _OPEN, _REAL, _CLOSE, _IS, "(-?" + _POINT[1:])),
    ("F", _loose(r"\bF", _OPEN, _COUNT, ",", _COUNT, _CLOSE, _IS, _POINT)),
    ("chi2", _loose(r"(?:χ[²2]|chi[-\s]?(?:2|sq(?:uared?)?))", _OPEN, _COUNT + _TOTAL, _CLOSE, _IS, _POINT)),
    ("r", _loose(r"\br", _OPEN, _COUNT, _CLOSE, _IS, r"(-?\d*\.\d+)")),
]
_LEVEL = r"\s*".join(["(?:95", "%?", "CI?", "[:=]?", ")?"])
_EFFECT = _loose(r"\b(a?(?:HR|OR|RR))\b", "[:=]?", _RATIO, r"[\[(,;\s]+" + _LEVEL + _RATIO, r"[–\-\sto]+", _RATIO)
_MEAN_SD = _loose(r"(?<![.\w])" + _CELL, r"(?:[(±\[]|\s)", _CELL, flags=0)
_SIZE = r"(\d{2,4})\b"
#: Every kind of white space, as the JVM writes it: texts that have none of what is looked for stay there.
_GAP = r"[\s\p{Z}\x1c-\x1f\x85]"
_N = _loose(r"\bn", "[:=]", _SIZE)
_COHORT = _loose(r"\bn", "=", _SIZE)
_FUNDING = re.compile("grant|funding|(?:funded|sponsored|supported) by", re.I)
_COI = re.compile("coi statement|disclosures?|(?:competing|conflicts? of) interests?", re.I)
#: Company names and phrases that mark an industry link; sorted, and to be extended by the caller.
INDUSTRY = "advisory board|alector|amgen|amylyx|annexon|astrazeneca|biogen|brainstorm|clene|consulting fees|cytokinetics|denali|glaxosmithkline|gsk|honoraria|inc\\.|industry|ionis|llc|merck|novartis|orphazyme|pfizer|pharmaceuticals?|prilenia|roche|s\\.a\\.|sanofi|sponsored|takeda|treeway|wave\\s+life"
_STRONGLY = r"(?:statistically\s+)?"
_SIG = re.compile(rf"\b{_STRONGLY}significant(?:ly)?\b" + r"(?!\s*(?:different|higher|lower))", re.I)
_NOT_SIG = re.compile(r"\b(?:ns\b|non[ -]?significant|no\s+significant|" + rf"not\s+{_STRONGLY}significant)", re.I)
_PROPER = r"[A-Z][a-z]+"
_AUTHOR = re.compile(rf"\b({_PROPER}(?:[ '-]{_PROPER})*),?\s+" + rf"(?:[A-Z]\.?\s*){_PLACES}")


def _rows(df: DataFrame, key: str, text: str, schema: str, f, when: str | None = None) -> DataFrame:
    """Rows that f makes of each text, with the key first; a null text counts as empty. Only texts that match `when` are sent to Python at all."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = [(k, *row) for k, t in zip(pdf[key], pdf[text]) for row in f(t or "")]
            yield pd.DataFrame(out, columns=[key, *names])

    rows = df.select(key, text) if when is None else df.select(key, text).where(F.col(text).rlike(when))
    return rows.mapInPandas(run, f"`{key}` {kind}, {schema}")


def _around(text: str, m: re.Match, width: int = 60) -> str:
    """A match with the characters around it, on one line."""
    a, b = m.span()
    return " ".join(text[max(0, a - width) : b + width].split("\n"))


def nearby_stat(text: str, at: int, window: int = 200):
    """The test statistic that ends last in the characters before a place."""
    best = None
    for kind, pattern in _STATS:
        for m in pattern.finditer(text, max(0, at - window), at):
            if best is None or m.end() > best[2] or (kind == "t" and best[0] == "t"):
                best = (kind, [float(x) for x in m.groups()], m.end())
    return best


def pvalues(df: DataFrame, key: str = "pmid", text: str = "text") -> DataFrame:
    """(key, p_reported, p_str, op, test_type, test_params, context_excerpt) of each p-value from 0 (not included) to 1."""

    def f(t):
        for m in _P.finditer(t):
            p = float(m.group(2))
            if 0 < p <= 1:
                s = nearby_stat(t, m.start())
                yield p, m.group(2), m.group(1), s[0] if s else None, s[1] if s else None, _around(t, m)

    return _rows(df, key, text, "p_reported double, p_str string, op string, test_type string, test_params array<double>, context_excerpt string", f, rf"(?i)p(?:-|{_GAP})*(?:value)?(?:-|{_GAP})*[≤≥<=>]")


def effects(df: DataFrame, key: str = "pmid", text: str = "text") -> DataFrame:
    """Ratios with intervals: (key, kind, estimate, ci_lo, ci_hi, ci_consistent, excludes_null, implausibly_wide, width_over_est)."""

    def f(t):
        for m in _EFFECT.finditer(t):
            est, *ends = map(float, m.groups()[1:])
            lo, hi = sorted(ends)
            if min(est, lo) > 0:
                w = (hi - lo) / max(est, 0.1)
                yield m.group(1), est, lo, hi, lo <= est <= hi, lo > 1 or hi < 1, w > 5, round(w, 2)

    return _rows(df, key, text, "kind string, estimate double, ci_lo double, ci_hi double, ci_consistent boolean, excludes_null boolean, implausibly_wide boolean, width_over_est double", f, "(?i)(?<![a-z])a?(?:hr|or|rr)(?![a-z])")


def triples(df: DataFrame, key: str = "pmid", text: str = "text", lines: int = 20, max_n: int = 2000, max_mean: float = 100.0) -> DataFrame:
    """(key, mean, sd, n_used, n_candidates, decimals): means with SDs, and the first n in the text within `lines` lines of them."""

    def f(t):
        starts = np.cumsum([0] + [len(x) + 1 for x in t.split("\n")])
        line = lambda at: int(np.searchsorted(starts, at, side="right")) - 1
        ns = [(line(m.start()), int(m.group(1))) for m in _N.finditer(t) if 5 <= int(m.group(1)) <= max_n]
        seen = set()
        for m in _MEAN_SD.finditer(t):
            mean, sd = map(float, m.groups())
            near = [n for i, n in ns if abs(i - line(m.start())) <= lines]
            if mean <= max_mean and near and (mean, sd, near[0]) not in seen:
                seen.add((mean, sd, near[0]))
                yield mean, sd, near[0], sorted(set(near)), len(m.group(1).split(".")[1])

    return _rows(df, key, text, "mean double, sd double, n_used int, n_candidates array<int>, decimals int", f, rf"(?i)n{_GAP}*[:=]")


def papers(df: DataFrame, key: str = "pmid", text: str = "text", industry: str = INDUSTRY) -> DataFrame:
    """One row a text: funding class, authors' surnames, cohort size, and mentions of significance."""
    linked = re.compile(rf"\b(?:{industry})\b", re.I)

    def f(t):
        fund, coi = [m.start() for m in _FUNDING.finditer(t)], [m.start() for m in _COI.finditer(t)]
        ind = any(linked.search(t, at, at + 500) for at in fund + coi)
        cls = "industry_linked" if ind else "public_disclosed" if fund and coi else "partial" if fund or coi else "none_stated"
        names: list[str] = []
        for m in _AUTHOR.finditer(t[:3000]):
            if len(m.group(1)) >= 3 and m.group(1).lower() not in ("abstract", "article", "introduction") and m.group(1) not in names:
                names.append(m.group(1))
            if len(names) >= 12:
                break
        cohort = [int(x) for x in _COHORT.findall(t[:5000]) if 20 <= int(x) <= 5000]
        sig, non = len(_SIG.findall(t)), len(_NOT_SIG.findall(t))
        yield cls, ind, names, max(cohort) if cohort else None, sig, non, sig / (sig + non) if sig + non else None

    return _rows(df, key, text, "funding_classification string, industry_linked boolean, authors array<string>, cohort_size int, n_significant long, n_not_significant long, positivity_ratio double", f)


# --- tests reported in full, recomputed

_DF = r"\d+(?:\.\d+)?"
_PLAIN = r"(?:\.\d+|\d+(?:\.\d+)?)"
_TAIL = [_IS, rf"(?P<val>[−-]?{_PLAIN})", "[;,]", rf"(?:[Pp]\s*(?P<op>[<=>≈])\s*(?P<p>{_PLAIN})|(?:[Pp]\s*=" + r"\s*)?(?P<ns>ns)\b)"]
_BEFORE = "(?<![0-9A-Za-z_])"
_HEADS = {
    "t": ["t", _OPEN, rf"(?P<a>{_DF})", _CLOSE], "F": ["F", _OPEN, rf"(?P<a>{_DF})", ",", rf"(?P<b>{_DF})", _CLOSE],
    "chi2": [r"(?:[xX]2|[Χχ]\s?[²2]|chi-squared?|chi2)", _OPEN, rf"(?P<a>{_DF})", _TOTAL + r"\s*" + _CLOSE], "r": ["r", _OPEN, rf"(?P<a>{_DF})", _CLOSE], "z": ["z"],
}
_TESTS = [(k, _loose(_BEFORE + h[0], *h[1:], *_TAIL, flags=0)) for k, h in _HEADS.items()]
ALPHA, _EPS = 0.05, 1e-12


def _dp(s: str) -> int:
    return len(s.split(".")[-1]) if "." in s else 0


def find_tests(t: str) -> list[dict]:
    """Reported tests in order; of overlapping ones the earliest, then the longest."""
    got = []
    for kind, pattern in _TESTS:
        for m in pattern.finditer(t):
            g = m.groupdict()
            got.append({"stat": kind, "df1": g.get("a"), "df2": g.get("b"), "value": g["val"].replace("−", "-"), "op": "ns" if g["ns"] else "=" if g["op"] == "≈" else g["op"], "p": g["p"] if not g["ns"] else None, "anchor": m.group(0), "start": m.start(), "end": m.end()})
    out, end = [], -1
    for e in sorted(got, key=lambda e: (e["start"], -e["end"])):
        if e["start"] >= end:
            out.append(e)
            end = e["end"]
    return out


@lru_cache(maxsize=1 << 16)
def recompute(stat: str, v: float, d1: float | None, d2: float | None) -> float:
    """Two-tailed p of a statistic."""
    if stat == "z":
        return math.erfc(abs(v) / math.sqrt(2))
    if stat == "F":
        return special.beta_inc1(d2 / 2, d1 / 2, d2 / (d2 + d1 * v))
    if stat == "chi2":
        return float(special.chi2_sf(v, d1))
    t = v if stat == "t" else v * math.sqrt(d1 / (1 - v * v))
    return special.beta_inc1(d1 / 2, 0.5, d1 / (d1 + t * t))


def p_range(e: dict) -> tuple[float, float]:
    """Least and largest p over all values that round to what is printed."""
    v, h = float(e["value"]), 0.5 * 10.0 ** -_dp(e["value"])
    lo, hi = v - h, v + h
    near, far = sorted((abs(lo), abs(hi)))
    vs = [max(0.0, lo), hi] if e["stat"] in ("F", "chi2") else [0.0 if lo <= 0 <= hi else near, far]
    if e["stat"] == "r":
        vs = [min(x, 1 - 1e-9) for x in vs]
    ds = []
    for d in (e["df1"], e["df2"]):
        w = 0.5 * 10.0 ** -_dp(d) if d and "." in d else 0
        ds.append([None] if d is None else [float(d)] if not w else [max(float(d) - w, 1e-9), float(d) + w])
    ps = [recompute(e["stat"], x, a, b) for x in vs for a in ds[0] for b in ds[1]]
    return min(ps), max(ps)


def _agrees(lo: float, hi: float, op: str, p: str | None) -> bool:
    if op == "ns":
        return hi > ALPHA - _EPS
    q = float(p)
    h = 0.5 * 10.0 ** -_dp(p)
    return {"=": lo <= q + h + _EPS and hi >= max(0.0, q - h) - _EPS, "<": lo < q + _EPS, ">": hi > q - _EPS}[op]


def judge(e: dict) -> tuple[str, float | None, float | None]:
    """(verdict, least p, largest p). Only an impossible statistic, or a decision that flips whatever the rounding, is a FAIL."""
    v, p = float(e["value"]), None if e["p"] is None else float(e["p"])
    if p is not None and not 0 <= p <= 1:
        return "UNDETERMINED", None, None
    if e["stat"] == "r" and abs(v) - 0.5 * 10.0 ** -_dp(e["value"]) >= 1 - _EPS:
        return "FAIL", None, None
    if any(d is not None and float(d) <= 0 for d in (e["df1"], e["df2"])) or (e["stat"] in ("F", "chi2") and v < 0):
        return "FAIL", None, None
    lo, hi = p_range(e)
    if not (lo == lo and hi == hi):
        return "UNDETERMINED", None, None
    if _agrees(lo, hi, e["op"], e["p"]):
        return "PASS", lo, hi
    if e["stat"] in ("t", "r", "z") and _agrees(lo / 2, hi / 2, e["op"], e["p"]):
        return "FLAG", lo, hi
    op = e["op"]
    claim = False if op == "ns" else (True if p <= ALPHA + _EPS else None) if op == "<" else (False if p >= ALPHA - _EPS else None) if op == ">" else True if p < ALPHA - _EPS else False if p > ALPHA + _EPS else None
    side = False if lo > ALPHA + _EPS else True if hi < ALPHA - _EPS else None
    return ("FAIL" if claim is not None and side is not None and claim != side else "FLAG"), lo, hi


def reported_tests(df: DataFrame, key: str = "pmid", text: str = "text") -> DataFrame:
    """(key, stat, df1, df2, value, p_op, p, verdict, p_low, p_high, anchor, start) of each test reported in full."""

    def f(t):
        for e in find_tests(t):
            verdict, lo, hi = judge(e)
            yield e["stat"], *(None if x is None else float(x) for x in (e["df1"], e["df2"], e["value"])), e["op"], None if e["p"] is None else float(e["p"]), verdict, lo, hi, e["anchor"], e["start"]

    return _rows(df, key, text, "stat string, df1 double, df2 double, value double, p_op string, p double, verdict string, p_low double, p_high double, anchor string, start int", f)


def finding_counts(findings: DataFrame, by: str = "source") -> DataFrame:
    return findings.groupBy(by).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in "PASS FLAG FAIL UNDETERMINED".split()])
