"""Strength of claims, and where hedges drop between parts of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers, each counted once a sentence; kept sorted.
HEDGES = sorted(["is likely", "may", "might", "could", "seems to", "suggests", "tends to", "possibly", "appears to", "potentially", "we hypothesize", "is consistent with", "it is possible that", "not inconsistent with"])
AMPLIFIERS = sorted(["is not", "shows", "proves", "we show", "excludes", "confirms", "rules out", "establishes", "definitively", "demonstrates", "this establishes", "our results demonstrate"])
CAUSAL = sorted(["causes", "drives", "explains", "leads to", "underlies", "determines", "results in", "is responsible for"])


def hits(sentence: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur, as whole words. Only for those that the sentence holds in any case is a pattern tried."""

    def count(x: Column) -> Column:
        n = F.lit(0)
        for p in phrases:
            n = n + (x["low"].contains(p) & x["own"].rlike(rf"(?i)\b{re.escape(p)}\b")).cast("int")
        return n

    return F.get(F.transform(F.array(F.struct(F.lower(sentence).alias("low"), sentence.alias("own"))), count), F.lit(0))  # a lambda over one element, so that it is lowered once


def claim_strength(sentence: Column) -> Column:
    """From 0, all hedges, to 1, none; without markers 0.3 and a hundredth a word, 0.5 at most."""
    h, s = hits(sentence, HEDGES), hits(sentence, AMPLIFIERS) + hits(sentence, CAUSAL)
    n = F.size(F.filter(F.split(F.trim(sentence), r"\s+"), lambda w: w != ""))
    score = lambda x: F.when(x["h"] + x["s"] == 0, F.least(F.lit(0.5), F.lit(0.3) + F.lit(0.01) * x["n"])).otherwise(((x["s"] - x["h"]) / (x["h"] + x["s"]) + 1) / 2)
    return F.get(F.transform(F.array(F.struct(h.alias("h"), s.alias("s"), n.alias("n"))), score), F.lit(0))


def section_strength(sentences: DataFrame, by: list[str], sentence: str = "sentence") -> DataFrame:
    s = F.col(sentence)
    return sentences.groupBy(*by).agg(F.avg(claim_strength(s)).alias("mean_strength"), F.sum(hits(s, HEDGES)).alias("hedges"), F.sum(hits(s, AMPLIFIERS)).alias("amplifiers"), F.sum(hits(s, CAUSAL)).alias("causal"), F.count("*").alias("n_sentences"))


def escalations(sentences: DataFrame, doc: str, pos: str, threshold: float, sentence: str = "sentence", least: float = 0.5) -> DataFrame:
    """(doc, late, n_weaker, weakest): sentences of at least `least` strength after ones weaker by the threshold, how many these are, and the weakest's strength.

    Each later sentence is compared with the strengths before it through a count of them, not pair by pair: strengths are rounded to a thousandth.
    """
    from pyspark.sql import Window

    s = sentences.select(doc, pos, F.round(claim_strength(F.col(sentence)), 3).alias("strength"))
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    w = s.withColumn("weakest", F.min("strength").over(before))
    return w.where((F.col("strength") >= least) & (F.col("strength") - F.col("weakest") >= threshold - 1e-9)).select(doc, F.col(pos).alias("late"), "strength", "weakest", F.round(F.col("strength") - F.col("weakest"), 3).alias("delta"))


def overclaiming_score(hedge_drop: Column, scope_gap: Column, support: Column) -> Column:
    """Half by dropped hedges, half by conclusions without support; the latter counts 0 where nothing was compared."""
    scope = F.when(support > 0, F.least(scope_gap, F.lit(1.0))).otherwise(0.0)
    return 0.5 * F.least(2 * hedge_drop, F.lit(1.0)) + 0.5 * scope


#: Words of kinds of study, by which the first 20000 characters are told; sorted within each.
_KINDS = [
    ("rct", ["double[- ]blind", "intention[- ]to[- ]treat", "placebo[- ]controlled", "randomi[sz]ed controlled trial", "randomly assigned", r"\brct\b"]),
    ("review", ["a review of", "application and prospect", "literature review", "narrative review", "overview of", "prospect of", "scoping review", "state[- ]of[- ]the[- ]art", "systematic review"]),
    ("discovery", ["atlas of", "drug mechanism", "enhancer hijack", "genome[- ]wide association", "immunometabolic", "mendelian randomi", "molecular characterization", "multi[- ]omics", "quantitative trait loci", "single[- ]cell", "structural variation", "transcriptomic atlas", r"\bgwas\b"]),
    ("method", ["image reconstruction", "segmentation", "super[- ]resolution", "surface reconstruction", "vessel reconstruction", r"\bregistration\b"]),
    ("prognostic", ["hazard ratio", "predict[a-z ]{0,25}(?:conversion|decline|impairment|mortality|onset|outcome|progression|recurrence|survival|treatment response)", "prognos", "recurrence prediction", "risk of (?:conversion|developing|progression)", "survival analysis", "time[- ]to[- ]event"]),
    ("diagnostic_ml", ["classif", "detect", "diagnos", "differentiat", "disease staging", "distinguish", "grading", "screen for", "screening", "tumou?r staging"]),
    ("method", ["benchmark", "foundation model", "new architecture", "novel framework", "we present a (?:framework|method|model)", "we propose"]),
]
_VALIDITY = {
    "external_validation": ["external (?:cohort|dataset|test|validation)", "held[- ]out", "independent (?:cohort|dataset|test|validation)", "multi[- ]?cent(?:er|re)", "multi[- ]?site", "out[- ]of[- ]distribution", "prospective validation"],
    "reports_ci": [r"95%\s*ci", "bootstrap", "confidence interval", "credible interval"],
    "imbalance_addressed": ["class weight", "imbalanc", "oversampl", "resampl", "smote", "stratified", "undersampl", "weighted (?:cross|loss|sampl)"],
    "leakage_addressed": ["data leakage", "group[- ]wise", "grouped (?:cross|k[- ]?fold|split)", "patient[- ]level split", "prevent[a-z ]{0,20}leakage", "subject[- ]wise"],
}
_MIMIC = ["differential diagnos", "differentiat[a-z ]+from", "disease control", "distinguish[a-z ]+from", "mimic", "other [a-z]+ (?:condition|disease|disorder)"]
_HEALTHY = ["healthy control", "healthy subject", "healthy volunteer", "normal control", "typically[- ]developing"]


def _any(words: list[str]) -> str:
    return "(?i)" + "|".join(words)


def study_type(text: Column) -> Column:
    """The first kind whose words the first 20000 characters have: those that merely mention a diagnosis are told apart first."""
    t = F.substring(text, 1, 20000)
    out = F.when(t.rlike(_any(_KINDS[0][1])), _KINDS[0][0])
    for kind, words in _KINDS[1:]:
        out = out.when(t.rlike(_any(words)), kind)
    return out.otherwise("other")


def ml_validity(text: Column) -> Column:
    """What a paper says of validation, intervals, imbalance and leakage, and with whom patients are compared: mimics are harder than the healthy."""
    comparator = F.when(text.rlike(_any(_MIMIC)), "mimic_differential").when(text.rlike(_any(_HEALTHY)), "healthy_easy").otherwise("unclear")
    return F.struct(*[text.rlike(_any(w)).alias(k) for k, w in _VALIDITY.items()], comparator.alias("comparator"))
