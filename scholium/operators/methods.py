"""Methods named in texts, methods that go with them, the resolution that methods and conclusions speak of, and an overall verdict."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.runtime import BROADCAST_ROWS, ship

#: ecosystem: method = resolutions: aliases besides its name. Callers may bring their own.
REGISTRY = """
beast: Bayesian Skyline / Skygrid = temporal: bayesian skygrid, bayesian skyline, skygrid, skyline
beast: BEAST Phylodynamics = temporal: beast, beast2
beast: BSSVS = cross_sectional temporal: bssvs
beast: Discrete Trait Analysis = cross_sectional temporal:
bayes: Approximate Bayesian Computation = aggregate: abc
bayes: MCMC = aggregate individual: markov chain monte carlo
bayes: R-INLA = individual spatial: inla
bayes: Stan / brms = aggregate individual: brms, stan
causal: Difference-in-Differences = aggregate temporal: diff-in-diff
causal: Instrumental Variable = aggregate: instrumental variables
causal: Mendelian Randomization = aggregate individual: mr
causal: Propensity Score Matching = individual: propensity score
epigenomics: ATAC-seq = genome_wide site_specific: atacseq
epigenomics: Bismark = genome_wide site_specific: methylation
epigenomics: ChIP-seq = genome_wide site_specific: chipseq, macs2
expression: DESeq2 = gene_wide individual: deseq
expression: edgeR = gene_wide individual:
expression: GSEA = aggregate: gene set enrichment
expression: limma-voom = gene_wide individual: limma, voom
hyphy: aBSREL = gene_wide: adaptive branch-site
hyphy: BUSTED = gene_wide: branch-site unrestricted statistical test
hyphy: FADE = site_specific:
hyphy: FEL = site_specific: fixed effects likelihood
hyphy: FUBAR = site_specific: fast unconstrained bayesian approximation
hyphy: MEME = site_specific: hyphy meme, mixed effects model of evolution
hyphy: PRIME = site_specific:
hyphy: RELAX = genome_wide: hyphy relax, relax framework
hyphy: SLAC = site_specific: single-likelihood ancestor counting
learning: Clustering = aggregate: dbscan, hierarchical clustering, k-means, kmeans
learning: PCA = aggregate: principal component analysis
learning: Random Forest = individual: gradient boosting, xgboost
learning: UMAP / t-SNE = aggregate: t-sne, tsne, umap
metagenomics: HUMAnN = aggregate gene_wide:
metagenomics: MetaPhlAn / Kraken2 = aggregate individual: kraken, kraken2, metaphlan
metagenomics: QIIME 2 = aggregate individual: qiime, qiime2
networks: GENIE3 = individual network: scenic
networks: STRING = network: ppi
networks: WGCNA = gene_wide network:
paml: baseml = genome_wide:
paml: codeml branch = gene_wide: branch model
paml: codeml branch-site = gene_wide site_specific: branch-site model
paml: codeml site = site_specific: codeml, m1a, m2a, m7, m8, paml, site model
phylogenetics: ape::ace = cross_sectional: ace
phylogenetics: diversitree = temporal:
phylogenetics: PGLS = cross_sectional: phylogenetic generalized least squares
phylogenetics: phytools = cross_sectional temporal:
population: ADMIXTURE = aggregate individual: structure
population: EHH / iHS = genome_wide site_specific: ehh, extended haplotype, ihs
population: Fst = aggregate genome_wide:
population: Site Frequency Spectrum = aggregate genome_wide: sfs
population: Tajima's D = gene_wide genome_wide: tajima
single_cell: CellRank = single_cell temporal:
single_cell: Scanpy / Seurat = aggregate single_cell: scanpy, seurat
single_cell: scVelo = single_cell temporal: rna velocity
structures: AlphaFold / ColabFold = individual site_specific: alphafold, colabfold
structures: Molecular Docking = site_specific: autodock
structures: Molecular Dynamics = site_specific temporal: md simulation
survival: Competing Risks = individual: fine-gray
survival: Cox Regression = individual: proportional hazards
survival: Kaplan-Meier = aggregate: product-limit
"""
#: Aliases that alone say nothing; words that are names of tools only in capitals; of these, concepts too, which need words of use nearby.
DISABLED, CAPITALS, CONTEXT = {"mr"}, {"admixture", "fade", "relax", "string", "structure"}, {"admixture", "string", "structure"}
_USE = re.compile(r"\b(?:" + "|".join(sorted("algorithm analysis applied computed estimated fit fitted framework implemented method model package performed pipeline program ran run software tool used using".split(), reverse=True)) + r")\b", re.I)
NEARBY = 90
COARSE = sorted("aggregate|average|bulk|distribution|frequency|general|global|mean|overall|pooled|prevalence|proportion|trend".split("|"))
FINE = sorted("codon|deletion|haplotype|individual|insertion|locus|point mutation|position|residue|site-specific|substitution|variant".split("|"))


def registry(spark: SparkSession) -> DataFrame:
    """(ecosystem, method, resolution, alias): a row an alias, the method's own name among them."""
    rows = []
    for line in REGISTRY.strip().split("\n"):
        eco, method, levels, aliases = re.fullmatch(r"(\w+): (.+?) = ([\w ]+):(.*)", line).groups()
        rows += [(eco, method, levels.split(), x) for x in dict.fromkeys([method.lower(), *[a.strip() for a in aliases.split(",") if a.strip()]])]
    return spark.createDataFrame(rows, "ecosystem string, method string, resolution array<string>, alias string")


def _capital(x: str) -> bool:
    return x.upper() == x and any(map(str.isalpha, x))


def verdict(text: str, alias: str, method: str, at: int, end: int) -> str:
    """accepted, or why a mention isn't taken for the method's use."""
    got = text[at:end]
    if alias in DISABLED:
        return "bare_alias_disabled"
    if (alias in CAPITALS or (method.isupper() and alias.isalpha())) and not _capital(got):
        return "requires_capitals"
    short = len(re.sub("[^a-zA-Z0-9]", "", alias)) <= 3
    if short and not _capital(got):
        return "requires_capitals"
    if (short or alias in CONTEXT) and not _USE.search(text, max(0, at - NEARBY), end + NEARBY):
        return "no_words_of_use_nearby"
    return "accepted"


_ALIASES_AT_MOST = 20_000


def _entries(reg: DataFrame) -> list[tuple[str, str, str]]:
    rows = reg.select("alias", "ecosystem", "method").distinct().orderBy("ecosystem", "method", "alias").limit(_ALIASES_AT_MOST + 1).collect()
    if len(rows) > _ALIASES_AT_MOST:
        raise ValueError("a registry of too many aliases to look for one by one")
    return [tuple(r) for r in rows]


def candidates(docs: DataFrame, reg: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ecosystem, method, alias, at, matched, reason): the first mention of each alias as whole words, and whether it's accepted. at is from 0."""
    names = [(a, e, m, re.compile(rf"(?<!\w){re.escape(a)}(?!\w)", re.I)) for a, e, m in _entries(reg)]
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<ecosystem:string,method:string,alias:string,at:int,matched:string,reason:string>>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            low = (t or "").lower()
            out.append([{"ecosystem": e, "method": n, "alias": a, "at": m.start(), "matched": m.group(), "reason": verdict(t, a, n, *m.span())} for a, e, n, p in names if a in low and (m := p.search(t))])
        return pd.Series(out)

    return docs.select(key, F.explode(find(F.col(text))).alias("c")).select(key, "c.*")


def detect(docs: DataFrame, reg: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ecosystem, method, at): methods that are accepted in a text, each once, and where first."""
    return candidates(docs, reg, key, text).where("reason = 'accepted'").groupBy(key, "ecosystem", "method").agg(F.min("at").alias("at"))


def identify(names: DataFrame, reg: DataFrame, name: str = "name") -> DataFrame:
    """names with `ecosystem` and `method`: of the alias it is; else of the longest that it holds or that holds it; null if none."""
    entries = _entries(reg)
    exact = {a: (e, m) for a, e, m in reversed(entries)}

    @F.pandas_udf("ecosystem string, method string")
    def f(xs: pd.Series) -> pd.DataFrame:
        out = []
        for x in xs:
            q = " ".join((x or "").lower().split())
            near = max(((len(a), e, m) for a, e, m in entries if q and (a in q or q in a)), key=lambda v: v[0], default=(0, None, None))
            out.append(exact.get(q) or near[1:])
        return pd.DataFrame(out, columns=["ecosystem", "method"])

    return names.withColumn("__f", f(F.col(name))).select(*names.columns, "__f.ecosystem", "__f.method")


def missing(detected: DataFrame, reg: DataFrame, key: str, required: DataFrame | None = None) -> DataFrame:
    """(key, ecosystem, method, priority): methods of ecosystems that a text uses which it doesn't name; high if they resolve what the text's question requires (required: key, resolution) and its methods don't, else medium."""
    m = reg.select("ecosystem", "method", "resolution").distinct()
    near = F.broadcast(m) if m.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else m
    cand = detected.select(key, "ecosystem").distinct().join(near, "ecosystem").join(detected.select(key, "ecosystem", "method"), [key, "ecosystem", "method"], "left_anti")
    if required is None:
        return cand.select(key, "ecosystem", "method", F.lit("medium").alias("priority"))
    covered = detected.select(key, "ecosystem", "method").join(near, ["ecosystem", "method"]).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("resolution"))).alias("covered"))  # a list a method of the registry
    wanted = required.groupBy(key).agg(F.collect_set("resolution").alias("wanted"))
    gap = F.array_except(F.coalesce("wanted", F.array().cast("array<string>")), F.coalesce("covered", F.array().cast("array<string>")))
    j = cand.join(covered, key, "left").join(wanted, key, "left")
    return j.select(key, "ecosystem", "method", F.when(F.arrays_overlap(gap, "resolution"), "high").otherwise("medium").alias("priority"))


def ecosystems(reg: DataFrame) -> DataFrame:
    """(ecosystem, methods, aliases, resolutions)."""
    r = reg.groupBy("ecosystem").agg(F.count_distinct("method").alias("methods"), F.count("*").alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("resolution")))).alias("resolutions"))
    return r


def keyword_score(text: Column, words: list[str]) -> Column:
    """Keywords present, a fifth each, 1 at most."""
    low = F.lower(text)
    n = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return F.least(n / 5.0, F.lit(1.0))


def resolution_level(text: Column) -> Column:
    """1 coarse, 2 between, 3 fine: by which of the keyword scores leads by more than a tenth."""
    a, f = keyword_score(text, COARSE), keyword_score(text, FINE)
    return F.when(f > a + 0.1, 3).when(a > f + 0.1, 1).otherwise(2)


def resolution_mismatch(method: Column, conclusion: Column) -> Column:
    """none, medium or high, by how much finer the conclusion speaks than the method."""
    gap = resolution_level(conclusion) - resolution_level(method)
    return F.when(gap >= 2, "high").when(gap == 1, "medium").otherwise("none")


def domain(text: Column) -> Column:
    """genomics from three of its signals on, temporal from two, else general."""
    low = F.lower(text)
    n = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return F.when(n(["allele", "codon", "gene ", "genome", "locus", "mutation", "nucleotide", "sequenc", "snp", "variant"]) >= 3, "genomics").when(n(["century", "decade", "epoch", "era ", "longitudinal", "temporal trend", "time series", "year-over-year"]) >= 2, "temporal").otherwise("general")


LEVEL_NAMES = {"genomics": ["genome_wide", "gene_wide", "site_specific"], "temporal": ["temporal_coarse", "temporal_medium", "temporal_fine"], "general": ["aggregate", "subgroup", "individual"]}


def level_name(text: Column) -> Column:
    """A text's resolution in its domain's words."""
    level, out = resolution_level(text), F.lit(None).cast("string")
    for d, names in LEVEL_NAMES.items():
        out = F.when(domain(text) == d, F.element_at(F.array(*[F.lit(x) for x in names]), level)).otherwise(out)
    return out


#: What a conclusion speaks of, what a method then must speak of or mustn't, and the blind spot.
_BLIND = [
    (["deletion", "indel", "insertion"], False, ["deletion", "gap", "indel", "insertion"], "insertions and deletions go unseen"),
    (["case-level", "individual", "patient", "per-subject"], True, ["aggregate", "cohort", "pooled", "population"], "population method, individual claims"),
    (["event", "instantaneous", "moment", "time-point"], True, ["epoch", "era", "longitudinal", "trend"], "time resolved too coarsely for events"),
    (["causal", "caused", "causes", "driving", "drove", "generated", "led to", "produced", "resulted in"], True, ["associated", "correlation", "covariate", "cross-sectional", "observational", "regression"], "observational method, causal claims"),
    (["designed", "engineered", "gain-of-function", "laboratory", "manipulation"], True, ["dn/ds", "omega", "selection intensity", "selection pressure"], "selection shows pressure, not mechanism"),
]
_SITE = ["individual site", "particular site", "site-specific", "specific site"]


def blind_spots(method: Column, conclusion: Column) -> Column:
    """What the conclusion claims that the method can't resolve."""
    m, c = F.lower(method), F.lower(conclusion)
    has = lambda t, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: t.contains(w))
    out = [F.when(has(c, said) & (has(m, words) if there else ~has(m, words)), spot) for said, there, words, spot in _BLIND]
    return F.array_compact(F.array(*out, F.when(has(c, _SITE) & (keyword_score(method, COARSE) > 0.3), "single sites vanish in a coarse background")))


def overall_severity(mismatch: Column, n_high_missing: Column, overclaiming: Column, failed: Column) -> Column:
    """low, medium, high or incomplete, of a text's analyses."""
    high = (mismatch == "high") | (overclaiming > 0.6)
    medium = (mismatch == "medium") | (n_high_missing > 0)
    return F.when(high, "high").when(medium, "medium").when(failed, "incomplete").when(overclaiming > 0.3, "medium").otherwise("low")
