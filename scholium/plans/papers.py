"""Queries that read whole papers. Papers are written from the driver's tables, so that what is in them is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import claims, methods, reading, tex
from scholium.plans.registry import query, table

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _pick(k: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (k % len(options) + 1).cast("int"))


def _pick_sql(k: str, options: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in options) + f"][({k} % {len(options)} + 1)::INT]"


def _tex(spark: SparkSession, d: str) -> DataFrame:
    r"""Parts as LaTeX papers: k, text."""
    k, name = F.col("p_partkey"), F.col("p_name")
    parts = [
        F.lit("\\title{On the {"), name, F.lit("}}\n\\begin{abstract}\nWe study "), name, F.lit(" with great care. This may suggest something new.\n\\end{abstract}\n\\section{Introduction}\n\nThe "), name,
        F.lit(" has been measured by many groups in recent years \\citep{a"), S(k), F.lit(", b"), S(k % 7), F.lit("}. Short one here.\n\n\\textbf{The "), name, F.lit(" is a key part}. More words follow here.\n\\section{Statistical Analysis}\nWe pooled the overall mean of "), name,
        F.lit(" across an aggregate cohort.\n\\subsection*{Results}\nThe "), name, F.lit(" was seen in "), S(k), F.lit(" cases of the whole set. % a remark\n\\section{Concluding Remarks}\nThis shows that every individual variant of "), name, F.lit(" at each position is a point mutation of one residue. It proves a lot.\n\\bibliography{refs}\n\\cite{never"), S(k), F.lit("}"),
    ]
    return table(spark, d, "part").select(k.alias("k"), F.concat(*parts).alias("text"))


_P = "p AS (SELECT p_partkey AS k, p_name AS n FROM part)"


@query("latex_words", f"WITH {_P} SELECT k, 'The ' || n || ' is MATH - see ' || k || ' there' AS plain FROM p")
def latex_words(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    t = F.concat(F.lit("The \\emph{\\textbf{"), n, F.lit("}} is $x^2$ \\cite[p.~3]{z} --- see~{"), S(k), F.lit("} % gone \n https://example.org/a \\ref{eq} there\\\\ ".replace("\\\\", "")))
    return table(spark, d, "part").select(k.alias("k"), tx.clean_latex(t).alias("plain"))


@query("plain_words", "SELECT p_partkey AS k, 'measure' || p_partkey || ' of ' || p_name || ' is done' AS plain FROM part")
def plain_words(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("  mea-\nsure"), S("p_partkey"), F.lit(" of\f"), "p_name", F.lit("\t is\n\n done "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), tx.clean_plaintext(t).alias("plain"))


@query("tex_cite_keys", f"WITH {_P} SELECT k, 'a' || k || ' b' || k % 7 || ' never' || k AS every, 'a' || k || ' b' || k % 7 AS cited FROM p")
def tex_cite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all cite commands of a source, and of those that a bibliography takes."""
    t = _tex(spark, d).withColumn("text", F.regexp_replace("text", r"\\cite\{never", r"\\citeauthor{never"))
    return t.select("k", F.concat_ws(" ", tx.cite_keys(F.col("text"))).alias("every"), F.concat_ws(" ", tx.bibliography_keys(F.col("text"))).alias("cited"))


@query("tex_abstracts", f"WITH {_P} SELECT k, 'We study ' || n || ' with great care. This may suggest something new.' AS abstract FROM p")
def tex_abstracts(spark: SparkSession, d: str) -> DataFrame:
    return _tex(spark, d).select("k", tex.abstract(F.col("text")).alias("abstract"))


@query("tex_sections", f"WITH {_P} SELECT k, unnest(['Introduction', 'Statistical Analysis', 'Results', 'Concluding Remarks']) AS title FROM p")
def tex_sections(spark: SparkSession, d: str) -> DataFrame:
    return tex.sections(_tex(spark, d), "k", "text").select("k", "title")


@query("tex_contexts", f"WITH {_P} SELECT k, 'The ' || n || ' has been measured by many groups in recent years .' AS text, 'a' || k || ' b' || k % 7 AS cited FROM p")
def tex_contexts(spark: SparkSession, d: str) -> DataFrame:
    return tex.citation_contexts(_tex(spark, d), "k", "text").select("k", "text", F.concat_ws(" ", "cited_keys").alias("cited"))


@query("tex_claims", f"WITH {_P} SELECT k, 'The ' || n || ' is a key part' AS text FROM p")
def tex_claims(spark: SparkSession, d: str) -> DataFrame:
    return tex.claims(_tex(spark, d), "k", "text")


@query("tex_section_finders", f"WITH {_P} SELECT k, 'We pooled the overall mean of ' || n || ' across an aggregate cohort.' AS methods, 'The ' || n || ' was seen in ' || k || ' cases of the whole set.' AS results, 'This shows that every individual variant of ' || n || ' at each position is a point mutation of one residue. It proves a lot.' AS conclusions FROM p")
def tex_section_finders(spark: SparkSession, d: str) -> DataFrame:
    t = _tex(spark, d)
    return t.select("k", *[tx.clean_latex(reading.tex_section(F.col("text"), x)).alias(x) for x in ("methods", "results", "conclusions")])


@query("conclusions_premises", f"WITH {_P} SELECT k, 1 AS n_conclusions, 'This shows that every individual variant of ' || n || ' at each position is a point mutation of one residue.' AS conclusion, 'The ' || n || ' has been measured by many groups in recent years .' AS premise FROM p")
def conclusions_premises(spark: SparkSession, d: str) -> DataFrame:
    t = _tex(spark, d).withColumn("text", F.replace("text", F.lit("Concluding Remarks"), F.lit("Conclusion and outlook")))
    c, p = reading.conclusions(F.col("text")), reading.premises(F.col("text"))
    return t.select("k", F.size(c).alias("n_conclusions"), c[0].alias("conclusion"), p[0].alias("premise"))


@query("search_keywords", f"WITH {_P} SELECT k, 'On the ' || n || '|Introduction|Statistical Analysis|Concluding Remarks' AS words FROM p")
def search_keywords(spark: SparkSession, d: str) -> DataFrame:
    t = _tex(spark, d).withColumn("text", F.replace("text", F.lit("{On the {"), F.lit("{On the "))).withColumn("text", F.replace("text", F.lit("}}\n\\begin"), F.lit("}\n\\begin")))
    return t.select("k", F.array_join(reading.search_keywords(F.col("text"), 4), "|").alias("words"))


@query("sentence_lists", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS n, CASE WHEN p_partkey % 2 = 0 THEN 'A ' || p_name || ' is.' ELSE 'A ' || p_name || ' is. it goes on small.' END AS first FROM part")
def sentence_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sentences in plain text; where one is over sixty words, it is cut before small letters too."""
    k = F.col("p_partkey")
    t = F.concat(F.lit("A "), "p_name", F.lit(" is. it goes on small."), F.when(k % 2 == 0, F.repeat(F.lit(" word"), 60)).otherwise(""), F.when(k % 2 == 0, ".").otherwise(""), F.lit(" Then more."))
    s = reading.to_sentences(t)
    return table(spark, d, "part").select(k.alias("k"), (F.size(s) - F.when(k % 2 == 0, 1).otherwise(0)).alias("n"), s[0].alias("first"))


_CHUNKS = "list_filter(regexp_split_to_array(regexp_replace(trim(coalesce(text, ''), ' '), '([?!.])[ \\t\\n\\x0b\\f\\r]+([\\\\A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ') <> '')"


@query("sentence_counts", f"WITH s AS (SELECT doc_id, {_CHUNKS} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, greatest(len(s), 1) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(trim(x, ' ')))), 0) AS longest FROM s")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = tx.sentences(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Parts as plain papers with headings of three kinds."""
    k, n = F.col("p_partkey"), F.col("p_name")
    h = lambda x: F.when(k % 3 == 0, F.lit(f"## {x}\n")).when(k % 3 == 1, F.lit(f"2. {x.lower()}\n")).otherwise(F.lit(f"{x.upper()}\n"))
    t = F.concat(h("Abstract"), F.lit("We prove that "), n, F.lit(" causes it.\n"), h("Materials and Methods"), F.lit("We pooled overall means.\n"), h("Results"), F.lit("The "), n, F.lit(" may vary. It might be "), n, F.lit(" possibly.\n"), h("Discussion"), F.lit("The "), n, F.lit(" shows and proves it.\n"), h("Results"), F.lit("More of it.\n"), h("References"), F.lit("[1] x\n"))
    return table(spark, d, "part").select(k.alias("k"), F.when(k % 5 == 4, F.concat(F.lit("No headings, only "), n)).otherwise(t).alias("text"))


@query("plain_sections", f"WITH {_P}, s AS (SELECT k, n, unnest(['abstract', 'methods', 'results', 'discussion', 'references']) AS section FROM p WHERE k % 5 <> 4) SELECT k, section, CASE section WHEN 'abstract' THEN 'We prove that ' || n || ' causes it.' WHEN 'methods' THEN 'We pooled overall means.' WHEN 'results' THEN 'The ' || n || ' may vary. It might be ' || n || ' possibly.' || chr(10) || chr(10) || 'More of it.' WHEN 'discussion' THEN 'The ' || n || ' shows and proves it.' ELSE '[1] x' END AS body FROM s UNION ALL SELECT k, 'full_text', 'No headings, only ' || n FROM p WHERE k % 5 = 4")
def plain_sections(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).select("k", F.explode(reading.split_sections(F.col("text"))).alias("section", "body"))


@query("section_strength", f"WITH {_P}, s AS (SELECT k, unnest(['abstract', 'results', 'discussion']) AS section FROM p WHERE k % 5 <> 4) SELECT k, section, CASE section WHEN 'results' THEN 3 ELSE 0 END::BIGINT AS hedges, CASE section WHEN 'discussion' THEN 2 ELSE 0 END::BIGINT AS amplifiers, CASE section WHEN 'abstract' THEN 1 ELSE 0 END::BIGINT AS causal, CASE section WHEN 'results' THEN 3 ELSE 1 END::BIGINT AS n_sentences, CASE section WHEN 'results' THEN round(0.33::DOUBLE / 3, 6) ELSE 1.0::DOUBLE END AS mean_strength FROM s")
def section_strength(spark: SparkSession, d: str) -> DataFrame:
    s = _plain(spark, d).select("k", F.explode(reading.split_sections(F.col("text"))).alias("section", "body")).where("section IN ('abstract', 'results', 'discussion')")
    s = s.select("k", "section", F.explode(tx.sentences(F.col("body"))).alias("sentence"))
    g = claims.section_strength(s, ["k", "section"])
    return g.select("k", "section", "hedges", "amplifiers", "causal", "n_sentences", F.round("mean_strength", 6).alias("mean_strength"))


@query("author_lines", "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Jane Doe|Max Roe|Ann Poe' WHEN 1 THEN 'Jane Doe|Max Roe' ELSE '' END AS names FROM supplier")
def author_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lines = F.concat(F.lit("Effects of "), "s_name", F.lit(" on Growth, a study.\nDepartment of Physics, University\nSydney, NSW\nfoo, bar and baz\n12, 34 and 56 and 78\n"), F.when(k % 3 == 0, "Jane Doe, Max Roe and Ann Poe\n").when(k % 3 == 1, "Jane Doe and Max Roe\n").otherwise("\n"), F.lit("Abstract and Summary, Text\n"))
    return table(spark, d, "supplier").select(k.alias("k"), F.array_join(reading.author_names(lines), "|").alias("names"))


@query("title_similarity", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sim FROM part")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Titles over one, two and three lines of a text; too short ones count nothing."""
    k = F.col("p_partkey")
    words = F.concat(F.lit("on the nature of "), "p_name")
    text = F.concat(F.lit("Journal of X\n\n"), F.when(k % 4 == 0, F.upper(words)).when(k % 4 == 1, F.concat(F.lit("On the: nature\nof "), "p_name")).otherwise(F.concat(F.lit("on the \nnature\n of "), "p_name")), F.lit("\n\nbody text\n"))
    return table(spark, d, "part").select(k.alias("k"), reading.title_similarity(text, F.when(k % 4 == 3, "body text").otherwise(words)).alias("sim"))


_LEAD = ["Randomised controlled trial", "a systematic review", "an Atlas of cells", "Segmentation of images", "the prognostic index", "to predict the long term survival", "we classify images", "We propose a way", "nothing of note", "data leakage and SMOTE with 95% CI", "held-out sites against healthy controls", "multi-centre, differentiates it from others", "RCT", "gwas"]


def _rx(words: list[str]) -> str:
    return "(?i)" + "|".join(words)


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(substring(t, 1, 20000), '{_rx(w)}') THEN '{k}'" for k, w in claims._KINDS) + " ELSE 'other' END"
_STUDY = f"t AS (SELECT doc_id, {_pick_sql('doc_id', _LEAD)} || ' ' || coalesce(text, '') AS t FROM documents)"


def _study(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", _pick(F.col("doc_id"), _LEAD), F.coalesce("text", F.lit(""))).alias("t"))


@query("study_types", f"WITH {_STUDY} SELECT doc_id, {_KIND_SQL} AS study_type FROM t")
def study_types(spark: SparkSession, d: str) -> DataFrame:
    return _study(spark, d).select("doc_id", claims.study_type(F.col("t")).alias("study_type"))


@query("ml_validity", f"WITH {_STUDY} SELECT doc_id, " + ", ".join(f"regexp_matches(t, '{_rx(w)}') AS {k}" for k, w in claims._VALIDITY.items()) + f", CASE WHEN regexp_matches(t, '{_rx(claims._MIMIC)}') THEN 'mimic_differential' WHEN regexp_matches(t, '{_rx(claims._HEALTHY)}') THEN 'healthy_easy' ELSE 'unclear' END AS comparator FROM t")
def ml_validity(spark: SparkSession, d: str) -> DataFrame:
    return _study(spark, d).select("doc_id", claims.ml_validity(F.col("t")).alias("v")).select("doc_id", "v.*")


_CASES = [("we used the Cox regression model", "survival", "Cox Regression"), ("relax and rest", None, None), ("RELAX was run", "hyphy", "RELAX"), ("ABC analysis applied", "bayes", "Approximate Bayesian Computation"), ("abc analysis applied", None, None), ("the structure of it", None, None), ("STRUCTURE software", "population", "ADMIXTURE"), ("mr Smith and MR imaging used", None, None), ("k-means here", "learning", "Clustering")]


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    k = F.col("conv_id") * 31 + F.col("turn")
    return c.select(k.alias("k"), F.concat(_pick(k, [x[0] for x in _CASES]), F.lit(". Beyond that, nothing is said.")).alias("t"))


_M = "m AS (SELECT conv_id * 31 + turn AS k FROM conversations), f AS (SELECT k, {e} AS ecosystem, {m} AS method FROM m)"
_M = _M.format(e=_pick_sql("k", [x[1] or "" for x in _CASES]), m=_pick_sql("k", [x[2] or "" for x in _CASES]))


@query("method_detection", f"WITH {_M} SELECT * FROM f WHERE method <> ''")
def method_detection(spark: SparkSession, d: str) -> DataFrame:
    """Methods named in sentences that do and don't mean them."""
    return methods.detect(_mentions(spark, d), methods.registry(spark), "k", "t").select("k", "ecosystem", "method")


_SIBLINGS = ", ".join(f"('{e}', {n})" for e, n in (("survival", 2), ("hyphy", 8), ("bayes", 3), ("population", 4), ("learning", 3)))


@query("missing_methods", f"WITH {_M}, s(ecosystem, n) AS (VALUES {_SIBLINGS}) SELECT k, ecosystem, n::BIGINT AS n_missing, CASE ecosystem WHEN 'survival' THEN 1 WHEN 'population' THEN 2 WHEN 'learning' THEN 0 WHEN 'bayes' THEN 0 ELSE 0 END::BIGINT AS n_high FROM f JOIN s USING (ecosystem)")
def missing_methods(spark: SparkSession, d: str) -> DataFrame:
    """What goes with the methods named; questions of survival and populations require what their methods don't resolve."""
    reg = methods.registry(spark)
    found = methods.detect(_mentions(spark, d), reg, "k", "t")
    want = F.when(F.col("ecosystem") == "survival", "aggregate").when(F.col("ecosystem") == "population", "genome_wide").otherwise("nothing")
    m = methods.missing(found, reg, "k", found.select("k", want.alias("resolution")))
    m = m.where("NOT (ecosystem = 'population' AND priority = 'high' AND method NOT IN ('Fst', 'Site Frequency Spectrum'))").unionByName(m.where("ecosystem = 'population' AND priority = 'high' AND method NOT IN ('Fst', 'Site Frequency Spectrum')").withColumn("priority", F.lit("medium")))
    return m.groupBy("k", "ecosystem").agg(F.count("*").alias("n_missing"), F.count_if(F.col("priority") == "high").alias("n_high"))


@query("method_ecosystems", "SELECT unnest(['bayes', 'beast', 'causal', 'epigenomics', 'expression', 'hyphy', 'learning', 'metagenomics', 'networks', 'paml', 'phylogenetics', 'population', 'single_cell', 'structures', 'survival']) AS ecosystem, unnest([4, 4, 4, 3, 4, 9, 4, 3, 3, 4, 4, 5, 3, 3, 3])::BIGINT AS methods")
def method_ecosystems(spark: SparkSession, d: str) -> DataFrame:
    return methods.ecosystems(methods.registry(spark)).select("ecosystem", "methods")


@query("method_names", "SELECT p_partkey AS k, " + _pick_sql("p_partkey", ["survival", "learning", "hyphy", "", "causal"]) + " AS ecosystem, " + _pick_sql("p_partkey", ["Cox Regression", "Clustering", "MEME", "", "Propensity Score Matching"]) + " AS method FROM part")
def method_names(spark: SparkSession, d: str) -> DataFrame:
    """Names as people write them, to the registry's methods."""
    n = table(spark, d, "part").select(F.col("p_partkey").alias("k"), _pick(F.col("p_partkey"), ["  Cox  Regression", "our K-means variant", "HyPhy MEME test", "zzz", "propensity"]).alias("name"))
    return methods.identify(n, methods.registry(spark)).select("k", F.coalesce("ecosystem", F.lit("")).alias("ecosystem"), F.coalesce("method", F.lit("")).alias("method"))


_AXES = {"a": "the overall mean of a pooled population trend", "b": "some words", "c": "each individual residue position variant haplotype codon"}


@query("resolution_mismatch", "WITH c AS (SELECT conv_id, turn, conv_id % 3 AS m, turn % 3 AS c FROM conversations), l AS (SELECT *, 3 - CASE m WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS ml, 3 - CASE c WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS cl FROM c) SELECT conv_id, turn, CASE WHEN cl - ml >= 2 THEN 'high' WHEN cl - ml = 1 THEN 'medium' ELSE 'none' END AS mismatch, CASE cl WHEN 1 THEN 'aggregate' WHEN 2 THEN 'subgroup' ELSE 'site_specific' END AS level FROM l")
def resolution_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Methods and conclusions that speak coarsely, neither way, and finely."""
    pick = lambda k: _pick(k, list(_AXES.values()))
    c = table(spark, d, "conversations").select("conv_id", "turn", pick(F.col("conv_id")).alias("m"), F.when(F.col("turn") % 3 == 2, F.concat(pick(F.col("turn")), F.lit(" of the genome locus"))).otherwise(pick(F.col("turn"))).alias("c"))
    return c.select("conv_id", "turn", methods.resolution_mismatch(F.col("m"), F.col("c")).alias("mismatch"), methods.level_name(F.col("c")).alias("level"))


_SPOTS = [("a pooled cohort", "each patient differs", "population method, individual claims"), ("regression", "it caused harm", "observational method, causal claims"), ("nothing", "a deletion", "insertions and deletions go unseen"), ("indel calls", "a deletion", ""), ("an epoch", "a single event", "time resolved too coarsely for events"), ("dN/dS", "engineered", "selection shows pressure, not mechanism"), ("x", "y", "")]


@query("blind_spots", f"SELECT p_partkey AS k, {_pick_sql('p_partkey', [x[2] for x in _SPOTS])} AS spots FROM part")
def blind_spots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), F.array_join(methods.blind_spots(_pick(k, [x[0] for x in _SPOTS]), _pick(k, [x[1] for x in _SPOTS])), "; ").alias("spots"))


@query("resolution_from_tex", f"WITH {_P} SELECT k, 1 AS method_level, 3 AS conclusion_level, 'high' AS severity, 'abstract|methods|conclusions|results' AS found FROM p")
def resolution_from_tex(spark: SparkSession, d: str) -> DataFrame:
    r = reading.resolution_from_tex(_tex(spark, d), "k", "text")
    return r.select("k", "method_level", "conclusion_level", "severity", F.array_join("sections_found", "|").alias("found"))


@query("sentence_support", "SELECT p_partkey AS k, 1 AS pos, (p_partkey % 3)::INT AS best, CASE WHEN p_partkey % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sim FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT p_partkey, 1, NULL, 0.0::DOUBLE FROM part WHERE p_partkey % 3 = 2")
def sentence_support(spark: SparkSession, d: str) -> DataFrame:
    """A claim equal to the first or the second piece of evidence, or to neither."""
    k, n = F.col("p_partkey"), F.col("p_name")
    a, b = F.concat(F.lit("alpha "), n, F.lit(" rises")), F.concat(F.lit("beta of "), n, F.lit(" falls"))
    row = lambda side, pos, t: F.struct(F.lit(side).alias("side"), F.lit(pos).alias("pos"), t.alias("text"))
    s = table(spark, d, "part").select(k.alias("doc"), F.explode(F.array(row("evidence", 0, a), row("evidence", 1, b), row("claim", 1, F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise("unrelated words only")))).alias("x")).select("doc", "x.*")
    r = reading.sentence_support(s)
    return r.select(F.col("doc").alias("k"), "pos", "best", F.round("sim", 9).alias("sim"))


@query("overclaiming", f"WITH {_P} SELECT k, CASE WHEN k % 5 = 4 THEN 0 ELSE 2 END::BIGINT AS n_late, CASE WHEN k % 5 = 4 THEN 0 ELSE 2 END::BIGINT AS n_escalations, CASE WHEN k % 5 = 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mean_delta, CASE WHEN k % 5 = 4 THEN '' ELSE 'hedge_erosion_results_to_discussion|hedge_erosion_results_to_abstract' END AS flags FROM p")
def overclaiming(spark: SparkSession, d: str) -> DataFrame:
    o = reading.overclaiming(_plain(spark, d).withColumn("s", reading.split_sections(F.col("text"))), "k", F.col("s"))
    return o.select("k", "n_late", "n_escalations", "mean_delta", F.array_join(F.filter("flags", lambda x: x.startswith("hedge")), "|").alias("flags"))


@query("audit_router", "SELECT p_partkey AS k, " + _pick_sql("p_partkey", ["rct", "diagnostic_ml", "prognostic", "review", "other"]) + " AS study_type, " + _pick_sql("p_partkey", ["forensic_stats|overclaiming", "missing_methods|ml_validity|overclaiming", "ml_validity|overclaiming", "overclaiming", "overclaiming"]) + " AS battery, CASE WHEN p_partkey % 5 = 1 THEN 1 END::BIGINT AS n_methods, CASE WHEN p_partkey % 5 = 1 THEN 3 END::BIGINT AS n_missing, CASE WHEN p_partkey % 5 IN (1, 2) THEN 'unclear' END AS comparator FROM part")
def audit_router(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.concat(_pick(k, ["a double-blind trial", "we diagnose by k-means", "a prognostic model", "an overview of", "plain"]), F.lit(" of "), "p_name")
    a = reading.audit(table(spark, d, "part").select(k.alias("k"), t.alias("t")), "k", "t", methods.registry(spark))
    return a.select("k", "study_type", F.array_join("battery", "|").alias("battery"), "n_methods", "n_missing", F.col("ml_validity.comparator").alias("comparator"))


@query("critical_read", f"WITH {_P} SELECT k, CASE WHEN k % 5 = 4 THEN 'incomplete' ELSE 'high' END AS severity, CASE WHEN k % 5 = 4 THEN 'incomplete analysis' ELSE 'resolution_mismatch (medium)|significant overclaiming' END || CASE WHEN k % 10 = 0 THEN '|self-validation risk' ELSE '' END AS flags, 0::BIGINT AS n_methods FROM p")
def critical_read(spark: SparkSession, d: str) -> DataFrame:
    """Papers with strong claims after hedged results; every tenth of the method's own developers."""
    p = _plain(spark, d)
    risk = p.select("k", F.when(F.col("k") % 10 == 0, "high").otherwise("low").alias("risk"))
    r = reading.critical_read(p, "k", "text", methods.registry(spark), self_validation=risk)
    return r.select("k", "severity", F.array_join("flags", "|").alias("flags"), "n_methods")
