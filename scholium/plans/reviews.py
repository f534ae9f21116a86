"""Queries of a review's records: screening, charting, self-audits, validation, the audit store, and everything known of each paper."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import audit, battery, config, metadata, review, summaries
from scholium.plans.registry import query, table
from scholium.runtime import cut

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
_D = "d AS (SELECT doc_id AS k, 'p' || doc_id AS pmid, CASE doc_id % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' WHEN 2 THEN 'maybe' ELSE 'perhaps' END AS decision, doc_id % 3 AS m, lang, source, n_chars FROM documents)"


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    decision = F.when(k % 4 == 0, "include").when(k % 4 == 1, "exclude").when(k % 4 == 2, "maybe").otherwise("perhaps")
    themes = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("Z")))
    return table(spark, d, "documents").select(k.alias("k"), F.concat(F.lit("p"), S(k)).alias("pmid"), decision.alias("decision"), themes.alias("themes"), "lang", "source", "n_chars")


_RUBRIC = """# Screening
## Review question
Does it help?
## INCLUDE if
- it measures
- it compares
## EXCLUDE if
- it is a comment
## MAYBE if
* unclear
## Themes
- **theme A — measures**
- **B: people**
"""
_SCHEMA = """## Fields
| Field | Type | Notes |
|---|---|---|
| `pmid` | string | key |
| n | integer | |
"""
_SCALES = """
dimensions:
  - id: agree
    scale: [yes, no, unsure]
  - id: harm
    scale: [low, high]
"""


@query("config_files", "SELECT * FROM (VALUES ('rule exclude', 'it is a comment'), ('rule include', 'it compares'), ('rule include', 'it measures'), ('rule maybe', 'unclear'), ('theme A', 'measures'), ('theme B', 'people'), ('field pmid', 'string'), ('field n', 'integer'), ('scale agree', 'yes no unsure'), ('scale harm', 'low high'), ('question', 'Does it help?')) AS v(what, value)")
def config_files(spark: SparkSession, d: str) -> DataFrame:
    r = config.screening_rubric(_RUBRIC)
    rows = [(f"rule {k}", x) for k, v in r.rules.items() for x in v] + [(f"theme {k}", v) for k, v in r.themes.items()] + [(f"field {f}", t) for f, t, _ in config.charting_schema(_SCHEMA)]
    rows += [(f"scale {k}", " ".join(v)) for k, v in config.rating_scales(_SCALES).items()] + [("question", r.question)]
    return spark.createDataFrame(rows, "what string, value string")


@query("decision_warnings", f"WITH {_D} SELECT k, CASE WHEN decision = 'perhaps' THEN 'bad decision' ELSE concat_ws('|', CASE WHEN m = 2 THEN 'unknown theme' END, CASE WHEN m = 0 AND decision <> 'exclude' THEN 'no themes' END, CASE WHEN m > 0 AND decision = 'exclude' THEN 'themes of an excluded record' END) END AS warnings FROM d")
def decision_warnings(spark: SparkSession, d: str) -> DataFrame:
    known = list(config.screening_rubric(_RUBRIC).themes)
    return _decisions(spark, d).select("k", F.array_join(config.decision_warnings(F.col("decision"), F.col("themes"), known), "|").alias("warnings"))


@query("extraction_warnings", "SELECT doc_id AS k, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'missing: n' ELSE 'extra: a, z|missing: pmid' END AS warnings FROM documents")
def extraction_warnings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    row = F.when(k % 3 == 0, '{"pmid": 1, "n": null}').when(k % 3 == 1, '{"pmid": 2}').otherwise('{"z": 1, "n": 2, "a": 3}')
    fields = [f for f, _, _ in config.charting_schema(_SCHEMA)]
    return table(spark, d, "documents").select(k.alias("k"), F.array_join(config.extraction_warnings(row, fields), "|").alias("warnings"))


@query("rating_warnings", "SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'harm: maybe' WHEN 2 THEN 'agree: high|unknown: other' ELSE '' END AS warnings FROM documents")
def rating_warnings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    m = lambda **kw: F.create_map(*[F.lit(x) for p in kw.items() for x in p])
    r = F.when(k % 4 == 0, m(agree="yes", harm="low")).when(k % 4 == 1, m(agree="no", harm="maybe")).when(k % 4 == 2, m(agree="high", other="x")).otherwise(m(agree="", harm="high"))
    return table(spark, d, "documents").select(k.alias("k"), F.array_join(config.rating_warnings(r, config.rating_scales(_SCALES)), "|").alias("warnings"))


@query("rating_constraints", "SELECT doc_id AS pmid, concat_ws('|', CASE WHEN doc_id % 5 = 0 THEN 'dimension' END, CASE WHEN doc_id % 3 = 0 THEN 'rating' END, CASE WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'evidence' END) AS problems FROM documents")
def rating_constraints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    r = table(spark, d, "documents").select(k.alias("pmid"), F.when(k % 5 == 0, "other").otherwise("novelty").alias("dimension"), F.when(k % 3 == 0, "great").when(k % 3 == 1, "suspect").otherwise("good").alias("rating"), F.when(k % 2 == 1, "a quote").otherwise(" ").alias("evidence_quote"))
    return audit.checked_ratings(r, metadata.DIMENSIONS).select("pmid", F.array_join("problems", "|").alias("problems"))


def _by_length(batch: pd.DataFrame) -> pd.DataFrame:
    """A caller's screener: long texts in, short ones out with a reason, every seventh without a decision."""
    n, k = batch["n_chars"], batch["pmid"].astype(int)
    out = pd.DataFrame({"pmid": batch["pmid"], "decision": n.gt(2000).map({True: "include", False: "exclude"}), "reason": n.gt(500).map({True: "", False: "short"})})
    out.loc[k % 7 == 0, "decision"] = "unsure"
    return out


@query("screening", "SELECT doc_id::VARCHAR AS pmid, CASE WHEN doc_id % 7 = 0 THEN 'unsure' WHEN n_chars > 2000 THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN doc_id % 7 = 0 THEN 'unknown decision' WHEN n_chars <= 2000 AND n_chars > 500 THEN 'no reason' ELSE '' END AS warnings FROM documents")
def screening(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select(S("doc_id").alias("pmid"), "n_chars")
    return review.screen(r, _by_length).select("pmid", "decision", F.array_join("warnings", "|").alias("warnings"))


@query("screening_stub", "SELECT 'maybe' AS decision, count(*) AS n FROM documents")
def screening_stub(spark: SparkSession, d: str) -> DataFrame:
    return review.screen(table(spark, d, "documents").select(S("doc_id").alias("pmid"))).groupBy("decision").agg(F.count("*").alias("n"))


def _chart(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"pmid": batch["pmid"], "words": batch["text"].fillna("").str.split(" ").str.len().astype("int64"), "lang": batch["lang"]})


@query("charting", "SELECT doc_id::VARCHAR AS pmid, len(string_split(coalesce(text, ''), ' ')) AS words, lang FROM documents")
def charting(spark: SparkSession, d: str) -> DataFrame:
    """A caller's extractor in a schema given at run time."""
    r = table(spark, d, "documents").select(S("doc_id").alias("pmid"), "text", "lang")
    return review.chart(r, _chart, "pmid string, words long, lang string")


def _audit(batch: pd.DataFrame) -> pd.DataFrame:
    known = batch["title"].notna()
    return pd.DataFrame({"record_id": batch["record_id"], "confidence": known.map({True: 0.9, False: 0.2}), "flag": ~known, "reasoning": batch["decision"], "dimension": None})


@query("self_audits", f"WITH {_D} SELECT pmid AS record_id, CASE WHEN k % 3 = 0 THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END AS confidence, k % 3 = 0 AS flag, decision AS reasoning FROM d")
def self_audits(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of which every third has no record."""
    dec = _decisions(spark, d)
    rec = dec.where("k % 3 <> 0").select("pmid", F.col("source").alias("title"), F.lit("").alias("abstract"))
    return review.self_audit(dec, rec, _audit).drop("dimension")


@query("self_audit_stub", "SELECT true AS flag, 0.0::DOUBLE AS confidence, count(*) AS n FROM documents")
def self_audit_stub(spark: SparkSession, d: str) -> DataFrame:
    dec = _decisions(spark, d)
    return review.self_audit(dec, dec.select("pmid", F.lit("t").alias("title"), F.lit("a").alias("abstract"))).groupBy("flag", "confidence").agg(F.count("*").alias("n"))


@query("review_site_rows", f"WITH {_D} SELECT pmid, decision, CASE WHEN k % 3 = 0 THEN '(no record)' ELSE source END AS title, k % 5 = 0 AS flag, CASE WHEN k % 5 < 2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS confidence, row_number() OVER (ORDER BY k % 5 <> 0, CASE WHEN k % 5 < 2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END, pmid) - 1 AS place FROM d")
def review_site_rows(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with their records and audits, flagged ones first, then the least confident."""
    from scholium.operators.numbering import number_rows

    dec = _decisions(spark, d)
    rec = dec.where("k % 3 <> 0").select("pmid", F.col("source").alias("title"))
    aud = dec.where("k % 5 < 2").select(F.col("pmid").alias("record_id"), (F.col("k") % 5 == 0).alias("flag"), F.lit(0.4).alias("confidence"))
    q = review.review_queue(dec, rec, aud).withColumn("late", ~F.col("flag"))
    return number_rows(q, ["late", "confidence", "pmid"], number="place").drop("late")


@query("reconciled", f"WITH {_D} SELECT pmid AS record_id, CASE WHEN k % 2 = 0 THEN 'flip' ELSE 'agree' END AS human, k % 7 <> 0 AS reviewed, CASE WHEN k % 10 <> 9 THEN decision END AS original, k % 2 = 0 AS requeued FROM d")
def reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Human answers beside the decisions, every tenth of which is lacking; flips are queued again."""
    dec = _decisions(spark, d)
    human = dec.select(F.col("pmid").alias("record_id"), F.when(F.col("k") % 7 != 0, True).alias("reviewed"), F.when(F.col("k") % 2 == 0, True).alias("flip"), F.lit("n").alias("note"))
    o, q = review.reconcile(dec.where("k % 10 <> 9"), human)
    return o.join(q.select("record_id", F.lit(True).alias("requeued")), "record_id", "left").select("record_id", "human", "reviewed", "original", F.coalesce("requeued", F.lit(False)).alias("requeued"))


@query("rating_tallies", "SELECT dimension, value, count(*) AS n FROM (SELECT 'agree' AS dimension, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS value FROM documents UNION ALL SELECT 'harm', CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END FROM documents) GROUP BY ALL")
def rating_tallies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    h = table(spark, d, "documents").select(F.create_map(F.lit("agree"), F.when(k % 2 == 0, "yes").otherwise("no"), F.lit("harm"), F.when(k % 3 == 0, "high").otherwise("low")).alias("ratings"))
    return review.rating_tallies(h)


# --- declared summaries


@query(
    "declared_counts",
    "SELECT 'corpus_n' AS field, NULL AS value, count(*) AS n FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'kind', CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'a b' END, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'tags', t, count(*) FROM (SELECT unnest([lower(source), 'x y']) AS t FROM documents WHERE doc_id % 2 = 0) GROUP BY t",
)
def declared_counts(spark: SparkSession, d: str) -> DataFrame:
    """All of a configuration's counters over one reading of the rows."""
    k = F.col("doc_id")
    r = table(spark, d, "documents").select(k.alias("pos"), "lang", F.when(k % 3 != 0, "  A  B").otherwise(" ").alias("kind"), F.when(k % 2 == 0, F.array(F.upper("source"), F.lit(" x  Y "), F.lit(""), F.lit("drop me"))).alias("tags"))
    specs = [summaries.ScalarCounter("lang"), summaries.ScalarCounter("kind", default="unknown", normalize=True), summaries.ListCounter("tags", drop=("Drop me",))]
    return summaries.aggregate_counts(cut(r, "rows"), specs)


@query(
    "prisma_flow",
    """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN 'p' || (doc_id % 300) END AS p, CASE WHEN doc_id % 2 = 0 THEN 'd' || (doc_id % 500) END AS d, 't' || sha1(text) AS t FROM documents),
    r AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS seen, true AS kept UNION ALL SELECT o.rn, CASE WHEN list_has_any(r.seen, list_filter([p, d, t], lambda x: x IS NOT NULL)) THEN r.seen ELSE list_concat(r.seen, list_filter([p, d, t], lambda x: x IS NOT NULL)) END, NOT list_has_any(r.seen, list_filter([p, d, t], lambda x: x IS NOT NULL)) FROM r JOIN o ON o.rn = r.rn + 1)
    SELECT count(*) AS identified, count(*) FILTER (NOT kept) AS duplicates_removed, count(*) FILTER (kept) AS screened, (SELECT count(*) FROM labels) AS screened_decisions, (SELECT count(*) FROM labels WHERE quality = 1) AS include, (SELECT count(*) FROM labels WHERE quality = 0) AS exclude, 0::BIGINT AS maybe,
    (SELECT count(*) FROM labels WHERE quality = 1) AS full_text_assessed, (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 0) AS included_after_full_text, (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 1) AS excluded_at_full_text FROM r WHERE rn > 0""",
)
def prisma_flow(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records of several databases, some with a number, some with a DOI, all with a title; labels as decisions."""
    k = F.col("doc_id")
    rec = table(spark, d, "documents").select(k.alias("pos"), F.col("source").alias("database"), F.when(k % 3 == 0, S(k % 300)).otherwise("").alias("pmid"), F.when(k % 2 == 0, F.concat(F.lit(" 10.1/D"), S(k % 500))).alias("doi"), F.concat(F.lit("T: "), F.sha1(F.col("text").cast("binary"))).alias("title"))
    dec = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "include").when(F.col("quality") == 0, "exclude").otherwise("maybe").alias("decision"), F.when(F.col("toxic") == 1, "exclude").otherwise("include").alias("full"))
    return summaries.prisma(rec, dec, dec.where("decision = 'include'").select(F.col("full").alias("decision")))


# --- the audit store

_ST = """p AS (SELECT vec_id AS k, label AS c FROM embeddings WHERE label IS NOT NULL), v AS (SELECT k, c, k % 3 AS q, k % 9 = 4 AS ex, k % 4 = 1 AS ind FROM p)"""


def _star(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as rated papers of clusters: with a rating of two dimensions, every ninth excluded, every fourth linked to industry, siblings by their number."""
    k = F.col("vec_id")
    e = table(spark, d, "embeddings").where("label IS NOT NULL").select(k.alias("n"), S(k).alias("pmid"), "label")
    n = F.col("n")
    one = lambda dim, rating, kind, v: e.select("pmid", F.lit(dim).alias("dimension"), rating.alias("rating"), kind.alias("paper_type"), F.lit(v).alias("rubric_version"))
    q = F.when(n % 3 == 0, "good").when(n % 3 == 1, "suspect").otherwise("n/a")
    ratings = one("construct_adequacy", F.lit("missing"), F.lit("z"), "v1").unionByName(one("construct_adequacy", q, F.lit("trial"), "v2")).unionByName(one("novelty", F.lit("good"), F.lit("cohort"), "v1"))
    papers = e.where("n % 5 <> 0").select("pmid", F.concat(F.lit("Paper "), "pmid").alias("title"), (2000 + n % 20).alias("year"), F.lit("").alias("journal"))
    records = e.select("pmid", F.concat(F.lit("Record "), "pmid").alias("title"), F.lit(1990).alias("year"), F.lit("Annals").alias("journal"), F.array(*[F.lit(x) for x in "ABCD"]).alias("authors"), F.lit("10.1/x").alias("doi"))
    asg = e.select("pmid", F.lit("r1").alias("cluster_run_id"), F.col("label").alias("cluster_id"), F.lit(0.5).alias("distance_to_centroid"))
    clusters = e.groupBy(F.col("label").alias("cluster_id")).agg(F.min_by("pmid", "n").alias("centroid_pmid")).select(F.lit("r1").alias("cluster_run_id"), "cluster_id", F.concat(F.lit("c"), S("cluster_id")).alias("cluster_name"), "centroid_pmid")
    log = e.where("n % 9 = 4").select("pmid", F.lit("first").alias("reason"), F.lit(1).alias("seq"))
    ex = audit.load_exclusions(log.unionByName(log.withColumn("reason", F.lit("short")).withColumn("seq", F.lit(2))))
    scans = e.where("n % 2 = 0").select("pmid", (n % 7).alias("n_pvalues"), F.lit(1).alias("n_effects"), F.lit(0.5).alias("positivity_ratio"))
    funding = e.select("pmid", F.when(n % 4 == 1, "industry_linked").otherwise("partial").alias("funding_classification"), (n % 4 == 1).alias("industry_linked"))
    salami = e.where("n % 10 = 0").select(F.col("pmid").alias("pmid_a"), S(n + 1).alias("pmid_b"), F.lit(3).alias("n_shared"))
    return metadata.star(ratings, papers, records, asg, clusters, ex, scans, funding, salami, "r1")


@query(
    "paper_metadata",
    f"""WITH {_ST} SELECT k::VARCHAR AS pmid, CASE WHEN k % 5 <> 0 THEN 'Paper ' || k ELSE 'Record ' || k END AS title, CASE WHEN k % 5 <> 0 THEN 2000 + k % 20 ELSE 1990 END::INT AS year, 'Annals' AS journal, c AS cluster_id, 'c' || c AS cluster_name, q = 0 AS is_voice, k = min(k) OVER (PARTITION BY c) AS is_centroid, CASE WHEN ex THEN 'short' END AS exclusion_reason, ind AS industry_linked,
    CASE WHEN k % 10 = 0 THEN (k + 1)::VARCHAR WHEN k % 10 = 1 AND (k - 1) IN (SELECT k FROM p) THEN (k - 1)::VARCHAR END AS sibling FROM v""",
)
def paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = _star(spark, d).where("title IS NOT NULL AND ratings IS NOT NULL")
    return m.select("pmid", "title", F.col("year").cast("int").alias("year"), "journal", "cluster_id", "cluster_name", "is_voice", "is_centroid", "exclusion_reason", "industry_linked", F.try_element_at("siblings", F.lit(1))["other"].alias("sibling"))


@query("compact_papers", f"WITH {_ST} SELECT k::VARCHAR AS pmid, 'A|B|C' AS authors, ex AS excluded, 'cohort' AS paper_type, ['good', 'suspect', 'n/a'][q + 1] AS construct_adequacy, 'good' AS novelty, NULL::VARCHAR AS transparency, CASE WHEN k % 2 = 0 THEN k % 7 ELSE 0 END::BIGINT AS n_pvalues, CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE END AS positivity_ratio FROM v")
def compact_papers(spark: SparkSession, d: str) -> DataFrame:
    c = metadata.compact(_star(spark, d))
    return c.select("pmid", F.array_join("authors", "|").alias("authors"), "excluded", "paper_type", "construct_adequacy", "novelty", "transparency", "n_pvalues", "positivity_ratio")


@query("cluster_stats", f"WITH {_ST} SELECT c AS cluster_id, 'c' || c AS cluster_name, count(*) AS n_audited, count(*) FILTER (NOT ex) AS n_valid, count(*) FILTER (ex) AS n_excluded, count(*) FILTER (q = 0 AND NOT ex) AS n_voices, count(*) FILTER (q = 1 AND NOT ex) AS n_suspect, 100.0::DOUBLE * count(*) FILTER (q = 1 AND NOT ex) / nullif(count(*) FILTER (NOT ex), 0) AS suspect_pct FROM v GROUP BY c")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return metadata.cluster_stats(metadata.compact(_star(spark, d)))


@query("corpus_summary", f"WITH {_ST} SELECT count(*) AS n_audited, count(*) FILTER (NOT ex) AS n_valid, count(*) FILTER (ex) AS n_excluded, count(*) FILTER (q = 0 AND NOT ex) AS n_voices, count(*) FILTER (ind) AS n_industry, count(*) FILTER (c IN (1, 2) AND NOT ex AND q < 2) AS diagnostic_n, count(*) FILTER (c IN (1, 2) AND NOT ex AND q = 1) AS diagnostic_suspect, 100.0::DOUBLE * count(*) FILTER (c IN (1, 2) AND NOT ex AND q = 1) / nullif(count(*) FILTER (c IN (1, 2) AND NOT ex AND q < 2), 0) AS diagnostic_pct FROM v")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return metadata.corpus_summary(metadata.compact(_star(spark, d)), [1, 2])


@query("cluster_index", f"WITH {_ST}, y AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 2000 + k % 20 ELSE 1990 END AS year FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY year DESC, k::VARCHAR) AS place, count(*) OVER (PARTITION BY c) AS n FROM y) SELECT c AS cluster_id, place::INT AS place, k::VARCHAR AS pmid, year::INT AS year, CASE WHEN k % 5 <> 0 THEN 'Paper ' || k ELSE 'Record ' || k END AS title, greatest(n - 50, 0) AS more FROM r WHERE place <= 50")
def cluster_index(spark: SparkSession, d: str) -> DataFrame:
    return metadata.cluster_index(metadata.compact(_star(spark, d)))


@query("exclusion_log", "SELECT doc_id::VARCHAR AS pmid, 'second' AS reason FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id::VARCHAR, 'first' FROM documents WHERE doc_id % 4 = 3")
def exclusion_log(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log in which some papers come twice, and some entries name none."""
    k = F.col("doc_id")
    one = table(spark, d, "documents").where(k % 2 == 1).select(S(k).alias("pmid"), F.lit("first").alias("reason"), F.lit(1).alias("seq"), k)
    two = one.where(k % 4 == 1).withColumn("reason", F.lit("second")).withColumn("seq", F.lit(2))
    none = one.withColumn("pmid", F.lit("")).withColumn("seq", F.lit(3))
    return audit.load_exclusions(one.unionByName(two).unionByName(none))


@query("store_upsert", "SELECT doc_id AS pmid, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS rating FROM documents UNION ALL SELECT doc_id + 10000000, 'new' FROM documents WHERE doc_id % 5 = 0")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").select(F.col("doc_id").alias("pmid"))
    new = k.where("pmid % 3 = 0").unionByName(k.where("pmid % 5 = 0").select((F.col("pmid") + 10_000_000).alias("pmid")))
    return audit.upsert(k.withColumn("rating", F.lit("old")), new.withColumn("rating", F.lit("new")), ["pmid"])


@query("latest_run", "SELECT 'run' || max(event_id) AS cluster_run_id FROM events")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return audit.latest_run(table(spark, d, "events").select(F.concat(F.lit("run"), S("event_id")).alias("cluster_run_id"), F.col("event_id").alias("seq")))


@query("picked_metadata", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def picked_metadata(spark: SparkSession, d: str) -> DataFrame:
    picked = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").join(picked, "doc_id", "left_semi").select("doc_id", "lang", "source")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("pmid"), F.col("label").alias("cluster_id"), (F.col("vec_id") * 7919 % 1000 / 1000.0).alias("distance_to_centroid"))


@query("sampling_runs", "WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label) SELECT l.level, l.strategy, l.k AS per_cluster, CAST(sum(CASE WHEN l.k IS NULL THEN n ELSE least(n, l.k) END) AS BIGINT) AS n_picked, count(*) AS n_clusters FROM c, (VALUES ('L0', 'nearest', 1), ('L1', 'spread', 5), ('L2', 'random', 20), ('L3', 'random', 50), ('L4', 'all', NULL)) AS l(level, strategy, k) GROUP BY ALL")
def sampling_runs(spark: SparkSession, d: str) -> DataFrame:
    """What every sampling level records of its run."""
    out = None
    for level in audit.LEVELS:
        runs, _ = audit.record_sampling(_levels(spark, d), level, f"s-{level}")
        out = runs if out is None else out.unionByName(runs)
    return out.select("level", "strategy", "per_cluster", "n_picked", "n_clusters")


@query("sample_L3", "WITH r AS (SELECT label AS cluster_id, vec_id AS pmid, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) - 1 AS i FROM embeddings WHERE label IS NOT NULL) SELECT cluster_id, pmid, i::INTEGER AS rank_in_cluster FROM r WHERE i < 50")
def sample_l3(spark: SparkSession, d: str) -> DataFrame:
    return audit.sample_level(_levels(spark, d), "L3").select("cluster_id", "pmid", "rank_in_cluster")


# --- calibration


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(S(k).alias("source"), k.alias("k"))
    f = lambda check, target, verdict: s.select("source", F.lit(check).alias("check"), F.lit(target).alias("target"), verdict.alias("verdict"))
    found = f("grim", "x / a", F.when(F.col("k") % 3 == 0, "FAIL").when(F.col("k") % 3 == 1, "FLAG").otherwise("PASS")).unionByName(f("grim", "x / b", F.lit("PASS"))).unionByName(f("sd", "y", F.when(F.col("k") % 2 == 0, "PASS").otherwise("UNDETERMINED")))
    e = lambda kind, check, exact, part, least: s.select("source", F.lit(kind).alias("kind"), F.lit(check).alias("check"), F.lit(exact).cast("string").alias("target"), F.lit(part).cast("string").alias("target_contains"), F.lit(least).cast("string").alias("min_verdict"))
    return found, e("must_detect", "grim", "x / a", None, "FAIL").unionByName(e("must_detect", "grim", None, "x", "FLAG")).unionByName(e("must_pass", "grim", None, "/ b", None)).unionByName(e("must_pass", "sd", None, "y", None))


@query("calibration", "WITH k AS (SELECT s_suppkey AS k FROM supplier) SELECT k::VARCHAR AS source, unnest(['must_detect', 'must_detect', 'must_pass', 'must_pass']) AS kind, unnest(['grim', 'grim', 'grim', 'sd']) AS \"check\", unnest(['x / a', 'x', '/ b', 'y']) AS target, unnest([k % 3 = 0, false, true, k % 2 = 0]) AS satisfied FROM k")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Two findings of one check match a part of a target, so that it isn't detected; an exact target may be one of them."""
    return battery.calibrate(*_cases(spark, d)).select("source", "kind", "check", "target", "satisfied")


@query("calibration_totals", "SELECT 'grim' AS \"check\", count(*) FILTER (s_suppkey % 3 = 0)::DOUBLE / (2 * count(*)) AS sensitivity, 1.0::DOUBLE AS specificity FROM supplier UNION ALL SELECT 'sd', NULL, count(*) FILTER (s_suppkey % 2 = 0)::DOUBLE / count(*) FROM supplier")
def calibration_totals(spark: SparkSession, d: str) -> DataFrame:
    return battery.sensitivity(battery.calibrate(*_cases(spark, d)))


@query("case_problems", "SELECT s_suppkey AS k, ['', 'nothing is asserted', 'unknown: must_deteect|nothing is asserted', 'an entry without a check', 'expected is lacking or no object'][s_suppkey % 5 + 1] AS problems FROM supplier")
def case_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = ['{"expected": {"must_detect": [{"check": "grim", "target": "x"}]}}', '{"expected": {"must_pass": []}}', '{"expected": {"must_deteect": []}}', '{"expected": {"must_pass": [{"target": "x"}]}}', '{"name": "x"}']
    case = F.element_at(F.array(*[F.lit(x) for x in c]), (k % 5 + 1).cast("int"))
    return table(spark, d, "supplier").select(k.alias("k"), F.array_join(battery.case_problems(case), "|").alias("problems"))
