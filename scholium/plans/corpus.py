"""Queries over documents, labels, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import audit, claims, resolve, summaries
from scholium.plans.registry import query, table

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_CHUNK = "regexp_extract_all(lower(substring(t, CAST(floor(n * {i} / 5) AS BIGINT) + 1, 3000)), '[a-z]+')"
_RATIO = "CASE WHEN n < 3000 THEN 1.0::DOUBLE ELSE greatest(" + ", ".join("CASE WHEN len({c}) >= 50 THEN len(list_filter({c}, lambda x: list_contains([" .format(c=_CHUNK.format(i=i)) + STOP + "], x)))::DOUBLE / len({c}) ELSE 0.0::DOUBLE END".format(c=_CHUNK.format(i=i)) for i in range(1, 5)) + ") END"
_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_REAL = "list_filter(l, lambda x: length(x) > 3 AND NOT regexp_matches(x, '(?i)^-{3}\\s*page\\s+\\d+\\s*-{3}$') AND NOT regexp_matches(x, '^\\d+$'))"
_SCORED = f"""base AS (SELECT doc_id, text, source, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
    r AS (SELECT *, {_RATIO} AS ratio, {_LINES} AS l FROM base),
    m AS (SELECT *, {_REAL} AS real_lines FROM r),
    u AS (SELECT doc_id, count(*) AS once FROM (SELECT doc_id, line FROM (SELECT doc_id, unnest(real_lines) AS line FROM m) GROUP BY doc_id, line HAVING count(*) = 1) GROUP BY doc_id),
    s AS (SELECT m.*, CASE WHEN len(l) < 5 OR len(real_lines) = 0 THEN 0.0::DOUBLE ELSE coalesce(once, 0)::DOUBLE / len(real_lines) END AS score FROM m LEFT JOIN u USING (doc_id))"""
_REASON = """CASE WHEN (SELECT count(*) FROM base b WHERE b.t = s.t) >= 2 THEN 'duplicate_content'
    WHEN ratio < 0.08 THEN CASE WHEN regexp_matches(substring(t, 1, 5000), '[BCDFGHJKLMNPQRSTVWXYZ]{8,}') THEN 'corrupted_text' ELSE 'non_english' END
    WHEN n < 8000 AND score < 0.30 THEN 'boilerplate_only' END"""


@query("exclusion_cascade", f"WITH {_SCORED} SELECT doc_id, {_REASON} AS reason FROM s")
def exclusion_cascade(spark: SparkSession, d: str) -> DataFrame:
    return resolve.exclusions(table(spark, d, "documents"), "doc_id", "text")


@query("exclusion_counts", f"WITH {_SCORED}, x AS (SELECT source, coalesce({_REASON}, 'ok') AS reason FROM s) SELECT source, reason, count(*) AS n FROM x GROUP BY ALL")
def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    x = resolve.exclusions(table(spark, d, "documents"), "doc_id", "text", keep=("source",))
    return x.groupBy("source", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("english_ratio", f"WITH {_SCORED} SELECT doc_id, round(ratio, 9) AS ratio FROM s")
def english_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(tx.english_ratio(F.coalesce("text", F.lit(""))), 9).alias("ratio"))


@query("boilerplate_score", f"WITH {_SCORED} SELECT doc_id, round(score, 9) AS score FROM s")
def boilerplate_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(tx.boilerplate_score(F.coalesce("text", F.lit(""))), 9).alias("score"))


@query("dup_groups", "SELECT sha1(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) >= 2")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return resolve.duplicate_groups(table(spark, d, "documents"), "doc_id", "text")


_WORDS = "list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


@query(
    "chunk_windows",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, greatest(len(w) - 51, 0) + 1, 150)) AS start FROM w WHERE len(w) > 0)
    SELECT doc_id, start::INTEGER AS start, least(200, n - start)::INTEGER AS n_words, md5(array_to_string(w[start + 1 : start + 200], ' ')) AS digest FROM s WHERE n <= 200 OR least(200, n - start) >= 20""",
)
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    c = tx.chunk_rows(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "start", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "paragraph_islands",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM l)
    SELECT doc_id, min(i)::INTEGER AS line, count(*) AS n_lines FROM g WHERE trim(line) <> '' GROUP BY doc_id, grp""",
)
def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    grp = F.sum((F.trim("line") == "").cast("int")).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("grp", grp).where(F.trim("line") != "").groupBy("doc_id", "grp").agg((F.min("i") + 1).alias("line"), F.count("*").alias("n_lines")).drop("grp")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality")
    x = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select(F.col("doc_id").alias("pos"), F.when(q == 1, "include").when(q == 0, "exclude").otherwise("maybe").alias("decision"), F.concat_ws(" ", F.upper("lang"), F.col("source")).alias("reason"))


_DEC = "dec AS (SELECT d.doc_id AS pos, CASE WHEN quality = 1 THEN 'include' WHEN quality = 0 THEN 'exclude' ELSE 'maybe' END AS decision, upper(lang) || ' ' || source AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("prisma_funnel", f"""WITH {_DEC} SELECT count(*) AS screened, count(*) FILTER (decision = 'include') AS include, count(*) FILTER (decision = 'exclude') AS exclude, count(*) FILTER (decision = 'maybe') AS maybe FROM dec""")
def prisma_funnel(spark: SparkSession, d: str) -> DataFrame:
    return summaries.funnel(_decisions(spark, d))


@query("exclusion_reasons_top20", f"WITH {_DEC} SELECT lower(reason) AS reason, count(*) AS n FROM dec WHERE decision = 'exclude' GROUP BY 1 ORDER BY n DESC, min(pos) LIMIT 20")
def exclusion_reasons_top20(spark: SparkSession, d: str) -> DataFrame:
    return summaries.exclusion_reasons(_decisions(spark, d))


@query("review_queue", f"WITH {_DEC} SELECT pos, decision, coalesce(toxic, 0) = 1 AS flagged, row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, pos) - 1 AS place FROM dec LEFT JOIN labels l ON l.doc_id = pos")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with their audit, flagged ones first."""
    from scholium.operators.numbering import number_rows

    x = _decisions(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("pos"), "toxic"), "pos", "left")
    x = x.select("pos", "decision", (F.coalesce("toxic", F.lit(0)) == 1).alias("flagged")).withColumn("o", F.when(F.col("flagged"), 0).otherwise(1))
    return number_rows(x, ["o", "pos"], number="place").drop("o")


@query("validation_summary", "SELECT count(*) AS touched, count(*) FILTER (quality IS NOT NULL) AS reviewed, count(*) FILTER (quality <> toxic) AS flipped, (count(*) FILTER (quality IS NOT NULL) - count(*) FILTER (quality <> toxic)) / nullif(count(*) FILTER (quality IS NOT NULL), 0)::DOUBLE AS agreement FROM labels")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.validation_summary(table(spark, d, "labels").select(F.col("quality").isNotNull().alias("reviewed"), (F.col("quality") != F.col("toxic")).alias("flip")))


@query(
    "list_counter",
    """WITH x AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
    n AS (SELECT doc_id, i, lower(trim(regexp_replace(w, '\\s+', ' ', 'g'))) AS value FROM x) SELECT value, count(*) AS n FROM n WHERE value <> '' AND value NOT IN ('the', 'of') GROUP BY value""",
)
def list_counter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.split("text", " ").alias("themes"))
    return summaries.list_counter(docs, summaries.ListCounter("themes", drop=("the", "of")))


@query("scalar_counter", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 3")
def scalar_counter(spark: SparkSession, d: str) -> DataFrame:
    return summaries.scalar_counter(table(spark, d, "documents").withColumnRenamed("doc_id", "pos"), summaries.ScalarCounter("lang", top=3, default="none"))


@query(
    "numeric_band",
    """WITH v AS (SELECT doc_id, unnest(regexp_extract_all('took ' || (doc_id % 97) || ' hours and ' || (doc_id % 13) || ' days', '(\\d+) hours', 1))::DOUBLE AS value FROM documents
    UNION ALL SELECT doc_id, unnest(regexp_extract_all('took ' || (doc_id % 97) || ' hours and ' || (doc_id % 13) || ' days', '(\\d+) days', 1))::DOUBLE * 24 FROM documents)
    SELECT (SELECT count(*) FROM documents) AS n_papers, count(*) AS n_values, min(value) AS min, max(value) AS max, count(*) FILTER (value BETWEEN 24 AND 72) AS n_in_band, list_sort(list(value))[count(*) // 2 + 1] AS median FROM v""",
)
def numeric_band(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("took "), (F.col("doc_id") % 97).cast("string"), F.lit(" hours and "), (F.col("doc_id") % 13).cast("string"), F.lit(" days")).alias("lead_time"))
    spec = summaries.NumericExtractor("lead_time", "doc_id", {"hours": r"(\d+) hours", "days": r"(\d+) days"}, "hours", {"days": 24.0}, (24, 72))
    return summaries.numeric_extractor(docs, spec)


def _store(spark: SparkSession, d: str):
    lab = table(spark, d, "labels")
    one = lambda v, k, c: lab.select(F.col("doc_id").alias("pmid"), F.lit(v).alias("rubric_version"), F.lit(k).alias("dimension"), c.alias("rating"))
    q, t = F.col("quality"), F.col("toxic")
    r = one("v1", "construct", F.when(q == 1, "good").otherwise("suspect")).unionByName(one("v1", "harm", F.when(t == 1, "suspect").otherwise("acceptable")))
    r = r.unionByName(one("v2", "construct", F.when((q == 1) & (F.col("doc_id") % 7 != 0), "good").otherwise("missing")))
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), F.lit("run1").alias("cluster_run_id"), F.col("label").alias("cluster_id"))
    c = a.select("cluster_run_id", "cluster_id").distinct().withColumn("cluster_name", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")))
    ex = lab.where("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("pmid"))
    return r, a, c, ex


_RATE = """r AS (SELECT doc_id AS pmid, 'v1' AS rubric_version, 'construct' AS dimension, CASE WHEN quality = 1 THEN 'good' ELSE 'suspect' END AS rating FROM labels
    UNION ALL SELECT doc_id, 'v1', 'harm', CASE WHEN toxic = 1 THEN 'suspect' ELSE 'acceptable' END FROM labels
    UNION ALL SELECT doc_id, 'v2', 'construct', CASE WHEN quality = 1 AND doc_id % 7 <> 0 THEN 'good' ELSE 'missing' END FROM labels), ex AS (SELECT doc_id AS pmid FROM labels WHERE toxic = 1 AND quality = 0)"""


@query("prevalence", f"WITH {_RATE} SELECT dimension, rating, count(DISTINCT pmid) AS n FROM r WHERE pmid NOT IN (SELECT pmid FROM ex) GROUP BY ALL")
def prevalence(spark: SparkSession, d: str) -> DataFrame:
    r, _, _, ex = _store(spark, d)
    return audit.prevalence(r, ex)


@query("by_cluster", f"WITH {_RATE} SELECT label AS cluster_id, 'cluster ' || label AS cluster_name, rating, count(DISTINCT pmid) AS n FROM r JOIN embeddings ON pmid = vec_id WHERE dimension = 'construct' AND pmid NOT IN (SELECT pmid FROM ex) GROUP BY ALL")
def by_cluster(spark: SparkSession, d: str) -> DataFrame:
    r, a, c, ex = _store(spark, d)
    return audit.by_cluster(r, a, c, "construct", "run1", ex)


@query("drift", f"WITH {_RATE} SELECT dimension, count(*) AS n_papers, count(*) FILTER (x.rating <> y.rating) AS n_changed FROM r x JOIN r y USING (pmid, dimension) WHERE x.rubric_version = 'v1' AND y.rubric_version = 'v2' GROUP BY dimension")
def drift(spark: SparkSession, d: str) -> DataFrame:
    return audit.drift(_store(spark, d)[0], "v1", "v2")


@query("rated_papers", f"WITH {_RATE} SELECT rubric_version, count(DISTINCT pmid) AS n_papers FROM r GROUP BY ROLLUP (rubric_version)")
def rated_papers(spark: SparkSession, d: str) -> DataFrame:
    return audit.rated_papers(_store(spark, d)[0])


@query("coverage", f"WITH {_RATE} SELECT dims_rated, count(*) AS n_papers FROM (SELECT pmid, count(DISTINCT dimension) AS dims_rated FROM r GROUP BY pmid) GROUP BY dims_rated")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(_store(spark, d)[0])


@query("rater_agreement", f"WITH {_RATE} SELECT dimension, count(*) AS n, avg(CASE WHEN x.rating = y.rating THEN 1.0::DOUBLE ELSE 0 END) AS agreement FROM r x JOIN r y USING (pmid, dimension) WHERE x.rubric_version = 'v1' AND y.rubric_version = 'v2' GROUP BY dimension")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    r = _store(spark, d)[0]
    return audit.agreement(r.where("rubric_version = 'v1'"), r.where("rubric_version = 'v2'"))


_STRENGTH = {k: " + ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{p}\\b') THEN 1 ELSE 0 END" for p in v) for k, v in (("h", claims.HEDGES), ("s", claims.AMPLIFIERS + claims.CAUSAL))}


@query(
    "claim_strength",
    f"""WITH c AS (SELECT conv_id, turn, text, {_STRENGTH['h']} AS h, {_STRENGTH['s']} AS s, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM conversations)
    SELECT conv_id, turn, round(CASE WHEN h + s = 0 THEN least(0.5::DOUBLE, 0.3::DOUBLE + 0.01::DOUBLE * n) ELSE ((s - h)::DOUBLE / (h + s) + 1) / 2 END, 6) AS strength FROM c""",
)
def claim_strength(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(claims.claim_strength(F.col("text")), 6).alias("strength"))


@query(
    "hedge_escalation",
    f"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'this may suggest ' WHEN 1 THEN 'this shows ' ELSE '' END || text AS text FROM conversations),
    c AS (SELECT conv_id, turn, {_STRENGTH['h']} AS h, {_STRENGTH['s']} AS s, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM t),
    v AS (SELECT conv_id, turn, round(CASE WHEN h + s = 0 THEN least(0.5::DOUBLE, 0.3::DOUBLE + 0.01::DOUBLE * n) ELSE ((s - h)::DOUBLE / (h + s) + 1) / 2 END, 3) AS strength FROM c),
    w AS (SELECT *, min(strength) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS weakest FROM v)
    SELECT conv_id, turn AS late, strength, weakest, round(strength - weakest, 3) AS delta FROM w WHERE strength >= 0.5 AND strength - weakest >= 0.3 - 1e-9""",
)
def hedge_escalation(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("turn") % 3 == 0, "this may suggest ").when(F.col("turn") % 3 == 1, "this shows ").otherwise("")
    t = table(spark, d, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("sentence"))
    return claims.escalations(t, "conv_id", "turn", 0.3)


@query("text_collection", "SELECT conv_id::VARCHAR AS pmid, role AS speaker, text FROM conversations WHERE trim(text) <> ''")
def text_collection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "pmid")
    return summaries.text_collection(c, summaries.TextCollection("text", ("pmid", "role"), {"role": "speaker"}))


@query("doi_norm", "SELECT page_id, 'https://doi.org/10.1/' || page_id AS raw, '10.1/' || page_id AS doi FROM pages")
def doi_norm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://doi.org/10.1/"), F.col("page_id").cast("string")).alias("raw"))
    return p.withColumn("doi", tx.norm_doi(F.col("raw")))


@query("storage_eviction", "WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(n_chars) OVER () AS total FROM documents) SELECT doc_id, n_chars, CAST(coalesce(before, 0) AS BIGINT) AS freed_before FROM r WHERE coalesce(before, 0) < total - 1000000")
def storage_eviction(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", "n_chars", F.col("n_chars").alias("score"))
    return resolve.eviction(c, 1_000_000, "n_chars", "score", "doc_id").select("doc_id", "n_chars", "freed_before")


@query("concentration", "WITH c AS (SELECT lang AS paper, source AS institution, count(*) AS k FROM documents GROUP BY ALL), r AS (SELECT *, CAST(sum(k) OVER (PARTITION BY paper) AS BIGINT) AS total, row_number() OVER (PARTITION BY paper ORDER BY k DESC, institution) AS rn FROM c) SELECT paper, institution, k, total FROM r WHERE rn = 1")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return resolve.concentration(table(spark, d, "documents").select(F.col("lang").alias("paper"), F.col("source").alias("institution")), "paper", "institution")
