"""Queries of bibliographies: items, entries, projects, merging, keys and checks, over sources written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import people, resolve
from scholium.plans.registry import query, table
from scholium.sources import bibitem, readers
from scholium.sources.sinks import write_csv

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _part(spark: SparkSession, d: str) -> DataFrame:
    """Parts as works: k, title (their names and numbers), year, style."""
    k = F.col("p_partkey")
    title = F.concat(F.lit("Study of the "), "p_name", F.lit(" number "), S(k))
    return table(spark, d, "part").select(k.alias("k"), title.alias("title"), (1950 + k % 70).alias("year"), (k % 6).alias("style"), F.col("p_size").alias("size"))


_PART = "w AS (SELECT p_partkey AS k, 'Study of the ' || p_name || ' number ' || p_partkey AS title, (1950 + p_partkey % 70)::VARCHAR AS year, p_partkey % 6 AS style, p_size AS size FROM part)"


def _item(style: Column, title: Column, year: Column) -> Column:
    """A work as an item's text, in one of six styles."""
    y = S(year)
    bodies = [
        F.concat(F.lit("A.~Smith and B.~Jones, ``"), title, F.lit(",'' \\textit{Annals} 12, 34-56 ("), y, F.lit(").")),
        F.concat(F.lit("Smith, A., Jones, B. ("), y, F.lit("). "), title, F.lit(". \\emph{Annals}, 12(3), 34-56.")),
        F.concat(F.lit("Smith A, Jones B. "), title, F.lit(". Annals "), y, F.lit(";12:34-56.")),
        F.concat(F.lit("Smith A. "), title, F.lit(". Oslo: House; "), y, F.lit(".")),
        F.concat(F.lit("A. Smith, "), title, F.lit(". Annals, 12, 34-56 ("), y, F.lit(")")),
        F.concat(F.lit("Smith, "), title, F.lit(", "), y, F.lit(", vol 3")),
    ]
    out = F.when(style == 0, bodies[0])
    for i in range(1, 6):
        out = out.when(style == i, bodies[i])
    return out


@query(
    "bibitem_styles",
    f"""WITH {_PART} SELECT 'k' || k AS cite_key, title, year, CASE style WHEN 0 THEN 'A. Smith and B. Jones' WHEN 1 THEN 'Smith, A., Jones, B' WHEN 2 THEN 'Smith A, Jones B' WHEN 3 THEN 'Smith A' WHEN 4 THEN 'A. Smith' ELSE 'Smith' END AS author,
    CASE WHEN style IN (3, 5) THEN '' ELSE 'Annals' END AS journal, CASE WHEN style IN (3, 5) THEN '' ELSE '12' END AS volume, CASE WHEN style = 1 THEN '3' ELSE '' END AS number, CASE WHEN style IN (3, 5) THEN '' ELSE '34-56' END AS pages, CASE WHEN style = 3 THEN 'Oslo: House' ELSE '' END AS publisher FROM w""",
)
def bibitem_styles(spark: SparkSession, d: str) -> DataFrame:
    """Each work in a source of its own, in one of six styles, read back."""
    w = _part(spark, d)
    tex = F.concat(F.lit("text\n\\begin{thebibliography}{99}\n\\bibitem{k"), S("k"), F.lit("} "), _item(F.col("style"), F.col("title"), F.col("year")), F.lit("\n\\end{thebibliography}\n"))
    return bibitem.bibitems(w.select(S("k").alias("source_file"), tex.alias("text"))).select("cite_key", "title", "year", "author", "journal", "volume", "number", "pages", "publisher")


def _entry(k: Column, title: Column, year: Column) -> Column:
    return F.concat(F.lit("% note\n@Article {p"), S(k), F.lit(",\n  title = {The {"), title, F.lit("}},\n  year = "), S(year), F.lit(",\n  journal = \"Annals, new\",\n  doi={10.1/"), S(k), F.lit("}, eprint={2101.0"), S(1000 + k % 9000), F.lit("}, archivePrefix={arXiv}\n}\n"))


@query("bibtex_entries", f"WITH {_PART} SELECT 'p' || k AS cite_key, 'article' AS entry_type, 'The ' || title AS title, year, 'Annals, new' AS journal, '10.1/' || k AS doi, '2101.0' || (1000 + k % 9000) AS arxiv_id FROM w")
def bibtex_entries(spark: SparkSession, d: str) -> DataFrame:
    w = _part(spark, d)
    return readers.bibtex(w.select(S("k").alias("source_file"), _entry(F.col("k"), F.col("title"), F.col("year")).alias("text"))).select("cite_key", "entry_type", "title", "year", "journal", "doi", "arxiv_id")


def _project(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each part size: a source a part, every third with an item, all naming the folder's first bibliography; the second is named by none; a skipped folder's source."""
    w = _part(spark, d)
    folder = F.concat(F.lit("root/p"), S("size"), F.lit("/"))
    item = F.concat(F.lit("\\begin{thebibliography}{9}\n\\bibitem{i"), S("k"), F.lit("} "), _item(F.lit(2), F.col("title"), F.col("year")), F.lit("\n\\end{thebibliography}\n"))
    tex = w.select(F.concat(folder, F.lit("t"), S("k"), F.lit(".tex")).alias("path"), F.concat(F.when(F.col("k") % 3 == 0, item).otherwise(""), F.lit("\\bibliography{refs, gone}\n")).alias("text"))
    sizes = w.select("size").distinct()
    bib = lambda name: sizes.select(F.concat(folder, F.lit(name)).alias("path"), _entry(F.col("size"), F.lit(name), F.lit(2000)).alias("text"))
    old = sizes.select(F.concat(folder, F.lit("archive/x.tex")).alias("path"), F.lit("\\begin{thebibliography}{9}\n\\bibitem{o} A. B. Title of it. Annals 2001;1:2.\n\\end{thebibliography}").alias("text"))
    return tex.unionByName(bib("refs.bib")).unionByName(bib("orphan.bib")).unionByName(old)


@query("project_walk", f"WITH {_PART}, s AS (SELECT count(DISTINCT size) AS n FROM w) SELECT count(*) AS tex_files, 2 * min(n) AS bib_files, count(*) FILTER (k % 3 = 0) AS bibitems, 2 * min(n) AS bibtex, 2 * min(n) AS with_doi, 2 * min(n) AS with_arxiv, count(*) FILTER (k % 3 = 0) + 2 * min(n) AS with_title FROM w, s")
def project_walk(spark: SparkSession, d: str) -> DataFrame:
    files = _project(spark, d)
    return bibitem.project_stats(files, bibitem.project_references(files))


@query("bib_resolution", f"WITH {_PART} SELECT DISTINCT 'root/p' || size || '/' || f AS source_file, f = 'refs.bib' AS cited FROM w, (SELECT unnest(['refs.bib', 'orphan.bib']) AS f)")
def bib_resolution(spark: SparkSession, d: str) -> DataFrame:
    return bibitem.project_references(_project(spark, d)).where("source_format = 'bibtex'").select("source_file", "cited")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as references: several a customer's key, BibTeX where finished, fields blank by their number."""
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        S("o_custkey").alias("cite_key"), F.when(o % 3 == 0, "  ").otherwise(F.concat(F.lit("Title "), S(o))).alias("title"), F.when(o % 4 == 0, None).otherwise(S(F.year("o_orderdate"))).alias("year"),
        F.when(o % 5 == 0, "").otherwise(F.concat(F.lit("10.2/"), S(o))).alias("doi"), F.lit("").alias("journal"), F.when(F.col("o_orderstatus") == "F", "bibtex").otherwise("bibitem").alias("source_format"),
        F.concat(F.lit("f"), S(o % 7), F.lit(".bib")).alias("source_file"), o.alias("pos"),
    )


_FIRST = "first({c} ORDER BY o_orderstatus <> 'F', o_orderkey) FILTER ({w})"


@query(
    "merge_references",
    f"""SELECT o_custkey::VARCHAR AS cite_key, {_FIRST.format(c="'Title ' || o_orderkey", w="o_orderkey % 3 <> 0")} AS title, {_FIRST.format(c="year(o_orderdate)::VARCHAR", w="o_orderkey % 4 <> 0")} AS year,
    {_FIRST.format(c="'10.2/' || o_orderkey", w="o_orderkey % 5 <> 0")} AS doi, array_to_string(list_sort(list(DISTINCT 'f' || o_orderkey % 7 || '.bib')), ' ') AS source_files, min(o_orderkey) AS pos FROM orders GROUP BY o_custkey""",
)
def merge_references(spark: SparkSession, d: str) -> DataFrame:
    m = resolve.merge_references(_refs(spark, d))
    return m.select("cite_key", "title", "year", "doi", F.array_join("source_files", " ").alias("source_files"), "pos")


@query("fuzzy_titles", "WITH w AS (SELECT p_partkey AS k, p_partkey // 3 AS g FROM part) SELECT 'k' || k AS cite_key, 'k' || min(k) OVER (PARTITION BY g, k % 3 = 2) AS leader FROM w")
def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    """Works in threes with nearly equal titles, the third of another year; years are as many as works, so that no year is large."""
    k = F.col("p_partkey")
    g = F.floor(k / 3)
    title = F.concat(F.md5(S(g).cast("binary")), F.lit(" on the "), F.md5(S(g + 7).cast("binary")), F.when(k % 3 == 1, F.lit(" ii")).otherwise(""))
    refs = table(spark, d, "part").select(F.concat(F.lit("k"), S(k)).alias("cite_key"), title.alias("title"), F.when(k % 3 == 2, S(1800 + g % 50)).otherwise(S(1900 + g % 50)).alias("year"), k.alias("pos"))
    return resolve.fuzzy_groups(refs).select("cite_key", "leader")


@query("normal_titles", f"WITH {_PART} SELECT k, lower(title) || ' for x y' AS title FROM w")
def normal_titles(spark: SparkSession, d: str) -> DataFrame:
    w = _part(spark, d)
    return w.select("k", tx.bare_title(F.concat(F.lit("\\textbf{"), "title", F.lit("}  {for} \\emph{X}\\relax{} $y$"))).alias("title"))


@query("doi_variants", "SELECT page_id, '10.1/ab' || page_id AS plain, CASE WHEN page_id % 4 = 3 THEN 'doi: 10.1/ab' || page_id ELSE '10.1/ab' || page_id END AS resolver_only, CASE WHEN page_id % 4 IN (0, 1) THEN '10.1/ab' || page_id END AS web FROM pages")
def doi_variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    lead = F.when(k % 4 == 0, "https://doi.org/").when(k % 4 == 1, " HTTP://dx.doi.org/").when(k % 4 == 2, "").otherwise("DOI: ")
    p = table(spark, d, "pages").select("page_id", F.concat(lead, F.lit("10.1/aB"), S(k), F.lit(" ")).alias("raw"))
    return p.select("page_id", tx.norm_doi(F.col("raw")).alias("plain"), tx.resolver_doi(F.col("raw")).alias("resolver_only"), tx.web_doi(F.col("raw")).alias("web"))


@query("cite_key_ladder", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'doi-10-1-x-' || page_id WHEN 1 THEN 'pmid-' || page_id WHEN 2 THEN 'md5-' || substring(md5('b' || page_id), 1, 12) ELSE 'item-a-title-' || page_id END AS cite_key FROM pages")
def cite_key_ladder(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", F.when(k % 4 == 0, F.concat(F.lit("10.1/X_"), S(k))).alias("doi"), F.when(k % 4 == 1, S(k)).alias("pmid"), F.when(k % 4 == 2, F.concat(F.lit("b"), S(k)).cast("binary")).alias("body"), F.concat(F.lit("A Title: "), S(k), F.lit("!")).alias("title"))
    return p.select("page_id", tx.library_key(F.col("doi"), F.col("pmid"), F.col("body"), F.col("title")).alias("cite_key"))


@query(
    "cross_database_dedup",
    """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, source, 'a' || sha1(text) AS k1, 'b' || (n_chars % 400) AS k2 FROM documents),
    r AS (SELECT 0::BIGINT AS rn, '' AS source, []::VARCHAR[] AS seen, true AS kept
    UNION ALL SELECT o.rn, o.source, CASE WHEN list_has_any(r.seen, [k1, k2]) THEN r.seen ELSE list_concat(r.seen, [k1, k2]) END, NOT list_has_any(r.seen, [k1, k2]) FROM r JOIN o ON o.rn = r.rn + 1)
    SELECT source, count(*) AS records, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS duplicates FROM r WHERE rn > 0 GROUP BY source""",
)
def cross_database_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts' digests, and lengths modulo 400, as two keys; sources as databases."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("k1"), (F.col("n_chars") % 400).alias("k2"))
    return resolve.dedup_stats(resolve.ordered_dedup(docs, [F.col("k1"), F.col("k2")], "doc_id", "doc_id"), "source")


@query(
    "depth2_references",
    """WITH f AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '10.3/' || (o_orderkey % 7000) END AS doi, 'The work ' || (o_orderkey % 5000) AS title, 'smith' || (o_orderkey % 50) AS key FROM orders),
    i AS (SELECT *, coalesce('d:' || doi, 't:' || lower(title)) AS id FROM f), n AS (SELECT * FROM i WHERE id NOT IN (SELECT 'd:10.3/' || p_partkey FROM part) AND id NOT IN (SELECT 't:the work ' || p_partkey FROM part)),
    u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS kn FROM u WHERE rn = 1)
    SELECT pos, CASE WHEN kn > 1 THEN key || '_' || (kn - 1) ELSE key END AS key FROM k""",
)
def depth2_references(spark: SparkSession, d: str) -> DataFrame:
    """References of citing works against parts as the known ones."""
    o = F.col("o_orderkey")
    works = table(spark, d, "orders").select(F.array(F.struct(F.when(o % 3 != 0, F.concat(F.lit("https://doi.org/10.3/"), S(o % 7000))).alias("doi"), F.concat(F.lit("The Work "), S(o % 5000)).alias("title"), F.concat(F.lit("smith"), S(o % 50)).alias("key"))).alias("references"), o.alias("pos"))
    known = table(spark, d, "part").select(F.concat(F.lit("10.3/"), S("p_partkey")).alias("doi"), F.concat(F.lit("the work "), S("p_partkey")).alias("title"))
    k2 = known.select(F.lit(None).cast("string").alias("doi"), "title")
    return people.new_references(people.cited_references(works), known.unionByName(k2)).select("pos", "key")


@query("crossref_match", "SELECT 'k' || p_partkey AS cite_key, CASE WHEN p_partkey % 3 < 2 THEN '10.4/' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN 1.15::DOUBLE WHEN p_partkey % 3 = 1 THEN 1.0::DOUBLE END AS score FROM part")
def crossref_match(spark: SparkSession, d: str) -> DataFrame:
    """Three candidates a work: another title, its own, and its own again; the year fits for a third, no title for another."""
    k = F.col("p_partkey")
    w = table(spark, d, "part").select(F.concat(F.lit("k"), S(k)).alias("cite_key"), F.md5(S(k).cast("binary")).alias("title"), F.lit("2001").alias("year"), k)
    own = F.when(k % 3 < 2, F.upper("title")).otherwise(F.md5(F.concat(S(k), F.lit("z")).cast("binary")))
    cand = lambda i, t, doi: F.struct(F.lit(i).alias("pos"), doi.alias("doi"), t.alias("title"), F.when(k % 3 == 0, "2001").otherwise("1999").alias("year"))
    c = w.select("cite_key", F.explode(F.array(cand(0, F.reverse("title"), F.lit("10.4/other")), cand(1, own, F.concat(F.lit("10.4/"), S(k))), cand(2, own, F.lit("10.4/later")))).alias("c")).select("cite_key", "c.*")
    return people.best_match(w, c).select("cite_key", "doi", F.round("score", 6).alias("score"))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    types = F.when(k % 11 == 0, F.array(F.lit("Correction"), F.lit("Retraction"))).when(k % 11 == 1, F.array(F.lit("expression_of_concern"))).when(k % 11 == 2, F.array(F.lit("erratum"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(F.concat(F.lit("10.5/"), S(k)).alias("doi"), F.concat(F.lit("On the "), "p_name", F.lit(" in depth")).alias("title"), (1950 + k % 70).alias("year"), types.alias("update_types"))


_WATCH = "w AS (SELECT '10.5/' || (o_orderkey % 1000) AS doi, last(CASE o_orderkey % 3 WHEN 0 THEN 'Retraction' WHEN 1 THEN 'Expression of concern' ELSE 'Reinstatement' END ORDER BY o_orderkey) AS nature FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)"
_RANK = "CASE greatest(CASE p_partkey % 11 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END, CASE nature WHEN 'Retraction' THEN 3 WHEN 'Expression of concern' THEN 2 ELSE 0 END) WHEN 3 THEN 'retracted' WHEN 2 THEN 'concern' WHEN 1 THEN 'corrected' END"


def _watch(spark: SparkSession, d: str) -> DataFrame:
    """A retraction list as a file: the last row of a DOI counts, and some have none."""
    o = F.col("o_orderkey")
    rows = table(spark, d, "orders").where(o % 4 == 0).select(F.when(o % 20 == 16, "Unavailable").otherwise(F.concat(F.lit(" 10.5/"), S(o % 1000))).alias("OriginalPaperDOI"), F.when(o % 3 == 0, "Retraction").when(o % 3 == 1, "Expression of concern").otherwise("Reinstatement").alias("RetractionNature"), o)
    return readers.retraction_csv(spark, write_csv(rows, ["o_orderkey"]))


@query("retraction_list", _WATCH.join(["WITH ", " SELECT doi, nature FROM w"]).replace("o_orderkey % 4 = 0", "o_orderkey % 4 = 0 AND o_orderkey % 20 <> 16"))
def retraction_list(spark: SparkSession, d: str) -> DataFrame:
    w = _watch(spark, d).where("doi <> 'unavailable'")
    return w.groupBy("doi").agg(F.max_by("nature", "pos").alias("nature"))


@query("retraction_status", f"WITH {_WATCH.replace('o_orderkey % 4 = 0', 'o_orderkey % 4 = 0 AND o_orderkey % 20 <> 16')} SELECT '10.5/' || p_partkey AS doi, {_RANK} AS status FROM part LEFT JOIN w ON doi = '10.5/' || p_partkey")
def retraction_status(spark: SparkSession, d: str) -> DataFrame:
    return resolve.retraction_status(_snapshot(spark, d), _watch(spark, d))


@query(
    "verify_dois",
    f"""WITH {_WATCH.replace('o_orderkey % 4 = 0', 'o_orderkey % 4 = 0 AND o_orderkey % 20 <> 16')}, s AS (SELECT p_partkey, {_RANK} AS status FROM part LEFT JOIN w ON doi = '10.5/' || p_partkey)
    SELECT 'k' || p_partkey AS cite_key, CASE WHEN p_partkey % 13 = 5 THEN 'not_found' ELSE coalesce(status, CASE WHEN p_partkey % 7 < 2 THEN 'mismatch' ELSE 'ok' END) END AS status FROM s""",
)
def verify_dois(spark: SparkSession, d: str) -> DataFrame:
    """References with a wrong title, a wrong year and an unknown DOI among right ones."""
    k = F.col("p_partkey")
    doi = F.concat(F.lit("doi: 10.5/"), S(k), F.when(k % 13 == 5, "-none").otherwise(""))
    refs = table(spark, d, "part").select(F.concat(F.lit("k"), S(k)).alias("cite_key"), doi.alias("doi"), F.when(k % 7 == 0, "Zzz qqq vvv").otherwise(F.concat(F.lit("{On} the "), "p_name", F.lit(" in depth"))).alias("title"), S(F.when(k % 7 == 1, 1800).otherwise(1950 + k % 70)).alias("year"))
    return resolve.verify_dois(refs, _snapshot(spark, d), _watch(spark, d)).select("cite_key", "status")


@query("first_match", "WITH a AS (SELECT c_nationkey::VARCHAR AS k, min(c_custkey) AS id FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_mktsegment AS k, min(c_custkey) AS id FROM customer GROUP BY 1) SELECT s_suppkey, coalesce(a.id, b.id) AS found FROM supplier LEFT JOIN a ON s_nationkey % 40 = a.k::INT LEFT JOIN b ON b.k = CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'none' ELSE '' END")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers looked up among customers by nation, then by segment; empty keys match nothing."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, S("c_nationkey")).otherwise("").alias("doi"), F.col("c_mktsegment").alias("pmid"))
    k = F.col("s_suppkey") % 3
    s = table(spark, d, "supplier").select("s_suppkey", S("s_nationkey").alias("doi"), F.when(k == 0, "BUILDING").when(k == 1, "none").otherwise("").alias("pmid"))
    return resolve.first_match(s, c, ["doi", "pmid"]).select("s_suppkey", "found")


@query("alternate_keys", "WITH p AS (SELECT p_partkey, 'k' || p_partkey AS own, 'k' || (p_partkey + 1) AS alt FROM part WHERE p_partkey % 3 <> 0) SELECT DISTINCT 'k' || l_partkey AS cite_key, coalesce((SELECT own FROM p WHERE own = 'k' || l_partkey), (SELECT min(own) FROM p WHERE alt = 'k' || l_partkey)) AS found FROM lineitem")
def alternate_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    refs = table(spark, d, "part").where(k % 3 != 0).select(F.concat(F.lit("k"), S(k)).alias("cite_key"), F.array(F.concat(F.lit("k"), S(k + 1))).alias("alternate_keys"))
    return resolve.by_any_key(table(spark, d, "lineitem").select(F.concat(F.lit("k"), S("l_partkey")).alias("cite_key")).distinct(), refs)


@query(
    "related_work",
    """WITH w AS (SELECT p_partkey AS k, '10.6/' || p_partkey AS doi, 'Effects of a ' || p_name || ' beyond ' || p_partkey AS title FROM part)
    SELECT k FROM w WHERE k % 5 <> 0 AND k % 7 <> 3 AND title NOT LIKE '%smith2003%' AND k % 4 <> 1 AND k % 9 <> 2""",
)
def related_work(spark: SparkSession, d: str) -> DataFrame:
    """Works found, less known DOIs (every fifth), known titles (by remainder of 7), titles with a cite key, and short abstracts."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    title = F.concat(F.lit("Effects of a "), "p_name", F.lit(" beyond "), S(k))
    w = p.select(k.alias("k"), F.concat(F.lit("https://doi.org/10.6/"), S(k)).alias("doi"), F.when(k % 4 == 1, F.concat(title, F.lit(" smith2003"))).otherwise(title).alias("title"), F.when(k % 9 == 2, "too short").otherwise(F.repeat(F.lit("word "), 25)).alias("abstract"))
    known = p.where((k % 5 == 0) | (k % 7 == 3)).select(F.when(k % 5 == 0, F.concat(F.lit("10.6/"), S(k))).alias("doi"), F.when(k % 7 == 3, F.upper(title)).alias("title"), F.lit("smith2003").alias("cite_key"))
    return resolve.related_work(w, known).select("k")


@query(
    "deduplicated_references",
    """WITH w AS (SELECT p_partkey AS k, p_partkey // 3 AS g, p_partkey % 3 = 2 AS late FROM part) SELECT coalesce('k' || min(k) FILTER (k % 3 = 1), 'k' || min(k)) AS cite_key, count(*) AS n, array_to_string(list_sort(list(DISTINCT 'f' || k % 5)), ' ') AS files,
    coalesce(array_to_string(list_sort(list('k' || k) FILTER (NOT (k % 3 = 1) AND (k % 3 <> 0 OR has1) AND NOT late OR (k % 3 = 0 AND has1))), ' '), '') AS others FROM (SELECT *, max((k % 3 = 1)::INT) OVER (PARTITION BY g, late) = 1 AS has1 FROM w) GROUP BY g, late""",
)
def deduplicated_references(spark: SparkSession, d: str) -> DataFrame:
    """Works in threes with nearly equal titles: two of one year, of which the second is BibTeX and so keeps its key, and one of another."""
    k = F.col("p_partkey")
    g = F.floor(k / 3)
    title = F.concat(F.md5(S(g).cast("binary")), F.lit(" on the "), F.md5(S(g + 7).cast("binary")), F.when(k % 3 == 1, F.lit(" ii")).otherwise(""))
    refs = table(spark, d, "part").select(F.concat(F.lit("k"), S(k)).alias("cite_key"), title.alias("title"), F.when(k % 3 == 2, S(1800 + g % 50)).otherwise(S(1900 + g % 50)).alias("year"), F.lit("").alias("doi"), F.lit("").alias("journal"), F.when(k % 3 == 1, "bibtex").otherwise("bibitem").alias("source_format"), F.concat(F.lit("f"), S(k % 5)).alias("source_file"), k.alias("pos"))
    r = resolve.deduplicate_references(refs)
    return r.select("cite_key", (F.size("alternate_keys") + 1).cast("long").alias("n"), F.array_join("source_files", " ").alias("files"), F.array_join("alternate_keys", " ").alias("others"))


@query("ris_records", "SELECT page_id::VARCHAR AS pmid, 'Title ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Words of it' END AS abstract, 'Annals' AS journal, '2001' AS year, '10.1/' || page_id AS doi, 'Doe, Jane|Roe, Max' AS authors FROM pages UNION ALL SELECT NULL, 'Second', NULL, NULL, NULL, NULL, '' FROM pages")
def ris_records(spark: SparkSession, d: str) -> DataFrame:
    """Exports of two records each, with tags of either kind."""
    k = S("page_id")
    t = F.concat(F.lit("TY  - JOUR\nAN  - "), k, F.lit("\nTI  - Title "), k, F.lit("\nAU  - Doe, Jane\nA1  - Roe, Max\n"), F.when(F.col("page_id") % 2 == 0, "N2  - Words of it\n").otherwise(""), F.lit("JO  - Annals\nY1  - 2001/03/04/\nDO  - 10.1/"), k, F.lit("\nER  - \n\nTY  - JOUR\nT1  - Second\nER  - \n"))
    return readers.ris(table(spark, d, "pages").select(t.alias("text"))).withColumn("authors", F.array_join("authors", "|"))


@query("database_export", "SELECT p_partkey::VARCHAR AS pmid, 'On \"' || p_name || '\", again' AS title, NULL::VARCHAR AS doi FROM part")
def database_export(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(S("p_partkey").alias("Accession"), F.concat(F.lit('On "'), "p_name", F.lit('", again')).alias("Article Title"))
    from scholium.runtime import table_path

    path = table_path(spark, "csv")
    p.write.option("header", True).option("escape", '"').csv(path)
    return readers.database_csv(spark, path, {"pmid": "Accession", "title": "Article Title", "doi": "DOI"})


@query("projected_fields", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS maker, '' AS gone FROM part")
def projected_fields(spark: SparkSession, d: str) -> DataFrame:
    from scholium.operators import summaries

    p = table(spark, d, "part").withColumn("p_brand", F.when(F.col("p_size") > 10, F.col("p_brand")))
    return summaries.project(p, ["p_partkey", "p_brand", "gone"], {"p_partkey": "id", "p_brand": "maker"})
