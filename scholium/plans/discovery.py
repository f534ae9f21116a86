"""Queries of discovery, sources, sinks and libraries: records written out and read again, filters, publishers, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import library, people
from scholium.plans.registry import query, table
from scholium.runtime import table_path
from scholium.sources import discovery, readers, sinks
from scholium.streaming import state

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# --- files there and back


@query("jsonl_records", "SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey::BIGINT END AS region FROM nation")
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey").cast("long")).alias("region"), F.lit("extra").alias("unknown"))
    return readers.jsonl(spark, sinks.write_jsonl(n, key="id"), "id long, name string, region long")


@query("jsonl_stream", "SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id")
def jsonl_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events written as records, read as a stream, appended to a log, and counted there."""
    path = sinks.write_jsonl(table(spark, d, "events").select("event_id", "user_id"))
    out, ck = table_path(spark, "log"), table_path(spark, "log-checkpoint")
    sinks.append_log(readers.jsonl_stream(spark, path, "event_id long, user_id long"), out, ck).awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("text_folder", "SELECT 't' || n_nationkey AS pmid, 'The report on ' || n_name || ' says ' || repeat('word ', 12) || 'end' AS text FROM nation WHERE n_nationkey % 4 <> 0")
def text_folder(spark: SparkSession, d: str) -> DataFrame:
    """A text a nation in a file of its own; every fourth is too short."""
    t = F.when(F.col("n_nationkey") % 4 == 0, "too short").otherwise(F.concat(F.lit("The re-\nport  on\f"), "n_name", F.lit(" says "), F.repeat(F.lit("word\t"), 12), F.lit("end\n")))
    path = table_path(spark, "texts")
    table(spark, d, "nation").select(F.concat(F.lit("t"), S("n_nationkey")).alias("stem"), t.alias("text")).repartition(25, "stem").write.partitionBy("stem").text(path)
    return readers.texts(spark, path, folder="stem")


@query("json_case_files", "SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS name, CASE WHEN r_regionkey % 2 = 1 THEN 'not valid JSON' END AS error FROM region")
def json_case_files(spark: SparkSession, d: str) -> DataFrame:
    """A case a region; every other one isn't valid JSON and becomes a row with an error."""
    k = F.col("r_regionkey")
    path = table_path(spark, "cases")
    body = F.when(k % 2 == 0, F.to_json(F.struct(F.col("r_name").alias("name")))).otherwise("{broken")
    table(spark, d, "region").select(k, body.alias("value")).repartition(5, "r_regionkey").write.partitionBy("r_regionkey").option("lineSep", "\n").text(path)
    c = readers.json_texts(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "r_regionkey=([0-9]+)/", 1).alias("file"), "value"))
    return c.select(F.col("file").cast("int").alias("k"), F.try_variant_get("body", "$.name", "string").alias("name"), "error")


@query("medline_records", "SELECT p_partkey::VARCHAR AS pmid, 'On ' || p_name AS title, 'AIM: to see. Done.' AS abstract, 'Annals' AS journal, (1950 + p_partkey % 70)::VARCHAR AS year, CASE p_partkey % 3 WHEN 0 THEN '10.1/' || p_partkey WHEN 1 THEN '10.9/x' END AS doi, 'Jane Doe|Max Roe' AS authors FROM part")
def medline_records(spark: SparkSession, d: str) -> DataFrame:
    """Citation records as XML; the DOI stands in one place, in another, or nowhere."""
    k = F.col("p_partkey")
    loc = F.when(k % 3 == 0, F.concat(F.lit('<ELocationID EIdType="pii">p</ELocationID><ELocationID EIdType="doi">10.1/'), S(k), F.lit("</ELocationID>"))).otherwise("")
    ids = F.when(k % 3 == 1, F.lit('<ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.9/x</ArticleId>')).otherwise('<ArticleId IdType="pubmed">1</ArticleId>')
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), S(k), F.lit("</PMID><Article><Journal><JournalIssue><PubDate><Year>"), S(1950 + k % 70), F.lit("</Year></PubDate></JournalIssue><Title>Annals</Title></Journal><ArticleTitle>On "), "p_name", F.lit("</ArticleTitle>"), loc, F.lit('<Abstract><AbstractText Label="AIM">to see.</AbstractText><AbstractText>Done.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author><Author><LastName>Roe</LastName><ForeName>Max</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList>'), ids, F.lit("</ArticleIdList></PubmedData></PubmedArticle>"))
    r = readers.medline_xml(table(spark, d, "part").select(xml.alias("xml")))
    return r.withColumn("authors", F.array_join("authors", "|"))


def _fetch(page: int, options: dict):
    """Page i of a service: ten records, with the last of the page before again, newer."""
    for i in range(page * 10 - (page > 0), page * 10 + 10):
        yield str(i), f"title {i} of page {page}", page


@query("paged_source", "SELECT range::VARCHAR AS pmid, 'title ' || range || ' of page ' || CASE WHEN range % 10 = 9 AND range < 59 THEN range // 10 + 1 ELSE range // 10 END AS title FROM range(60)")
def paged_source(spark: SparkSession, d: str) -> DataFrame:
    """A service read page by page, a task each; of records that come twice the later page's stays."""
    name = discovery.register_paged(spark, "scholium_pages", "pmid string, title string, page int", 6, _fetch)
    return discovery.last_wins(spark.read.format(name).load(), "pmid", "page").select("pmid", "title")


@query("arxiv_entries", "SELECT page_id, '2101.' || page_id AS id, 'A title of ' || page_id AS title, 'Jane Doe|Max Roe' AS authors, 'An abstract.' AS abstract, make_date(2020, 1 + (page_id % 12)::INT, 3)::VARCHAR AS published, 'cs.LG|stat.ML' AS categories, CASE WHEN page_id % 2 = 0 THEN 'http://arxiv.org/pdf/' || page_id END AS pdf_url FROM pages")
def arxiv_entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    pdf = F.when(k % 2 == 0, F.concat(F.lit('<link title="pdf" href="http://arxiv.org/pdf/'), S(k), F.lit('" type="application/pdf"/>'))).otherwise("")
    xml = F.concat(F.lit('<entry><id>http://arxiv.org/abs/2101.'), S(k), F.lit("</id><published>2020-"), F.lpad(S(1 + k % 12), 2, "0"), F.lit("-03T10:00:00Z</published><title>A title\n   of "), S(k), F.lit("</title><summary>\n An abstract.\n</summary><author><name>Jane Doe</name></author><author><name>Max Roe</name></author>"), F.lit('<link href="http://arxiv.org/abs/x" rel="alternate" type="text/html"/>'), pdf, F.lit('<category term="cs.LG"/><category term="stat.ML"/></entry>'))
    p = table(spark, d, "pages").select(k, xml.alias("xml"))
    a = discovery.arxiv_papers(p.select("xml"))
    return a.select(F.substring_index("id", ".", -1).cast("long").alias("page_id"), "id", "title", F.array_join("authors", "|").alias("authors"), "abstract", S("published").alias("published"), F.array_join("categories", "|").alias("categories"), "pdf_url")


# --- filters


def _works(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    venue = F.when(k % 6 == 0, "Zenodo archive").when(k % 6 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Annals of "), "p_brand"))
    doi = F.when(k % 5 == 0, F.concat(F.lit("https://doi.org/10.5281/"), S(k))).when(k % 5 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://doi.org/10.7/"), S(k)))
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(3)), F.col("p_type"), F.array(F.lit(1)), F.lit("thing"), F.array(F.lit(2)), F.lit("robot"), F.when(k % 4 == 0, F.array(F.lit(4), F.lit(200))).otherwise(F.array(F.lit(600))))
    return table(spark, d, "part").select(F.concat(F.lit("https://x.org/W"), S(k)).alias("id"), doi.alias("doi"), F.when(k % 7 == 0, F.concat(F.lit("Robots and "), "p_name")).otherwise(F.col("p_name")).alias("title"), venue.alias("venue"), F.array(F.when(k % 3 == 0, "Ada B. Lovelace").otherwise("Max Roe")).alias("authors"), index.alias("abstract_inverted_index"), F.lit("2020-01-01").alias("published"), F.lit("u").alias("pdf_url"))


@query("quality_sources", "SELECT p_partkey AS k FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 5 <> 0")
def quality_sources(spark: SparkSession, d: str) -> DataFrame:
    w = _works(spark, d).where(discovery.good_source(F.col("venue"), F.col("doi"), ["zenodo", "preprints.org"]))
    return w.select(F.substring_index("id", "W", -1).cast("long").alias("k"))


@query("openalex_papers", "SELECT CASE WHEN p_partkey % 5 = 1 THEN 'openalex:W' || p_partkey ELSE '10.7/' || p_partkey END AS id, 'a ' || p_type || ' thing a robot' || CASE WHEN p_partkey % 4 = 0 THEN ' robot' ELSE '' END AS abstract, 'robot' AS keywords, CASE WHEN p_partkey % 3 = 0 THEN 'ada lovelace' ELSE '' END AS by FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 5 <> 0")
def openalex_papers(spark: SparkSession, d: str) -> DataFrame:
    p = discovery.openalex_search(_works(spark, d), ["robot", "absent"], ["ada lovelace"], ["zenodo"])
    return p.select("id", "abstract", F.array_join("matched_keywords", "|").alias("keywords"), F.array_join("matched_authors", "|").alias("by"))


_LONG = "repeat('x', 600)"


@query("keyword_relevance", f"WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'A Robot here' ELSE 'none' END AS title, CASE p_partkey % 4 WHEN 1 THEN {_LONG} || ' robot and ROBOT' WHEN 2 THEN 'early robot' ELSE {_LONG} || ' robot' END AS a FROM part) SELECT k, k % 4 < 3 AS relevant FROM t")
def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    long = F.repeat(F.lit("x"), 600)
    a = F.when(k % 4 == 1, F.concat(long, F.lit(" robot and ROBOT"))).when(k % 4 == 2, "early robot").otherwise(F.concat(long, F.lit(" robot")))
    return table(spark, d, "part").select(k.alias("k"), discovery.keyword_relevant("Robot", F.when(k % 4 == 0, "A Robot here").otherwise("none"), a).alias("relevant"))


@query("match_arrays", "SELECT doc_id, array_to_string(list_filter(['the', 'ou', 'zzzz'], lambda k: contains(lower(text), k)), '|') AS keywords, CASE WHEN source IN ('src0', 'src1') THEN 'A. src' || right(source, 1) ELSE '' END AS by FROM documents WHERE text IS NOT NULL AND length(source) = 4")
def match_arrays(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND length(source) = 4")
    return docs.select("doc_id", F.array_join(discovery.matching_keywords(F.col("text"), ["the", "ou", "zzzz"]), "|").alias("keywords"), F.array_join(discovery.matching_authors(F.concat_ws("; ", F.lit("Roe, Max"), "source"), ["A. src0", "A. src1"]), "|").alias("by"))


@query("domain_keywords", "SELECT doc_id, contains(substring(lower(text), 1, 20000), 'ieng') OR contains(substring(lower(text), 1, 20000), 'oeau') AS any FROM documents WHERE text IS NOT NULL")
def domain_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", discovery.any_keyword(F.col("text"), ["ieng", "oeau"]).alias("any"))


@query("paper_source", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0")
def paper_source(spark: SparkSession, d: str) -> DataFrame:
    files = F.array(F.concat(F.lit("proj/"), "o_orderstatus", F.lit("/a.bib")), F.when(F.col("o_orderkey") % 3 == 0, "old/F/b.tex").otherwise("x.tex"))
    return table(spark, d, "orders").where(discovery.from_source(files, "/F/")).select("o_orderkey")


@query("lookback", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= (SELECT max(o_orderdate)::DATE - 365 FROM orders)")
def lookback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").cast("date").alias("today"))
    return o.crossJoin(F.broadcast(last)).where(discovery.since(F.col("o_orderdate").cast("date"), 365, F.col("today"))).select("o_orderkey")  # one row


_BLOCKS = {"C1_language": "eauen OR \"the \"[tiab]", "C2_a": "ou AND NOT zz", "C3_b": "(ieng OR thre) AND en"}
_POP = "(contains(t, 'eauen') OR contains(t, 'the '))"


@query("boolean_blocks", f"WITH d AS (SELECT lower(coalesce(text, '')) AS t FROM documents) SELECT 'C2_a' AS block, count(*) FILTER ({_POP} AND contains(t, 'ou') AND NOT contains(t, 'zz')) AS n FROM d UNION ALL SELECT 'C3_b', count(*) FILTER ({_POP} AND (contains(t, 'ieng') OR contains(t, 'thre')) AND contains(t, 'en')) FROM d")
def boolean_blocks(spark: SparkSession, d: str) -> DataFrame:
    return discovery.block_counts(table(spark, d, "documents"), _BLOCKS, "text")


@query("boolean_query", "SELECT * FROM (VALUES ('blocks', '(eauen OR \"the \"[tiab]) AND (ou AND NOT zz OR (ieng OR thre) AND en) AND 2000:2020[pdat]'), ('filtered', '(eauen OR \"the \"[tiab]) AND (ou AND NOT zz OR (ieng OR thre) AND en) AND humans'), ('first', '(a) AND (b)'), ('whole', 'q')) AS v(kind, q)")
def boolean_query(spark: SparkSession, d: str) -> DataFrame:
    q = discovery.boolean_query
    return spark.createDataFrame([("blocks", q(_BLOCKS, years=(2000, 2020))), ("filtered", q(_BLOCKS, "humans", (1, 2))), ("first", q({"x": "a", "y": "b"})), ("whole", q({}, whole="q"))], "kind string, q string")


@query("first_wins", "SELECT id, min(source) AS source FROM (SELECT p_partkey % 900 AS id, '0part' AS source FROM part UNION ALL SELECT c_custkey, '1customer' FROM customer UNION ALL SELECT s_suppkey * 7, '2supplier' FROM supplier) GROUP BY id")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select((F.col("p_partkey") % 900).alias("id"), F.lit("0part").alias("source"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("1customer").alias("source"))
    c = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("id"), F.lit("2supplier").alias("source"))
    return discovery.first_wins([a, b, c])


@query("abstract_backfill", "SELECT p_partkey AS pmid, CASE WHEN p_partkey % 3 = 0 THEN 'own' WHEN p_partkey % 2 = 0 THEN 'found ' || p_partkey END AS abstract FROM part")
def abstract_backfill(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("pmid"), F.when(k % 3 == 0, "own").when(k % 3 == 1, " ").alias("abstract"))
    return discovery.backfill(p, p.where("pmid % 2 = 0").select("pmid", F.concat(F.lit("found "), S("pmid")).alias("abstract")))


@query("open_copies", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://a.org/x.pdf|http://b.org/pdf/' || page_id || '|http://c.org/view' ELSE 'http://b.org/pdf/' || page_id || '|http://a.org/x?format=pdf|http://c.org/view' END AS urls FROM pages")
def open_copies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    b = F.concat(F.lit("http://b.org/pdf/"), S(k))
    u = discovery.open_pdfs(F.when(k % 3 == 0, "").otherwise("http://c.org/view"), F.array(F.lit("http://c.org/view"), b, F.lit(None).cast("string"), b, F.when(k % 2 == 0, "http://a.org/x.pdf").otherwise("http://a.org/x?format=pdf")))
    return table(spark, d, "pages").select("page_id", F.array_join(u, "|").alias("urls"))


_DOIS = ["10.1016/a", "10.1038/b", "10.9999/c", "10.1136/d", "10.1097/e"]
_NAMES = ["elsevier", "springer", "generic", "bmj", "lippincott"]


@query("publishers", "SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'karger' ELSE ['elsevier', 'springer', 'generic', 'bmj', 'lippincott'][(page_id % 5 + 1)::INT] END AS publisher, CASE page_id % 7 WHEN 6 THEN 'karger.com' WHEN 5 THEN 'other.org' ELSE '' END AS domain FROM pages")
def publishers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    doi = F.element_at(F.array(*[F.lit(x) for x in _DOIS]), (k % 5 + 1).cast("int"))
    url = F.when(k % 7 == 6, "https://WWW.karger.com/x").when(k % 7 == 5, "https://other.org/y?z=1").otherwise(F.lit(None).cast("string"))
    return table(spark, d, "pages").select("page_id", discovery.publisher(F.when(k % 7 == 6, "10.9999/q").otherwise(doi), url).alias("publisher"), discovery.publisher_domain(url).alias("domain"))


@query("record_ids", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'p' || page_id WHEN 1 THEN 'd' || page_id ELSE '' END AS id, CASE WHEN page_id % 2 = 0 THEN 'A, B, C et al. (4 authors)' ELSE 'A, B' END AS authors FROM pages")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    c = F.when(k % 3 == 0, F.concat(F.lit("p"), S(k))).otherwise("0")
    e = F.when(k % 3 == 1, F.concat(F.lit("d"), S(k))).otherwise("")
    names = F.when(k % 2 == 0, F.array(*[F.lit(x) for x in "ABCD"])).otherwise(F.array(F.lit("A"), F.lit("B")))
    return table(spark, d, "pages").select("page_id", tx.record_id(c, e).alias("id"), tx.author_list(names).alias("authors"))


# --- libraries


@query("min_max_scores", "WITH p AS (SELECT page_id, length(url)::DOUBLE AS a, length(html)::DOUBLE AS b, 5.0::DOUBLE AS c FROM pages) SELECT page_id, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.5 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 9) AS score FROM p")
def min_max_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.length("url").cast("double").alias("a"), F.length("html").cast("double").alias("b"), F.lit(5.0).alias("c"))
    return library.min_max_score(p, {"a": 1.0, "b": 0.5, "c": 0.8}).select("page_id", F.round("score", 9).alias("score"))


@query("library_stats", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source")
def library_stats(spark: SparkSession, d: str) -> DataFrame:
    return library.stats(table(spark, d, "documents").withColumnRenamed("n_chars", "size"))


@query("library_search", "SELECT p_partkey::VARCHAR AS key FROM part WHERE p_partkey % 50 IN (7, 8) ORDER BY p_partkey % 50, p_partkey::VARCHAR LIMIT 10")
def library_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts equal to the query are nearest; ties by key."""
    k = F.col("p_partkey")
    t = F.when(k % 50 == 7, "quantum entanglement in rubidium").when(k % 50 == 8, "quantum of something else entirely").otherwise(F.concat("p_name", F.lit(" "), S(k)))
    return library.search(table(spark, d, "part").select(k.alias("key"), t.alias("text")), "Quantum entanglement, in rubidium!").select("key")


@query("acquire_coverage", "SELECT count(*) AS n_records, count(*) FILTER (p_size > 10) AS with_doi, count(*) FILTER (p_partkey % 4 = 1) AS downloaded, round(100.0::DOUBLE * count(*) FILTER (p_size > 10) / count(*), 1) AS doi_pct, round(100.0::DOUBLE * count(*) FILTER (p_partkey % 4 = 1) / count(*), 1) AS downloaded_pct FROM part")
def acquire_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pmid"), F.when(F.col("p_size") > 10, "10.1/x").alias("doi"))
    return library.coverage(p, p.where("pmid % 4 = 1"))


@query("download_queue", "SELECT 'k' || p_partkey AS cite_key, '10.1/' || p_partkey AS doi, 'https://proxy/https://doi.org/10.1/' || p_partkey AS url, p_name AS title FROM part WHERE p_size > 10 AND p_partkey % 4 <> 1")
def download_queue(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.concat(F.lit("k"), S(k)).alias("cite_key"), F.when(F.col("p_size") > 10, F.concat(F.lit("doi:10.1/"), S(k))).alias("doi"), F.col("p_name").alias("title"), k.alias("n"))
    return sinks.download_queue(p, p.where("n % 4 = 1"), "https://proxy/")


@query("store_manifest", "SELECT 'k' || page_id AS cite_key, 'lib/' || sha256(html) || '.bin' AS object, octet_length(encode(html))::INT AS size, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL")
def store_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(table(spark, d, "pages").where("html IS NOT NULL").select(F.concat(F.lit("k"), S("page_id")).alias("cite_key"), F.col("html").cast("binary").alias("content")), "lib/")


@query("snapshot_tiers", "SELECT source, count(*) FILTER (doc_id % 3 = 0) AS local, count(*) FILTER (doc_id % 3 <> 0) AS remote FROM documents GROUP BY source")
def snapshot_tiers(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue's snapshot, restored, with what is kept near."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source")
    folder = table_path(spark, "snapshots")
    sinks.snapshot(c, folder, "v1")
    t = sinks.tiers(sinks.restore(spark, folder, "v1"), c.where("key % 3 = 0"))
    return t.groupBy("source").agg(F.count_if(F.col("tier") == "local").alias("local"), F.count_if(F.col("tier") == "remote").alias("remote"))


@query("digest_lines", "SELECT p_brand AS source, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, line) - 1 AS pos, line FROM (SELECT p_brand, p_name, '- **' || p_name || '** A, B' || CASE WHEN p_size > 10 THEN ' [link](u' || p_partkey || ')' ELSE '' END AS line FROM part)")
def digest_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_name").alias("title"), F.array(F.lit("A"), F.lit("B")).alias("authors"), F.when(F.col("p_size") > 10, F.concat(F.lit("u"), S("p_partkey"))).alias("url"))
    return sinks.digest_lines(p)


@query("numeric_aware_order", "SELECT key, row_number() OVER (ORDER BY TRY_CAST(key AS BIGINT) IS NULL, TRY_CAST(key AS BIGINT), key) - 1 AS place FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE (n_nationkey * 7)::VARCHAR END AS key FROM nation)")
def numeric_aware_order(spark: SparkSession, d: str) -> DataFrame:
    from scholium.operators.numbering import number_rows

    n = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(S(F.col("n_nationkey") * 7)).alias("key"))
    o = sinks.numeric_aware(F.col("key"))
    return number_rows(n.select("key", o[0].alias("a"), o[1].alias("b")), ["a", "b", "key"], number="place").select("key", "place")


# --- incremental work


@query("unseen_papers", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unseen_papers(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return state.unseen(table(spark, d, "lineitem").select("l_partkey"), known, "l_partkey")


@query("run_log_resume", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def run_log_resume(spark: SparkSession, d: str) -> DataFrame:
    """Work in two runs: the second leaves out what the first has logged, and the log holds each item once."""
    e = table(spark, d, "events").select("user_id", "event_type", F.concat_ws("-", "user_id", "event_type").alias("doi"))
    path = table_path(spark, "runs")
    e.where("event_id % 2 = 0" if "event_id" in e.columns else "user_id % 2 = 0").dropDuplicates(["doi"]).write.parquet(path)
    state.unseen(e, spark.read.parquet(path), "doi").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("entrenchment", "WITH w AS (SELECT l_suppkey AS author, l_linenumber % 3 <> 0 AS topic FROM lineitem), a AS (SELECT author, count(*) AS n, count(*) FILTER (topic) AS on_topic FROM w GROUP BY author) SELECT author, n, on_topic, on_topic::DOUBLE / n AS ratio, CASE WHEN on_topic < 3 THEN 'low' WHEN on_topic::DOUBLE / n >= 0.5 THEN 'high' WHEN on_topic::DOUBLE / n >= 0.25 THEN 'medium' ELSE 'low' END AS entrenched FROM a")
def entrenchment(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("author"), F.when(F.col("l_linenumber") % 3 != 0, "Deep learning, of Proteins").otherwise("Learning to cook").alias("title"))
    return people.entrenchment(w, ["proteins", "learning", "deep"])


@query("author_profiles", "WITH a AS (SELECT o_custkey AS paper, o_orderkey % 5 AS author, count(*) AS n_works, count(*) FILTER (o_orderstatus = 'F') AS n_dev FROM orders GROUP BY ALL), t AS (SELECT paper, max(n_dev) AS dev FROM a GROUP BY paper) SELECT a.paper, a.author, n_works, n_works AS n_shared, n_dev > 0 AS developer, CASE WHEN dev > 0 THEN 'high' ELSE 'low' END AS self_validation, concat_ws('|', CASE WHEN n_dev > 0 THEN 'method_developer' END, CASE WHEN n_works >= 5 THEN 'extensive_coauthor_history' END) AS flags FROM a JOIN t USING (paper)")
def author_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Customers as papers, orders as their authors' works; each work has its author and one that all share."""
    o = table(spark, d, "orders")
    w = o.select(F.col("o_custkey").alias("paper"), (F.col("o_orderkey") % 5).alias("author"), S("o_orderkey").alias("work"), F.when(F.col("o_orderstatus") == "F", "We introduce K-Means, a method").otherwise("Other").alias("title"))
    both = w.unionByName(w.withColumn("author", F.lit(-1).cast("long")))
    used = o.select(F.col("o_custkey").alias("paper"), F.lit("k-means").alias("method")).distinct()
    return people.profiles(both, used).where("author >= 0").select("paper", "author", "n_works", "n_shared", "developer", "self_validation", F.array_join("flags", "|").alias("flags"))
