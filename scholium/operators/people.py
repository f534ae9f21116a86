"""Authors, citations and the state of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import norm_doi, norm_title


def shared_works(authorship: DataFrame, work: str = "work", author: str = "author") -> DataFrame:
    """(work, authors) of works by at least two of the authors."""
    return authorship.groupBy(work).agg(F.array_sort(F.collect_set(author)).alias("authors")).where(F.size("authors") >= 2)


def entrenchment(works: DataFrame, topic: list[str], least: int = 2) -> DataFrame:
    """(author, n, on_topic, ratio, entrenched): works whose titles share at least two topic words; entrenched from three works, at half or more high, a quarter medium."""
    words = F.array(*[F.lit(w) for w in sorted(topic)])
    w = works.withColumn("on", F.size(F.array_intersect(F.array_distinct(F.split(norm_title(F.col("title")), " ")), words)) >= least)
    a = w.groupBy("author").agg(F.count("*").alias("n"), F.count_if("on").alias("on_topic"))
    r = F.col("on_topic") / F.col("n")
    return a.withColumn("ratio", r).withColumn("entrenched", F.when(F.col("on_topic") < 3, "low").when(r >= 0.5, "high").when(r >= 0.25, "medium").otherwise("low"))


def self_validation(team: DataFrame, paper: str = "paper") -> DataFrame:
    """(paper, n_developers, risk): authors of a paper who developed its method; one is medium, two high."""
    a = team.groupBy(paper).agg(F.count_if("developer").alias("n_developers"))
    return a.withColumn("risk", F.when(F.col("n_developers") >= 2, "high").when(F.col("n_developers") == 1, "medium").otherwise("low"))


def citation_uptake(original: DataFrame, citing: DataFrame) -> DataFrame:
    """(paper, n_citing, n_self, n_independent, low_uptake): citations by works with an author of the cited one are its own. original: paper, authors. citing: paper, id, authors."""
    j = citing.select("paper", "id", F.col("authors").alias("by")).join(original.select("paper", "authors"), "paper")
    own = F.arrays_overlap(F.coalesce("by", F.array().cast("array<string>")), F.coalesce("authors", F.array().cast("array<string>")))
    a = j.groupBy("paper").agg(F.count("*").alias("n_citing"), F.count_if(own).alias("n_self"))
    return a.withColumn("n_independent", F.col("n_citing") - F.col("n_self")).withColumn("low_uptake", F.col("n_independent") < 3)


def pre_submit(refs: DataFrame, cited: DataFrame) -> DataFrame:
    """One row: cited keys without a reference, share of references with a DOI, references without a title, DOIs used twice. refs: cite_key, alternate_keys, title, doi."""
    known = refs.select(F.explode(F.concat(F.array("cite_key"), F.coalesce("alternate_keys", F.array().cast("array<string>")))).alias("cite_key")).distinct()
    lost = cited.select("cite_key").distinct().join(known, "cite_key", "left_anti").agg(F.count("*").alias("n_missing"))
    doi = norm_doi(F.col("doi"))
    a = refs.agg(F.count("*").alias("n_refs"), F.floor(100 * F.try_divide(F.count(doi), F.count("*"))).alias("doi_percent"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("n_untitled"))
    twice = refs.where(doi.isNotNull()).groupBy(doi.alias("d")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_shared_dois"))
    return lost.crossJoin(a).crossJoin(twice)  # one row each


def collection_status(refs: DataFrame, folder: str) -> DataFrame:
    """By folder: references, and those with a DOI, a PDF and a text."""
    return refs.groupBy(folder).agg(F.count("*").alias("n_refs"), F.count_if(norm_doi(F.col("doi")).isNotNull()).alias("with_doi"), F.count_if("has_pdf").alias("with_pdf"), F.count_if("has_text").alias("with_text"))


def new_references(found: DataFrame, known: DataFrame) -> DataFrame:
    """Cited works that aren't known by DOI, or without one by the first 50 letters of the title; each once, with a key made unique by a suffix. Both have doi, title; found has key and pos too."""
    from pyspark.sql import Window

    ident = lambda d: d.withColumn("__id", F.coalesce(F.concat(F.lit("d:"), norm_doi(F.col("doi"))), F.concat(F.lit("t:"), F.nullif(F.substring(norm_title(F.col("title")), 1, 50), F.lit("")))))
    f = ident(found).where("__id IS NOT NULL").join(ident(known).select("__id").distinct(), "__id", "left_anti")
    f = f.withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy("pos"))).where("__n = 1")
    k = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    return f.withColumn("__k", k).withColumn("key", F.when(F.col("__k") > 1, F.concat_ws("_", "key", (F.col("__k") - 1).cast("string"))).otherwise(F.col("key"))).drop("__id", "__n", "__k")


def relevant(works: DataFrame, keywords: list[str], title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Works with a keyword in the title, twice in the abstract, or in its first 500 characters."""
    t, a = F.lower(F.coalesce(F.col(title), F.lit(""))), F.lower(F.coalesce(F.col(abstract), F.lit("")))
    ok = F.lit(False)
    for k in (x.lower() for x in keywords):
        ok = ok | t.contains(k) | (F.size(F.split(a, rf"\Q{k}\E")) > 2) | F.substring(a, 1, 500).contains(k)
    return works.where(ok)


def best_match(refs: DataFrame, candidates: DataFrame, least: float = 0.80) -> DataFrame:
    """(cite_key, doi, score): of each reference's candidates, the most similar title, with 0.15 for the same year; null below `least`. candidates: cite_key, pos, doi, title, year."""
    from scholium.operators.resolve import ratio

    j = refs.select("cite_key", F.col("title").alias("t"), F.col("year").alias("y")).join(candidates.select("cite_key", "pos", "doi", "title", "year"), "cite_key")
    s = ratio(F.lower("t"), F.lower("title")) + F.when(F.col("y") == F.col("year"), 0.15).otherwise(0.0)
    b = j.withColumn("s", s).groupBy("cite_key").agg(F.max_by(F.struct("doi", "s"), F.struct("s", -F.col("pos"))).alias("b"))
    best = b.where(F.col("b.s") >= least).select("cite_key", F.col("b.doi").alias("doi"), F.col("b.s").alias("score"))
    return refs.select("cite_key").join(best, "cite_key", "left")


def cited_references(works: DataFrame, references: str = "references") -> DataFrame:
    """(pos, key, doi, title) of the references of citing works, in the order of works."""
    return works.select("pos", F.posexplode(references).alias("at", "r")).select("pos", "at", F.col("r.key").alias("key"), F.col("r.doi").alias("doi"), F.col("r.title").alias("title"))


def profiles(works: DataFrame, used: DataFrame) -> DataFrame:
    """(paper, author, n_works, n_shared, developer, self_validation, flags) of the authors of papers by their works.

    works: paper, author, work, title, and abstract if there is one. used: paper, method. A developer's works name a method that the paper uses; a work is shared if two of the
    paper's authors wrote it, from five on it's a flag. Methods of a paper are few; they meet its authors' works by the paper.
    """
    said = F.lower(F.concat_ws(" ", *[c for c in ("title", "abstract") if c in works.columns]))
    w = works.select("paper", "author", "work", said.alias("said"))
    m = used.groupBy("paper").agg(F.collect_set(F.lower("method")).alias("methods"))
    a = w.join(m, "paper", "left").withColumn("dev", F.coalesce(F.exists("methods", lambda x: F.contains(F.col("said"), x)), F.lit(False)))
    by = a.groupBy("paper", "author").agg(F.count_distinct("work").alias("n_works"), F.max("dev").alias("developer"))
    both = shared_works(w.select(F.struct("paper", "work").alias("work"), "author")).select(F.col("work.paper").alias("paper"), F.explode("authors").alias("author")).groupBy("paper", "author").agg(F.count("*").alias("n_shared"))
    out = by.join(both, ["paper", "author"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    risk = self_validation(by).select("paper", F.col("risk").alias("self_validation"))
    flags = F.array_compact(F.array(F.when(F.col("developer"), "method_developer"), F.when(F.col("n_shared") >= 5, "extensive_coauthor_history"), F.when(F.col("n_works") == 0, "not_found")))
    return out.join(risk, "paper").withColumn("flags", flags)
