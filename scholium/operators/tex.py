"""Paragraphs, sections, citation contexts and claims of LaTeX sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import text as tx


def body(t):
    """The source before its bibliography."""
    return F.element_at(F.split(t, r"\\begin\{thebibliography\}|\\bibliography\{", 2), 1)


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text) of runs of lines that aren't blank; line is the first one's number, from 1."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("i", "l"))
    lines = lines.withColumn("g", F.sum((F.trim("l") == "").cast("int")).over(Window.partitionBy(key).orderBy("i"))).where(F.trim("l") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.rtrim("l").alias("l")))), lambda x: x.l), " ")
    return lines.groupBy(key, "g").agg((F.min("i") + 1).alias("line"), F.trim(joined).alias("text")).drop("g")


def sections(df: DataFrame, key: str, text: str, least_words: int = 10) -> DataFrame:
    """(key, pos, title, text) of sections of at least so many words, cleaned."""
    parts = F.split(body(F.col(text)), r"(?=\\(?:sub)*section\*?\{)")
    s = df.select(key, F.posexplode(parts).alias("pos", "s")).where(F.col("s").rlike(r"^\\(?:sub)*section\*?\{"))
    s = s.select(key, "pos", F.regexp_extract("s", r"^\\(?:sub)*section\*?\{([^}]*)\}", 1).alias("title"), tx.clean_latex(F.regexp_replace("s", r"^\\(?:sub)*section\*?\{[^}]*\}", "")).alias("text"))
    return s.where(F.size(tx.words(F.col("text"))) >= least_words)


def citation_contexts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, pos, text, cited_keys) of the sentences that cite; one that is under four words when cleaned stands for its paragraph."""
    p = paragraphs(df.withColumn("__b", body(F.col(text))), key, "__b").where(F.col("text").contains("\\cite"))
    s = p.select(key, "line", F.col("text").alias("para"), F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s")).withColumn("cited_keys", tx.cite_keys(F.col("s"))).where(F.size("cited_keys") > 0)
    own = tx.clean_latex(F.col("s"))
    return s.select(key, "line", "pos", F.when(F.size(tx.words(own)) < 4, tx.clean_latex(F.col("para"))).otherwise(own).alias("text"), "cited_keys")


def claims(df: DataFrame, key: str, text: str, least_words: int = 3) -> DataFrame:
    """(key, text) of assertions in bold of at least so many words."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\\textbf\{([^{}]+)\}"), F.lit(1))
    return df.select(key, F.explode(found).alias("raw")).select(key, tx.clean_latex(F.col("raw")).alias("text")).where(F.size(tx.words(F.col("text"))) >= least_words)


def abstract(t):
    """The abstract's cleaned text, or null."""
    marks = [rf"\\{edge}\{{abstract\}}" for edge in ("begin", "end")]
    return F.nullif(tx.clean_latex(F.regexp_extract(t, "(?s)" + "(.*?)".join(marks), 1)), F.lit(""))
