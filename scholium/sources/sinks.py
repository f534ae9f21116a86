"""Sinks: record files, tables of text, digests, queues, and snapshots of a catalogue. Files go to the folder all executors share unless a path is given."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.runtime import table_path


def numeric_aware(key: Column) -> list[Column]:
    """Sort order of keys: whole numbers first, by value, then the rest as text."""
    n = key.cast("string").try_cast("long")
    return [n.isNull(), n, key.cast("string")]


def write_jsonl(df: DataFrame, path: str | None = None, key: str | None = None) -> str:
    """One JSON object a line, nulls included, in UTF-8; with a key, ordered by it within and over files. The folder written to."""
    path = path or table_path(df.sparkSession, "jsonl")
    out = df.orderBy(*numeric_aware(F.col(key))) if key else df
    out.write.option("ignoreNullFields", False).mode("overwrite").json(path)
    return path


def write_csv(df: DataFrame, drop: list[str] | None = None, path: str | None = None) -> str:
    """CSV with a header, ordered by the dropped columns."""
    path = path or table_path(df.sparkSession, "csv")
    drop = drop or []
    (df.orderBy(*drop) if drop else df).drop(*drop).write.option("header", True).mode("overwrite").csv(path)
    return path


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """A stream's rows appended to a Parquet folder, all that are there, then it ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- rendering: the rows are made by Spark, a bounded number of them is formatted by the driver


def text_table(df: DataFrame, rows: int = 200) -> str:
    """A table with columns as wide as their longest value; of longer results the first `rows`, and how many more."""
    got = [["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(rows + 1).collect()]
    more = len(got) > rows
    lines = [df.columns, *got[:rows]]
    width = [max(len(x[i]) for x in lines) for i in range(len(df.columns))]
    out = ["  ".join(v.ljust(w) for v, w in zip(x, width)).rstrip() for x in lines]
    return "\n".join([out[0], "  ".join("-" * w for w in width), *out[1:], *(["..."] if more else [])])


def digest_lines(papers: DataFrame, title: str = "title", authors: str = "authors", url: str = "url", source: str = "source") -> DataFrame:
    """(source, pos, line): a Markdown line a paper, by source and title."""
    from scholium.functions.text import author_list
    from scholium.operators.numbering import number_rows

    line = F.concat(F.lit("- **"), F.coalesce(F.col(title), F.lit("(untitled)")), F.lit("** "), author_list(F.coalesce(F.col(authors), F.array().cast("array<string>"))), F.when(F.coalesce(F.col(url), F.lit("")) != "", F.concat(F.lit(" ["), F.lit("link]("), F.col(url), F.lit(")"))).otherwise(""))
    return number_rows(papers.select(F.col(source).alias("source"), F.coalesce(F.col(title), F.lit("")).alias("t"), line.alias("line")), ["t", "line"], ["source"], number="pos").select("source", "pos", "line")


def html_page(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A page with a table of the first `rows` rows; values are escaped."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "\n".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>\n<table><tr>{head}</tr>\n{body}\n</table>\n"


# --- queues


def download_queue(refs: DataFrame, have: DataFrame, prefix: str = "", key: str = "cite_key") -> DataFrame:
    """(key, doi, url, title) of references with a DOI whose text isn't there; the address is the DOI's behind a proxy's prefix."""
    from scholium.functions.text import norm_doi

    d = refs.withColumn("doi", norm_doi(F.col("doi"))).where("doi IS NOT NULL").join(have.select(key).distinct(), key, "left_anti")
    return d.select(key, "doi", F.concat(F.lit(prefix + "https://doi.org/"), F.col("doi")).alias("url"), F.coalesce("title", F.lit("")).alias("title"))


def manifest(files: DataFrame, prefix: str) -> DataFrame:
    """(cite_key, object, size, sha256) of stored files (cite_key, content)."""
    digest = F.sha2(F.col("content"), 256)
    return files.select("cite_key", F.concat(F.lit(prefix), digest, F.lit(".bin")).alias("object"), F.octet_length("content").alias("size"), digest.alias("sha256"))


# --- snapshots


def snapshot(catalog: DataFrame, folder: str, name: str) -> str:
    """A catalogue as it is now, under a name of its own; an existing one isn't overwritten."""
    path = f"{folder.rstrip('/')}/{name}"
    catalog.write.mode("error").parquet(path)
    return path


def restore(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def tiers(catalog: DataFrame, keep: DataFrame, key: str = "key") -> DataFrame:
    """catalog with `tier`: local for what is kept, else remote."""
    k = keep.select(key).distinct().withColumn("__k", F.lit(True))
    return catalog.join(k, key, "left").withColumn("tier", F.when(F.col("__k"), "local").otherwise("remote")).drop("__k")


def to_json(rows: DataFrame, rows_at_most: int = 10_000) -> str:
    """A summary of a bounded number of rows as one JSON text."""
    got = rows.limit(rows_at_most + 1).collect()
    if len(got) > rows_at_most:
        raise ValueError("a summary of too many rows")
    return json.dumps([r.asDict(recursive=True) for r in got], ensure_ascii=False, default=str)
