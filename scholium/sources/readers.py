"""Readers of record streams, texts, bibliographies and lists, and a bounded remote source."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.functions.text import clean_plaintext
from scholium.runtime import ship

MEDLINE = "pmid string, title string, abstract string, journal string, year string, doi string, authors array<string>, pub_types array<string>, mesh array<string>"
SCREENING = "pmid string, decision string, reason string, themes array<string>"
RATINGS = "pmid string, rubric_version string, dimension string, paper_type string, rating string, evidence_quote string, free_notes string, scored_at string, confidence int, sub_ratings_json string"


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Records of one JSON object a line; a malformed line fails, or with strict=False is left out. Fields outside the schema are ignored, absent ones null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def texts(spark: SparkSession, path: str, least: int = 50, suffix: str = ".txt", folder: str | None = None) -> DataFrame:
    """(pmid, text) of the files of a folder, named by their stems and cleaned; texts under `least` characters go. A file is one row and one task's: folders of many files spread. With `folder`, the name is the value of the folder of that key."""
    d = spark.read.option("recursiveFileLookup", bool(folder)).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)" + re.escape(suffix) + "$", 1) if folder is None else F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(folder)}=([^/]*)/", 1)
    return d.where(F.length("value") >= least).select(name.alias("pmid"), clean_plaintext(F.col("value")).alias("text"))


def latex(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the LaTeX sources under a folder; bytes that aren't UTF-8 become replacement characters."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").load(path)
    return d.select("path", F.decode("content", F.lit("utf-8")).alias("text"))


def jsonl_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The same records as a stream, as files arrive in a folder. Blank lines are skipped."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def retraction_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doi, nature, pos) of a retraction list with the columns OriginalPaperDOI and RetractionNature; pos orders rows as they stand in the files."""
    d = spark.read.option("header", True).option("multiLine", True).csv(path)
    return d.select(F.lower(F.trim("OriginalPaperDOI")).alias("doi"), F.trim("RetractionNature").alias("nature"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos"))


def json_cases(spark: SparkSession, path: str) -> DataFrame:
    """(file, body, error): whole JSON files; one that doesn't parse is a row with an error, not a failed job."""
    d = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return json_texts(d.select(F.col("_metadata.file_name").alias("file"), "value"))


def json_texts(d: DataFrame) -> DataFrame:
    body = F.try_parse_json("value")
    return d.select("file", body.alias("body"), F.when(body.isNull(), "not valid JSON").alias("error"))


def medline_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Records of citation XML, one a row. Labelled parts of an abstract are joined; the DOI comes from the electronic location, else from the identifiers."""
    loc = "array<struct<_EIdType:string,_VALUE:string>>"
    schema = (
        "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
        f"Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>,ELocationID:{loc},AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>>>,"
        "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
    )
    x = df.select("*", F.from_xml(F.col(xml), schema).alias("x"))
    art = F.col("x.MedlineCitation.Article")
    part = lambda p: F.when(p["_Label"].isNotNull(), F.concat(p["_Label"], F.lit(": "), p["_VALUE"])).otherwise(p["_VALUE"])
    doi = F.coalesce(F.try_element_at(F.filter(art["ELocationID"], lambda e: F.lower(e["_EIdType"]) == "doi"), F.lit(1))["_VALUE"], F.try_element_at(F.filter(F.col("x.PubmedData.ArticleIdList.ArticleId"), lambda e: e["_IdType"] == "doi"), F.lit(1))["_VALUE"])
    return x.select(
        F.col("x.MedlineCitation.PMID._VALUE").alias("pmid"), art["ArticleTitle"].alias("title"), F.concat_ws(" ", F.transform(art["Abstract"]["AbstractText"], part)).alias("abstract"), art["Journal"]["Title"].alias("journal"),
        art["Journal"]["JournalIssue"]["PubDate"]["Year"].alias("year"), doi.alias("doi"), F.transform(art["AuthorList"]["Author"], lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"])).alias("authors"),
    )


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
_NAME = re.compile(r"([A-Za-z_]\w*)\s*=")


_BRACES = str.maketrans("", "", "{}")


def _body(s: str, at: int) -> int:
    """Place after the brace that closes the one before `at`."""
    depth = 1
    while at < len(s) and depth:
        depth += {"{": 1, "}": -1}.get(s[at], 0)
        at += 1
    return at


def parse_bibtex(s: str) -> list[dict]:
    out = []
    for m in _ENTRY.finditer(s):
        if m.group(1).lower() in ("comment", "string", "preamble"):
            continue
        body = s[m.end() : _body(s, m.end()) - 1]
        rec, at = {"entry_type": m.group(1).lower(), "cite_key": m.group(2)}, 0
        while f := _NAME.search(body, at):
            at = f.end() + len(body[f.end() :]) - len(body[f.end() :].lstrip())
            if at < len(body) and body[at] == "{":
                end = _body(body, at + 1)
                value = body[at + 1 : end - 1]
            elif body[at : at + 1] == '"':
                value, _, _ = body[at + 1 :].partition('"')
                end = at + len(value) + 2
            else:
                value, _, _ = body[at:].partition(",")
                end = at + len(value)
            rec[f.group(1).lower()] = " ".join(value.translate(_BRACES).split())
            at = end
        if rec.get("archiveprefix", "").lower() == "arxiv" and rec.get("eprint"):
            rec["arxiv_id"] = rec["eprint"]
        elif m := _NOTE.search(rec.get("note", "")):
            rec["arxiv_id"] = m.group(1)
        out.append(rec)
    return out


REFERENCE = ["cite_key", "entry_type", "title", "author", "year", "journal", "volume", "number", "pages", "publisher", "doi", "url", "arxiv_id"]
_NOTE = re.compile(r"arxiv:?\s*(\d{4}\.\d{4,5})", re.I)


def bibtex(df: DataFrame, text: str = "text", source: str = "source_file") -> DataFrame:
    """References of BibTeX files, one file a row, with source_file, source_format and pos. Braces nest, so this runs in Python."""
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(src, i, *(r.get(c, "") for c in REFERENCE)) for src, t in zip(pdf[source], pdf[text]) for i, r in enumerate(parse_bibtex(t or ""))]
            yield pd.DataFrame(rows, columns=[source, "pos", *REFERENCE])

    return df.select(source, text).mapInPandas(run, f"{source} string, pos int, " + ", ".join(f"{c} string" for c in REFERENCE)).withColumn("source_format", F.lit("bibtex"))


#: RIS tags of the fields of a record.
_RIS = {"pmid": ["AN", "PMID"], "title": ["T1", "TI"], "abstract": ["AB", "N2"], "journal": ["JF", "JO", "T2"], "year": ["PY", "Y1"], "doi": ["DO"]}


def ris(df: DataFrame, text: str = "text") -> DataFrame:
    """(pmid, title, abstract, journal, year, doi, authors) of the records of RIS exports, one export a row: each ends with ER, and of a field's tags the first that is there counts."""
    parts = F.filter(F.split(F.col(text), r"(?m)^ER  -.*$"), lambda r: r.rlike(r"(?m)^[A-Z][A-Z0-9]+  - "))
    r = df.select(F.explode(parts).alias("r"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("r", rf"(?m)^{t}  - (.*)$", 1)), F.lit(""))
    fields = {k: F.coalesce(*[tag(t) for t in tags]) for k, tags in _RIS.items()}
    fields["year"] = F.nullif(F.regexp_extract(F.coalesce(fields["year"], F.lit("")), r"(\d{4})", 1), F.lit(""))
    authors = F.transform(F.regexp_extract_all("r", F.lit(r"(?m)^A[U1]  - (.*)$"), F.lit(1)), lambda a: F.trim(a))
    return r.select(*[c.alias(k) for k, c in fields.items()], authors.alias("authors"))


def database_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Records of a database's CSV export: its columns under our names; absent ones are null."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.select(*[(F.col(f"`{c}`") if c in d.columns else F.lit(None).cast("string")).alias(k) for k, c in columns.items()])


def register_offline_works(spark: SparkSession) -> str:
    """Registers a data source `offline_works` that serves work records from a local JSON-lines snapshot in place of a web service."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Works(DataSource):
        @classmethod
        def name(cls):
            return "offline_works"

        def schema(self):
            return "id string, title string, year int, doi string"

        def reader(self, schema):
            return Reader(self.options)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.keyword = options["path"], options.get("keyword", "").lower()

        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            import json

            with open(self.path) as f:
                for line in f:
                    if line.strip():
                        r = json.loads(line)
                        if self.keyword in (r.get("title") or "").lower():
                            yield r.get("id"), r.get("title"), r.get("year"), r.get("doi")

    spark.dataSource.register(Works)
    return "offline_works"
