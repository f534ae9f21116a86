r"""References set by hand in \bibitem blocks, and the walk over a project's sources and bibliographies.

An item is read by the first style that fits: quoted title; authors (year). title; the medical article and book; year in brackets at the end; year in the middle;
else only a year and a long title in italics.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.runtime import ship
from scholium.sources.readers import REFERENCE, bibtex

_BLOCK = re.compile(r"\\begin\{thebibliography\}[^\n]*\n" + r"(?P<items>.*?)" + r"\\end\{thebibliography\}", re.S)
_ITEM = re.compile(r"\\bibitem\s*(?:\[[^\]]*\])?\{(?P<key>[^}]*)\}(?P<body>.*?)" + r"(?=\\bibitem\s*[\[{]|\Z)", re.S)
_DOI = re.compile(r"(?:https?://doi\.org/|doi:?\s*)" + r"(?P<doi>\d+\.[^\s}]+)", re.I)
_LINK = re.compile(r"\\(?:href|url)\{" + r"(?P<url>[^}]*)\}")
_ARXIV = re.compile(r"arxiv:?\s*(?:preprint\s*(?:arxiv:)?)?" + r"(?P<id>[a-z-]+/\d{7}|\d{4}\.\d{4,5})", re.I)
_QUOTED = re.compile(r"``(?P<title>.+?),?\s*''", re.S)
_SPAN = r"[\d–-]+"
_YEAR = r"(?:19|20)\d\d"
_AFTER = re.compile(rf"(?P<journal>.*?),?\s+(?P<volume>\d+),\s*(?P<pages>{_SPAN})\s*\((?P<year>\d{{4}})\)")
_STYLES = {
    "dated": re.compile(r"(?P<authors>.*?)[,.]?\s*\((?P<year>\d{4}(?:,\s*in press)?)\)\.\s*(?P<rest>.*)\Z", re.S),
    "article": re.compile(rf"(?P<authors>.*?)\.\s+(?P<title>.*?)\.\s+(?P<journal>.*?)\s+(?P<year>{_YEAR})\s*;\s*(?P<volume>\d+)\s*:\s*(?P<pages>{_SPAN})"),
    "book": re.compile(rf"(?P<authors>.*?)\.\s+(?P<title>.*?)\.\s+(?P<place>.*?):\s*(?P<house>.*?);\s*(?P<year>{_YEAR})\."),
}
_LAST_YEAR = re.compile(r"\((?P<year>\d{4})\)\s*\.?\s*\Z")
_MID_YEAR = re.compile(rf",\s*(?P<year>{_YEAR})\b")
_INITIALS = re.compile(r"(?P<authors>(?:(?:[A-Z]\.\s*){1,2}[\w'-]+(?:\s+(?:et\s+al\.?|and\b))?,?\s*)+?),\s*(?P<rest>(?![A-Z]\.).*)\Z", re.S)
_VOLUME = re.compile(rf"(?P<journal>.*?),\s*(?P<volume>\d+)(?:\((?P<number>\d+)\))?,\s*(?P<pages>{_SPAN})")
_PAGES = re.compile(rf"(?P<journal>.*?),\s*(?P<pages>{_SPAN})\s*\Z")
_TAIL = re.compile(rf",\s*(?P<volume>\d+),\s*(?P<pages>{_SPAN})\s*\Z")


def _plain(s: str, links: bool = True) -> str:
    """Without markup: emphasis keeps its content, links go."""
    s = re.sub(r"\\href\{[^}]*\}\{[^}]*\}" + (r"|\\url\{[^}]*\}" if links else ""), "", s)
    s = re.sub(r"\\(?:emph|textbf|textit)\{([^}]*)\}", lambda m: m.group(1), s).replace(r"\&", "&").replace("~", " ")
    return " ".join(re.sub("[{}]", "", s).split())


def looks_like_author(s: str) -> bool:
    """Initials, "et al", or a short text with a capitalised word."""
    return bool(re.search(r"[A-Z]\.\s*[A-Z]", s)) or "et al" in s.lower() or (len(s) < 80 and bool(re.search("[A-Z][a-z]", s)))


def split_title(s: str) -> dict:
    """title, journal, volume, number and pages of "title. journal, 12(3), 45-67"."""
    title, dot, rest = (x.strip() for x in (re.split(r"(\.\s+)", s, maxsplit=1) + ["", ""])[:3])
    out = {"title": title}
    if dot:
        m = _VOLUME.match(rest) or _PAGES.match(rest)
        out |= {k: v or "" for k, v in m.groupdict().items()} if m else {"journal": rest.rstrip(".")}
    if m := _TAIL.search(out["title"]):
        out |= m.groupdict() | {"title": out["title"][: m.start()].strip()}
    return out


def parse_item(body: str) -> dict:
    """The fields of an item's text; those that can't be told are left out."""
    out = {}
    for k, m in (("doi", _DOI.search(body)), ("url", _LINK.search(body)), ("arxiv_id", _ARXIV.search(body))):
        if m:
            out[k] = m.group(1).rstrip(".")
    if m := _QUOTED.search(body):
        before = _plain(re.sub(r"\\textit\{[^}]*\}", "", body[: m.start()])).rstrip(", ")
        after = _plain(body[m.end() :])
        out |= {"title": m.group("title").strip()} | ({"author": before} if before else {})
        if a := _AFTER.match(after):
            out |= a.groupdict()
        elif y := re.search(r"\((\d{4})\)", after):
            out["year"] = y.group(1)
    else:
        out |= _by_style(_plain(body), body)
    if "pages" in out:
        out["pages"] = out["pages"].replace("–", "--")
    if "authors" in out:
        out["author"] = out.pop("authors")
    return {k: v.strip() for k, v in out.items() if v and v.strip()}


def _by_style(s: str, raw: str) -> dict:
    if m := _STYLES["dated"].match(s):
        return {"authors": m["authors"].strip().rstrip(",."), "year": m["year"]} | split_title(m["rest"].strip())
    if m := _STYLES["article"].match(s):
        return m.groupdict()
    if m := _STYLES["book"].match(s):
        return {"authors": m["authors"], "title": m["title"], "publisher": f"{m['place'].strip()}: {m['house'].strip()}", "year": m["year"]}
    if m := _LAST_YEAR.search(s):
        before = s[: m.start()].strip().rstrip(",.")
        if a := _INITIALS.match(before):
            return {"year": m["year"], "authors": a["authors"].rstrip(", ")} | split_title(a["rest"].strip())
        first, comma, rest = before.partition(",")
        named = bool(comma) and looks_like_author(first.strip())
        return {"year": m["year"]} | ({"authors": first} if named else {}) | split_title(rest.strip() if named else before)
    if m := _MID_YEAR.search(s):
        first, comma, rest = s[: m.start()].partition(",")
        return {"year": m["year"]} | ({"authors": first} | split_title(rest.strip()) if comma else {})
    year, italic = re.search(rf"\b{_YEAR}\b", s), re.search(r"\\(?:emph|textit)\{([^}]{11,})\}", raw)
    return ({"year": year.group(0)} if year else {}) | ({"title": italic.group(1)} if italic else {})


def parse_bibitems(tex: str) -> list[dict]:
    return [{"cite_key": m["key"].strip()} | parse_item(m["body"].strip()) for b in _BLOCK.finditer(tex) for m in _ITEM.finditer(b["items"])]


def bibitems(df: DataFrame, text: str = "text", source: str = "source_file") -> DataFrame:
    """References of the item blocks of LaTeX sources, one source a row, in the columns of `bibtex`."""
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(src, i, *(r.get(c, "") for c in REFERENCE)) for src, t in zip(pdf[source], pdf[text]) if t and "thebibliography" in t for i, r in enumerate(parse_bibitems(t))]
            yield pd.DataFrame(rows, columns=[source, "pos", *REFERENCE])

    return df.select(source, text).mapInPandas(run, f"{source} string, pos int, " + ", ".join(f"{c} string" for c in REFERENCE)).withColumn("source_format", F.lit("bibitem"))


SKIPPED = "__pycache__ .devcontainer .git archive node_modules tools".split()


def in_skipped_folder(path: Column) -> Column:
    return F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.isin(SKIPPED))


def named_bibliographies(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    r"""(path, bib): the files beside a source that its \bibliography commands name, whether they exist or not."""
    names = F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\\bibliography\{([^}]+)\}"), F.lit(1)), lambda g: F.split(g, ",")))
    d = df.select(F.col(path).alias("path"), F.explode(names).alias("n")).select("path", F.trim("n").alias("n")).where("n <> ''")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    return d.select("path", F.concat(folder, F.when(F.col("n").endswith(".bib"), F.col("n")).otherwise(F.concat("n", F.lit(".bib")))).alias("bib")).distinct()


def project_references(files: DataFrame) -> DataFrame:
    """References of a project's files (path, text): of all sources' item blocks and all bibliographies, each file once; `cited` tells bibliographies that a source names. Some folders are skipped."""
    f = files.where(~in_skipped_folder(F.col("path"))).withColumnRenamed("path", "source_file")
    tex, bib = f.where(F.col("source_file").endswith(".tex")), f.where(F.col("source_file").endswith(".bib"))
    named = named_bibliographies(tex, "source_file").select(F.col("bib").alias("source_file")).distinct().withColumn("cited", F.lit(True))
    entries = bibtex(bib).join(named, "source_file", "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return bibitems(tex).withColumn("cited", F.lit(True)).unionByName(entries)


def project_stats(files: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: files read, references by format, and those with a DOI, an arXiv number and a title."""
    f = files.where(~in_skipped_folder(F.col("path"))).agg(F.count_if(F.col("path").endswith(".tex")).alias("tex_files"), F.count_if(F.col("path").endswith(".bib")).alias("bib_files"))
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    r = refs.agg(F.count_if(F.col("source_format") == "bibitem").alias("bibitems"), F.count_if(F.col("source_format") == "bibtex").alias("bibtex"), has("doi").alias("with_doi"), has("arxiv_id").alias("with_arxiv"), has("title").alias("with_title"))
    return f.crossJoin(r)  # one row each
