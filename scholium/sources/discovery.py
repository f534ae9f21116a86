"""Discovery of papers: a paged data source for whatever service a caller can reach, records of several services in one shape, and the filters that pick from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions.text import inverted_index_text, norm_doi

#: The shape of a discovered paper.
PAPER = "id string, title string, authors array<string>, abstract string, published date, source string, source_url string, pdf_url string, matched_keywords array<string>, matched_authors array<string>"


def register_paged(spark: SparkSession, name: str, schema: str, pages: int, fetch: Callable[[int, dict], Iterable[tuple]]) -> str:
    """Registers a data source `name` whose page i, from 0 to pages - 1, is what fetch(i, options) gives; each page is a task of its own, fetched where it runs and again if that is lost.

    fetch travels to the executors, so it holds what it needs; the option `pages` lowers the number.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [InputPartition(i) for i in range(min(pages, int(self.options.get("pages", pages))))]

        def read(self, partition):
            yield from fetch(partition.value, self.options)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Paged)
    return name


# --- queries

_POPULATION = "c1"


def population_blocks(blocks: dict[str, str]) -> list[str]:
    """Blocks named C1...; without any, the first."""
    return [k for k in blocks if k.lower().startswith(_POPULATION)] or list(blocks)[:1]


def boolean_query(blocks: dict[str, str], filters: str = "", years: tuple[int, int] | None = None, whole: str = "") -> str:
    """(population) AND (any other block) AND filters. A whole query is taken as it is; a filter goes before a range of years."""
    if whole.strip():
        return whole
    if not blocks:
        raise ValueError("neither blocks nor a whole query")
    first = population_blocks(blocks)
    groups = [[blocks[k] for k in first], [v for k, v in blocks.items() if k not in first]]
    out = " AND ".join(f"({' OR '.join(g)})" for g in groups if g)
    last = filters.strip() or (f"{years[0]}:{years[1]}[pdat]" if years else "")
    return f"{out} AND {last}" if last else out


def matches(text: Column, expression: str) -> Column:
    """Whether a text satisfies terms joined by AND, OR and NOT, with brackets; quoted terms may hold spaces. A term is looked for as it stands, whatever its case; what is in square brackets behind it is left aside."""
    import re

    tokens = re.findall(r'\(|\)|\b(?:AND|OR|NOT)\b|"[^"]*"(?:\[[^\]]*\])?|[^\s()"]+', expression)
    low, at = F.lower(text), 0

    def parse(stop: tuple[str, ...] = ()) -> Column:
        nonlocal at
        out = factors()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            out = out | factors()
        return out

    def factors() -> Column:
        nonlocal at
        out = factor()
        while at < len(tokens) and tokens[at] in ("AND", "NOT"):
            at += tokens[at] == "AND"
            out = out & factor()
        return out

    def factor() -> Column:
        nonlocal at
        if at >= len(tokens) or tokens[at] in (")", "AND", "OR"):
            raise ValueError("a term is lacking")
        t = tokens[at]
        at += 1
        if t == "NOT":
            return ~factor()
        if t == "(":
            out = parse()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("a bracket isn't closed")
            at += 1
            return out
        words = [t]
        while t[0] != '"' and at < len(tokens) and tokens[at] not in ("(", ")", "AND", "OR", "NOT"):
            words.append(tokens[at])
            at += 1
        term = re.sub(r"\[[^\]]*\]$", "", " ".join(words)).strip('"').lower()
        return F.coalesce(low.contains(term), F.lit(False))

    out = parse()
    if at < len(tokens):
        raise ValueError(f"nothing should follow: {tokens[at]}")
    return out


def block_counts(records: DataFrame, blocks: dict[str, str], text: str) -> DataFrame:
    """(block, n): records that satisfy the population and each other block, in one pass."""
    first = population_blocks(blocks)
    pop = matches(F.col(text), " OR ".join(f"({blocks[k]})" for k in first))
    rest = [k for k in blocks if k not in first]
    counts = records.agg(*[F.count_if(pop & matches(F.col(text), blocks[k])).alias(f"n{i}") for i, k in enumerate(rest)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.col(f"n{i}").alias("n")) for i, k in enumerate(rest)])).alias("x")).select("x.*")


# --- filters


def good_source(venue: Column, doi: Column, blocked: list[str]) -> Column:
    """Neither a blocked venue, by part of its name, nor a repository's DOI."""
    low = F.lower(F.coalesce(venue, F.lit("")))
    out = ~F.coalesce(doi, F.lit("")).contains("10.5281")
    for b in blocked:
        out = out & ~low.contains(b.lower())
    return out


def keyword_relevant(keyword: Column | str, title: Column, abstract: Column) -> Column:
    """A keyword in the title, twice in the abstract, or within its first 500 characters."""
    k = F.lower(F.lit(keyword) if isinstance(keyword, str) else keyword)
    t, a = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, abstract))
    n = F.length(a) - F.length(F.replace(a, k, F.lit("")))
    return F.contains(t, k) | (n >= 2 * F.length(k)) | F.contains(F.substring(a, 1, 500), k)


def matching_keywords(text: Column, keywords: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(text), F.lower(k)))


def matching_authors(authors: Column, wanted: list[str]) -> Column:
    """Wanted authors whose last name stands anywhere in the authors' line."""
    return F.filter(F.array(*[F.lit(a) for a in wanted]), lambda a: F.contains(F.lower(authors), F.lower(F.element_at(F.split(F.trim(a), r"\s+"), -1))))


def any_keyword(text: Column, keywords: list[str], first: int = 20_000) -> Column:
    """Whether the first characters hold any keyword (given in lower case)."""
    body = F.substring(F.lower(text), 1, first)
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(body, k))


def from_source(files: Column, part: str) -> Column:
    """Whether any of a reference's source files has the part in its path."""
    return F.exists(files, lambda f: F.contains(f, F.lit(part)))


def since(when: Column, days: int, today: Column | None = None) -> Column:
    """Lookback: no older than so many days. Unknown dates stay."""
    return when.isNull() | (when >= F.date_sub(today if today is not None else F.current_date(), days))


# --- records of services


def openalex_papers(works: DataFrame) -> DataFrame:
    """Works with id, doi, title, venue, authors (array), abstract_inverted_index (map), published and pdf_url, as papers."""
    doi = norm_doi(F.col("doi"))
    key = F.coalesce(doi, F.concat(F.lit("openalex:"), F.substring_index("id", "/", -1)))
    none = F.array().cast("array<string>")
    return works.select(key.alias("id"), "title", "authors", inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"), F.col("published").cast("date").alias("published"), F.lit("openalex").alias("source"), F.col("id").alias("source_url"), "pdf_url", none.alias("matched_keywords"), none.alias("matched_authors"))


def openalex_search(works: DataFrame, keywords: list[str], authors: list[str], blocked: list[str], most: int | None = None) -> DataFrame:
    """Papers of good sources that a keyword is relevant to, or that a wanted author wrote. With `most`, so many for each keyword and author, the newest."""
    w = works.where(good_source(F.col("venue"), F.col("doi"), blocked))
    p = openalex_papers(w).withColumn("matched_keywords", F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: keyword_relevant(k, F.col("title"), F.col("abstract"))))
    p = p.withColumn("matched_authors", matching_authors(F.concat_ws("; ", "authors"), authors))
    p = p.where((F.size("matched_keywords") > 0) | (F.size("matched_authors") > 0))
    if most is None:
        return p
    from pyspark.sql import Window

    e = p.select("id", "published", F.explode(F.concat(F.transform("matched_keywords", lambda k: F.concat(F.lit("k"), k)), F.transform("matched_authors", lambda a: F.concat(F.lit("a"), a)))).alias("by"))
    keep = e.withColumn("rn", F.row_number().over(Window.partitionBy("by").orderBy(F.desc_nulls_last("published"), "id"))).where(F.col("rn") <= most).select("id").distinct()
    return p.join(keep, "id", "left_semi")


_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_type:string,_href:string>>"
)


def arxiv_query(keywords: list[str], categories: list[str]) -> list[str]:
    """A query for each keyword, within any of the categories."""
    cats = " OR ".join(f"cat:{c}" for c in categories)
    return [f'all:"{k}"' + (f" AND ({cats})" if cats else "") for k in keywords]


def arxiv_papers(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Papers of Atom entries, one a row: id, title on one line, authors, abstract, published, categories, pdf_url, source_url."""
    e = df.select(F.from_xml(F.col(xml), _ENTRY, {"ignoreNamespace": "true"}).alias("e")).select("e.*")
    pdf = F.try_element_at(F.filter("link", lambda x: x["_type"] == "application/pdf"), F.lit(1))["_href"]
    return e.select(F.when(F.contains("id", F.lit("/abs/")), F.substring_index("id", "/abs/", -1)).otherwise("").alias("id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.transform("author", lambda a: a["name"]).alias("authors"), F.trim("summary").alias("abstract"), F.try_to_timestamp("published").cast("date").alias("published"), F.transform("category", lambda c: c["_term"]).alias("categories"), pdf.alias("pdf_url"), F.col("id").alias("source_url"))


def preprint_papers(rows: DataFrame, server: str, keywords: list[str], authors: list[str]) -> DataFrame:
    """Preprints (doi, title, abstract, authors in one line, date) that match a keyword or an author, each DOI once, as papers."""
    k, a = matching_keywords(F.concat_ws(" ", "title", "abstract"), keywords), matching_authors(F.col("authors"), authors)
    p = rows.where(F.coalesce("doi", F.lit("")) != "").withColumn("k", k).withColumn("a", a).where((F.size("k") > 0) | (F.size("a") > 0)).dropDuplicates(["doi"])
    url = F.concat(F.lit(f"https://www.{server}.org/content/"), "doi")
    people = F.filter(F.transform(F.split("authors", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return p.select(F.concat(F.lit("doi:"), "doi").alias("id"), "title", people.alias("authors"), "abstract", F.col("date").try_cast("date").alias("published"), F.lit(server).alias("source"), url.alias("source_url"), F.concat(url, F.lit(".full.pdf")).alias("pdf_url"), F.col("k").alias("matched_keywords"), F.col("a").alias("matched_authors"))


def first_wins(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of sources with each id once, from the first source that has it."""
    from pyspark.sql import Window

    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("__rank", F.lit(i))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy(key).orderBy("__rank")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__rank", "__n")


def last_wins(records: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last record."""
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), order).alias("r")).select(key, "r.*")


def backfill(records: DataFrame, abstracts: DataFrame, key: str = "pmid") -> DataFrame:
    """records with empty abstracts filled from another table."""
    a = abstracts.groupBy(key).agg(F.max("abstract").alias("__a"))
    return records.join(a, key, "left").withColumn("abstract", F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), "__a")).drop("__a")


def open_pdfs(best: Column, others: Column) -> Column:
    """Addresses of open copies, each once: those that end in .pdf first, then those that speak of one, else in their order."""
    urls = F.array_distinct(F.filter(F.concat(F.array(best), F.coalesce(others, F.array().cast("array<string>"))), lambda u: F.coalesce(u, F.lit("")) != ""))
    rank = lambda u: F.when(u.endswith(".pdf"), 0).when(u.contains("/pdf/") | u.contains("format=pdf"), 1).otherwise(2)
    of = lambda r: F.filter(urls, lambda u: rank(u) == r)
    return F.concat(of(0), of(1), of(2))


# --- publishers

#: Publisher: DOI prefixes, parts of addresses.
PUBLISHERS = {
    "bmj": (["10.1136/"], ["bmj.com"]), "elsevier": (["10.1016/"], ["linkinghub.elsevier.com", "sciencedirect.com"]), "jama": (["10.1001/"], ["jamanetwork.com"]), "karger": (["10.1159/"], ["karger.com"]),
    "lippincott": (["10.1097/", "10.1212/"], ["journals.lww.com", "neurology.org"]), "scielo": (["10.1590/"], ["scielo.br", "scielo.org"]), "springer": (["10.1007/", "10.1038/", "10.1186/"], ["link.springer.com"]),
    "taylor_francis": (["10.1080/", "10.3109/"], ["tandfonline.com"]), "thieme": (["10.1055/"], ["thieme-connect.de"]), "wiley": (["10.1002/", "10.1111/"], ["onlinelibrary.wiley.com"]),
}


def publisher(doi: Column, url: Column, adapters: dict[str, tuple[list[str], list[str]]] = PUBLISHERS) -> Column:
    """The first adapter that can handle a DOI or an address; generic if none can."""
    low, out = F.lower(F.coalesce(url, F.lit(""))), F.lit("generic")
    for name, (prefixes, domains) in reversed(adapters.items()):
        ok = F.lit(False)
        for d in domains:
            ok = ok | low.contains(d)
        for p in prefixes:
            ok = ok | F.coalesce(doi, F.lit("")).startswith(p)
        out = F.when(ok, name).otherwise(out)
    return out


def publisher_domain(url: Column) -> Column:
    """The known part of an address, else its host."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.coalesce(F.try_parse_url(low, F.lit("HOST")), F.lit(""))
    for d in sorted((d for _, ds in PUBLISHERS.values() for d in ds), reverse=True):
        out = F.when(low.contains(d), d).otherwise(out)
    return out
