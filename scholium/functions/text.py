"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words by whose share English body text is told; sorted.
_OPTION = r"(?:\[[^\]]*\])?"
_STARTS = r"(?=[\\A-Z])"
_CONSONANTS = "BCDFGHJKLMNPQRSTVWXYZ"
_PAGE_MARK = r"(?i)^-{3}\s*page\s+\d+\s*-{3}$"
STOPWORDS = sorted("a an and are as at be between by for from had has have in is methods of on or patients results study that the their these this to was we were which with".split())


def clean_plaintext(t: Column) -> Column:
    """Form feeds to spaces, words joined over line ends, white space collapsed."""
    t = F.regexp_replace(t, "\f", " ")
    t = F.regexp_replace(t, r"-\n", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_latex(t: Column, unwraps: int = 6) -> Column:
    """LaTeX to plain words: citations and references go, formulas become MATH, commands are unwrapped."""
    for pattern, by in ((r"(?<!\\)%[^\n]*", ""), (r"\\(?:cite|ref|eqref|label|autoref|cref)[a-zA-Z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", " "), (r"\$\$[\s\S]*?\$\$|\$[^$]*\$", "MATH"), (r"https?://\S+", " "), (r"10\.\d{4,9}/\S+", " ")):
        t = F.regexp_replace(t, pattern, by)
    for _ in range(unwraps):
        t = F.regexp_replace(t, r"\\[A-Za-z]+\*?" + _OPTION + r"\{([^}{]*)\}", "$1")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?|[{}~]", " ")
    t = F.regexp_replace(t, "---|--|\u2013|\u2014", "-")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def cite_keys(t: Column) -> Column:
    """Keys of all \\cite-like commands, in order, repeated ones once."""
    groups = F.regexp_extract_all(t, F.lit(r"\\(?:no)?cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]+)\}"), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def bibliography_keys(t: Column) -> Column:
    """Keys of \\cite, \\citep, \\citet and \\nocite alone, in order, repeated ones once; \\nocite{*} names none."""
    groups = F.regexp_extract_all(t, F.lit(r"\\(?:nocite|cite[pt]?)\{([^}]+)\}"), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k))))
    return F.array_distinct(F.filter(keys, lambda k: ~k.isin("", "*")))


def sentences(t: Column) -> Column:
    """Cut after . ! or ? where white space and a capital or a backslash follow."""
    parts = F.filter(F.transform(F.split(F.trim(t), r"(?<=[?!.])\s+" + _STARTS), lambda s: F.trim(s)), lambda s: s != "")
    one = F.array(F.struct(parts.alias("p"), F.trim(t).alias("t")))  # a lambda over one element, so that the parts are worked out once
    return F.get(F.transform(one, lambda x: F.when(F.size(x["p"]) > 0, x["p"]).otherwise(F.array(x["t"]))), F.lit(0))


def words(t: Column) -> Column:
    return F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")


def chunk_rows(df: DataFrame, key: str, text: str, size: int = 200, step: int = 150, least: int = 20) -> DataFrame:
    """(key, start, n_words, text): windows of words. A text no longer than a window is one chunk; of longer ones, chunks under `least` words go.

    The words are split once a text, and each window is a slice of them.
    """
    w = df.select(key, words(F.col(text)).alias("__w")).withColumn("__n", F.size("__w")).where("__n > 0")
    w = w.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__n") - (size - step) - 1, F.lit(0)), F.lit(step))))
    n = F.least(F.lit(size), F.col("__n") - F.col("start"))
    w = w.withColumn("n_words", n).where((F.col("__n") <= size) | (F.col("n_words") >= least))
    return w.select(key, "start", "n_words", F.concat_ws(" ", F.slice("__w", F.col("start") + 1, F.col("n_words"))).alias("text"))


def english_ratio(t: Column) -> Column:
    """Largest share of English stopwords in four stretches of the body; 1 for texts under 3000 characters, stretches under 50 words count 0."""
    n = F.length(t)
    stop = F.lit("(?<![a-z])(?:" + "|".join(STOPWORDS) + ")(?![a-z])")
    ratios = []
    for i in range(1, 5):
        part = F.lower(F.substring(t, F.floor(n * i / 5).cast("int") + 1, F.lit(3000)))
        w = F.regexp_count(part, F.lit("[a-z]+"))
        ratios.append(F.when(w >= 50, F.regexp_count(part, stop) / w).otherwise(0.0))
    return F.when(n < 3000, 1.0).otherwise(F.greatest(*ratios))


def corrupted(t: Column) -> Column:
    """A run of eight capital consonants in the first 5000 characters, as broken font tables leave."""
    return F.substring(t, 1, 5000).rlike(f"[{_CONSONANTS}]" + "{8,}")


def boilerplate_score(t: Column) -> Column:
    """Share of meaningful lines that occur once; 0 with fewer than five lines that aren't blank or none meaningful.

    One fold over the sorted lines, where equal ones are neighbours.
    """

    def meaningful(x: Column) -> Column:
        return (F.length(x) > 3) & ~x.rlike(_PAGE_MARK) & ~x.rlike(r"^\d+$")

    def step(s: Column, x: Column) -> Column:
        same = s.prev == x
        real = meaningful(x)
        once = F.when(~real, s.once).when(same, F.when(s.run == 1, s.once - 1).otherwise(s.once)).otherwise(s.once + 1)
        return F.struct(x.alias("prev"), F.when(same, s.run + 1).otherwise(1).alias("run"), once.alias("once"), F.when(real, s.real + 1).otherwise(s.real).alias("real"), (s.lines + 1).alias("lines"))

    def score(s: Column) -> Column:
        return F.when((s.lines < 5) | (s.real == 0), 0.0).otherwise(s.once / s.real)

    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("once"), F.lit(0).alias("real"), F.lit(0).alias("lines"))
    lines = F.array_sort(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.aggregate(lines, start, step, score)


def norm_title(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def norm_doi(d: Column) -> Column:
    """Lower case, without resolver or doi: prefix; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(d)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")), F.lit(""))


def content_tokens(t: Column, least: int = 3) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(F.array_distinct(F.filter(F.split(norm_title(t), " "), lambda w: F.length(w) >= least)), stop)


def title_coverage(title: Column, text: Column) -> Column:
    """Share of a title's content words that the text has."""
    a = content_tokens(title)
    return F.try_divide(F.size(F.array_intersect(a, F.split(norm_title(text), " "))), F.size(a))


def record_id(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty, nor zero; else the empty text."""
    return F.coalesce(*[F.nullif(F.nullif(c.cast("string"), F.lit("")), F.lit("0")) for c in candidates], F.lit(""))


def inverted_index_text(index: Column) -> Column:
    """The text of a map from word to its places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.concat_ws(" ", F.transform(F.array_sort(pairs), lambda x: x.w))


def author_list(names: Column, show: int = 3) -> Column:
    n = F.size(names)
    return F.when(n > show, F.concat(F.concat_ws(", ", F.slice(names, 1, show)), F.lit(" et al. ("), n.cast("string"), F.lit(" authors)"))).otherwise(F.concat_ws(", ", names))


def bare_title(t: Column) -> Column:
    """A title without markup, in lower case: emphasis and braces keep their content, other commands go."""
    for _ in range(2):
        t = F.regexp_replace(t, r"\\(?:emph|textbf|textit)\{([^}]*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\{([^}]*)\}", "$1"), r"\\[a-zA-Z]+", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"[{}$\\]", ""), r"\s+", " ")))


def resolver_doi(d: Column) -> Column:
    """Lower case, without a resolver's address only; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(d)), r"^https?://(?:dx\.)?doi\.org/", "")), F.lit(""))


def web_doi(d: Column) -> Column:
    """The DOI of a resolver's address, in lower case; null for anything else."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(d)), r"^https?://(?:dx\.)?doi\.org/(\S+)$", 1), F.lit(""))


def slug(t: Column) -> Column:
    """Lower-case letters and digits, anything between them one hyphen."""
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), F.lit("-"))


def library_key(doi: Column, pmid: Column, body: Column, title: Column) -> Column:
    """A key by the first of: DOI, PMID, checksum of the content, title."""
    d, p = norm_doi(doi), F.nullif(F.trim(pmid), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi-"), slug(d)), F.concat(F.lit("pmid-"), p), F.concat(F.lit("md5-"), F.substring(F.md5(body), 1, 12)), F.concat(F.lit("item-"), slug(title)))
