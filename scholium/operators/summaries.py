"""Corpus summaries: declared counters and extractors, the review funnel, and distributions of reported p-values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import special
from scholium.runtime import cut, small_join


def collapsed(c: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


@dataclass(frozen=True)
class ListCounter:
    field: str
    top: int | None = None
    drop: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScalarCounter:
    field: str
    top: int | None = None
    default: str | None = None
    drop_empty: bool = False
    normalize: bool = False


@dataclass(frozen=True)
class TextCollection:
    field: str
    include: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class NumericExtractor:
    field: str
    key: str
    units: dict[str, str]
    convert_to: str | None = None
    conversions: dict[str, float] = field(default_factory=dict)
    band: tuple[float, float] | None = None


def _most_common(df: DataFrame, value: str, pos: str, top: int | None) -> DataFrame:
    """Counts of values; with top, the most frequent, ties to the first to appear."""
    c = df.groupBy(value).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))
    return c if top is None else c.orderBy(F.desc("n"), "first_pos").limit(top)


def list_counter(df: DataFrame, spec: ListCounter, pos: str = "pos") -> DataFrame:
    """(value, n, first_pos) of a list column's normalised items; pos orders the rows. Empty and dropped items don't count."""
    drop = [x.strip().lower() for x in spec.drop]
    items = df.select(F.col(pos).alias("__p"), F.posexplode(spec.field)).select(F.struct(F.col("__p"), F.col("pos")).alias("__at"), collapsed(F.col("col")).alias("value"))
    items = items.where("value != ''")
    if drop:
        items = items.where(~F.col("value").isin(drop))
    return _most_common(items, "value", "__at", spec.top).select("value", "n")


def dropped_items(df: DataFrame, spec: ListCounter) -> DataFrame:
    return df.select(F.explode(spec.field).alias("x")).agg(F.count_if(collapsed(F.col("x")).isin([d.lower() for d in spec.drop])).alias("n_dropped"))


def scalar_counter(df: DataFrame, spec: ScalarCounter, pos: str = "pos") -> DataFrame:
    v = F.trim(F.col(spec.field).cast("string"))
    v = F.nullif(collapsed(v) if spec.normalize else v, F.lit(""))
    rows = df.select(F.col(pos).alias("__at"), v.alias("value"))
    if spec.default is not None:
        rows = rows.withColumn("value", F.coalesce("value", F.lit(spec.default)))
    elif spec.drop_empty:
        rows = rows.where("value IS NOT NULL")
    else:
        rows = rows.withColumn("value", F.coalesce("value", F.lit("")))
    return _most_common(rows, "value", "__at", spec.top).select("value", "n")


def project(df: DataFrame, fields: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Chosen fields as text, renamed; absent and null ones are empty."""
    rename = rename or {}
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(rename.get(c, c)) for c in fields])


def text_collection(df: DataFrame, spec: TextCollection) -> DataFrame:
    """Rows with a text that isn't blank, and chosen fields of theirs; absent ones are empty."""
    rows = df.where(F.trim(F.col(spec.field)) != "").withColumn("__text", F.col(spec.field))
    names = [spec.rename.get(c, c) for c in spec.include]
    return project(rows, [*spec.include, "__text"], spec.rename | {"__text": "text"}).select(*names, "text")


def _valued(found: Column, unit: str, factor: float) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(unit).alias("unit"), (x.try_cast("double") * factor).alias("value")))


def numeric_values(df: DataFrame, spec: NumericExtractor) -> DataFrame:
    """(key, unit, value) of each number found, in the common unit."""
    parts = []
    for unit, pattern in spec.units.items():
        factor = spec.conversions.get(unit, 1.0) if spec.convert_to and unit != spec.convert_to else 1.0
        found = F.regexp_extract_all(F.col(spec.field), F.lit("(?i)" + pattern), F.lit(1))
        parts.append(_valued(found, unit, factor))
    return df.select(F.col(spec.key).alias("key"), F.explode(F.concat(*parts)).alias("x")).select("key", "x.*").where("value IS NOT NULL")


def numeric_extractor(df: DataFrame, spec: NumericExtractor) -> DataFrame:
    """One row: papers with any text in the field, values found, least, largest, the upper one of the middle values, and those in the band."""
    v = numeric_values(df, spec)
    band = F.count_if(F.col("value").between(*spec.band)) if spec.band else F.lit(None).cast("long")
    n = v.agg(F.count("*").alias("n_values"), F.min("value").alias("min"), F.max("value").alias("max"), band.alias("n_in_band"))
    # the value at place n div 2: equal values are counted, and the counts summed over ranges of values, so that no task holds all
    from scholium.operators.numbering import number_rows

    counts = number_rows(v.groupBy("value").agg(F.count("*").alias("k")), ["value"], total_of="k", total="before")
    half = F.floor(F.col("n_values") / 2)
    middle = counts.crossJoin(F.broadcast(n)).where((F.col("before") <= half) & (F.col("before") + F.col("k") > half)).agg(F.max("value").alias("median"))
    papers = df.where(F.trim(F.col(spec.field)) != "").agg(F.count_distinct(spec.key).alias("n_papers"))
    return papers.crossJoin(n).crossJoin(middle)  # one row each


def aggregate(df: DataFrame, specs: list, pos: str = "pos") -> dict[str, DataFrame]:
    """The result of each declared counter, collection and extractor by its field, and corpus_n. The rows are read once a spec; give a written table."""
    run = {ListCounter: lambda x: list_counter(df, x, pos), ScalarCounter: lambda x: scalar_counter(df, x, pos), TextCollection: lambda x: text_collection(df, x), NumericExtractor: lambda x: numeric_extractor(df, x)}
    return {"corpus_n": df.agg(F.count("*").alias("corpus_n"))} | {x.field: run[type(x)](x) for x in specs}


def aggregate_counts(df: DataFrame, specs: list, pos: str = "pos") -> DataFrame:
    """(field, value, n) of all counters among the specs, and corpus_n, in one table."""
    parts = aggregate(df, [x for x in specs if isinstance(x, (ListCounter, ScalarCounter))], pos)
    out = parts.pop("corpus_n").select(F.lit("corpus_n").alias("field"), F.lit(None).cast("string").alias("value"), F.col("corpus_n").alias("n"))
    for name, d in parts.items():
        out = out.unionByName(d.select(F.lit(name).alias("field"), "value", "n"))
    return out


def prisma(records: DataFrame, decisions: DataFrame, full_text: DataFrame | None = None) -> DataFrame:
    """One row: identified, duplicates removed (by PMID, DOI or title, the first database's record stays), screened, decisions, and full texts assessed and included.

    records: pos (order, unique), database, pmid, doi, title. decisions and full_text: decision.
    """
    from scholium.functions.text import norm_title
    from scholium.operators.resolve import ordered_dedup

    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    d = ordered_dedup(records, [blank(F.col("pmid")), blank(F.lower("doi")), F.nullif(norm_title(F.col("title")), F.lit(""))], "pos", "pos")
    out = d.agg(F.count("*").alias("identified"), F.count_if(~F.col("kept")).alias("duplicates_removed"), F.count_if("kept").alias("screened"))
    f = funnel(decisions).withColumnRenamed("screened", "screened_decisions")
    out = out.crossJoin(f)  # one row each
    if full_text is not None:
        out = out.crossJoin(funnel(full_text).select(F.col("screened").alias("full_text_assessed"), F.col("include").alias("included_after_full_text"), F.col("exclude").alias("excluded_at_full_text")))
    return out


def funnel(decisions: DataFrame) -> DataFrame:
    """Screening decisions: all, include, exclude, maybe."""
    d = F.col("decision")
    return decisions.agg(F.count("*").alias("screened"), *[F.count_if(d == x).alias(x) for x in ("include", "exclude", "maybe")])


def exclusion_reasons(decisions: DataFrame, top: int = 20, pos: str = "pos") -> DataFrame:
    rows = decisions.where("decision = 'exclude'").select(F.col(pos).alias("__at"), F.coalesce(collapsed(F.col("reason")), F.lit("")).alias("reason"))
    return _most_common(rows, "reason", "__at", top).select("reason", "n")


def validation_summary(touched: DataFrame) -> DataFrame:
    """Touched, reviewed and flipped records, and the share that agreed; null without reviews."""
    a = touched.agg(F.count("*").alias("touched"), F.count_if("reviewed").alias("reviewed"), F.count_if(F.col("reviewed") & F.col("flip")).alias("flipped"))
    return a.withColumn("agreement", F.try_divide(F.col("reviewed") - F.col("flipped"), F.col("reviewed")))


# --- reported p-values: (pmid, p_reported, p_str, op)


def p_curve(pvalues: DataFrame) -> DataFrame:
    """Bins of the significant p-values reported with = or <, and the tests of skew on their counts."""
    p = F.col("p_reported")
    s = pvalues.where((p < 0.05) & F.col("op").isin("=", "<"))
    bins = [F.count_if((p >= i / 100) & (p < (i + 1) / 100)).alias(f"bin_{i + 1:02d}") for i in range(5)]
    a = s.agg(F.count("*").alias("n_significant"), *bins, F.count_if(p < 0.025).alias("n_low"), F.count_if(p >= 0.025).alias("n_high"))
    return a.withColumn("hacking_ratio", F.try_divide(F.col("bin_05"), F.col("bin_02")))


def right_skew_p(n_low: int, n_high: int) -> float | None:
    """One-sided binomial p that low p-values are no more than half; null up to 20 values."""
    return special.binomial_sf(n_low, n_low + n_high) if n_low + n_high > 20 else None


def last_digits(pvalues: DataFrame) -> DataFrame:
    """(digit, n) from 0 to 9 of p-values reported with = and a point, by their printed last digit."""
    last = F.right("p_str", F.lit(1))
    c = pvalues.where((F.col("op") == "=") & F.col("p_str").contains(".") & last.rlike("^[0-9]$")).groupBy(last.cast("int").alias("digit")).agg(F.count("*").alias("n"))
    digits = pvalues.sparkSession.range(10).select(F.col("id").cast("int").alias("digit"))
    return digits.join(F.broadcast(c), "digit", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # ten rows


def last_digit_test(pvalues: DataFrame) -> DataFrame:
    """Chi-squared against uniform digits from 100 values on, and what their shares suggest."""
    d, n = F.col("digit"), F.col("n")
    share = lambda *ds: F.try_divide(F.sum(F.when(d.isin(*ds), n).otherwise(0)), F.sum(n))
    a = last_digits(pvalues).agg(F.sum("n").alias("n_values"), (F.try_divide(10 * F.sum(n * n), F.sum(n)) - F.sum(n)).alias("chi2"), share(1, 2, 3, 4).alias("small"), share(4, 5, 7).alias("fraud"), share(0, 9).alias("zero_nine"))
    enough = F.col("n_values") >= 100
    a = a.withColumn("chi2", F.when(enough, F.col("chi2")))
    a = a.withColumn("p", special.chi2_tail(F.col("chi2"), F.when(enough, 9.0)))
    return a.withColumn("reading", F.when(enough, F.when(F.col("small") > 0.45, "newcomb_benford").when((F.col("fraud") > 0.40) & (F.col("zero_nine") < 0.10), "possible_fraud").otherwise("ambiguous")))


def positivity(rows: DataFrame) -> DataFrame:
    r = F.col("positivity_ratio")
    return rows.where(r.isNotNull()).agg(F.count("*").alias("n_papers"), F.avg(r).alias("mean_positivity"), F.count_if(r > 0.85).alias("n_high"), F.avg((r > 0.85).cast("double")).alias("share_high"))


def industry_positivity(funding: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean positivity of papers with and without industry links, and Welch's t."""
    j = funding.select("pmid", "industry_linked").join(rows.select("pmid", "positivity_ratio").where("positivity_ratio IS NOT NULL"), "pmid")
    a = j.agg(*[f(F.when(F.col("industry_linked") == v, F.col("positivity_ratio"))).alias(f"{name}{int(v)}") for v in (True, False) for f, name in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))])
    v1, v0 = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    a = a.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(v1 + v0))).withColumn("df", F.try_divide((v1 + v0) * (v1 + v0), v1 * v1 / (F.col("n1") - 1) + v0 * v0 / (F.col("n0") - 1)))
    return a.withColumn("p", 2 * special.t_tail(F.abs("t"), F.col("df")))


#: Papers of one set of authors that one row of a cell holds.
MEMBERS = 1024


def salami(papers: DataFrame, least: int = 3) -> DataFrame:
    """Pairs with the same cohort size, of a size that at least three papers have, and at least `least` authors in common.

    Papers of one size and the same authors are one class, and classes are compared. In a common order of authors, the rarest first, two sets that share `least` authors
    share one that isn't among the last least - 1 of either: only by those do they meet. At the end pairs of classes become pairs of papers, in cells of MEMBERS a side,
    so that no pair is made twice, nor shuffled.
    """
    big = papers.where("cohort_size IS NOT NULL").groupBy("cohort_size").agg(F.count("*").alias("k")).where("k >= 3").select("cohort_size")
    names = F.array_sort(F.array_distinct(F.array_compact("authors"))).alias("authors")
    rows = cut(papers.join(big, "cohort_size").select("pmid", "cohort_size", names).where(F.size("authors") >= least).withColumn("c", F.xxhash64("cohort_size", "authors")), "papers")
    classes = rows.groupBy("c").agg(F.first("cohort_size").alias("cohort_size"), F.first("authors").alias("authors"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("tiles"))
    classes = cut(classes, "classes")
    each = classes.select("c", "cohort_size", F.explode("authors").alias("author"))
    often = each.groupBy("cohort_size", "author").agg(F.count("*").alias("n")).where("n > 1")
    order = F.array_sort(F.collect_list(F.struct("n", "author")))  # a class's authors
    ranked = small_join(each, often, ["cohort_size", "author"], "left").withColumn("n", F.coalesce("n", F.lit(1))).groupBy("c", "cohort_size").agg(order.alias("a"))
    first = ranked.select("c", "cohort_size", F.transform("a", lambda x: x["author"]).alias("authors"), F.explode(F.slice("a", 1, F.size("a") - (least - 1))).alias("x")).where("x.n > 1").select("c", "cohort_size", "authors", F.col("x.author").alias("author"))
    a = first.select(F.col("c").alias("ca"), F.col("authors").alias("in_a"), "cohort_size", "author")
    b = first.select(F.col("c").alias("cb"), F.col("authors").alias("in_b"), "cohort_size", "author")
    met = a.join(b, ["cohort_size", "author"]).where("ca < cb").withColumn("shared", F.array_sort(F.array_intersect("in_a", "in_b"))).where(F.size("shared") >= least)
    met = met.groupBy("ca", "cb").agg(F.first("cohort_size").alias("cohort_size"), F.first("shared").alias("shared"))
    met = met.unionByName(classes.select(F.col("c").alias("ca"), F.col("c").alias("cb"), "cohort_size", F.col("authors").alias("shared")))

    tiles = classes.select("c", "tiles")
    blocks = small_join(rows.select("c", "pmid"), tiles, ["c"]).groupBy("c", F.pmod(F.xxhash64("pmid"), "tiles").cast("int").alias("tile")).agg(F.collect_set("pmid").alias("pmids"))  # some MEMBERS
    blocks = cut(blocks, "blocks")
    cells = met.join(tiles.select(F.col("c").alias("ca"), F.col("tiles").alias("ta")).hint("merge"), "ca").join(tiles.select(F.col("c").alias("cb"), F.col("tiles").alias("tb")).hint("merge"), "cb")
    cells = cells.withColumn("ia", F.explode(F.sequence(F.lit(0), F.col("ta") - 1))).withColumn("ib", F.explode(F.sequence(F.when(F.col("ca") == F.col("cb"), F.col("ia")).otherwise(0), F.col("tb") - 1)))
    side = lambda x: blocks.select(F.col("c").alias(f"c{x}"), F.col("tile").alias(f"i{x}"), F.col("pmids").alias(f"in_{x}")).hint("merge")
    cells = cells.join(side("a"), ["ca", "ia"]).join(side("b"), ["cb", "ib"])
    n = int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = (F.col("ca") == F.col("cb")) & (F.col("ia") == F.col("ib"))
    pairs = cells.select("cohort_size", "shared", F.size("shared").cast("long").alias("n_shared"), same.alias("same"), "in_a", "in_b").repartition(n)  # a number that Spark keeps to: few bytes make many rows
    pairs = pairs.withColumn("a", F.explode("in_a")).withColumn("b", F.explode("in_b")).where("(a < b) OR (NOT same AND a > b)")
    return pairs.select(F.least("a", "b").alias("pmid_a"), F.greatest("a", "b").alias("pmid_b"), "cohort_size", "n_shared", "shared")
