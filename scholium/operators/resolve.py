"""Entity resolution: exact groups, ordered deduplication, fuzzy titles, retractions, exclusions."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.runtime import components, cut, ship, small_join


def duplicate_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, n, first) of each text that occurs at least twice."""
    return df.groupBy(F.sha1(F.col(text).cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n >= 2")


def exclusions(df: DataFrame, key: str, text: str, keywords: list[str] | None = None, title: str | None = None, least_title: float = 0.50, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, reason): the first reason that holds of duplicate_content, corrupted_text, non_english, boilerplate_only,
    metadata_content_mismatch, domain_keyword_absent; null if none. All members of a group of equal texts are flagged.

    Only a digest of each text is shuffled to find the groups, and the group's size comes back by the digest.
    """
    d = df.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__h", F.sha1(F.col("__t").cast("binary")))
    n = F.length("__t")
    ratio = tx.english_ratio(F.col("__t"))
    ladder = F.when(ratio < 0.08, F.when(tx.corrupted(F.col("__t")), "corrupted_text").otherwise("non_english"))
    ladder = ladder.when((n < 8000) & (tx.boilerplate_score(F.col("__t")) < 0.30), "boilerplate_only")
    if title:
        from scholium.operators.reading import title_similarity

        d = d.withColumn("__sim", title_similarity(F.when((n >= 1000) & (F.length(tx.norm_title(F.col(title))) >= 10), F.col("__t")), F.col(title)))
        ladder = ladder.when((n >= 1000) & (F.length(tx.norm_title(F.col(title))) >= 10) & (F.col("__sim") < least_title), "metadata_content_mismatch")
    if keywords:
        body = F.lower(F.substring("__t", 1, 20000))
        ladder = ladder.when((n > 4000) & ~F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: body.contains(k)), "domain_keyword_absent")
    d = d.select(F.col(key), *keep, F.col("__h"), ladder.alias("own"))
    twice = d.groupBy("__h").agg(F.count("*").alias("n")).where("n >= 2").select("__h", F.lit(True).alias("dup"))
    return small_join(d, twice, ["__h"], "left").select(key, *keep, F.when(F.col("dup"), "duplicate_content").otherwise(F.col("own")).alias("reason"))


def ordered_dedup(df: DataFrame, keys: list[Column], order: str, row: str) -> DataFrame:
    """df with `kept`: rows in order are kept unless a kept row before shares one of their keys; null keys match nothing. Dropped rows' keys don't count.

    Exact: rows are first joined into components by shared keys, and each component is folded in order by itself. `row` numbers the rows.
    """
    ship(df.sparkSession)
    base = df.select(F.col(row).cast("long").alias("r"), F.col(order).alias("o"), *[c.cast("string").alias(f"k{i}") for i, c in enumerate(keys)])
    links = None
    for i in range(len(keys)):
        g = base.where(f"k{i} IS NOT NULL").select("r", f"k{i}")
        first = g.groupBy(f"k{i}").agg(F.min("r").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        e = g.join(first, f"k{i}").select("a", F.col("r").alias("b"))
        links = e if links is None else links.unionByName(e)
    width = len(keys)
    comp = components(links).select(F.col("node").alias("r"), "root")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "r"])
        seen = [set() for _ in range(width)]
        kept = []
        for vals in zip(*[pdf[f"k{i}"] for i in range(width)]):
            ok = not any(v is not None and v in s for v, s in zip(vals, seen))
            kept.append(ok)
            if ok:
                for v, s in zip(vals, seen):
                    if v is not None:
                        s.add(v)
        return pd.DataFrame({"r": pdf["r"], "kept": kept})

    folded = base.join(comp, "r").groupBy("root").applyInPandas(fold, "r long, kept boolean")
    return df.join(folded.withColumnRenamed("r", row), row, "left").withColumn("kept", F.coalesce("kept", F.lit(True)))


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts from 0 to 1, by matching blocks."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if not u or not v else SequenceMatcher(None, u, v).ratio() for u, v in zip(x, y)])

    return f(a, b)


def merge_references(refs: DataFrame) -> DataFrame:
    """One row a cite_key: BibTeX rows first, blank fields filled from the others in order. refs: cite_key, title, year, doi, journal, source_format, source_file, pos."""
    order = F.struct((F.col("source_format") != "bibtex").alias("a"), F.col("pos"))
    filled = [F.min_by(F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", order)).alias(c) for c in ("title", "year", "doi", "journal")]
    return refs.groupBy("cite_key").agg(*filled, F.array_sort(F.collect_set("source_file")).alias("source_files"), F.min("pos").alias("pos"))


#: Titles of one side of a cell; runs of three letters are hashed to so many places.
TITLES, PLACES = 2048, 2048


def _marks(titles: list[str], threshold: float, first: bool) -> np.ndarray:
    """Rows whose products are at least 0 for titles that may be similar enough.

    A ratio above h needs M > h T / 2 letters in matching blocks, T being both lengths. Between blocks lies one of the T - 2 M letters without a match, so that there are at most
    T - 2 M + 1 blocks, which hold 5 M - 2 T - 2 runs of three letters in common. What two titles have in common is at most the places both have, and the mean of what either has there more than once.
    """
    x = np.zeros((len(titles), PLACES + 2), np.float32)
    for i, t in enumerate(titles):
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = (codes[:-2] * np.uint64(1 << 42) + codes[1:-1] * np.uint64(1 << 21) + codes[2:]) * np.uint64(0x9E3779B97F4A7C15)
        places = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(53)).astype(np.int64)
        x[i, np.unique(places)] = 1
        own = (len(places) - x[i].sum()) / 2 - (2.5 * threshold - 2) * len(codes) + 1.01  # a half of the 2 each, and a little for rounding
        x[i, PLACES:] = (own, 1) if first else (1, own)
    return x


def _similar_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """(y, later, earlier) of different titles (y, t, pos) of a year whose ratio is above the threshold. Pairs of blocks are compared in places of their own, and only those whose letters allow it in full."""
    size = titles.groupBy("y").agg(F.ceil(F.count("*") / TITLES).cast("int").alias("tiles"))
    d = small_join(titles, size, ["y"]).withColumn("mine", F.pmod(F.xxhash64("t"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    d = d.select("y", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "t", "pos")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        t, pos, mine = table.column("t").to_pylist(), table.column("pos").to_pylist(), table.column("mine").to_numpy()
        x, y = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a, b = _marks([t[k] for k in x], threshold, True), _marks([t[k] for k in y], threshold, False)
        later, earlier = [], []
        for at in range(0, len(x), 512):
            for u, v in zip(*np.nonzero(a[at : at + 512] @ b.T >= 0)):
                u, v = int(x[at + u]), int(y[v])
                if i == j and u >= v:
                    continue
                if pos[u] < pos[v]:
                    u, v = v, u
                if SequenceMatcher(None, t[u], t[v]).ratio() > threshold:
                    later.append(t[u])
                    earlier.append(t[v])
        return pa.table({"y": pa.array([table.column("y")[0].as_py()] * len(later), pa.string()), "later": pa.array(later, pa.string()), "earlier": pa.array(earlier, pa.string())})

    return d.groupBy("y", "i", "j").applyInArrow(compare, "y string, later string, earlier string")


def fuzzy_groups(refs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """refs with `leader`: in order, a reference joins the first group of its year whose first title is similar enough, else starts one.

    Similar titles are found first, block by block; what depends on order is decided within components of them. Years without a title stand alone.
    """
    ship(refs.sparkSession)
    base = cut(refs.select("cite_key", F.coalesce("year", F.lit("")).alias("y"), "pos", tx.norm_title(F.col("title")).alias("t")), "titles")
    titles = base.where("t <> ''").groupBy("y", "t").agg(F.min("pos").alias("pos"), F.min_by("cite_key", "pos").alias("key"))  # equal ones join what the first did
    titles = cut(titles.withColumn("id", F.xxhash64("y", "t")), "titles")
    near = cut(_similar_titles(titles.select("y", "t", "pos"), threshold).select(F.xxhash64("y", "later").alias("a"), F.xxhash64("y", "earlier").alias("b")), "similar")
    comp = cut(components(near), "near")
    mates = near.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("before"))
    parts = titles.select("id", "pos").join(comp.select(F.col("node").alias("id"), "root").hint("merge"), "id").join(mates.hint("merge"), "id", "left")

    def fold(table: pa.Table) -> pa.Table:
        led, out = {}, []
        for _, one, before in sorted(zip(table.column("pos").to_pylist(), table.column("id").to_pylist(), table.column("before").to_pylist())):
            hit = min(((led[b], b) for b in before or () if b in led), default=None)  # the first leader
            if hit is None:
                led[one] = _
            out.append((one, hit[1] if hit else one))
        return pa.table({"id": pa.array([x for x, _ in out], pa.int64()), "to": pa.array([x for _, x in out], pa.int64())})

    to = parts.groupBy("root").applyInArrow(fold, "id long, to long").where("id <> to")
    firsts = titles.select("id").join(to.hint("merge"), "id", "left").select("id", F.coalesce("to", "id").alias("to"))
    firsts = firsts.join(titles.select(F.col("id").alias("to"), F.col("key").alias("leader")).hint("merge"), "to").select("id", "leader")
    got = base.withColumn("id", F.when(F.col("t") != "", F.xxhash64("y", "t"))).join(firsts.hint("merge"), "id", "left").select("cite_key", F.coalesce("leader", "cite_key").alias("leader"))
    return refs.join(got.hint("merge"), "cite_key")


def deduplicate_references(refs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(cite_key, title, year, doi, journal, source_files, alternate_keys, pos): references merged by key, then with similar titles of the same year; the first BibTeX key of a group stays, the others become alternate keys."""
    cols = ["title", "year", "doi", "journal"]
    tex = refs.groupBy("cite_key").agg(F.max((F.col("source_format") == "bibtex").cast("int")).alias("tex"))
    one = merge_references(refs).join(tex, "cite_key")
    g = fuzzy_groups(one, threshold)
    order = F.struct(F.col("tex") == 0, F.col("pos"))
    filled = [F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", order)).alias(c) for c in cols]
    m = g.groupBy("leader").agg(F.min_by("cite_key", order).alias("cite_key"), *filled, F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_files")))).alias("source_files"), F.array_sort(F.collect_set("cite_key")).alias("keys"), F.min("pos").alias("pos"))
    return m.select("cite_key", *cols, "source_files", F.array_except("keys", F.array("cite_key")).alias("alternate_keys"), "pos")


def retraction_status(items: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """(doi, status): retracted before concern before corrected, by update types and the watch list's nature; null if neither says anything.

    items: doi, update_types (array). watch: doi, nature, pos; the last row of a doi counts.
    """
    rank = lambda c: F.when(c.rlike("retraction|withdrawal|removal"), 3).when(c.rlike("concern"), 2).when(c.rlike("correction|corrigendum|erratum|addendum|clarification"), 1).otherwise(0)
    d = items.select(tx.norm_doi(F.col("doi")).alias("doi"), F.coalesce(F.array_max(F.transform("update_types", lambda x: rank(F.lower(F.trim(x))))), F.lit(0)).alias("a"))
    if watch is not None:
        w = watch.withColumn("doi", tx.norm_doi(F.col("doi"))).where("doi IS NOT NULL AND doi != 'unavailable'").groupBy("doi").agg(F.max_by("nature", "pos").alias("nature"))
        d = d.join(w, "doi", "left").withColumn("a", F.greatest("a", F.coalesce(rank(F.lower("nature")), F.lit(0))))
    return d.select("doi", F.when(F.col("a") == 3, "retracted").when(F.col("a") == 2, "concern").when(F.col("a") == 1, "corrected").alias("status"))


def verify_dois(refs: DataFrame, snapshot: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """(cite_key, status): retracted, concern or corrected before mismatch (title below 0.70, or another year), else ok; not_found without an entry. snapshot: doi, title, year, update_types."""
    ship(refs.sparkSession)
    s = snapshot.select(tx.norm_doi(F.col("doi")).alias("doi"), F.col("title").alias("st"), F.col("year").cast("string").alias("sy")).withColumn("known", F.lit(True))
    j = refs.withColumn("doi", tx.norm_doi(F.col("doi"))).join(s, "doi", "left").join(retraction_status(snapshot, watch), "doi", "left")
    t = F.lower(F.trim(F.regexp_replace("title", r"[{}\\$]", "")))
    sim = ratio(t, F.lower(F.trim("st")))
    bad = ((F.coalesce(t, F.lit("")) != "") & (F.coalesce("st", F.lit("")) != "") & (sim < 0.70)) | ((F.coalesce("year", F.lit("")) != "") & (F.coalesce("sy", F.lit("")) != "") & (F.col("year") != F.col("sy")))
    return j.select("cite_key", F.when(F.col("known").isNull(), "not_found").when(F.col("status").isNotNull(), F.col("status")).when(bad, "mismatch").otherwise("ok").alias("status"))


def first_match(items: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """items with `found`, the catalog's id by the first of several keys that matches. Of a key's entries, the least id counts."""
    out, got = items, []
    for k in keys:
        c = catalog.where(F.coalesce(F.col(k), F.lit("")) != "").groupBy(F.col(k)).agg(F.min("id").alias(f"__{k}"))
        out = out.join(c, k, "left")
        got.append(F.col(f"__{k}"))
    return out.withColumn("found", F.coalesce(*got)).drop(*[f"__{k}" for k in keys])


def eviction(catalog: DataFrame, cap: int, size: str = "size", score: str = "score", key: str = "key") -> DataFrame:
    """Rows to evict: by score, largest first, until what is over the cap is freed.

    The running total is over the whole catalog, in one order; only rows whose score is needed are ranked.
    """
    from scholium.operators.numbering import number_rows

    need = catalog.agg(F.greatest(F.coalesce(F.sum(size), F.lit(0)) - cap, F.lit(0)).alias("need"))
    run = number_rows(catalog.withColumn("__neg", -F.col(score)), ["__neg", key], total_of=size, total="freed_before").drop("__neg", "number")
    return run.crossJoin(F.broadcast(need)).where("freed_before < need").drop("need")  # one row


def concentration(authors: DataFrame, paper: str, institution: str) -> DataFrame:
    """(paper, institution, k, total): each paper's most frequent institution, ties to the first by name."""
    c = authors.where(F.col(institution).isNotNull()).groupBy(paper, institution).agg(F.count("*").alias("k"))
    w = Window.partitionBy(paper)
    return c.withColumn("total", F.sum("k").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("k"), institution))).where("rn = 1").drop("rn")


def dedup_stats(deduped: DataFrame, database: str) -> DataFrame:
    """By database: records, kept and dropped ones."""
    return deduped.groupBy(database).agg(F.count("*").alias("records"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("duplicates"))


def by_any_key(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """(cite_key, found): the reference whose own key it is, else the first by name with it as another key; null without any."""
    own = refs.select(F.col("cite_key").alias("k"), F.col("cite_key").alias("ref"), F.lit(0).alias("rank"))
    other = refs.select(F.explode("alternate_keys").alias("k"), F.col("cite_key").alias("ref"), F.lit(1).alias("rank"))
    best = own.unionByName(other).groupBy("k").agg(F.min_by("ref", F.struct("rank", "ref")).alias("found"))
    return cited.join(best.withColumnRenamed("k", "cite_key"), "cite_key", "left")


def related_work(works: DataFrame, known: DataFrame, least_words: int = 20) -> DataFrame:
    """Works that aren't known: by DOI, by the first 80 letters of the title, or with a known cite key of over five letters in the title; those with a short abstract go too.

    Cite keys are looked for as whole words of titles, so that they join.
    """
    doi, title = tx.norm_doi(F.col("doi")), F.nullif(F.substring(F.lower(F.trim(F.col("title"))), 1, 80), F.lit(""))
    w = works.where(F.size(tx.words(F.coalesce("abstract", F.lit("")))) >= least_words).withColumn("__d", doi).withColumn("__t", title)
    w = w.join(known.select(doi.alias("__d")).where("__d IS NOT NULL").distinct(), "__d", "left_anti").join(known.select(title.alias("__t")).where("__t IS NOT NULL").distinct(), "__t", "left_anti")
    keys = known.select(F.lower("cite_key").alias("__k")).where("length(__k) > 5").distinct()
    hit = w.select("__d", "__t", F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z0-9_:.-]+"))).alias("__k")).join(keys, "__k").select("__d", "__t").distinct()
    return w.join(hit, w["__d"].eqNullSafe(hit["__d"]) & w["__t"].eqNullSafe(hit["__t"]), "left_anti").drop("__d", "__t")
