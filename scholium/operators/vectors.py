"""Vector operators: cosine joins in blocks, centroids, support, alignment and clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from scholium.runtime import cut, ship, small_join

#: Rows and numbers of a block of either side at most; a pair of blocks is one task's unit. Products that are held at once.
BLOCK, NUMBERS, STRIP = 16384, 1 << 21, 1 << 22


def cosine(a: Column, b: Column) -> Column:
    """Of two array columns; norms have 1e-12 added, so that a zero vector gives 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-12) * (F.sqrt(dot(b, b)) + 1e-12))


def _rows(values) -> np.ndarray:
    """A column of arrays of numbers as a matrix, without a Python object a number."""
    a = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = np.asarray(a.flatten().to_numpy(zero_copy_only=False), float)
    width = len(flat) // max(1, len(a))
    if (pc.list_value_length(a).to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(a), width)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt((v * v).sum(1))[:, None] + 1e-12)


def _blocks(d: DataFrame, vector: str) -> int:
    """Blocks of at most BLOCK rows and NUMBERS numbers that a side is cut into."""
    n, width = d.agg(F.count("*"), F.max(F.size(vector))).first()
    return -(-n // max(1, min(BLOCK, NUMBERS // max(1, width or 1)))) or 1


def _nearest(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray, k: int, other_than_itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, sim): each row of q with its k rows of c by rounded cosine, ties to the smaller id. STRIP products at a time."""
    out, step, n = [], max(1, STRIP // max(1, len(c))), len(c)
    part = max(1, n // max(2 * k, 64))  # the k-th largest of maxima of parts is a bound from below of the k-th largest
    edges = np.arange(0, n, part)
    for at in range(0, len(q), step):
        s = q[at : at + step] @ c.T
        if other_than_itself:
            s[qi[at : at + step, None] == ci[None, :]] = -np.inf
        if k == 1:
            least = s.max(1)
        elif len(edges) >= k:
            least = -np.partition(-np.maximum.reduceat(s, edges, axis=1), k - 1, axis=1)[:, k - 1]
        else:
            least = np.full(len(s), -np.inf)
        i, j = np.nonzero(s >= least[:, None] - 2e-12)
        sim = s[i, j]
        ok = np.isfinite(sim)
        i, j, sim = i[ok], j[ok], sim[ok]
        order = np.lexsort((ci[j], -np.round(sim, 12), i))
        i, j, sim = i[order], j[order], sim[order]
        first = np.searchsorted(i, np.arange(len(s)))
        take = np.arange(len(i)) - first[i] < k
        out.append((qi[at : at + step][i[take]], ci[j[take]], sim[take]))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, key: str = "id", vector: str = "vec", other_than_itself: bool = False) -> DataFrame:
    """(query, id, sim, rank from 1): the k corpus rows of largest cosine for each query, ties to the smaller id. Exact.

    Both sides are cut into blocks, and each pair of blocks is multiplied in one place, a strip of products at a time; of it, k rows a query are left, so that only those are ranked at the end.
    """
    ship(queries.sparkSession)
    nq, nc = (_blocks(d, vector) for d in (queries, corpus))
    kind = queries.schema[vector].dataType if queries.schema[vector].dataType == corpus.schema[vector].dataType == ArrayType(FloatType()) else ArrayType(DoubleType())
    side = lambda d, n, m, mine, ask: d.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.pmod(F.xxhash64(F.col(key)), F.lit(n)).alias(mine)).where("v IS NOT NULL").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("ask", F.lit(ask))
    q = side(queries, nq, nc, "mine", True).withColumn("cell", F.col("mine") * nc + F.col("other"))
    c = side(corpus, nc, nq, "mine", False).withColumn("cell", F.col("other") * nc + F.col("mine"))
    both = q.unionByName(c).select("cell", "ask", "id", "v")

    def multiply(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        got = [np.array([], np.int64), np.array([], np.int64), np.array([])]
        if ask.any() and not ask.all():
            v = _unit(_rows(table.column("v")))
            ok = np.isfinite(v).all(1)
            x, y = ask & ok, ~ask & ok
            if x.any() and y.any():
                got = _nearest(v[x], v[y], ids[x], ids[y], k, other_than_itself)
        return pa.table({"query": pa.array(got[0], pa.int64()), "id": pa.array(got[1], pa.int64()), "sim": pa.array(got[2], pa.float64())})

    found = both.groupBy("cell").applyInArrow(multiply, "query long, id long, sim double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("sim", 12)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def support(queries: DataFrame, corpus: DataFrame, weak: float, key: str = "id", vector: str = "vec") -> DataFrame:
    """(id, best, sim, weak): each query's nearest in the corpus; without a corpus, sim is 0 and the query weak."""
    best = top_k(queries, corpus, 1, key, vector).select(F.col("query").alias(key), F.col("id").alias("best"), "sim") if key != "id" else top_k(queries, corpus, 1, key, vector).select(F.col("id").alias("best"), F.col("query").alias("id"), "sim")
    out = queries.select(key).join(best, key, "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return out.withColumn("weak", F.col("sim") < weak)


def novelty(claims: DataFrame, corpus: DataFrame, threshold: float = 0.4) -> DataFrame:
    return support(claims, corpus, threshold).withColumnRenamed("weak", "novel")


def centroid(df: DataFrame, vector: str = "vec", by: list[str] | None = None) -> DataFrame:
    """(by, centroid) the mean of vectors, by component."""
    by = by or []
    parts = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centroid"))


def centroid_distance(df: DataFrame, by: str, vector: str = "vec") -> DataFrame:
    """df with `distance`, 1 minus the cosine to its group's centroid. Groups are few: their centroids are joined by Spark's own choice."""
    return df.join(centroid(df, vector, [by]), by).withColumn("distance", 1 - cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def fit(df: DataFrame, corpus: DataFrame, vector: str = "vec") -> DataFrame:
    """One row: mean, least, largest and population deviation of the rows' cosines to the corpus's centroid, and the cosine of both centroids."""
    c = centroid(corpus, vector)
    own = centroid(df, vector).withColumnRenamed("centroid", "own")
    a = df.crossJoin(F.broadcast(c)).select(cosine(F.col(vector), F.col("centroid")).alias("s"))  # one row
    a = a.agg(F.avg("s").alias("mean_fit"), F.min("s").alias("min_fit"), F.max("s").alias("max_fit"), F.stddev_pop("s").alias("std_fit"))
    return a.crossJoin(own.crossJoin(c).select(cosine(F.col("own"), F.col("centroid")).alias("centroid_fit")))


def continuity(df: DataFrame, doc: str, pos: str, vector: str = "vec") -> DataFrame:
    """df with the cosine to the row before in its document; 0 for the first."""
    prev = F.lag(vector).over(Window.partitionBy(doc).orderBy(pos))
    return df.withColumn("continuity", F.when(prev.isNull(), 0.0).otherwise(cosine(F.col(vector), prev)))


def _best_of_key(contexts: DataFrame, cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """(context, cited, sim): the largest cosine of a context to the chunks of each key it cites, of keys that have any.

    Contexts and chunks meet by key in blocks, many small keys in one cell; of each pair of blocks a context keeps one number a key.
    """
    ship(contexts.sparkSession)
    asked = cites.join(contexts.select(F.col("id").alias("context"), "vec").hint("merge"), "context").select("cited", "context", F.col("vec").cast("array<double>").alias("v"))
    have = chunks.select("id", F.col("cited_key").alias("cited"), F.col("vec").cast("array<double>").alias("v")).where("cited IS NOT NULL AND v IS NOT NULL")
    n, width = have.agg(F.count("*"), F.max(F.size("v"))).first()
    block = max(1, min(BLOCK, NUMBERS // max(1, width or 1)))
    tiles = lambda d, name: d.groupBy("cited").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    size = cut(tiles(have, "nc").join(tiles(cites, "nq"), "cited"), "keys")
    cells = F.pmod(F.xxhash64("cited"), F.lit(max(1, 2 * n // block)))
    side = lambda d, by, mine, other: small_join(d, size, ["cited"]).withColumn("mine", F.pmod(F.xxhash64(by), F.col(mine)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    q = side(asked.where("v IS NOT NULL"), "context", "nq", "nc").select(cells.alias("cell"), F.col("mine").alias("i"), F.col("other").alias("j"), "cited", "context", "v")
    c = side(have, "id", "nc", "nq").select(cells.alias("cell"), F.col("other").alias("i"), F.col("mine").alias("j"), "cited", F.lit(None).cast(cites.schema["context"].dataType).alias("context"), "v")
    both = q.withColumn("ask", F.lit(True)).unionByName(c.withColumn("ask", F.lit(False)))

    def multiply(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False)
        v = _unit(_rows(table.column("v")))
        code = np.asarray(table.column("cited").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False))
        order = np.lexsort((ask, code))
        code, ask, v = code[order], ask[order], v[order]
        begin = np.searchsorted(code, np.arange(code[-1] + 2))
        rows, sims = [], []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            m = a + int(np.searchsorted(ask[a:b], True))  # chunks, then contexts
            if m in (a, b):
                continue
            step = max(1, STRIP // (m - a))
            for at in range(m, b, step):
                s = v[at : min(b, at + step)] @ v[a:m].T
                rows.append(order[at : min(b, at + step)])
                sims.append(np.fmax.reduce(s, axis=1))
        if not rows:
            return table.select(["context", "cited"]).slice(0, 0).append_column("sim", pa.array([], pa.float64()))
        sim = np.concatenate(sims)
        return table.select(["context", "cited"]).take(pa.array(np.concatenate(rows))).append_column("sim", pa.array(sim, mask=~np.isfinite(sim)))

    kinds = ", ".join(f"{c} {cites.schema[c].dataType.simpleString()}" for c in ("context", "cited"))
    return both.groupBy("cell", "i", "j").applyInArrow(multiply, f"{kinds}, sim double").groupBy("context", "cited").agg(F.max("sim").alias("sim"))


def _aligned(contexts: DataFrame, cites: DataFrame, chunks: DataFrame, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The alignment with the k best chunks, and (context, matches) of the `most` best."""
    key = chunks.select("id", F.col("cited_key").alias("__key"))
    near = top_k(contexts, chunks, max(k, most)).join(key.hint("merge"), "id")
    near = cut(near.groupBy(F.col("query").alias("context")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("__key").alias("cited_key"), "sim"))).alias("all")), "nearest")  # max(k, most) a context
    head = near.select("context", F.transform(F.filter("all", lambda m: m["rank"] <= k), lambda m: m["cited_key"]).alias("top"))
    best = cites.join(contexts.select(F.col("id").alias("context")).hint("merge"), "context").distinct()
    best = best.join(_best_of_key(contexts, cites.distinct(), chunks).hint("merge"), ["context", "cited"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    out = best.join(head.hint("merge"), "context", "left").select("context", "cited", "sim", F.coalesce(F.array_contains("top", F.col("cited")), F.lit(False)).alias("in_top"))
    return out, near.select("context", F.filter("all", lambda m: m["rank"] <= most).alias("matches"))


def citation_alignment(contexts: DataFrame, cites: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(context, cited, sim, in_top): the best chunk of each cited key for each context, 0 where the key has none, and whether the key is among the context's k best chunks.

    contexts: id, vec. cites: context, cited. chunks: id, cited_key, vec.
    """
    return _aligned(contexts, cites, chunks, k, k)[0]


def citation_summary(contexts: DataFrame, cites: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(context, best_cited_sim, any_cited_in_top3, matches): each context's best cited similarity, whether a cited key is among its three nearest chunks, and its k nearest chunks' keys with their similarities."""
    a, top = _aligned(contexts, cites, chunks, 3, k)
    best = a.groupBy("context").agg(F.max("sim").alias("best_cited_sim"), F.max("in_top").alias("any_cited_in_top3"))
    none = F.coalesce("best_cited_sim", F.lit(0.0)).alias("best_cited_sim"), F.coalesce("any_cited_in_top3", F.lit(False)).alias("any_cited_in_top3")
    return contexts.select(F.col("id").alias("context")).join(best.hint("merge"), "context", "left").join(top.hint("merge"), "context", "left").select("context", *none, "matches")


def uncited_relevance(contexts: DataFrame, refs: DataFrame, cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """(cited_key, context, sim) of references that no context cites: the context that any of their chunks is nearest to, ties to the smaller. refs: cited_key."""
    lost = refs.select("cited_key").distinct().join(cites.select(F.col("cited").alias("cited_key")).distinct(), "cited_key", "left_anti")
    left = chunks.join(lost, "cited_key", "left_semi")
    best = top_k(left, contexts, 1).select(F.col("query").alias("id"), F.col("id").alias("context"), "sim")
    j = left.select("id", "cited_key").join(best, "id")
    return j.groupBy("cited_key").agg(F.max_by(F.struct("context", "sim"), F.struct(F.round("sim", 12), -F.col("context"))).alias("b")).select("cited_key", "b.context", "b.sim")


def strength_heatmap(paragraphs: DataFrame, corpus: DataFrame, weak: float = 0.3) -> DataFrame:
    """(id, doc, pos, support, best, weak, continuity) of paragraphs (id, doc, pos, vec): how near the corpus they are, and the paragraph before."""
    s = support(paragraphs, corpus, weak).withColumnRenamed("sim", "support")
    return continuity(paragraphs, "doc", "pos").select("id", "doc", "pos", "continuity").join(s, "id")


def travel(old: DataFrame, new: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: the cosines of both versions' centroids to the corpus's, and whether the new one is nearer."""
    c = [centroid(d).withColumnRenamed("centroid", n) for d, n in ((old, "a"), (new, "b"), (corpus, "c"))]
    x = c[0].crossJoin(c[1]).crossJoin(c[2])  # one row each
    x = x.select(cosine(F.col("a"), F.col("c")).alias("old_to_corpus"), cosine(F.col("b"), F.col("c")).alias("new_to_corpus"))
    return x.withColumn("delta", F.col("new_to_corpus") - F.col("old_to_corpus")).withColumn("nearer", F.col("delta") > 0)


def section_diff(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc, old_id, new_id, shift, words_change) of two versions' sections (doc, id, title_vec, vec, words): matched by title within a document above `least`; removed ones shift by 1, added ones have no old_id.

    A document's sections are few, so they meet by document.
    """
    a = old.select("doc", F.col("id").alias("old_id"), F.col("title_vec").alias("at"), F.col("vec").alias("av"), F.col("words").alias("aw"))
    b = new.select("doc", F.col("id").alias("new_id"), F.col("title_vec").alias("bt"), F.col("vec").alias("bv"), F.col("words").alias("bw"))
    j = a.join(b, "doc").withColumn("t", F.round(cosine(F.col("at"), F.col("bt")), 12))
    best = j.groupBy("doc", "old_id").agg(F.max_by(F.struct("new_id", "bv", "bw", "t"), F.struct("t", -F.col("new_id"))).alias("m")).where(F.col("m.t") > least)
    d = a.join(best, ["doc", "old_id"], "left")
    hit = F.col("m").isNotNull()
    out = d.select("doc", "old_id", F.col("m.new_id").alias("new_id"), F.when(hit, 1 - cosine(F.col("av"), F.col("m.bv"))).otherwise(1.0).alias("shift"), (F.coalesce("m.bw", F.lit(0)) - F.col("aw")).alias("words_change"))
    used = out.where("new_id IS NOT NULL").select("doc", "new_id").distinct()
    added = b.join(used, ["doc", "new_id"], "left_anti").select("doc", F.lit(None).cast(old.schema["id"].dataType).alias("old_id"), "new_id", F.lit(None).cast("double").alias("shift"), F.col("bw").alias("words_change"))
    return out.unionByName(added)


def cached(df: DataFrame, embed, text: str, folder: str, key: str = "id") -> DataFrame:
    """df with `vec`, each different text embedded once: those in the folder's table by their checksum are reused, others are embedded and appended. embed takes (digest, text) rows and gives (digest, vec)."""
    spark = df.sparkSession
    d = df.withColumn("__d", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    try:
        have = spark.read.parquet(folder)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = None
    texts = d.groupBy(F.col("__d").alias("digest")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    new = texts if have is None else texts.join(have.select("digest"), "digest", "left_anti")
    embed(new).select("digest", F.col("vec").cast("array<double>").alias("vec")).write.mode("append").parquet(folder)
    return d.join(spark.read.parquet(folder).dropDuplicates(["digest"]).withColumnRenamed("digest", "__d"), "__d").drop("__d")


def hashed_terms(texts: DataFrame, width: int = 256) -> DataFrame:
    """(digest, vec): counts of words and word pairs in `width` places by hash, of unit length: an embedding without a model or a corpus."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 1)
    pairs = F.zip_with(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    d = texts.select("digest", w.alias("w")).select("digest", F.transform(F.concat("w", pairs), lambda x: F.pmod(F.xxhash64(x), F.lit(width)).cast("int")).alias("h"))

    def run(batches):
        for b in batches:
            out = []
            for h in b.column(1).to_pylist():
                v = np.bincount(np.array(h, np.int64), minlength=width).astype(float)
                out.append(v / (np.sqrt(v @ v) + 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["digest", "vec"])

    return d.mapInArrow(run, "digest string, vec array<double>")


def argument_edges(conclusions: DataFrame, premises: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(from_paper, to_paper, conclusion, premise, sim): the best pair of each two different papers above the threshold. Both have id, paper, vec.

    Pairs above the threshold are found block by block, and of two papers a block keeps the best alone.
    """
    j = _best_above(conclusions, premises, threshold)
    best = F.max_by(F.struct("query", "id", "sim"), F.struct(F.round("sim", 12), -F.col("query"), -F.col("id")))
    return j.groupBy("from_paper", "to_paper").agg(best.alias("b")).select("from_paper", "to_paper", F.col("b.query").alias("conclusion"), F.col("b.id").alias("premise"), F.col("b.sim").alias("sim"))


def _best_above(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(from_paper, to_paper, query, id, sim): of each pair of blocks, the best pair above the threshold of each two different papers."""
    ship(a.sparkSession)
    na, nb = (_blocks(d, "vec") for d in (a, b))
    cols = [F.col("id").cast("long").alias("id"), F.col("paper").cast("long").alias("paper"), F.col("vec").cast("array<double>").alias("v")]
    side = lambda d, n, m, cell, ask: d.where("vec IS NOT NULL AND paper IS NOT NULL").select(*cols, F.pmod(F.xxhash64("id"), F.lit(n)).alias("m")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(cell.alias("cell"), F.lit(ask).alias("ask"), "id", "paper", "v")
    x, y = side(a, na, nb, F.col("m") * nb + F.col("o"), True), side(b, nb, na, F.col("o") * nb + F.col("m"), False)

    def run(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False)
        ids, paper = table.column("id").to_numpy(), table.column("paper").to_numpy()

        def best(i, j, s):  # of each two papers
            order = np.lexsort((ids[j], ids[i], -np.round(s, 12), paper[j], paper[i]))
            i, j, s = i[order], j[order], s[order]
            first = np.ones(len(i), bool)
            first[1:] = (paper[i][1:] != paper[i][:-1]) | (paper[j][1:] != paper[j][:-1])
            return i[first], j[first], s[first]

        v = _unit(_rows(table.column("v")))
        x, y = np.flatnonzero(ask), np.flatnonzero(~ask)
        step, held = max(1, STRIP // max(1, len(y))), (np.array([], np.int64), np.array([], np.int64), np.array([]))
        for at in range(0, len(x), step):
            s = v[x[at : at + step]] @ v[y].T
            i, j = np.nonzero(s > threshold)
            i, j, s = x[at + i], y[j], s[i, j]
            other = paper[i] != paper[j]
            held = best(*(np.concatenate(z) for z in zip(held, (i[other], j[other], s[other]))))
        i, j, s = held
        return pa.table({"from_paper": pa.array(paper[i], pa.int64()), "to_paper": pa.array(paper[j], pa.int64()), "query": pa.array(ids[i], pa.int64()), "id": pa.array(ids[j], pa.int64()), "sim": pa.array(s, pa.float64())})

    return x.unionByName(y).groupBy("cell").applyInArrow(run, "from_paper long, to_paper long, query long, id long, sim double")


def abstract_alignment(sections: DataFrame, abstract: list[float] | None = None, margin: float = 0.05) -> DataFrame:
    """sections (doc, name, vec, abstract_vec) with `sim` to the abstract and `under`, below the document's median less the margin."""
    s = sections.withColumn("sim", cosine(F.col("vec"), F.col("abstract_vec")))
    med = s.groupBy("doc").agg(F.percentile("sim", F.lit(0.5)).alias("med"))
    return s.join(med, "doc").withColumn("under", F.col("sim") < F.col("med") - margin).drop("med")


def revision_diff(old: DataFrame, new: DataFrame, match: float = 0.5) -> DataFrame:
    """(id, best, sim, shift, status) of the new version's parts: matched to the nearest old part above `match`, else added; and old parts that no new one is near, removed."""
    fwd = support(new, old, match)
    back = support(old, new, match)
    a = fwd.select("id", "best", "sim", (1 - F.col("sim")).alias("shift"), F.when(F.col("sim") > match, "matched").otherwise("added").alias("status"))
    b = back.where(F.col("sim") <= match).select("id", "best", "sim", (1 - F.col("sim")).alias("shift"), F.lit("removed").alias("status"))
    return a.unionByName(b)


def tfidf(df: DataFrame, key: str, text: str, by: list[str] | None = None) -> DataFrame:
    """(key, term, weight): words and word pairs weighted by ln((1 + n) / (1 + df)) + 1, with rows of unit length. Counts are over all rows, or over those that share `by`; keys are then unique within it and hold it."""
    by = by or []
    names = [f"__by{i}" for i in range(len(by))]
    w = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 1)
    pairs = F.zip_with(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    groups = [F.col(c).alias(n) for c, n in zip(by, names)]
    d = df.select(*groups, F.col(key).alias("key"), w.alias("w"))
    terms = d.select(*names, "key", F.explode(F.concat(F.col("w"), pairs)).alias("term")).groupBy(*names, "key", "term").agg(F.count("*").alias("tf"))
    n = df.select(*groups).groupBy(*names).agg(F.count("*").alias("n"))
    seen = terms.groupBy(*names, "term").agg(F.count("*").alias("df"))
    x = terms.join(seen, [*names, "term"])
    x = x.join(n, names) if names else x.crossJoin(F.broadcast(n))  # one row
    x = x.withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = x.groupBy(*names, "key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(norm, [*names, "key"]).select("key", "term", (F.col("x") / F.col("norm")).alias("weight"))


def kmeans(df: DataFrame, key: str = "id", vector: str = "vec", k: int = 20, seed: int = 42, starts: int = 10) -> DataFrame:
    """(key, cluster_id, distance_to_centroid) by Spark's own k-means on unit vectors: of so many starts, the one with the least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    u = cut(Normalizer(inputCol="raw", outputCol="features").transform(v).select("id", "features"), "unit")
    models = [KMeans(k=k, seed=seed + i, maxIter=30).fit(u) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, center array<double>")
    out = model.transform(u).join(F.broadcast(centers), "prediction")  # k rows
    return out.select(F.col("id").alias(key), F.col("prediction").alias("cluster_id"), (1 - cosine(vector_to_array("features"), F.col("center"))).alias("distance_to_centroid"))


def cluster_heads(assigned: DataFrame, key: str = "id") -> DataFrame:
    """(cluster_id, n_papers, centroid): each cluster's size and the member nearest its centre, ties to the smaller key."""
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n_papers"), F.min_by(key, F.struct(F.round("distance_to_centroid", 12), key)).alias("centroid"))
