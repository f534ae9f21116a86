"""Near-duplicate embeddings by NN-descent (Dong, Moses and Li, 2011).

Each vector keeps a list of its K nearest found so far. A forest of random hyperplanes gives the first lists; then neighbours of a common
neighbour, listed or listing, are compared and improve each other's lists. Pairs in the lists at or above the threshold are links. Where lists are full of links, more may be missing:
a list grows to everything that links reach from it, its component, and further lists are made of each vector's K nearest outside its component, until these hold no link.
Then components are compared whole, in tiles.
Recall is audited against brute force on bounded samples of vectors; below the wanted recall, another forest and round follow, and in the end an error.

Equal vectors are one node throughout. Vectors only meet within a label and a dimension.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm._runs import by_group
from scholium.llm._tables import read
from scholium.llm._vectors import dtype_of, matrix, pack_vectors, unit
from scholium.runtime import components, cut, drop, ship, small_join

log = logging.getLogger(__name__)

THRESHOLD = 0.98
#: Length of neighbour lists; trees of a forest; vectors of a leaf on average; vectors compared at once.
K, TREES, LEAF, CHUNK = 8, 6, 192, 2048
#: Neighbours of one node compared at once; a hub's others come in further lots.
LOCAL = 96
#: Vectors of each sample of the recall audit, and the recall below which another round follows; after ROUNDS of them it's an error.
AUDIT, RECALL, ROUNDS = 512, 0.99, 4
VERIFY_TILE = 1024
SEED = 7


def _leaves(kind: np.dtype, forest: int):
    """(cls, leaf, salt, vec) of each vector in each tree, and its comp if it has one: a leaf is the label, and the signs against the tree's hyperplanes."""

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = unit(matrix(part.column(4).to_pylist(), kind))
                depth, group = part.column(2).to_numpy(), part.column(3).to_numpy()
                for t in range(TREES):
                    if (d, t) not in planes:
                        planes[d, t] = np.random.default_rng([SEED, forest, t, d]).standard_normal((d, 40))
                    bits = (x @ planes[d, t]) > 0
                    code = np.zeros(len(x), np.int64)
                    for j in range(40):
                        code = np.where(j < depth, code * 2 + bits[:, j], code)
                    leaf = (group * np.int64(1000003)) ^ ((code * 64 + t) * np.int64(-7046029254386353131))
                    salt = np.random.default_rng([SEED, forest, t]).integers(1 << 62) ^ (part.column(0).to_numpy() * np.int64(0x1E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(leaf), pa.array(salt), *part.columns[4:]], ["cls", "leaf", "salt", *part.schema.names[4:]])

    return run


def _chunks(batches, keys: list[str], size: int):
    """Tables of at most `size` rows with equal keys, from sorted rows."""
    held, n, last = [], 0, None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        at = 0
        while at < b.num_rows:
            now = tuple(c[at] for c in cols)
            same = np.ones(b.num_rows - at, bool)
            for c, v in zip(cols, now):
                same &= c[at:] == v
            to = at + (int(np.argmin(same)) if not same.all() else b.num_rows - at)
            if held and (now != last or n == size):
                yield pa.Table.from_batches(held)
                held, n = [], 0
            to = min(to, at + size - n)
            held.append(b.slice(at, to - at))
            n += to - at
            last, at = now, to
    if held:
        yield pa.Table.from_batches(held)


_LISTS = "cls long, near binary, sims binary"


def _lists(cls, near, sims) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(near, pa.binary()), pa.array(sims, pa.binary())], ["cls", "near", "sims"])


def _compare(kind: np.dtype, keys: list[str], size: int):
    """For each chunk of rows with equal keys: each member's K nearest in it, above its bound where it has one, and outside its comp where it has one."""

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        for table in _chunks(batches, keys, size):
            if table.num_rows < 2:
                continue
            cls = table.column("cls").to_numpy()
            bound = table.column("bound").to_numpy() if "bound" in table.column_names else None
            if len(np.unique(cls)) < len(cls):
                _, first = np.unique(cls, return_index=True)
                table = table.take(pa.array(first))
                cls, bound = cls[first], bound[first] if bound is not None else None
            x = unit(matrix(table.column("vec").to_pylist(), kind)).astype(np.float32)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            if "comp" in table.column_names:
                comp = table.column("comp").to_numpy()
                s[comp[:, None] == comp[None, :]] = -2
            k = min(K, len(cls) - 1)
            if k < 1:
                continue
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(s, top, 1)
            for i in range(len(cls)):
                ok = best[i] > (bound[i] if bound is not None else -2)
                near = cls[top[i][ok]]
                if len(near):
                    out[0].append(cls[i])
                    out[1].append(near.tobytes())
                    out[2].append(best[i][ok].tobytes())
            if len(out[0]) > 20000:
                yield _lists(*out)
                out = ([], [], [])
        if out[0]:
            yield _lists(*out)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One list of a node's K nearest from several."""
    near = np.frombuffer(b"".join(table.column("near").to_pylist()), np.int64)
    sims = np.frombuffer(b"".join(table.column("sims").to_pylist()), np.float32)
    near, first = np.unique(near, return_index=True)
    sims = sims[first]
    top = np.lexsort((near, -sims))[:K]
    return pa.Table.from_batches([_lists([table.column("cls")[0].as_py()], [near[top].tobytes()], [sims[top].tobytes()])])


def _merged(lists: DataFrame) -> DataFrame:
    return lists.repartition("cls").sortWithinPartitions("cls").mapInArrow(by_group(_merge, ["cls"]), _LISTS)


def _edges(lists: DataFrame, least: float | None) -> DataFrame:
    """(cls, other, bound): bound is the list's least similarity, if the list is full."""

    def run(batches):
        for b in batches:
            a, o, m = [], [], []
            for c, near, sims in zip(*(x.to_pylist() for x in b.columns)):
                near, sims = np.frombuffer(near, np.int64), np.frombuffer(sims, np.float32)
                low = float(sims.min()) if len(sims) >= K else -2.0
                if least is not None:
                    near = near[sims >= least]
                a.append(np.full(len(near), c))
                o.append(near)
                m.append(np.full(len(near), low))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, o, m)], ["cls", "other", "bound"])

    return lists.mapInArrow(run, "cls long, other long, bound double")


def _round(nodes: DataFrame, lists: DataFrame, kind: np.dtype) -> DataFrame:
    """Lists after comparing all neighbours, listed or listing, of each node among themselves."""
    e = _edges(lists, None)
    bounds = e.groupBy("cls").agg(F.first("bound").alias("bound"))
    members = e.select(F.col("cls").alias("center"), F.col("other").alias("cls")).unionByName(e.select(F.col("other").alias("center"), "cls")).distinct()
    members = members.join(nodes.select("cls", "vec", *[c for c in nodes.columns if c == "comp"]).join(bounds, "cls"), "cls")
    near = members.repartition("center").sortWithinPartitions("center", F.xxhash64("cls")).mapInArrow(_compare(kind, ["center"], LOCAL), _LISTS)
    return cut(_merged(lists.unionByName(near)), "lists")


def _verify(kind: np.dtype, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links in a tile in double precision: each node's linked vectors there (w), and links that join all that are linked (a, b)."""
        tile, m = table.column("tile")[0].as_py(), table.column("tiles")[0].as_py()
        cls, mult, half = (table.column(c).to_numpy() for c in ("cls", "mult", "chunk"))
        x = unit(matrix(table.column("vec").to_pylist(), kind))
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        i, j = divmod(tile, m)
        if m > 1:  # pairs inside a chunk are counted in one tile only, the one with the next chunk
            own = ((half == i) & (j == (i + 1) % m)) | ((half == j) & (i == (j + 1) % m)) if m > 2 else np.ones(len(cls), bool)
            link &= (half[:, None] != half[None, :]) | own[:, None]
        w = link @ mult
        some = np.flatnonzero(w > 0)
        alive, a, b = np.ones(len(cls), bool), [], []
        for first in some.tolist():
            if not alive[first]:
                continue
            alive[first] = False
            work = [first]
            while work:
                y = work.pop()
                near = np.flatnonzero(link[y] & alive)
                alive[near] = False
                work += near.tolist()
                a += [cls[y]] * len(near)
                b += cls[near].tolist()
        return pa.table({
            "a": pa.array(cls[some].tolist() + a, pa.int64()),
            "b": pa.array([None] * len(some) + b, pa.int64()),
            "w": pa.array(w[some].tolist() + [None] * len(b), pa.int64()),
        })

    return run


def _first_lists(deep: DataFrame, kind: np.dtype, forest: int) -> DataFrame:
    """Lists from the leaves of one forest, several a node."""
    comp = ", comp long" if "comp" in deep.columns else ""
    near = deep.mapInArrow(_leaves(kind, forest), f"cls long, leaf long, salt long, vec binary{comp}")
    return near.repartition("leaf").sortWithinPartitions("leaf", "salt").mapInArrow(_compare(kind, ["leaf"], CHUNK), _LISTS)


def _components(nodes: DataFrame, deep: DataFrame, lists: DataFrame, kind: np.dtype, forest: int, threshold: float) -> DataFrame:
    """(cls, comp) of all that the lists' links reach. Where a list is full of links, lists of the nearest outside the components follow, until they hold no link."""
    least = threshold - 1e-5  # the lists hold single-precision similarities; the tiles decide in double
    pairs = cut(_edges(lists, least).select(F.col("cls").alias("a"), F.col("other").alias("b")), "pairs")
    more = bool(_edges(lists, None).where(F.col("bound") >= least).head(1))
    while True:
        comp = cut(components(pairs).select(F.col("node").alias("cls"), F.col("root").alias("comp")), "near")
        if not more:
            drop(pairs)
            return comp
        whole = cut(nodes.select("cls", "vec").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "outside")
        first = cut(_merged(_first_lists(deep.join(whole.select("cls", "comp"), "cls").select(*deep.columns, "comp"), kind, forest)), "lists")
        outer = _round(whole, first, kind)
        found = cut(_edges(outer, least).select(F.col("cls").alias("a"), F.col("other").alias("b")), "pairs")
        more = bool(found.head(1))
        for t in (whole, first, outer):
            drop(t)
        if more:  # each component with a link outside joins another one, so that few passes follow
            both = cut(pairs.unionByName(found), "pairs")
            drop(pairs)
            drop(comp)
            pairs = both
        drop(found)
        if not more:
            drop(pairs)
            return comp


def _links(nodes: DataFrame, comp: DataFrame, kind: np.dtype, threshold: float) -> DataFrame:
    """A table of links: (cls, null, w) and (cls, b, null), complete within components."""
    sized = comp.groupBy("comp").agg(F.ceil(F.count("*") / VERIFY_TILE).cast("long").alias("tiles"))
    members = comp.join(sized, "comp").join(nodes.select("cls", "vec", "mult"), "cls").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.when(j != F.col("chunk"), F.least(j, F.col("chunk")) * F.col("tiles") + F.greatest(j, F.col("chunk"))))
    members = members.withColumn("tile", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(others, lambda x: x.isNotNull()))))
    found = members.repartition("comp", "tile").sortWithinPartitions("comp", "tile").mapInArrow(by_group(_verify(kind, threshold), ["comp", "tile"]), "a long, b long, w long")
    return cut(found, "links")


def _audit(nodes: DataFrame, weight: DataFrame, kind: np.dtype, threshold: float) -> float:
    """Mean over vectors with links of found links over all links: the lesser of that of small groups and that of large ones.

    Bounded samples, those with the least hash, are drawn apart from vectors with no link found, with up to K and with more. The first two are the small
    groups, weighted by the numbers of vectors they stand for, so that vectors whose links are all missed count.
    """
    part = nodes.join(weight, "cls", "left").withColumn("part", F.when(F.col("w").isNull(), 0).when(F.col("w") <= K, 1).otherwise(2))
    stand = {r["part"]: r["n"] for r in part.groupBy("part").agg(F.count("*").alias("n")).collect()}
    picked = [part.where(F.col("part") == i).orderBy(F.xxhash64("cls"), "cls").limit(AUDIT).select("cls", "grp", "vec", "part", F.coalesce("w", F.lit(0)).alias("w")).toPandas() for i in sorted(stand)]
    if not picked:
        return 1.0
    picked = pd.concat(picked, ignore_index=True)
    sample = {g: (p["cls"].to_numpy(), unit(matrix([bytes(v) for v in p["vec"]], kind))) for g, p in picked.groupby("grp")}

    def run(batches):
        for b in batches:
            grp, cls, mult = (b.column(k).to_numpy() for k in (0, 1, 3))
            for g in np.unique(grp).tolist():
                if g not in sample:
                    continue
                at = np.flatnonzero(grp == g)
                x = unit(matrix(b.column(2).take(pa.array(at)).to_pylist(), kind))
                who, q = sample[g]
                hit = (q @ x.T >= threshold) & (who[:, None] != cls[at][None, :])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(hit @ mult[at])], ["cls", "n"])

    true = nodes.select("grp", "cls", "vec", "mult").mapInArrow(run, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    true = {r["cls"]: r["n"] for r in true.collect()}
    n = picked["cls"].map(true).fillna(0).to_numpy(np.int64)
    each = picked["part"].map(pd.Series(stand) / picked["part"].value_counts()).to_numpy(np.float64)  # vectors that one stands for
    got = []
    for large in (False, True):
        at = np.flatnonzero(((picked["part"] == 2) == large).to_numpy() & (n > 0))
        if len(at):
            got.append(float(np.average(np.minimum(picked["w"].to_numpy()[at], n[at]) / n[at], weights=each[at])))
    return min(got, default=1.0)


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of df, whose key is an integer.

    Rows link when their labels are equal and not null and the cosine of their vectors in double precision is at least the threshold; equal vectors
    always do. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. n_links counts rows. A component's id is its
    smallest key, kept marks the row whose key that is; of repeated keys, each such row. A null key counts as a row, and is its own component's id
    only if all its keys are null. Empty tables give no rows. Other columns of df are left aside. Without a label column, all rows meet.
    The audited recall is in the attribute `recall` of the result; it is an error if it stays below RECALL.
    """
    ship(df.sparkSession)
    kind = dtype_of(df, vector)
    cols = [F.col(key).cast("long").alias("id"), (F.xxhash64(F.col(label)) if label else F.lit(0).cast("long")).alias("lab"), (F.col(label).isNotNull() if label else F.lit(True)).alias("labelled")]
    rows = pack_vectors(df, vector, cols)
    rows = rows.withColumn("vec", F.when(F.col("labelled"), F.col("vec"))).withColumn("grp", F.xxhash64("lab", "dim")).withColumn("cls", F.when(F.col("vec").isNotNull(), F.xxhash64("grp", "vec")))
    rows = cut(rows.select("id", "grp", "cls", "dim", "vec"), "vectors")
    nodes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("mult"), F.min("id").alias("first"), F.first("grp").alias("grp"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    nodes = cut(nodes, "nodes")
    depth = nodes.groupBy("grp").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / LEAF))).cast("int").alias("depth"))
    deep = small_join(nodes, depth, ["grp"]).select("cls", "dim", "depth", "grp", "vec")
    lists = None
    for r in range(ROUNDS):
        near = _first_lists(deep, kind, r)
        first = cut(_merged(near if lists is None else near.unionByName(lists)), "lists")
        nxt = _round(nodes, first, kind)
        drop(first)
        if lists is not None:
            drop(lists)
        lists = nxt
        comp = _components(nodes, deep, lists, kind, r, threshold)
        found = _links(nodes, comp, kind, threshold)
        weight = found.where("w IS NOT NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
        recall = _audit(nodes, weight, kind, threshold)
        log.info("round %d: recall %.4f", r + 1, recall)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} of near duplicates is below {RECALL} after {ROUNDS} rounds")
    linked = components(found.where("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "cls")
    info = nodes.select("cls", "mult", "first").join(weight, "cls", "left").join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = info.groupBy("root").agg(F.min("first").alias("component_id"))
    info = cut(info.join(least, "root").select("cls", (F.col("mult") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id").where("n_links > 0"), "classes")
    out = small_join(rows.where("cls IS NOT NULL").select("id", "cls"), info, ["cls"], "left").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("cls IS NULL").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    out.recall = recall
    return out


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op3_nn_descent": op3_nn_descent}
ORACLES = {
    "op3_nn_descent": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
    p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM p GROUP BY x)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id"""
}
