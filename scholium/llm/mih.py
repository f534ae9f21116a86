"""Nearest neighbours by multi-index hashing (Norouzi, Punjani and Fleet, 2012) over learned binary codes.

Codes are signs after a learned rotation (iterative quantisation, Gong and Lazebnik, 2011), of as many rotations as the
code has bits for. A code is split into m substrings of about log2(n) bits, so that a substring's buckets hold a code or so each; each substring is an index of its own. By the
pigeonhole principle, a code within radius r of the query's lies within r // m in one of the first r % m + 1 substrings or r // m - 1 in one of the others, so probing
these buckets misses none. What they hold is checked on whole codes, ranked by the query's own projections against them, and the best are ranked on the original vectors.

An index's buckets lie in cells, by the substring's first bits: a cell holds BLOCK codes or so, crowded ones are cut into tiles, and a query goes only to those cells
whose first bits are near enough. No code meets a query outside the probed buckets.

Rotations are learned on a bounded sample. The probing radius, the radius of whole codes and the length of the short list are such that, of a bounded sample of queries compared with
all rows, the wanted share of true nearest passes; the sample's recall is in the result. Queries that found fewer than k are compared with all rows.
"""

from __future__ import annotations

import logging
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.llm._runs import by_group
from scholium.llm._tables import read
from scholium.llm._vectors import dtype_of, matrix, pack_vectors, unit
from scholium.runtime import cut, drop, ship, small_join

log = logging.getLogger(__name__)

BITS = 256
#: Bounds of what is learned from: rows for the rotations, queries for the radii; the share of true neighbours wanted after each of the three steps.
SAMPLE, PROBES, SHARE = 8192, 256, 0.98
#: Codes of a cell on average; queries compared with all rows at once; candidates held at once.
BLOCK, LOT, PAIRS = 16384, 1024, 1 << 20
SEED = 11


class Codes:
    """Rotations for vectors of one dimension."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = 12):
        d = x.shape[1]
        rng = np.random.default_rng(SEED)
        self.mean = x.mean(0)
        y = x - self.mean
        _, vecs = np.linalg.eigh(y.T @ y)
        basis = vecs[:, ::-1][:, : min(d, bits)]
        v, mats = y @ basis, []
        while sum(m.shape[1] for m in mats) < bits:
            r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
                r = u @ w
            mats.append(basis @ r)
        self.rotation = np.concatenate(mats, 1)[:, :bits]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words."""
        return np.packbits(self.project(x) > 0, axis=1).view(np.uint64)


def hamming(queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """All pairs, as a matrix."""
    out = np.zeros((len(queries), len(codes)), np.uint16)
    for w in range(queries.shape[1]):
        out += np.bitwise_count(queries[:, w, None] ^ codes[None, :, w])
    return out


class Plan:
    """How codes are split and probed: m substrings of s bits, the first c of which name a cell; near[i] is substring i's probing radius."""

    def __init__(self, n: int, bits: int = BITS, block: int | None = None):
        self.s = int(min(32, max(8, round(np.log2(max(n, 2))))))
        self.m = bits // self.s
        self.c = int(min(self.s, max(0, np.ceil(np.log2(max(n, 1) / (block or BLOCK))))))
        self.radius, self.most, self.short = 0, bits, 0
        self._powers = 2.0 ** np.arange(self.s)[::-1]

    @property
    def near(self) -> np.ndarray:
        i = np.arange(self.m)
        return np.where(i <= self.radius % self.m, self.radius // self.m, self.radius // self.m - 1)

    def substrings(self, codes: np.ndarray) -> np.ndarray:
        """One row a code: its substrings as integers."""
        bits = np.unpackbits(codes.view(np.uint8), axis=1)[:, : self.m * self.s].reshape(len(codes), self.m, self.s)
        return (bits @ self._powers).astype(np.int64)

    def cells(self, subs: np.ndarray) -> np.ndarray:
        return (np.arange(self.m) << self.c) + (subs >> (self.s - self.c))

    def least_radius(self, d: np.ndarray) -> np.ndarray:
        """For rows of substring distances, the least probing radius that retrieves each: the pigeonhole's r of substring i at distance d is d * m + i."""
        return (d * self.m + np.arange(self.m)).min(-1)


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of so many bits with at most so many ones."""
    return np.array([sum(1 << i for i in x) for k in range(min(bits, most) + 1) for x in combinations(range(bits), k)], np.int64)


def probe(values: np.ndarray, query: np.ndarray, near: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, value) positions of all values, sorted and distinct, within each query's distance: by enumerating what lies near it, or by its distances if the values are fewer."""
    most = int(near.max(initial=-1))
    masks = flips(bits, most) if _choose(bits, most) * 8 < len(values) else None
    if masks is None:
        return np.nonzero(np.bitwise_count(query[:, None] ^ values[None, :]) <= near[:, None])
    want = query[:, None] ^ masks[None, :]
    at = np.minimum(np.searchsorted(values, want), len(values) - 1)
    ok = (values[at] == want) & (np.bitwise_count(masks)[None, :] <= near[:, None])
    q, k = np.nonzero(ok)
    return q, at[q, k]


def _choose(bits: int, most: int) -> int:
    n, total = 1, 0
    for k in range(min(bits, most) + 1):
        total += n
        n = n * (bits - k) // (k + 1)
    return total


def _entries(plan: Plan, ask: bool):
    """(cell, cls, code) of each code in each substring; of queries, in every cell whose first bits are near enough."""
    near = plan.near
    each = sum(_choose(plan.c, int(x)) for x in near) if ask else plan.m
    step = max(1, (1 << 16) // max(1, each))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                cells = plan.cells(plan.substrings(codes))
                if not ask:
                    who, cell = np.repeat(np.arange(len(codes)), plan.m), cells.ravel()
                else:
                    got = [(np.repeat(np.arange(len(codes)), len(f)), (cells[:, i, None] ^ f[None, :]).ravel()) for i in range(plan.m) if near[i] >= 0 for f in [flips(plan.c, int(near[i]))]]
                    who, cell = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *part.take(pa.array(who)).columns], ["cell", *part.schema.names])

    return run


def _crowded(plan: Plan):
    """(cell, n): how many of a task's codes lie in each cell."""

    def run(batches):
        n = np.zeros(plan.m << plan.c, np.int64) if plan.c < 16 else None
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            cell, k = np.unique(plan.cells(plan.substrings(codes)), return_counts=True)
            if n is None:
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(k)], ["cell", "n"])
            else:
                n[cell] += k
        if n is not None and n.any():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], ["cell", "n"])

    return run


def _match(plan: Plan, codes: Codes, kind: np.dtype):
    """(ask, cls, score): of a cell's tile, each query's codes in the probed buckets within the radius of whole codes, as far as they can be on its short list. A code comes from the first substring that retrieves it."""
    near, low = plan.near, plan.s - plan.c

    def run(table: pa.Table) -> pa.Table:
        ask = table.column("vec").is_valid().to_numpy()
        cls = table.column("cls").to_numpy()
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(len(cls), -1)
        qa, xa = np.flatnonzero(ask), np.flatnonzero(~ask)
        out: list[tuple] = []
        if len(qa) and len(xa):
            cell = table.column("cell")[0].as_py()
            sub, prefix = cell >> plan.c, cell & ((1 << plan.c) - 1)
            qs, xs = plan.substrings(code[qa]), plan.substrings(code[xa])
            left = near[sub] - np.bitwise_count((qs[:, sub] >> low) ^ prefix).astype(np.int64)
            order = np.argsort(xs[:, sub], kind="stable")
            xa, xs = xa[order], xs[order]
            values, begin, count = np.unique(xs[:, sub] & ((1 << low) - 1), return_index=True, return_counts=True)
            proj = codes.project(unit(matrix(table.column("vec").take(pa.array(qa)).to_pylist(), kind))).astype(np.float32)
            for at in range(0, len(qa), LOT):
                q, v = probe(values, qs[at : at + LOT, sub] & ((1 << low) - 1), left[at : at + LOT], low)
                q = q + at
                ends = np.cumsum(count[v])
                # some queries' candidates at a time
                cuts = [0, *np.flatnonzero(np.diff(ends // PAIRS) > 0).tolist(), len(q)] if len(q) else [0]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    n = count[v[lo:hi]]
                    i = np.repeat(q[lo:hi], n)
                    x = np.repeat(begin[v[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    h = np.zeros(len(i), np.int64)
                    for w in range(code.shape[1]):
                        h += np.bitwise_count(code[qa[i], w] ^ code[xa[x], w])
                    ok = h <= plan.most
                    i, x = i[ok], x[ok]
                    if sub and len(i):
                        ok = ~(np.bitwise_count(qs[i, :sub] ^ xs[x, :sub]) <= near[None, :sub]).any(1)
                        i, x = i[ok], x[ok]
                    if len(i):
                        out.append((i, x, _projected(proj, i, code[xa], x)))
        if not out:
            return pa.table({"ask": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        i, x, a = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((-a, i))
        i, x, a = i[order], x[order], a[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = np.minimum(np.searchsorted(i, i) + plan.short - 1, np.searchsorted(i, i, side="right") - 1)
        top = (rank < plan.short) | (a == a[last])
        return pa.table({"ask": pa.array(cls[qa[i[top]]]), "cls": pa.array(cls[xa[x[top]]]), "score": pa.array(a[top])})

    return run


def _projected(proj: np.ndarray, i: np.ndarray, code: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sums of query i's projections with the signs of code x: the larger, the nearer."""
    out = np.empty(len(i))
    for at in range(0, len(i), 16384):
        sign = np.unpackbits(code[x[at : at + 16384]].view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        out[at : at + 16384] = (proj[i[at : at + 16384]] * sign).sum(1, dtype=np.float64)
    return np.round(out, 5)


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, each row summed alike wherever it stands."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _reranked(kind: np.dtype):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, x = (matrix(b.column(k).to_pylist(), kind) for k in (1, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(_cosines(q, x))], ["query_id", "vec_id", "score"])

    return run


def _measure(kind: np.dtype, codes: Codes, ids: np.ndarray, q: np.ndarray, code: np.ndarray, k: int):
    """Brute force of a few queries over a task's rows: of each one, the k nearest (q, s, code), and how many of the rows have each projected score (q, bin, n)."""
    proj = codes.project(unit(q)).astype(np.float32)
    scale = np.abs(proj).sum(1)

    def run(batches):
        hist = np.zeros((len(q), BINS + 1), np.int64)
        best, where, held = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), []
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                raw = part.column(2).to_pylist()
                x, c = matrix(part.column(1).to_pylist(), kind), np.frombuffer(b"".join(raw), np.uint64).reshape(part.num_rows, -1)
                s = unit(q) @ unit(x).T
                s[ids[:, None] == part.column(0).to_numpy()[None, :]] = -2
                sign = np.unpackbits(c.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
                bins = _bin((proj @ sign.T) / scale[:, None])
                for i in range(len(q)):
                    hist[i] += np.bincount(bins[i], minlength=BINS + 1)
                best, held = np.concatenate([best, s], 1), held + raw
                top = np.argsort(-best, axis=1, kind="stable")[:, :k]
                code_of = np.concatenate([where, np.broadcast_to(np.arange(len(held) - part.num_rows, len(held)), s.shape)], 1)
                best, where = np.take_along_axis(best, top, 1), np.take_along_axis(code_of, top, 1)
                used, back = np.unique(where, return_inverse=True)
                held, where = [held[u] for u in used], back.reshape(where.shape)
        n = best.size
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), best.shape[1])), pa.array(best.ravel()), pa.array([held[j] for j in where.ravel()], pa.binary()), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64))], _MEASURED)
        i, j = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), -3.0)), pa.nulls(len(i), pa.binary()), pa.array(j), pa.array(hist[i, j])], _MEASURED)

    return run


_MEASURED = ["q", "s", "code", "bin", "n"]
#: Bins of projected scores from -1 to 1, the best first.
BINS = 4096


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(((1 - score) / 2 * BINS).astype(np.int64), 0, BINS)


def search(df: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = 5, share: float = SHARE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k rows of largest cosine found for each row of df where the condition `queries` holds.

    Candidates are all rows with another key than the query's; with fewer than k, all are returned. Ties go to the smaller key. score is the cosine in double precision
    of the original vectors. Vectors null, empty, zero or with null or non-finite components take no part, nor do null keys; vectors of several
    dimensions only meet their own. Rows repeated in key and vector count once. Empty tables give no rows. Other columns of df are left aside.
    The recall on the sampled queries is in the attribute `recall` of the result, the least of all dimensions'.
    """
    ship(df.sparkSession)
    kind = dtype_of(df, vector)
    rows = pack_vectors(df.where(F.col(key).isNotNull()), vector, [F.col(key).cast("long").alias("id"), queries.alias("ask")]).where("vec IS NOT NULL")
    rows = cut(rows.dropDuplicates(["id", "vec"]), "vectors")
    dims = [r["dim"] for r in rows.select("dim").distinct().orderBy("dim").collect()]
    out, recall = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 1.0
    for dim in dims:
        got, r = _one_dimension(rows.where(F.col("dim") == dim).select("id", "ask", "vec"), kind, k, share)
        out, recall = (got if dim == dims[0] else out.unionByName(got)), min(recall, r)
    out.recall = recall
    return out


def _fit(found: DataFrame, asked: DataFrame, kind: np.dtype, codes: Codes, plan: Plan, k: int, share: float) -> float:
    """Sets the plan's radii and short list by a bounded sample of queries against all rows; the sample's recall."""
    probe_rows = asked.orderBy(F.xxhash64("vec", "id"), "id").limit(PROBES).toPandas()
    q = matrix([bytes(v) for v in probe_rows["vec"]], kind)
    c = codes.encode(unit(q))
    measured = cut(found.select("id", "vec", "code").mapInArrow(_measure(kind, codes, probe_rows["id"].to_numpy(), q, c, k), "q long, s double, code binary, bin long, n long"), "measured")
    best = measured.where("s > -2").withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "code"))).where(F.col("rn") <= k).select("q", "code").toPandas()
    hist = np.zeros((len(q), BINS + 1), np.int64)
    for r in measured.where("s = -3").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect():  # sampled queries times bins
        hist[r["q"], r["bin"]] = r["n"]
    drop(measured)
    if not len(best):
        plan.short = k + 2
        return 1.0
    who = best["q"].to_numpy()
    near = np.frombuffer(b"".join(bytes(x) for x in best["code"]), np.uint64).reshape(len(who), -1)
    r = plan.least_radius(np.bitwise_count(plan.substrings(c)[who] ^ plan.substrings(near)).astype(np.int64))
    h = np.zeros(len(who), np.int64)
    for w in range(near.shape[1]):
        h += np.bitwise_count(c[who, w] ^ near[:, w])
    proj = codes.project(unit(q)).astype(np.float32)
    sign = np.unpackbits(near.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    rank = np.cumsum(hist, 1)[who, _bin((proj[who] * sign).sum(1) / np.abs(proj).sum(1)[who])]  # rows at least as near
    at = lambda x: int(np.quantile(x, share, method="higher"))
    plan.radius, plan.most, plan.short = at(r), at(h), max(k + 2, at(rank))
    return float(((r <= plan.radius) & (h <= plan.most) & (rank <= plan.short)).mean())


def _one_dimension(rows: DataFrame, kind: np.dtype, k: int, share: float) -> tuple[DataFrame, float]:
    picked = rows.select("id", "vec").orderBy(F.xxhash64("vec"), "id").limit(SAMPLE).toPandas()
    codes = Codes(unit(matrix([bytes(v) for v in picked["vec"]], kind)))

    def encode(batches):
        for b in batches:
            c = [bytes(r) for r in codes.encode(unit(matrix(b.column(1).to_pylist(), kind)))] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c, pa.binary())], ["id", "vec", "code"])

    # of equal vectors, only the k + 1 smallest keys can be among a query's k nearest
    least = rows.select("id", "vec").withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rn") <= k + 1).drop("rn")
    found = cut(least.mapInArrow(encode, "id long, vec binary, code binary").withColumn("cls", F.xxhash64("code")), "index")
    asked = cut(rows.where("ask").select("id", "vec").mapInArrow(encode, "id long, vec binary, code binary").withColumn("ask", F.xxhash64("vec")), "asked")
    nothing = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nq = asked.count()
    if not nq:
        return nothing, 1.0
    index = found.select("cls", "code").dropDuplicates(["cls"])
    plan = Plan(index.count())
    recall = _fit(found, asked, kind, codes, plan, k, share)
    log.info("%d substrings of %d bits, radius %d, %d on whole codes, short list %d, recall %.4f", plan.m, plan.s, plan.radius, plan.most, plan.short, recall)
    # equal codes are one entry, and so are equal queries
    asks = asked.groupBy("ask").agg(F.min(F.struct("id", "vec", "code")).alias("x")).select(F.col("ask").alias("cls"), "x.code", "x.vec")
    posts = index.mapInArrow(_entries(plan, False), "cell long, cls long, code binary").withColumn("vec", F.lit(None).cast("binary"))
    wants = asks.mapInArrow(_entries(plan, True), "cell long, cls long, code binary, vec binary")
    crowded = cut(index.mapInArrow(_crowded(plan), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("tiles")), "crowded")
    n = crowded.count()
    if n:
        posts = small_join(posts, crowded, ["cell"], "left").withColumn("tile", F.pmod(F.xxhash64("cls"), F.coalesce("tiles", F.lit(1))).cast("int")).drop("tiles")
        wants = small_join(wants, crowded, ["cell"], "left").withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))).drop("tiles")
    else:
        posts, wants = (d.withColumn("tile", F.lit(0)) for d in (posts, wants))
    drop(crowded) if not n else None
    cells = posts.unionByName(wants).repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    pairs = cells.mapInArrow(by_group(_match(plan, codes, kind), ["cell", "tile"]), "ask long, cls long, score double")
    pairs = pairs.withColumn("rk", F.rank().over(Window.partitionBy("ask").orderBy(F.desc("score")))).where(F.col("rk") <= plan.short).select("ask", "cls")
    near = pairs.join(found.select("cls", F.col("id").alias("vec_id"), F.col("vec").alias("x")), "cls").join(asked.select("ask", F.col("id").alias("query_id"), F.col("vec").alias("q")), "ask")
    near = near.where("query_id <> vec_id").select("query_id", "q", "vec_id", "x").mapInArrow(_reranked(kind), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda d: d.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    got = cut(top(near).select("query_id", "rank", "vec_id", "score"), "nearest")
    few = cut(asked.join(got.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "vec"), "few")
    left = few.count()
    if left:  # compared with all rows, so many at a time
        got = got.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        lots = -(-left // LOT)
        for i in range(lots):
            some = few.where(F.pmod(F.xxhash64("id"), F.lit(lots)) == i).toPandas()
            if len(some):
                q = matrix([bytes(v) for v in some["vec"]], kind)
                every = found.select("id", "vec").mapInArrow(_exhaustive(kind, some["id"].to_numpy(), q, k), "query_id long, vec_id long, score double")
                got = got.unionByName(top(every).select("query_id", "rank", "vec_id", "score"))
    return got, recall


def _exhaustive(kind: np.dtype, ids: np.ndarray, q: np.ndarray, k: int):
    """Of a task's rows, each query's k nearest or more."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x, who = matrix(part.column(1).to_pylist(), kind), part.column(0).to_numpy()
                s = unit(q) @ unit(x).T
                s[ids[:, None] == who[None, :]] = -3
                n = min(k, len(who))
                # products of matrices may round apart from sums of rows
                i, j = np.nonzero((s >= np.partition(s, len(who) - n, axis=1)[:, len(who) - n, None] - 1e-9) & (s > -3))
                score = np.concatenate([_cosines(q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(who[j]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op4_multi_index_hashing": op4_multi_index_hashing}
