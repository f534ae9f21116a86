"""Exact n-gram Jaccard join with count-vector R-trees.

A document is the set of its word shingles. Hashed into groups, a set is a point of group counts, and the overlap of two sets is
at most the sum of their coordinate minima. An R-tree over such points bounds whole nodes by their largest coordinates, and pairs that
survive are verified on the sets.

One tree over a corpus doesn't serve: unrelated sets of one size give nearly the same counts, so its boxes overlap and nothing is pruned
above the leaves. So the root is replaced by coordinates that two similar sets must share. Let d be the most hashes in which two
linked sets may differ, (|A| + |B|)(100 - t) / (100 + t). Hashed into more than d blocks, they agree in all but d
blocks; sorted by a common rule, the first d + 1 blocks of each have one in common. Blocks with most shingles come first, which are the rarest.
Documents that share a block's content meet; small trees over their points prune them; what is left is verified once.

Equal sets are one class throughout, and groups larger than TILE are split into tiles, so that no task depends on the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm._runs import by_group
from scholium.llm._shingles import mix, shingle_sets
from scholium.llm._tables import freeing, read
from scholium.runtime import BROADCAST_ROWS, components, cut, drop, free, ship, small_join

WIDTH, PERCENT = 5, 80
#: Members of a group that one task compares among themselves, or against as many others.
TILE, VERIFY_TILE = 8192, 512
LEAF = 32
STEP = 300
FLUSH = 1 << 20


# --- arithmetic of the threshold: links need overlap * (100 + t) >= t * (a + b)


def max_difference(a, b, t: int = PERCENT):
    return (a + b) * (100 - t) // (100 + t)


def class_of(sets: np.ndarray) -> int:
    """64 bits of a set, whatever its order; equal sets are equal in it, and n of them differ wrongly with a chance of n**2 / 2**65."""
    return int(mix(np.array([mix(sets ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(sets))], np.uint64)).view(np.int64)[0])


def block_keys(sets: list[np.ndarray], t: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(position in sets, key) of the blocks each set meets others by. Sets that can only link with equal ones have none."""
    who, keys = [], []
    sizes = np.array([len(s) for s in sets], np.int64)
    octave = np.zeros(len(sets), np.int64)
    octave[sizes > 0] = np.floor(np.log2(sizes[sizes > 0])).astype(np.int64)
    largest = sizes * 100 // t  # of a set that links
    for below in (0, 1):
        k = octave - below
        top = np.minimum(largest, (1 << np.maximum(k + 1, 0)) - 1) if below else largest
        d = max_difference(sizes, top, t)
        # as the larger of a pair, a set also joins the octave below, if one of its partners lies there
        use = np.flatnonzero((d > 0) & (k >= 0) & ((top * 100 >= sizes * t) if below else True))
        if not len(use):
            continue
        n = sizes[use]
        flat = np.concatenate([sets[i] for i in use])
        doc = np.repeat(np.arange(len(use)), n)
        # more blocks than any difference in the octave; 3/4 of its least size at 80 percent
        most = max_difference((2 << k[use]) * 100 // t, 2 << k[use], t)
        blocks = np.maximum(most + 1, (most * 3 + 1) // 2)
        block = ((flat >> np.uint64(32)) * blocks[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])]))
        count = np.diff(np.append(edge, len(flat)))
        total = np.add.reduceat(mix(flat), edge)
        owner, number = doc[edge], block[edge]
        tag = k[use][owner].astype(np.uint64) << np.uint64(40)
        key = mix(total + mix(tag + number.astype(np.uint64)) * np.uint64(2 * 7 + 1))
        filled = np.bincount(owner, minlength=len(use))
        need = d[use] + 1
        short = np.flatnonzero(filled < need)  # then empty blocks count too, last of all
        first = np.searchsorted(owner, short)
        empty = [np.setdiff1d(np.arange(blocks[j]), number[a : a + filled[j]]) for j, a in zip(short, first)]
        if empty:
            j = np.repeat(short, [len(e) for e in empty])
            e = (k[use][j].astype(np.uint64) << np.uint64(40)) + np.concatenate(empty).astype(np.uint64)
            e = mix(mix(e) * np.uint64(15) + np.uint64(1))
            owner, count, key = np.append(owner, j), np.append(count, np.zeros(len(e), np.int64)), np.append(key, e)
        order = np.lexsort((key, -count, owner))
        owner, key = owner[order], key[order]
        begin = np.searchsorted(owner, np.arange(len(use)))
        rank = np.arange(len(owner)) - begin[owner]
        take = rank < need[owner]
        who.append(use[owner[take]])
        keys.append(key[take])
    return (np.concatenate(who), np.concatenate(keys)) if who else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


# --- points and trees


def groups_for(size: int) -> int:
    """Coordinates of a set of this size: a power of two, with 8 to 16 hashes each, 16 at least."""
    return max(16, 1 << max(0, int(size).bit_length() - 4))


def point(s: np.ndarray) -> np.ndarray:
    g = groups_for(len(s))
    return np.bincount((s >> np.uint64(64 - g.bit_length() + 1)).astype(np.int64), minlength=g).astype(np.int32)


def fold(p: np.ndarray, g: int) -> np.ndarray:
    """The same point with fewer coordinates: neighbours added up."""
    return p if len(p) == g else p.reshape(g, -1).sum(1, dtype=np.int32)


class CountTree:
    """A packed R-tree: points split at medians into leaves of LEAF, and levels of boxes above. Every set has a size and a point."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, t: int = PERCENT):
        self.t = t
        self.order = self._pack(sizes, points, np.arange(len(sizes)))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = []  # from the leaves up: least size, largest size, largest coordinates
        lo, hi, top = self.sizes, self.sizes, self.points
        while len(lo) > LEAF:
            cut_at = np.arange(0, len(lo), LEAF)
            lo, hi, top = np.minimum.reduceat(lo, cut_at), np.maximum.reduceat(hi, cut_at), np.maximum.reduceat(top, cut_at, axis=0)
            self.levels.append((lo, hi, top))

    def _pack(self, sizes, points, idx):
        out, work = [], [idx]
        while work:
            i = work.pop()
            if len(i) <= LEAF:
                out.append(i)
                continue
            spread = points[i].max(0) - points[i].min(0)
            s = sizes[i]
            by = s if s.max() - s.min() > spread.max() else points[i, int(spread.argmax())]
            i = i[np.argsort(by, kind="stable")]
            half = (len(i) // 2 + LEAF - 1) // LEAF * LEAF
            work += [i[half:], i[:half]]
        return np.concatenate(out) if out else idx

    def _may(self, lo, hi, top, size, p):
        ok = (lo * self.t <= size * 100) & (size * self.t <= hi * 100)
        i = np.flatnonzero(ok)
        bound = np.minimum(top[i], p).sum(1)  # of the overlap
        return i[bound * (100 + self.t) >= self.t * (np.maximum(lo[i], -(-size * self.t // 100)) + size)]

    def search(self, size: int, p: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """Members whose bound allows a link with a set of this size and point; with alive, only those of them."""
        i = None
        for lo, hi, top in reversed(self.levels):
            j = np.arange(len(lo)) if i is None else (i[:, None] * LEAF + np.arange(LEAF)).ravel()
            j = j[j < len(lo)]
            i = j[self._may(lo[j], hi[j], top[j], size, p)]
        j = np.arange(len(self.sizes)) if i is None else (i[:, None] * LEAF + np.arange(LEAF)).ravel()
        j = j[j < len(self.sizes)]
        if alive is not None:
            j = j[alive[j]]
        return j[self._may(self.sizes[j], self.sizes[j], self.points[j], size, p)]


def spanning(sizes: np.ndarray, points: list[np.ndarray], t: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs that join all sets whose bounds allow links, directly or by way of others."""
    if len(sizes) < 2:
        return []
    g = min(len(p) for p in points)
    if len(sizes) == 2:
        bound = int(np.minimum(fold(points[0], g), fold(points[1], g)).sum())
        return [(0, 1)] if bound * (100 + t) >= t * int(sizes.sum()) else []
    tree = CountTree(sizes, np.array([fold(p, g) for p in points]), t)
    alive, out, left = np.ones(len(sizes), bool), [], len(sizes)
    for first in range(len(sizes)):
        if not alive[first]:
            continue
        alive[first] = False
        left -= 1
        work = [first]
        while work and left:
            x = work.pop()
            near = tree.search(int(tree.sizes[x]), tree.points[x], alive)
            alive[near] = False
            left -= len(near)
            work += near.tolist()
            out += [(int(tree.order[x]), int(tree.order[y])) for y in near]
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of the incidence matrix of what two sets at least hold."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    doc, number = doc[shared], number[shared]
    if len(number):
        number = np.unique(number, return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)
    width = max(64, (1 << 21) // max(n, 1))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[doc[a:b], number[a:b] - at] = 1
        out += m @ m.T
    out = np.rint(out).astype(np.int64)
    out[np.diag_indices(n)] = [len(s) for s in sets]
    return out


# --- the join


_SETS = "cls long, n long, point binary, hashes binary, mult long"


def _text(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def _sizes(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            sets = shingle_sets(part.column(1).to_pylist(), WIDTH)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], ["doc_id", "n", "cls"])


def _emitter(buckets: int, t: int):
    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            key, cls = (np.concatenate(x) for x in zip(*held))
            at = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            key, cls, at = key[order], cls[order], at[order]
            some, begin = np.unique(at, return_index=True)
            end = np.append(begin[1:], len(at))
            blobs = [key[a:b].tobytes() + cls[a:b].tobytes() for a, b in zip(begin, end)]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in batches:
            for at in range(0, b.num_rows, STEP):
                sets = shingle_sets(b.column(1).slice(at, STEP).to_pylist(), WIDTH)
                cls = np.array([class_of(s) for s in sets], np.int64)
                fresh = []
                for i, c in enumerate(cls.tolist()):  # a class comes from each task once, however many copies it has
                    if c not in seen:
                        seen.add(c)
                        fresh.append(i)
                who, key = block_keys([sets[i] for i in fresh], t)
                held.append((key, cls[np.array(fresh, np.int64)][who]))
                size += len(key)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _meet(batches) -> Iterator[pa.RecordBatch]:
    """From a partition's whole buckets, the classes that share a key: (leader, tile, members), equal groups once. The leader is the least member."""
    keys, classes = [], []
    for b in batches:
        for x in b.column(1).to_pylist():
            n = len(x) // 16
            keys.append(np.frombuffer(x, np.uint64, n))
            classes.append(np.frombuffer(x, np.int64, n, 8 * n))
    if not keys:
        return
    key, cls = np.concatenate(keys), np.concatenate(classes)
    del keys, classes
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    keep = new_key | np.concatenate([[True], cls[1:] != cls[:-1]])
    key, cls = key[keep], cls[keep]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(begin, len(key)))
    cls, count = cls[np.repeat(count > 1, count)], count[count > 1]
    if not len(count):
        return
    begin = np.cumsum(count) - count
    # most keys of two similar documents bring the same two together
    _, first = np.unique(_group_ids(cls, begin, count), return_index=True)
    held, size = [], 0
    for j in first.tolist():
        for tile, part in tiles(cls[begin[j] : begin[j] + count[j]], TILE):
            held.append((part[0], tile, part.tobytes()))
            size += len(part)
            if size >= FLUSH:
                yield _groups(held)
                held, size = [], 0
    if held:
        yield _groups(held)


def _groups(held: list[tuple]) -> pa.RecordBatch:
    leader, tile, blob = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(np.array(leader, np.int64)), pa.array(np.array(tile, np.int64)), pa.array(blob, pa.binary())], ["leader", "tile", "members"])


def _group_ids(cls: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(cls.view(np.uint64)), begin) + count.astype(np.uint64))


def _gather(table: pa.Table) -> pa.Table:
    """One row of a leader's groups in a tile: all different ones in a row (groups, with their sizes), and all different members."""
    blobs = list(dict.fromkeys(table.column("members").to_pylist()))
    every = np.unique(np.frombuffer(b"".join(blobs), np.int64))
    sizes = np.array([len(b) // 8 for b in blobs], np.int32)
    return pa.table({"leader": table.column("leader").slice(0, 1), "tile": table.column("tile").slice(0, 1), "groups": pa.array([b"".join(blobs)], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "members": pa.array([every.tolist()], pa.list_(pa.int64()))})


def tiles(members: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(tile, members) such that any two members are together in a tile of at most twice `size`."""
    n = -(-len(members) // size)
    if n <= 1:
        yield 0, members
        return
    for i in range(n):
        for j in range(i + 1, n):
            yield i * n + j, np.sort(np.concatenate([members[i::n], members[j::n]]))


def _sets_of(batches) -> Iterator[pa.RecordBatch]:
    """The sets of texts that are of the class wanted of them; of texts without a wanted class, any."""
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            sets = shingle_sets(part.column(0).to_pylist(), WIDTH)
            cls = [class_of(s) for s in sets]
            ok = [i for i, (c, w) in enumerate(zip(cls, part.column(1).to_pylist())) if len(sets[i]) and (w is None or w == c)]
            sets = [sets[i] for i in ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cls[i] for i in ok], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s).astype(np.uint16 if len(s) < 65536 else np.int32).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), part.column(2).take(pa.array(ok, pa.int64()))],
                ["cls", "n", "point", "hashes", "mult"],
            )


def _read_point(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, np.uint16 if n < 65536 else np.int32).astype(np.int32)


def _prune(t: int):
    def run(table: pa.Table) -> pa.Table:
        """Edges that join, of each group of a leader, all members whose bounds allow links. Members that earlier groups joined stay joined."""
        head = table.filter(pc.is_valid(table.column("groups")))
        flat, sizes = np.frombuffer(head.column("groups")[0].as_py(), np.int64), np.frombuffer(head.column("sizes")[0].as_py(), np.int32)
        table = table.filter(pc.is_valid(table.column("point")))  # nulls would turn integers into floats
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        point = [_read_point(x, k) for x, k in zip(table.column("point").to_pylist(), n.tolist())]
        where = np.argsort(cls)
        root = np.arange(len(cls))
        a, b = [], []
        for members in sorted(np.split(flat, np.cumsum(sizes)[:-1]), key=len, reverse=True):
            i = where[np.searchsorted(cls[where], members)]
            if len(np.unique(root[i])) == 1:
                continue
            for x, y in spanning(n[i], [point[k] for k in i], t):
                x, y = i[x], i[y]
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    a.append(cls[x])
                    b.append(cls[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verify(t: int):
    def run(table: pa.Table) -> pa.Table:
        """Links in a tile: each class's linked documents there (w), and links that join all that are linked (a, b)."""
        tile, tiles_in = table.column("tile")[0].as_py(), table.column("tiles")[0].as_py()
        once = np.unique(table.column("cls").to_numpy(), return_index=True)[1]
        if len(once) < table.num_rows:
            table = table.take(pa.array(once))
        n, cls, mult = (table.column(c).to_numpy() for c in ("n", "cls", "mult"))
        half = table.column("chunk").to_numpy()
        k = overlaps([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
        link = k * (100 + t) >= t * (n[:, None] + n[None, :])
        link[np.diag_indices(len(n))] = False
        i, j = divmod(tile, tiles_in)
        if tiles_in > 1:  # pairs inside a chunk are counted in the one tile that is theirs
            same = half[:, None] == half[None, :]
            own = (half == i) & (j == (i + 1) % tiles_in) | (half == j) & (i == (j + 1) % tiles_in) if tiles_in > 2 else np.ones(len(n), bool)
            link &= ~same | own[:, None]
        w = link @ mult
        some = np.flatnonzero(w > 0)
        out_a, out_b = [], []
        alive = np.ones(len(n), bool)
        for first in some.tolist():
            if not alive[first]:
                continue
            alive[first] = False
            work = [first]
            while work:
                x = work.pop()
                near = np.flatnonzero(link[x] & alive)
                alive[near] = False
                work += near.tolist()
                out_a += [cls[x]] * len(near)
                out_b += cls[near].tolist()
        a = np.concatenate([cls[some], np.array(out_a, np.int64)])
        return pa.table({
            "a": pa.array(a, pa.int64()),
            "b": pa.array([None] * len(some) + out_b, pa.int64()),
            "w": pa.array(w[some].tolist() + [None] * len(out_b), pa.int64()),
        })

    return run


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, n_similar, component_id) for each row of df, whose key is an integer.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets, equal sets among them. A text without
    words, empty or null, links with nothing and is its own component. Repeated keys are rows of their own; n_similar counts rows. A component's id is its
    smallest key; null keys count as rows, but only name a component if all are null. Empty tables give no rows. Other columns of df are left aside.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the threshold lies from 50 to 100 percent")
    ship(df.sparkSession)
    spark = df.sparkSession
    t = percent
    docs = _text(df, key, text)
    rows = cut(docs.mapInArrow(freeing(_sizes), "doc_id long, n long, cls long"), "sizes")
    classes = rows.where("n > 0").groupBy("cls").agg(F.count("*").alias("mult"), F.min("doc_id").alias("first"))
    buckets = 8 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = docs.mapInArrow(freeing(_emitter(buckets, t)), "bucket int, blob binary").repartition(F.col("bucket")).mapInArrow(freeing(_meet), "leader long, tile long, members binary")
    met = met.repartition("leader", "tile").sortWithinPartitions("leader", "tile").mapInArrow(by_group(_gather, ["leader", "tile"]), "leader long, tile long, groups binary, sizes binary, members array<long>")
    met = cut(met, "met")
    free(spark)
    members = met.select("leader", "tile", F.explode("members").alias("cls"))
    wanted = cut(members.select("cls").distinct().join(classes, "cls").select("cls", "first", "mult"), "wanted")
    # a text is read again for its key and class; keys may repeat, so that a set may come more than once
    n = wanted.count()
    keyed = wanted.where("first IS NOT NULL").select(F.col("first").alias("doc_id"), F.col("cls").alias("want"), "mult")
    have = docs.join(F.broadcast(keyed) if n <= BROADCAST_ROWS else keyed.hint("merge"), "doc_id").select("text", "want", "mult").mapInArrow(freeing(_sets_of), _SETS)
    lost = docs.where("doc_id IS NULL").select("text", F.lit(None).cast("long").alias("want"), F.lit(None).cast("long").alias("mult")).mapInArrow(freeing(_sets_of), _SETS)
    lost = lost.drop("mult").dropDuplicates(["cls"]).join(wanted.where("first IS NULL").select("cls", "mult"), "cls").select("cls", "n", "point", "hashes", "mult")
    sets = cut(have.unionByName(lost), "sets")
    free(spark)
    points = sets.select("cls", "n", "point").dropDuplicates(["cls"])
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("groups", "binary"), ("sizes", "binary"))]
    parts = members.join(points, "cls").select("leader", "tile", "cls", "n", "point", *empty)
    parts = parts.unionByName(met.select("leader", "tile", F.lit(None).cast("long").alias("cls"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("point"), "groups", "sizes"))
    pairs = parts.repartition("leader", "tile").sortWithinPartitions("leader", "tile").mapInArrow(by_group(_prune(t), ["leader", "tile"]), "a long, b long")
    near = components(pairs.distinct())
    comp = cut(near.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "near")
    free(spark)
    sized = comp.groupBy("comp").agg(F.ceil(F.count("*") / VERIFY_TILE).cast("long").alias("tiles"))
    # a row for each class that has a neighbour; the sets stay where they are if these are few
    members = small_join(sets.select("cls", "n", "hashes", "mult"), comp.join(sized, "comp"), ["cls"])
    members = members.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    # chunk i meets chunk j in tile i * tiles + j, for i < j
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.when(j != F.col("chunk"), F.least(j, F.col("chunk")) * F.col("tiles") + F.greatest(j, F.col("chunk"))))
    members = members.withColumn("tile", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(others, lambda x: x.isNotNull()))))
    found = cut(members.repartition("comp", "tile").sortWithinPartitions("comp", "tile").mapInArrow(by_group(_verify(t), ["comp", "tile"]), "a long, b long, w long"), "links")
    free(spark)
    weight = found.where("w IS NOT NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
    linked = components(found.where("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "cls")
    info = classes.join(weight, "cls", "left").join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = info.groupBy("root").agg(F.min("first").alias("component_id"))
    info = info.join(least, "root").select("cls", (F.col("mult") - 1 + F.coalesce("w", F.lit(0))).alias("n_similar"), "component_id").where("n_similar > 0")
    info = cut(info, "classes")
    free(spark)
    out = small_join(rows.where("n > 0"), info, ["cls"], "left").select("doc_id", "n", "n_similar", "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("n_similar"), F.lit(None).cast("long").alias("component_id")))
    drop(met)
    drop(sets)
    drop(comp)
    return out.select(F.col("doc_id").cast(df.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """df's rows without those that `similar` puts in the component of a smaller key. Rows that share a key share its fate; rows with a null key stay."""
    found = similar(df, key, text, percent).where("n_similar > 0 AND component_id IS NOT NULL")
    gone = cut(found.where(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__gone")).distinct(), "gone")
    free(df.sparkSession)
    n = gone.count()
    some = gone.where("__gone IS NOT NULL")
    out = df.join(F.broadcast(some) if n <= BROADCAST_ROWS else some.hint("merge"), F.col(key) == F.col("__gone"), "left_anti")
    return out


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}


def _sql() -> str:
    """All pairs that share a shingle, as text, and what links reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= {WIDTH} THEN list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    t AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM e GROUP BY x)
    SELECT n.doc_id, n.n AS n_shingles, coalesce(k.n, 0) AS n_similar, c.component_id FROM n JOIN c ON c.x = n.doc_id LEFT JOIN k ON k.x = n.doc_id"""


ORACLES = {"op10_jaccard_join": _sql()}
