"""Operators that compare rows: near duplicates, search, set joins, mixing, fixity, and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholium.llm import fixity, mih, mixing, neardup, setjoin
from scholium.llm._shingles import shingle_sets

DIR = "/root/testdata/sf0.01"


def roots(n, pairs, ids):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            par[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        r = find(i)
        if ids[i] is not None:
            least[r] = ids[i] if least.get(r) is None else min(least[r], ids[i])
    return [least.get(find(i)) for i in range(n)]


# --- set join


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def check_join(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, i, "x", 1) for i, (k, t) in enumerate(rows)], "doc_id long, text string, cls int, n string, component_id int")
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    deg = Counter(x for p in pairs for x in p)
    comp = roots(len(rows), pairs, [k for k, _ in rows])
    want = Counter((k, len(sets[i]), deg[i], comp[i]) for i, (k, _) in enumerate(rows))
    assert Counter(tuple(r) for r in setjoin.similar(df, **kw).collect()) == want
    return df


def family(rng, size, n, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_against_brute_force(spark):
    rng = random.Random(4)
    texts = [t for size in (1, 3, 4, 5, 6, 8, 9, 12, 20, 33, 64, 130, 260) for t in family(rng, size, 8, max(1, size // 40))]
    texts += [texts[-1] + " tail" * k for k in (1, 5, 30, 60)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " \n\t "), (None, texts[-1]), (1003, "A b\tC"), (1004, "a B c"), (5, texts[0]), (5, texts[0]), (1005, "long " * 40000)]
    rng.shuffle(rows)
    check_join(spark, rows)
    check_join(spark, [])
    check_join(spark, [(None, "a b c"), (None, "a b c")])


def test_join_is_whole_at_any_tile_size(spark, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(family(rng, 120, 60, 3) + family(rng, 40, 30, 1)))
    rng.shuffle(rows)
    check_join(spark, rows)
    # tiling itself, on the functions that tasks call
    for n in (1, 5, 16, 17, 50):
        met = set()
        for _, part in setjoin.tiles(np.arange(n), 8):
            met |= {(a, b) for a in part.tolist() for b in part.tolist()}
        assert met == {(a, b) for a in range(n) for b in range(n)}


def test_verify_counts_each_pair_once():
    import pyarrow as pa

    rng = random.Random(7)
    base = [rng.randrange(1 << 40) for _ in range(200)]
    sets = []
    for _ in range(30):
        s = set(base)
        for _ in range(rng.randint(0, 16)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(1 << 40))
        sets.append(np.array(sorted(s), np.uint64))
    want = Counter()
    for i in range(30):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                want[i] += 1
                want[j] += 1
    for m in (1, 2, 3, 4):
        chunk = [i % m for i in range(30)]
        got = Counter()
        for a in range(m):
            for b in range(a + 1, m) if m > 1 else [0]:
                who = [i for i in range(30) if chunk[i] in (a, b)]
                t = pa.table({"tile": [a * m + b if m > 1 else 0] * len(who), "tiles": [m] * len(who), "cls": who, "n": [len(sets[i]) for i in who], "mult": [1] * len(who), "chunk": [chunk[i] for i in who], "hashes": [sets[i].tobytes() for i in who]})
                for r in setjoin._verify(80)(t).to_pylist():
                    got[r["a"]] += r["w"] or 0
        assert got == want


def test_tree_loses_nothing():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(60, 300), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(400)]
    g = min(setjoin.groups_for(len(s)) for s in sets)
    pts = np.array([setjoin.fold(setjoin.point(s), g) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = setjoin.CountTree(sizes, pts)
    for i in range(0, 400, 7):
        found = set(tree.order[tree.search(int(sizes[i]), pts[i])].tolist())
        for j in range(400):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (sizes[i] + sizes[j] - o):
                assert j in found


def test_similar_sets_share_a_block():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(4, 90))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 9)), dtype=np.uint64)]))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 80 * (len(a) + len(b) - o) and len(b) and not np.array_equal(a, b):
            who, key = setjoin.block_keys([a, b])
            assert set(key[who == 0].tolist()) & set(key[who == 1].tolist())


def test_lots_of_short_texts_have_all_their_keys():
    rng = np.random.default_rng(12)
    sets = shingle_sets([" ".join(f"w{x}" for x in rng.integers(0, 10**9, 8 + i % 2)).encode() for i in range(300)])
    who, key = setjoin.block_keys(sets)
    for i, s in enumerate(sets):
        assert sorted(key[who == i].tolist()) == sorted(setjoin.block_keys([s])[1].tolist())


def test_join_of_short_texts(spark):
    rng = random.Random(12)
    check_join(spark, [(i, t) for i, t in enumerate(t for k in range(300) for t in family(rng, 8 + k % 3, 2, 1))])


def full_collections(spark):
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    return sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))


def test_join_frees_the_drivers_garbage(spark):
    df = spark.createDataFrame(list(enumerate(family(random.Random(8), 40, 12, 1))), "doc_id long, text string")
    before = full_collections(spark)
    setjoin.similar(df)
    assert full_collections(spark) >= before + 5  # after each table that ends a step


def test_keep_one_frees_the_drivers_garbage(spark):
    df = spark.createDataFrame(list(enumerate(family(random.Random(8), 40, 12, 1))), "doc_id long, text string")
    before = full_collections(spark)
    setjoin.keep_one(df)
    assert full_collections(spark) >= before + 6  # the join's five, and one before the rows are left out


def test_shingles_of_long_words():
    t = ["a" * 5000 + " b c d e f", "x y", None and "", "z"]
    assert [len(s) for s in shingle_sets([(x or "").encode() for x in t])] == [2, 1, 0, 1]


# --- embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls string")


def planted(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            c = rng.standard_normal(dim)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((k, [float(x) for x in c + rng.standard_normal(dim) * 0.05], label, "q"))
                k += 1
    center = rng.standard_normal(dim)
    for _ in range(60):  # a group larger than any neighbour list
        rows.append((k, [float(x) for x in center + rng.standard_normal(dim) * 0.02], 1, "q"))
        k += 1
    rows += [(k, None, 0, "q"), (k + 1, [0.0] * dim, 0, "q"), (k + 2, [float("nan")] * dim, 0, "q"), (k + 3, [1.0, None] + [0.0] * (dim - 2), 0, "q"), (k + 4, [], 0, "q"), (k + 5, rows[0][1], 0, "q"), (None, rows[0][1], 0, "q"), (k + 6, [1.0, 2.0], 0, "q"), (3, rows[9][1], 0, "q"), (k + 7, rows[0][1], 0, "q"), (k + 7, rows[0][1], 0, "q")]
    return rows


def valid(v):
    return v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)


def test_links_against_brute_force(spark):
    rows = planted()
    f32 = [np.array(r[1], np.float32).astype(float) if valid(r[1]) else None for r in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = f32[i], f32[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98 or np.array_equal(a, b):
                    pairs.append((i, j))
    deg = Counter(x for p in pairs for x in p)
    comp = roots(len(rows), pairs, [r[0] for r in rows])
    want = Counter((r[0], deg[i], comp[i], r[0] == comp[i]) for i, r in enumerate(rows))
    got = neardup.link_vectors(vectors(spark, rows))
    assert got.recall >= 0.99
    assert Counter(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert neardup.link_vectors(vectors(spark, [])).count() == 0


def brute_links(rows):
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    link = x @ x.T >= 0.98
    np.fill_diagonal(link, False)
    pairs = [(i, j) for i, j in np.argwhere(link).tolist() if j < i and rows[i][2] == rows[j][2]]
    deg = Counter(a for p in pairs for a in p)
    return {r[0]: (deg[i], c) for i, (r, c) in enumerate(zip(rows, roots(len(rows), pairs, [r[0] for r in rows])))}


def tight_groups(rng, groups, size, dim=64, inside=0.999, across=0.985):
    """Groups of vectors whose cosine is `inside` within each, and `across` between any two of them."""
    q = np.linalg.qr(rng.standard_normal((dim, 1 + groups + groups * size)))[0].T
    out = []
    for g in range(groups):
        for i in range(size):
            v = math.sqrt(across) * q[0] + math.sqrt(inside - across) * q[1 + g] + math.sqrt(1 - inside) * q[1 + groups + g * size + i]
            out.append(v.tolist())
    return out


@pytest.mark.parametrize("groups, size, far", [(2, 9, 0), (4, 12, 400)])
def test_links_across_saturated_lists(spark, groups, size, far):
    rng = np.random.default_rng(21)
    rows = [(i, v, 0, "q") for i, v in enumerate(tight_groups(rng, groups, size) + rng.standard_normal((far, 64)).tolist())]
    want = brute_links(rows)
    assert want[0] == (groups * size - 1, 0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in neardup.link_vectors(vectors(spark, rows)).collect()} == want


def test_audit_sees_missed_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(22)
    big = tight_groups(rng, 1, 60, dim=128)
    pairs = [(c + rng.standard_normal(128) * 0.01).tolist() for c in rng.standard_normal((10, 128)) for _ in range(2)]
    rows = [(i, 1, 7, bytearray(np.array(v, np.float32).tobytes())) for i, v in enumerate(big + pairs)]
    nodes = spark.createDataFrame(rows, "cls long, mult long, grp long, vec binary")
    for found, least, most in ((60, 0.0, 0.0), (80, 1.0, 1.0), (70, 0.4, 0.6)):  # without the links of the last 80 - found
        weight = spark.createDataFrame([(i, 59 if i < 60 else 1) for i in range(found)], "cls long, w long")
        assert least <= neardup._audit(nodes, weight, np.dtype(np.float32), 0.98) <= most
    monkeypatch.setattr(neardup, "_audit", lambda *_: 0.98)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        neardup.link_vectors(vectors(spark, [(0, [1.0, 0.0], 0, "q"), (1, [1.0, 0.1], 0, "q")]))


def test_search_against_brute_force(spark):
    rows = [r for r in planted(2) if r[0] != 3 or r[2] != 0]
    got = mih.search(vectors(spark, rows), F.col("vec_id") % 5 == 0).collect()
    use = sorted({(r[0], tuple(np.array(r[1], np.float32).astype(float))) for r in rows if r[0] is not None and valid(r[1])})
    hit = total = 0
    for k, v in use:
        if k % 5:
            continue
        a = np.array(v)
        true = sorted(((-float(a @ np.array(w) / math.sqrt((a @ a) * (np.array(w) @ np.array(w)))), i) for i, w in use if i != k and len(w) == len(v)))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == k)
        assert [m[0] for m in mine] == list(range(1, len(true) + 1))
        assert all(mine[i][2] >= mine[i + 1][2] for i in range(len(mine) - 1))
        hit += len({m[1] for m in mine} & {i for _, i in true})
        total += len(true)
    assert hit >= 0.95 * total
    few = [(0, [1.0, 0.0], 0, "q"), (1, [1.0, 0.0], 0, "q"), (2, [0.0, 1.0], 0, "q")]
    assert [(r["rank"], r.vec_id) for r in sorted(mih.search(vectors(spark, few), F.col("vec_id") == 0).collect())] == [(1, 1), (2, 2)]
    assert mih.search(vectors(spark, []), F.lit(True)).count() == 0


def test_search_recall_on_embeddings(spark):
    got = mih.op4_multi_index_hashing(spark, DIR).toPandas()
    e = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(e["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    asked = e.index[e["vec_id"] % 50 == 0]
    for i in asked:
        s = x @ x[i]
        s[i] = -2
        true = set(e["vec_id"].to_numpy()[np.argsort(-s)[:5]].tolist())
        hits += len(true & set(got[got["query_id"] == e["vec_id"][i]]["vec_id"]))
    assert hits >= 0.9 * 5 * len(asked)


def test_probing_misses_no_code():
    """All codes within the radius of pigeonholes come, each once, whatever the cells; both ways of probing agree."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24))
    codes = mih.Codes(x, 64)
    q = x[:40] + rng.standard_normal((40, 24)) * 0.3
    cx, cq = codes.encode(x), codes.encode(q)
    dist = mih.hamming(cq, cx)
    for block, radius in ((16384, 0), (16384, 9), (100, 9), (20, 14), (20, 40)):
        plan = mih.Plan(len(x), 64, block)
        plan.radius, plan.short, plan.most = radius, len(x), 64
        got = Counter()
        rows = [[], []]
        for ask, (ids, code) in enumerate(((np.arange(600), cx), (np.arange(40), cq))):
            batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([bytes(c) for c in code], pa.binary())], ["cls", "code"])
            for b in mih._entries(plan, bool(ask))([batch]):
                rows[ask] += b.to_pylist()
        for cell in {r["cell"] for r in rows[1]}:
            here = [(cell, r["cls"], r["code"], None) for r in rows[0] if r["cell"] == cell] + [(cell, r["cls"], r["code"], q[r["cls"]].tobytes()) for r in rows[1] if r["cell"] == cell]
            table = pa.table({n: pa.array(c, k) for n, c, k in zip(("cell", "cls", "code", "vec"), zip(*here), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))})
            got.update((r["ask"], r["cls"]) for r in mih._match(plan, codes, np.dtype(np.float64))(table).to_pylist())
        near = (np.bitwise_count(plan.substrings(cq)[:, None] ^ plan.substrings(cx)[None]) <= plan.near).any(-1)
        assert set(got) == set(zip(*np.nonzero(near))) and max(got.values()) == 1
        assert set(zip(*np.nonzero(dist <= min(radius, plan.m * plan.s)))) <= set(got)
    values = np.unique(rng.integers(0, 1 << 12, 3000))
    query = rng.integers(0, 1 << 12, 50)
    for near in (np.full(50, 1), rng.integers(-1, 3, 50), np.full(50, 9)):
        want = set(zip(*np.nonzero(np.bitwise_count(query[:, None] ^ values[None]) <= near[:, None])))
        assert set(zip(*mih.probe(values, query, near, 12))) == want


def test_search_in_crowded_cells(spark, monkeypatch):
    """A third of all rows are near copies that share cells, cut into tiles; equal vectors and equal codes are many."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    vec = [base + rng.standard_normal(16) * 1e-3 for _ in range(200)] + [base] * 60 + list(rng.standard_normal((400, 16)))
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), i) for i, v in enumerate(vec)], "vec_id long, embedding array<float>, rank int")
    monkeypatch.setattr(mih, "BLOCK", 16)
    got = mih.search(df, F.col("vec_id") % 3 == 0)
    assert got.recall >= 0.9
    rows = got.collect()
    x = np.array([v.astype(np.float32) for v in vec], float)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    hit = 0
    for i in range(0, len(vec), 3):
        s = np.round(u @ u[i], 12)
        s[i] = -2
        mine = {r.vec_id: r.score for r in rows if r.query_id == i}
        assert len(mine) == 5 and all(abs(s[j] - v) < 1e-9 for j, v in mine.items())
        hit += sum(s[j] >= np.sort(s)[-5] - 1e-12 for j in mine)
    assert hit >= 0.9 * 5 * len(range(0, len(vec), 3))


# --- mixing


def corpus(spark, n=400):
    rng = random.Random(10)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 60))), "hot" if i % 3 else rng.choice(["a", "b", "c", None]), 1.0) for i in range(n)]
    rows += [(n, None, "a", 1.0), (n + 1, "", None, 1.0), (5, rows[5][1], rows[5][2], 1.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")


def test_mixture_fills_its_quotas(spark):
    rows, df = corpus(spark)
    count = lambda t: max(1, len((t or "").split()))
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += count(t)
    m = mixing.mix(df, max_repeat=3.0)
    got = m.select("doc_id", "text", "source", "__mix").collect()
    a = m.mixture.exponent
    w = {s: (v / sum(tokens.values())) ** a for s, v in tokens.items()}
    z = sum(w.values())
    longest = max(count(t) for _, t, _, _ in rows)
    for s in tokens:
        took = sum(count(r.text) for r in got if r.source == s)
        quota = max(tokens[s], int(w[s] / z * m.mixture.budget + 1e-6))
        assert quota <= took < quota + 2 * longest
        assert took / tokens[s] <= 3.0 + 2 * longest / tokens[s]
    assert {r.doc_id for r in got} == {r[0] for r in rows}  # none is lost
    assert max(w[s] / z * m.mixture.budget / tokens[s] for s in tokens) == pytest.approx(3.0, abs=0.01)
    for (doc, _, s, _) in rows:  # epochs are whole before the next begins
        mine = sorted(r["__mix"].epoch for r in got if r.doc_id == doc)
        if doc != 5:
            assert mine == list(range(len(mine)))


@pytest.mark.parametrize("budget, repeat", [(None, 3.0), (None, 1.5), (9000, 2.5)])
def test_mixture_against_brute_force(spark, budget, repeat):
    """Exponent, weights, quotas, who is taken how often, and each copy's block, all done again in plain Python from the documents' own hashes."""
    rows, df = corpus(spark)
    got = mixing.mix(df, max_repeat=repeat, budget=budget)
    found = Counter((r.doc_id, r.text, r.source, r["__mix"].epoch, r["__mix"].block, round(r["__mix"].weight, 9), r["__mix"].quota) for r in got.collect())
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    ranks = df.select("doc_id", "text", "source", h.alias("__h")).select("*", *[mixing._rank(F.lit(e)).alias(f"r{e}") for e in range(12)]).collect()
    by = {}
    for r in ranks:
        by.setdefault(r.source, []).append((max(1, len((r.text or "").split())), r))
    tokens = {s: sum(n for n, _ in x) for s, x in by.items()}
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}
    low, high = min(p.values()), max(p.values())
    steps = [i / 200_000 for i in range(200_001)]
    if budget is None:
        a = max(0.0, 1 - math.log(repeat) / math.log(high / low))
    else:
        a = next((x for x in steps if budget / total * low ** (x - 1) / sum(v**x for v in p.values()) <= repeat), 1.0)
    assert abs(got.mixture.exponent - a) < 1e-5
    a, whole = got.mixture.exponent, got.mixture.budget
    z = sum(v**a for v in p.values())
    assert whole == (budget or math.ceil(total * z * max(high ** (1 - a), low ** (1 - a)) - 1e-6))
    blocks, want = max(1, -(-whole // mixing.BLOCK_TOKENS)), Counter()
    for s, docs in by.items():
        w = p[s] ** a / z
        quota = math.floor(w * whole + 1e-6) if budget else max(math.floor(w * whole + 1e-6), tokens[s])
        full, rest = divmod(quota, tokens[s])
        taken = []
        for n, r in sorted(docs, key=lambda x: x[1][f"r{full}"]):
            last = taken and taken[-1][1][f"r{full}"] == r[f"r{full}"]  # equal rows go together
            if not last and sum(x for x, _ in taken) >= rest:
                break
            taken.append((n, r))
        for epoch, part in [(e, docs) for e in range(full)] + ([(full, taken)] if rest else []):
            for _, r in part:
                along = (epoch + r[f"r{epoch}"] / 2.0**62) * tokens[s] / quota
                want[r.doc_id, r.text, r.source, epoch, min(blocks - 1, math.floor(along * blocks)), round(w, 9), quota] += 1
    assert found == want


def test_mixture_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b", "s", "x", "y"), (2, None, None, "z", "w")], "doc_id long, text string, source string, `__s` string, `a.b` string")
    assert sorted((r["__s"], r["a.b"]) for r in mixing.mix(d).drop("__mix").distinct().collect()) == [("x", "y"), ("z", "w")]


def test_mixture_meets_an_entropy(spark):
    _, df = corpus(spark)
    for target in (0.9, 1.2, 1.5):
        m = mixing.mix(df, max_repeat=None, entropy=target)
        w = {r.source: r["__mix"].weight for r in m.select("source", "__mix").collect()}
        assert sum(w.values()) == pytest.approx(1, abs=1e-9)
        assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(target, abs=1e-3)


def test_mixture_with_a_budget_and_order(spark):
    rows, df = corpus(spark)
    m = mixing.mix(df, max_repeat=2.0, budget=3000)
    assert m.mixture.budget == 3000
    total = sum(max(1, len((r.text or "").split())) for r in m.collect())
    assert 3000 - 5 <= total <= 3000 + 5 * 60
    ordered = mixing.in_order(mixing.mix(df, max_repeat=2.0))
    assert ordered.columns == df.columns
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


def test_many_sources_use_the_other_way(spark, monkeypatch):
    _, df = corpus(spark)
    a = mixing.mix(df, max_repeat=None, entropy=1.2)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    b = mixing.mix(df, max_repeat=None, entropy=1.2)
    assert a.mixture.exponent == pytest.approx(b.mixture.exponent, abs=1e-9)


# --- fixity


def test_audit_locates_damage(spark):
    rng = random.Random(12)
    rows = [(i if i % 50 else None, f"body {rng.random()}" if i % 9 else None, i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, body string, file int").where("k IS NOT NULL")
    rec = fixity.warc_record(F.lit("u"), F.col("k"), F.col("body"))
    a = fixity.Tree(df, "k", rec, F.col("file"), fanout=4)
    assert fixity.damage(a, fixity.Tree(df, "k", rec, F.col("file"), fanout=4)).count() == 0
    bad = df.withColumn("body", F.when(F.col("k").isin(3, 333, 334), "changed").otherwise(F.col("body"))).where("k < 690 OR k % 2 = 0")
    got = {(r.key, r.status) for r in fixity.damage(a, fixity.Tree(bad, "k", rec, F.col("file"), fanout=4)).collect()}
    lost = {(r[0], "missing") for r in rows if r[0] is not None and r[0] >= 690 and r[0] % 2}
    assert got == {(3, "damaged"), (333, "damaged"), (334, "damaged")} | lost
    assert {(r.key, r.status) for r in fixity.damage(fixity.Tree(bad, "k", rec, F.col("file"), fanout=4), a).collect()} == {(3, "damaged"), (333, "damaged"), (334, "damaged")} | {(k, "extra") for k, _ in lost}
    none = fixity.Tree(df.where("k < 0"), "k", rec, F.col("file"), fanout=4)
    assert fixity.damage(none, none).count() == 0


def replica_damage(a, b):
    """Of lists of (file, key, body): by file and key, records of the two that don't match."""
    out = []
    for g in {x[:2] for x in a} | {x[:2] for x in b}:
        x, y = (Counter(r[2] or "" for r in rows if r[:2] == g) for rows in (a, b))
        left, right = sum((x - y).values()), sum((y - x).values())
        out += [(*g, "damaged")] * min(left, right) + [(*g, "missing" if left > right else "extra")] * abs(left - right)
    return Counter(out)


def test_audit_against_brute_force(spark):
    """Records lost, added and changed anywhere, repeated and null keys, empty, null and long bodies, and columns named like the tree's own."""
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        a = [(i % 2, rng.choice([None, i, i // 3, 5]), rng.choice(["x", "", None, f"body {i}", "long " * 20000])) for i in range(260)]
        b = [(f, k, rng.choice(["changed", t])) if rng.random() < 0.03 else (f, k, t) for f, k, t in a if rng.random() > 0.05]
        b += [(rng.randrange(2), rng.choice([None, 7, 1000 + i]), "new") for i in range(9)]
        trees = []
        for rows in (a, b):
            df = spark.createDataFrame([(*r, "n", "d") for r in rows], "file int, key long, body string, node string, digest string")
            trees.append(fixity.Tree(df, "key", F.coalesce("body", F.lit("")), F.col("file"), fanout=4))
        got = Counter((r.file, r.key, r.status) for r in fixity.damage(*trees).collect())
        assert got == replica_damage(a, b)


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near duplicates", "secrets", "mixture", "packing"]
    from scholium.runtime import cut

    kept = [cut(docs)]
    for _, f in corpus_pipeline.STAGES[:-1]:
        kept.append(cut(f(spark, kept[-1], DIR)))
        assert kept[-1].columns == docs.columns
    _, good, single, clean, mixed = kept
    lab = spark.read.parquet(f"{DIR}/labels.parquet")
    assert docs.join(lab.where("quality = 1"), "doc_id").join(good, "doc_id", "left_anti").count() <= 0.02 * docs.count()
    sets = {r.doc_id: shingles(r.text) for r in good.collect()}
    comp = {r.doc_id: r.component_id for r in setjoin.similar(good).collect()}
    assert {r.doc_id for r in single.collect()} == {k for k in sets if comp[k] == k}
    from scholium.llm import secrets_scan

    assert sum(len(secrets_scan.base_spans(r.text)) for r in clean.collect()) == 0
    assert clean.count() == single.count()
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in clean.collect()}


def test_pipeline_edge_cases(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(1, None, None, None, None, "a", 1.0), (2, "", "en", "s", 0, "b", 2.0), (None, "good words", "en", "s", 3, None, None), (4, "token=abcdef1 é", "en", None, 9, "c", 3.0), (4, "token=abcdef1 é", "en", None, 9, "c", 3.0), (5, "long words " * 30000, "en", "s", 1, "d", 4.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, Score double")
    for d in (odd, odd.where("false"), docs.where("false")):
        for name, f in corpus_pipeline.STAGES:
            got = f(spark, d, DIR)
            assert name == "packing" or got.columns == d.columns
            got.collect()
    assert [r.text for r in corpus_pipeline.without_secrets(spark, odd, DIR).where("doc_id = 4").collect()] == ["<assign> é"] * 2
