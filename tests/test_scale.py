"""What must hold whatever the size of the tables."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scholium import runtime


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_uncounted_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    a = runtime.cut(spark.range(60_000).select(F.xxhash64("id").alias("k"), "id"))
    b = runtime.cut(a.select("k", (F.col("id") + 1).alias("other")))  # about a MB, which Spark would broadcast
    assert "BroadcastHashJoin" in plan(a.join(b, "k"))
    with runtime.counted_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan(a.join(b, "k"))
    assert spark.conf.get(name) == was
    small = runtime.small_join(a, b, ["k"], bound=100)
    assert "BroadcastHashJoin" not in plan(small)
    assert small.count() == 60_000


def test_nearest_holds_a_strip_of_products(monkeypatch):
    from scholium.operators import vectors

    rng = np.random.default_rng(1)
    c = vectors._unit(rng.integers(-1, 2, (3000, 4)).astype(float))  # many ties
    q, qi, ci = c[:2000], np.arange(2000), rng.permutation(3000)
    s = np.round(q @ c.T, 12)
    for k in (1, 3):
        want = np.lexsort((np.broadcast_to(ci, s.shape), -s), axis=1)[:, :k]
        monkeypatch.setattr(vectors, "STRIP", 30_000)
        tracemalloc.start()
        a, b, _ = vectors._nearest(q, c, qi, ci, k, False)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (a == np.repeat(qi, k)).all() and (b == ci[want].ravel()).all()
        assert peak < 10e6  # all products would be 48 MB


def test_cited_keys_meet_in_blocks(spark, monkeypatch):
    from scholium.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = lambda n: [(i, i % 3, [float(x) for x in rng.normal(size=5)]) for i in range(n)]
    q, c = rows(200), rows(300)
    contexts = spark.createDataFrame([(i, v) for i, _, v in q], "id long, vec array<double>")
    chunks = spark.createDataFrame([(i, k, v) for i, k, v in c], "id long, cited_key long, vec array<double>")
    cites = spark.createDataFrame([(i, k) for i, g, _ in q for k in (g, 9)], "context long, cited long")
    s = vectors._unit(np.array([v for *_, v in q])) @ vectors._unit(np.array([v for *_, v in c])).T
    keys = np.array([k for _, k, _ in c])
    for r in vectors.citation_alignment(contexts, cites, chunks, 3).collect():
        own = s[r.context, keys == r.cited]
        assert abs(r.sim - (own.max() if len(own) else 0)) < 1e-9
        assert r.in_top == (r.cited in keys[np.argsort(-s[r.context])[:3]])


def test_equal_sds_by_size_and_label(spark):
    from scholium.operators.groupchecks import variance_ratio

    g = spark.createDataFrame([(2.0, 5, 1), (2.0, 9, 2), (2.0, 9, 3), (1.0, 7, 4), (1.0, 6, 6), (1.0, 6, 5), (None, 1, 0)], "sd double, n long, label int")
    r = variance_ratio(g, [], "sd", "n", "label").first()
    assert (r.max_group, r.min_group) == (3, 5)


def test_sample_sizes_all_at_once():
    import time

    from scholium.functions import checks, special

    rng = np.random.default_rng(3)
    t = pd.DataFrame({"t": np.round(rng.uniform(0, 6, 3000), 3), "p": [f"{x:.3f}" for x in rng.uniform(0, 0.3, 3000)], "n": rng.integers(2, 200, 3000)})
    began = time.perf_counter()
    got = pd.DataFrame(checks._sizes_of(t))
    assert time.perf_counter() - began < 15  # test by test it took a second a hundred
    for i in range(0, 3000, 150):
        at = lambda df: special.beta_inc1(df / 2, 0.5, df / (df + t.t[i] ** 2)) if t.t[i] else 1.0  # noqa: E731, B023
        assert abs(got.p_at_n[i] - at(t.n[i] - 1)) < 1e-9
        fit = [d + 1 for d in range(1, 400) if abs(at(d) - float(t.p[i])) <= 0.0005 + 1e-12]
        if fit and fit[-1] < 400:
            assert (got.n_low[i], got.n_high[i]) == (fit[0], fit[-1])


def test_salami_makes_each_pair_once(spark, monkeypatch):
    from scholium.operators import summaries

    monkeypatch.setattr(summaries, "MEMBERS", 4)
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, sorted(rng.choice(list("abcdefg"), int(rng.integers(2, 6)), replace=False).tolist())) for i in range(90)]
    d = summaries.salami(spark.createDataFrame(rows, "pmid long, cohort_size int, authors array<string>"))
    want = sorted((a, b, c, len(set(x) & set(y))) for a, c, x in rows for b, e, y in rows if a < b and c == e and len(set(x) & set(y)) >= 3)
    assert sorted(tuple(r) for r in d.select("pmid_a", "pmid_b", "cohort_size", "n_shared").collect()) == want
    last = d._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "Aggregate" not in last  # pairs aren't shuffled once more


def test_papers_are_read_row_by_row(spark):
    from scholium.operators import reading

    d = spark.createDataFrame([(1, "# Results\nIt may vary.\n# Discussion\nIt proves all.\n")], "k long, t string")
    o = reading.overclaiming(d, "k", reading.split_sections(F.col("t")))
    r = reading.resolution_match(d, "k", F.col("t"), F.col("t"))
    for x in (o, r):
        p = x._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in p and "Aggregate" not in p  # nothing is shuffled or broadcast
    assert o.first().n_escalations == 1


def test_nearest_within_a_long_text():
    from scholium.operators.reading import nearest_within

    rng = np.random.default_rng(5)
    s = [[f"w{x}" for x in rng.integers(0, 40, 6)] for _ in range(120)]
    long, short = nearest_within(s[:20], s[20:]), [nearest_within(s[:20], s[20:60], s[60:]), nearest_within(s[:20], s[60:100], [*s[20:60], *s[100:]]), nearest_within(s[:20], s[100:], s[20:100])]
    for i, (j, v) in enumerate(long):
        parts = [(v2, 0 - (j2 + at)) for at, part in zip((0, 40, 80), short) for j2, v2 in [part[i]] if j2 >= 0]
        best = max(parts, key=lambda x: (round(x[0], 12), x[1]))
        assert abs(best[0] - v) < 1e-9 and -best[1] == j


def test_titles_meet_in_blocks(spark, monkeypatch):
    from difflib import SequenceMatcher

    from scholium.operators import resolve

    monkeypatch.setattr(resolve, "TITLES", 20)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        t = list(f"{'abcdefghij'[i % 10] * 3} effects of {'klmnopqrst'[i % 7]} on things {i % 12} and more")
        for _ in range(int(rng.integers(0, 6))):
            t[int(rng.integers(len(t)))] = "xyz "[int(rng.integers(4))]
        rows.append((f"k{i}", " ".join("".join(t).split()), str(2000 + i % 2), i))
    want, leaders = {}, []
    for k, t, y, _ in rows:
        want[k] = next((a for a, u, z in leaders if z == y and SequenceMatcher(None, t, u).ratio() > 0.85), k)
        if want[k] == k:
            leaders.append((k, t, y))
    got = resolve.fuzzy_groups(spark.createDataFrame(rows, "cite_key string, title string, year string, pos long"))
    assert {r.cite_key: r.leader for r in got.collect()} == want
    assert 2 < len(set(want.values())) < 118
