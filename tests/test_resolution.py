"""Order-dependent resolution, components, numbering and readers."""

import random

from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import audit, resolve, vectors
from scholium.operators.numbering import number_rows
from scholium.runtime import components
from scholium.sources import readers
from scholium.streaming import state


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_number_rows(spark):
    rows = [(i % 3 if i % 7 else None, i // 4, i % 5) for i in range(200)]
    got = number_rows(spark.createDataFrame(rows, "g int, o int, s int"), ["o"], ["g"], total_of="s").collect()
    assert len(got) == 200
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.number)
        assert [r.number for r in mine] == list(range(len(mine)))
        assert [r.o for r in mine] == sorted(r.o for r in mine)
        total = 0
        for r in mine:
            assert r.total_before == total
            total += r.s


def test_ordered_dedup(spark):
    rows = [(0, "a", None), (1, "a", "x"), (2, None, "x"), (3, "b", "x"), (4, None, None), (5, "b", None)]
    d = spark.createDataFrame(rows, "r long, p string, d string")
    got = {x.r: x.kept for x in resolve.ordered_dedup(d, [F.col("p"), F.col("d")], "r", "r").collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: True}  # a dropped row's key doesn't count


def test_fuzzy_groups(spark):
    rows = [("a", "Deep learning for hearts", "2020", 0), ("b", "Deep learning for heart", "2020", 1), ("c", "Deep learning for hearts", "2021", 2), ("d", None, "2020", 3)]
    got = {r.cite_key: r.leader for r in resolve.fuzzy_groups(spark.createDataFrame(rows, "cite_key string, title string, year string, pos int")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_retraction(spark):
    items = spark.createDataFrame([("10.1/A", ["correction", "retraction"]), ("10.1/b", ["erratum"]), ("10.1/c", []), ("10.1/d", None)], "doi string, update_types array<string>")
    watch = spark.createDataFrame([("10.1/c", "Retraction", 0), ("10.1/c", "Expression of concern", 1)], "doi string, nature string, pos int")
    assert {r.doi: r.status for r in resolve.retraction_status(items, watch).collect()} == {"10.1/a": "retracted", "10.1/b": "corrected", "10.1/c": "concern", "10.1/d": None}


def test_doi_and_titles(spark):
    d = spark.createDataFrame([("HTTPS://doi.org/10.1/X ",), ("doi: 10.1/x",), ("",), (None,)], "d string")
    assert [r.x for r in d.select(tx.norm_doi(F.col("d")).alias("x")).collect()] == ["10.1/x", "10.1/x", None, None]


def test_sampling_excludes_null_safely(spark):
    a = spark.createDataFrame([(0, i, float(i)) for i in range(20)], "cluster_id int, pmid int, distance_to_centroid double")
    ex = spark.createDataFrame([(0,), (None,)], "pmid int")
    got = sorted((r.rank_in_cluster, r.pmid) for r in audit.sample_level(a, "L1", ex).collect())
    assert got == [(j, 1 + int(j * 19 / 5)) for j in range(5)]


def test_top_k_ties_and_empty(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, vec array<double>")
    c = spark.createDataFrame([(9, [2.0, 0.0]), (7, [3.0, 0.0]), (8, [0.0, 1.0])], "id long, vec array<double>")
    got = sorted((r.query, r.rank, r.id) for r in vectors.top_k(q, c, 2).collect())
    assert got == [(1, 1, 7), (1, 2, 9), (2, 1, 7), (2, 2, 8)]
    assert [r.novel for r in vectors.novelty(q.where("id = 1"), c.where("id < 0")).collect()] == [True]


def test_bibtex(spark):
    src = '@article{a1, title = {A {Nested} Title}, year = 2020, doi="10.1/x"}\n@comment{no}\n@misc{b2, eprint={2001.1}, archivePrefix={arXiv}}'
    got = readers.bibtex(spark.createDataFrame([("f.bib", src)], "source_file string, text string")).orderBy("pos").collect()
    assert [(r.cite_key, r.title, r.year, r.doi, r.arxiv_id) for r in got] == [("a1", "A Nested Title", "2020", "10.1/x", ""), ("b2", "", "", "", "2001.1")]


def test_json_and_text_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"pmid": "1", "title": "x", "extra": 3}\n\n{"pmid": "2"}\n')
    got = readers.jsonl(spark, str(tmp_path / "r.jsonl"), readers.MEDLINE).orderBy("pmid").collect()
    assert [(r.pmid, r.title) for r in got] == [("1", "x"), ("2", None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "11.txt").write_text("long enough " * 10)
    (tmp_path / "t" / "12.txt").write_text("short")
    assert [r.pmid for r in readers.texts(spark, str(tmp_path / "t")).collect()] == ["11"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "ok.json").write_text('{"a": 1}')
    (tmp_path / "c" / "bad.json").write_text("{")
    assert {r.file: r.error for r in readers.json_cases(spark, str(tmp_path / "c")).collect()} == {"ok.json": None, "bad.json": "not valid JSON"}


def test_streams_match_batches(spark, tmp_path):
    rows = [(i, f"u{i % 5}", ["success", "cloudflare_challenge", "other"][(i * 7) % 3]) for i in range(60)]
    d = spark.createDataFrame(rows, "i long, user string, outcome string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = state.outcome_stream(s, "user").writeStream.outputMode("update").format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user, r.attempts, r.successes, r.consecutive, r.needs_headed) for r in spark.table("outcomes").collect()}
    want = {(r.user, r.attempts, r.successes, r.consecutive, r.needs_headed) for r in state.outcome_state(d, "user", "i").collect()}
    assert got == want
