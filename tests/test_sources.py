"""Sinks, rendering, rubrics, queries, and tables that come and go."""

import os

import pytest
from pyspark.sql import functions as F

from scholium import runtime
from scholium.operators import config, extract, summaries
from scholium.sources import bibitem, discovery, sinks


def test_rendering(spark):
    d = spark.createDataFrame([(1, "a", 0.123456), (22, None, None)], "n int, name string, x double")
    assert sinks.text_table(d) == "n   name  x\n--  ----  ------\n1   a     0.1235\n22"
    assert sinks.text_table(d, 1).endswith("...")
    page = sinks.html_page(spark.createDataFrame([("<b>&",)], "x string"), "T<")
    assert "&lt;b&gt;&amp;" in page and "<title>T&lt;</title>" in page
    assert sinks.to_json(d.limit(1)) == '[{"n": 1, "name": "a", "x": 0.123456}]'
    with pytest.raises(ValueError):
        sinks.to_json(d, 1)


def test_record_files_keep_nulls_and_order(spark, tmp_path):
    d = spark.createDataFrame([("10", None), ("9", "ü"), ("x", "y")], "key string, v string")
    path = sinks.write_jsonl(d.repartition(3), str(tmp_path / "r"), key="key")
    lines = [x for f in sorted(os.listdir(path)) if f.endswith(".json") for x in open(f"{path}/{f}", encoding="utf-8").read().splitlines()]
    assert lines == ['{"key":"9","v":"ü"}', '{"key":"10","v":null}', '{"key":"x","v":"y"}']
    sinks.snapshot(d, str(tmp_path), "v1")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.snapshot(d, str(tmp_path), "v1")
    assert sinks.restore(spark, str(tmp_path), "v1").count() == 3


def test_scratch_tables_go(spark):
    with runtime.scratch(spark):
        a, b = runtime.cut(spark.range(3), "a"), runtime.keep(runtime.cut(spark.range(4), "b"))
    there = lambda d: os.path.exists(d._scholium_path.removeprefix("file:").replace("///", "/"))
    assert not there(a) and there(b) and b.count() == 4
    runtime.drop(b)
    assert not there(b)


def test_boolean_queries(spark):
    t = spark.createDataFrame([("the red fox",), ("a blue fox",), ("red and blue",), (None,)], "t string")
    say = lambda q: [r.x for r in t.select(discovery.matches(F.col("t"), q).alias("x")).collect()]
    assert say("fox AND (red OR blue)") == [True, True, False, False]
    assert say('"red fox"[tiab] OR NOT fox') == [True, False, True, True]
    assert say("red NOT fox") == [False, False, True, False]
    for bad in ("fox AND", "(fox", "fox) red", "OR fox"):
        with pytest.raises(ValueError):
            say(bad)
    with pytest.raises(ValueError):
        discovery.boolean_query({})


def test_rubrics_without_parts(spark):
    assert config.rating_scales() == {"agree": ["yes", "no", "unsure"]} == config.rating_scales("dimensions: []")
    assert config.screening_rubric("").rules == {"include": [], "exclude": [], "maybe": []} and config.charting_schema("no table") == []


@pytest.mark.parametrize("body, want", [
    ("C. Roe et al., A title here. Phys. Lett., 5, 6-7 (1999)", {"author": "C. Roe et al.", "title": "A title here", "journal": "Phys. Lett.", "volume": "5", "pages": "6-7", "year": "1999"}),
    ("Roe C. Title. Lancet 2003; 12 : 1–9", {"author": "Roe C", "title": "Title", "journal": "Lancet", "year": "2003", "volume": "12", "pages": "1--9"}),
    ("Nothing to read", {}),
    ("", {}),
    (r"Roe, \emph{Too short} 1980 doi:10.1/a.", {"doi": "10.1/a", "year": "1980"}),
])
def test_items(body, want):
    assert bibitem.parse_item(body) == want


def test_scans_keep_every_paper(spark):
    d = spark.createDataFrame([("a", "p = 0.03 and HR 1.5 (95% CI 1.1-2.0)"), ("b", ""), ("c", None), ("d", "P-value<.001; n = 41, 3.2 (0.4)")], "pmid string, text string")
    assert {r.pmid: r.p_reported for r in extract.pvalues(d).collect()} == {"a": 0.03, "d": 0.001}
    assert [r.pmid for r in extract.effects(d).collect()] == ["a"]
    assert {r.pmid: r.funding_classification for r in extract.papers(d).collect()} == dict.fromkeys("abcd", "none_stated")


def test_overlaps_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice([20, 30, None]), [f"a{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(0, 9))]) for i in range(150)]
    got = {(r.pmid_a, r.pmid_b): (r.n_shared, r.shared) for r in summaries.salami(spark.createDataFrame(rows, "pmid int, cohort_size int, authors array<string>")).collect()}
    want = {(a[0], b[0]): (len(s), sorted(s)) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and len(s := set(a[2]) & set(b[2])) >= 3}
    assert got == want and got
