"""The table battery, calibration, methods and people."""

from pyspark.sql import functions as F

from scholium.operators import battery, methods, people


def test_battery_and_calibration(spark):
    spec = [("s1", (0.0, 63.0, 1.0), [("score", None, [("a", 22, "18.72", "5.00"), ("b", 22, "19.05", "5.10")], 0.5), ("age", None, [("a", 10, "40.1", "80.0")], 0.2), ("bmi", None, [("a", 0, "1", "1")], 0.9)], [("women", "a", 25, 53.2, 1)], [("pain", "0.10", "0.30", "0.05")], [("bp", 10.0, 12.0, 5.0)], [("t", 5.0, 10.0, 25, 0.02)], [("w", 1.0, -1.0, 5, 2.0, 1.0, 5, 0.5)])]
    found = battery.run(spark.createDataFrame(spec, ", ".join(battery.SPEC.split(", ")[:8])))
    got = {(r.check, r.target): r.verdict for r in found.collect()}
    assert got["grim", "score / a"] == "FAIL" and got["grim", "score / b"] == "PASS" and got["grim", "bmi / a"] == "UNDETERMINED"
    assert got["quick_sd", "age / a"] == "FAIL" and got["grim_percentage", "women / a"] == "FAIL"
    assert got["correlation_bound", "pain"] == "FAIL" and got["change_arithmetic", "bp"] == "FAIL"
    assert got["t_paired", "t"] == "PASS" and got["t_independent", "w"] == "FAIL" and got["carlisle", "baseline p-values"] == "PASS"
    expected = [("s1", "must_detect", "grim", None, "score / a", "FAIL"), ("s1", "must_detect", "grim", None, "score", "FLAG"), ("s1", "must_detect", "grim", "score / a", None, "FAIL"), ("s1", "must_pass", "grim", None, "score / b", None), ("s1", "must_pass", "grim", None, "score", None), ("s1", "must_detect", "nothing", None, "x", "FLAG")]
    cal = battery.calibrate(found, spark.createDataFrame(expected, "source string, kind string, check string, target string, target_contains string, min_verdict string"))
    assert sorted((r.kind, r.check, r.target, r.satisfied) for r in cal.collect()) == sorted([("must_detect", "grim", "score / a", True), ("must_detect", "grim", "score", False), ("must_detect", "grim", "score / a", True), ("must_pass", "grim", "score / b", True), ("must_pass", "grim", "score", False), ("must_detect", "nothing", "x", False)])


def test_methods(spark):
    reg = methods.registry(spark)
    d = spark.createDataFrame([(1, "We fit Cox regression, not xk-means."), (2, None), (3, "MCMC; k-means."), (4, "relax, then abc used; the structure")], "id int, text string")
    found = methods.detect(d, reg, "id", "text")
    assert {(r.id, r.method) for r in found.collect()} == {(1, "Cox Regression"), (3, "MCMC"), (3, "Clustering")}
    assert {(r.alias, r.reason) for r in methods.candidates(d.where("id = 4"), reg, "id", "text").collect()} == {("relax", "requires_capitals"), ("abc", "requires_capitals"), ("structure", "requires_capitals")}
    required = spark.createDataFrame([(3, "spatial"), (3, "aggregate")], "id int, resolution string")
    got = {(r.id, r.method): r.priority for r in methods.missing(found, reg, "id", required).collect()}
    assert got[1, "Kaplan-Meier"] == "medium" and got[3, "R-INLA"] == "high" and got[3, "PCA"] == "medium" and (3, "Clustering") not in got
    s = spark.createDataFrame([("none", 0, 0.1, False), ("medium", 0, 0.1, True), ("none", 1, 0.7, False), ("none", 0, 0.4, False), ("none", 0, 0.1, True)], "m string, n int, o double, f boolean")
    assert [r.x for r in s.select(methods.overall_severity(F.col("m"), F.col("n"), F.col("o"), F.col("f")).alias("x")).collect()] == ["low", "medium", "high", "medium", "incomplete"]


def test_people(spark):
    w = spark.createDataFrame([("a", "deep hearts now"), ("a", "deep hearts two"), ("a", "hearts deep x"), ("a", "other"), ("b", "deep hearts")], "author string, title string")
    assert {r.author: r.entrenched for r in people.entrenchment(w, ["deep", "hearts"]).collect()} == {"a": "high", "b": "low"}
    found = spark.createDataFrame([("k", "10.1/A", "x", 0), ("k", "doi:10.1/a", "x", 1), ("k", None, "A title", 2), ("k", None, None, 3), ("z", "10.9/known", "y", 4)], "key string, doi string, title string, pos int")
    known = spark.createDataFrame([("https://doi.org/10.9/KNOWN", "q")], "doi string, title string")
    assert sorted((r.key, r.pos) for r in people.new_references(found, known).collect()) == [("k", 0), ("k_1", 2)]
    refs = spark.createDataFrame([("a", "Deep learning", "2020"), ("b", "Other", "2020")], "cite_key string, title string, year string")
    cand = spark.createDataFrame([("a", 0, "d1", "Deep learnin", "2019"), ("a", 1, "d2", "Deep learning", "2020"), ("b", 0, "d3", "zzz", "1990")], "cite_key string, pos int, doi string, title string, year string")
    assert {r.cite_key: r.doi for r in people.best_match(refs, cand).collect()} == {"a": "d2", "b": None}
    works = spark.createDataFrame([("ALS x", ""), ("y", "als and als"), ("y", "z" * 600 + " als"), (None, None)], "title string, abstract string")
    assert people.relevant(works, ["ALS"]).count() == 2
