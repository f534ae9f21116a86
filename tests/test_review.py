"""LaTeX parsing and review records."""

from pyspark.sql import functions as F

from scholium.operators import review, tex

SRC = r"""\begin{abstract}We show \textbf{a bold claim here}.\end{abstract}
\section{Intro}
Deep nets win \citep{a, b}. Nothing here.
Second line \cite{c} ends the long paragraph now.

\section*{End} one two three four five six seven eight nine ten eleven
\bibliography{refs} \cite{zzz}"""


def test_tex(spark):
    d = spark.createDataFrame([(1, SRC), (2, ""), (3, None)], "k int, t string")
    assert [(r.line, r.text[:5]) for r in tex.paragraphs(d, "k", "t").orderBy("line").collect()] == [(1, "\\begi"), (6, "\\sect")]
    got = {tuple(r.cited_keys): r for r in tex.citation_contexts(d, "k", "t").collect()}
    assert set(got) == {("a", "b"), ("c",)} and "cite" not in got["c",].text
    assert [r.title for r in tex.sections(d, "k", "t").orderBy("pos").collect()] == ["Intro", "End"]
    assert [r.text for r in tex.claims(d, "k", "t").collect()] == ["a bold claim here"]
    assert [r.x for r in d.select(tex.abstract(F.col("t")).alias("x")).collect()][1:] == [None, None]


def test_screening_and_reconciling(spark):
    rec = spark.createDataFrame([("1", "A"), ("2", "B"), ("", "C")], "pmid string, title string")
    s = {r.pmid: r for r in review.screen(rec).collect()}
    assert s["1"].decision == "maybe" and s["1"].warnings == [] and s[""].warnings == ["no pmid"]
    human = spark.createDataFrame([("1", True, True, "n"), ("9", None, None, None)], "record_id string, reviewed boolean, flip boolean, note string")
    o, q = review.reconcile(review.screen(rec), human)
    assert sorted((r.record_id, r.human, r.original) for r in o.collect()) == [("1", "flip", "maybe"), ("9", "agree", None)]
    assert [r.record_id for r in q.collect()] == ["1"]
    audits = spark.createDataFrame([("1", True, 0.2)], "record_id string, flag boolean, confidence double")
    got = review.review_queue(review.screen(rec), rec.where("pmid = '1'"), audits).orderBy(F.desc("flag"), "confidence").collect()
    assert got[0].pmid == "1" and {r.title for r in got[1:]} == {"(no record)"}
    t = spark.createDataFrame([({"a": "x"},), ({"a": "x", "b": "y"},), (None,)], "ratings map<string,string>")
    assert {(r.dimension, r.value, r.n) for r in review.rating_tallies(t).collect()} == {("a", "x", 2), ("b", "y", 1)}
    c = review.missing_fields(spark.createDataFrame([("1", "")], "pmid string, design string"), ["pmid", "design"], ["pmid"])
    assert c.first().problems == ["missing design", "unknown design"]
