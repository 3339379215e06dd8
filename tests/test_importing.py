"""Imports: what becomes of inputs, in order, once, and what a killed run leaves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import importing
from quillstack.operators.importing import ANSWER, PDF, Library, first_of_each

FEED = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>On  Bars</title><author><name>Ada Quill</name></author><published>2021-01-02T00:00:00Z</published><summary>Abstract: x</summary></entry></feed>"


def item(title, doi=None, **more):
    return json.dumps({"title": [title], "DOI": doi, "author": [{"family": "Wren", "given": "Bo"}], "issued": {"date-parts": [[2020]]}} | more)


ANSWERS = [
    ("arxiv", "2101.00001", FEED),
    ("arxiv", "2101.00002", "<feed/>"),
    ("crossref", "10.1000/A", item("Alpha", "10.1000/a")),
    ("crossref", "10.1000/b", item("Beta", "10.1000/b")),
    ("crossref", "10.1000/c", item("Gamma words", "10.1000/c")),
    ("crossref", "10.1000/d", item("Gamma other", "10.1000/d")),
    ("crossref", "10.1000/e", "no json"),
    ("pubmed", "12345", item("Delta", "10.1000/delta")),
    ("pubmed", "12346", json.dumps({"author": []})),
    ("pmc", "PMC77", json.dumps({"records": [{"pmcid": "PMC77", "doi": "10.1000/b"}]})),
    ("pmc", "PMC78", json.dumps({"records": []})),
    ("page", "https://pub.example.org/x", '<meta name="citation_doi" content="10.1000/c"><meta name="citation_pdf_url" content="/x.pdf">'),
    ("page", "https://pub.example.org/y", '<meta name="citation_pdf_url" content="files/Some-Report.pdf">'),
    ("page", "https://pub.example.org/z", "<p>nothing</p>"),
]
PDFS = [("2101.00001", "bars text"), ("PMC77", "beta text"), ("https://pub.example.org/x.pdf", "gamma text"), ("https://pub.example.org/files/Some-Report.pdf", "report text"), ("/in/Local Work.pdf", "local text"), ("10.1000/A", "alpha text")]
INPUTS = [
    "2101.00001", "https://doi.org/10.1000/A", "10.1000/a", "nothing at all", "https://pub.example.org/x", "10.1000/d", "https://pubmed.ncbi.nlm.nih.gov/12345/", "pmid: 12346",
    "https://pmc.ncbi.nlm.nih.gov/articles/PMC77/", "https://pmc.ncbi.nlm.nih.gov/articles/PMC78/", "2101.00002", "https://pub.example.org/y", "https://pub.example.org/z", "/in/Local Work.pdf", "10.1000/e", "https://pub.example.org/10.1000/b?x=1",
]
WANT = [
    ("added", "quill-2021-bars", ["2101.00001.pdf"]), ("added", "wren-2020-alpha", ["wren-2020-alpha.pdf"]), ("skipped", None, None), ("failed", None, None), ("added", "wren-2020-gamma", ["wren-2020-gamma.pdf"]),
    ("added", "wren-2020-gamma-2", []), ("added", "wren-2020-delta", []), ("failed", None, None), ("added", "wren-2020-beta", ["PMC77.pdf"]), ("failed", None, None), ("failed", None, None),
    ("added", "unknown-0000-some-report", ["Some-Report.pdf"]), ("failed", None, None), ("added", "unknown-0000-local", ["Local Work.pdf"]), ("failed", None, None), ("skipped", None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(list(enumerate(INPUTS)), "pos long, input string"), spark.createDataFrame(ANSWERS, ANSWER), spark.createDataFrame(PDFS, PDF)


def test_a_run(spark, tmp_path, tables, monkeypatch):
    inputs, answers, pdfs = tables
    held = Library(spark, f"file://{tmp_path}/lib", buckets=2)

    def end(step):
        left = [step]

        def before_write(what):
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("ended")

        return before_write

    # a run that ends between writes leaves nothing, and is done whole when it comes again
    original = held.store.before_write
    for step in (0, 3):
        held.store.before_write = held.index.store.before_write = end(step)
        with pytest.raises(RuntimeError, match="ended"):
            held.add("one", inputs, answers, pdfs)
        assert held.store.latest().number == 0
    held.store.before_write = held.index.store.before_write = original
    got = held.add("one", inputs, answers, pdfs).orderBy("pos").collect()
    works = {r["key"]: r for r in held.works().collect()}
    assert [(r["status"], r["keys"][0] if r["keys"] else None, works[r["keys"][0]]["files"] if r["keys"] else None) for r in got] == WANT
    assert all((r["message"] is None) == (r["status"] == "added") for r in got)
    assert (got[2]["message"], got[15]["message"]) == ("duplicate of wren-2020-alpha (this run)", "duplicate of wren-2020-beta (this run)")
    assert (works["quill-2021-bars"]["title"], works["quill-2021-bars"]["arxiv"], works["unknown-0000-local"]["title"]) == ("On Bars", "2101.00001", "Local Work")
    # the first file's text is found
    for word, key in (("bars", "quill-2021-bars"), ("report", "unknown-0000-some-report"), ("delta", "wren-2020-delta")):
        assert [r["key"] for r in held.index.bm25(word).collect()] == [key]
    version = held.store.latest()
    # the same run again, and its inputs under another name
    assert sorted(map(str, held.add("one", inputs, answers, pdfs).collect())) == sorted(map(str, got))
    assert held.store.latest() == version
    again = held.add("two", inputs, answers, pdfs).collect()
    assert {r["status"] for r in again} == {"skipped", "failed"} and held.works().count() == len(works)
    assert next(r["message"] for r in again if r["pos"] == 2) == "duplicate of wren-2020-alpha (doi)"
    forced = held.add("three", inputs.filter("pos = 1"), answers, pdfs, force=True).collect()
    assert forced[0]["keys"] == ["wren-2020-alpha-2"]
    assert held.index.store.latest().facts["rows"] == len(works) + 1


def test_first_of_each(spark):
    """Against going through the works one by one, with long chains of shared titles and DOIs."""
    r = random.Random(4)
    rows = [(i, r.choice([None, "", *(f"10.1/{k}" for k in range(25))]), r.choice([None, " ", *(f"T{k}" for k in range(25))])) for i in range(120)]
    rows += [(200 + i, f"10.2/{(i + 1) // 2}", f"chain {i // 2}") for i in range(12)]
    rows += [(400, "10.1/X ", "new"), (401, "10.1/x", "other"), (402, None, "OTHER")]
    kept, want = [], {}
    norm = lambda x: (x or "").strip().lower()
    for i, d, t in rows:
        hits = [k for k, kd, kt in kept if (norm(d) and norm(d) == norm(kd)) or (norm(t) and norm(t) == norm(kt))]
        want[i] = min(hits, default=None)
        if not hits:
            kept.append((i, d, t))
    df = spark.createDataFrame(rows, "pos long, doi string, title string").repartition(3)
    assert {x["pos"]: x["match"] for x in first_of_each(df).collect()} == want
    assert first_of_each(df.limit(0)).count() == 0


def test_nothing_comes(spark, tmp_path, tables):
    _, answers, pdfs = tables
    held = Library(spark, f"file://{tmp_path}/lib", buckets=2)
    assert held.works().count() == 0 and held.outcomes().count() == 0
    assert held.add("r", spark.createDataFrame([(0, None)], "pos long, input string"), answers.limit(0), pdfs.limit(0)).select("status").collect() == [("failed",)]
    assert importing.resolve(spark.createDataFrame([], "pos long, input string"), answers, pdfs).filter(F.col("record").isNotNull()).count() == 0


def test_an_answer_is_parsed_once(spark):
    body = '{"title":"T","DOI":"10.1234/a","author":[{"family":"Q","given":"A"}],"issued":{"date-parts":[[2001]]}}'
    inputs = spark.createDataFrame([(1, "10.1234/a"), (2, "10.1234/b"), (3, "10.1234/c"), (4, "10.1234/d")], "pos long, input string")
    said = spark.createDataFrame([("crossref", "10.1234/a", body), ("crossref", "10.1234/b", f"[{body}]"), ("crossref", "10.1234/c", "{no")], importing.ANSWER)
    told = importing.resolve(inputs, said, spark.createDataFrame([], importing.PDF))
    # items and summaries, once each
    assert told._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 4
    got = {r["pos"]: r for r in told.collect()}
    assert got[1]["record"] == got[2]["record"] and (got[1]["record"]["title"], got[1]["record"]["authors"], got[1]["record"]["year"]) == ("T", ["A Q"], 2001)
    assert [got[i]["message"] for i in (3, 4)] == ["no record of 10.1234/c", "no record of 10.1234/d"]
