import json

import pytest
from pyspark.sql import functions as F

from quillstack.operators.importing import ANSWER, PDF, Library
from quillstack.streaming import requests


def framed(*texts):
    return b"".join(len(t.encode()).to_bytes(4, "little") + t.encode() for t in texts)


def add(x):
    return json.dumps({"action": "add", "input": x})


def test_equal_requests_add_once(spark, tmp_path, monkeypatch):
    """Three batches, each a new start from the checkpoint; one of them ends before its responses and comes again."""
    incoming, root = tmp_path / "in", f"file://{tmp_path}/out"
    incoming.mkdir()
    there = [("crossref", "10.1000/a", json.dumps({"title": "Alpha", "DOI": "10.1000/a"}))]
    pdfs = spark.createDataFrame([], PDF)
    asked = []

    def answers(inputs):
        asked.append(sorted(r["input"] for r in inputs.collect()))
        return spark.createDataFrame(there, ANSWER), pdfs

    def batch(name, *texts):
        (incoming / name).write_bytes(framed(*texts))
        requests.serve(spark, f"file://{incoming}", root, f"file://{tmp_path}/checkpoint", answers, buckets=2).awaitTermination(300)
        rows = spark.read.parquet(f"{root}/responses/*").filter(F.col("origin").endswith(name)).orderBy("nth").collect()
        return [(r["status"], r["keys"]) for r in rows], [json.loads(r["response"]) for r in rows]

    key = ["unknown-0000-alpha"]
    got, told = batch("1", add("10.1000/a"), '{"action":"ping"}', add("https://doi.org/10.1000/A"), "nonsense", add("10.1000/b"))
    assert got == [("added", key), (None, None), ("repeated", None), (None, None), ("failed", [])]
    assert [t["ok"] for t in told] == [True, True, True, False, False] and "no record" in told[4]["error"]
    # the library's commit is made, the responses are not
    whole = Library.add

    def cut_off(self, *a, **b):
        whole(self, *a, **b)
        raise RuntimeError("cut off")

    there.append(("crossref", "10.1000/b", json.dumps({"title": "Beta", "DOI": "10.1000/b"})))
    monkeypatch.setattr(Library, "add", cut_off)
    with pytest.raises(Exception, match="cut off"):
        batch("2", add("10.1000/A"), add("10.1000/b"))
    monkeypatch.setattr(Library, "add", whole)
    # this start does the second batch again and then the third, which can't know its outcome yet: the library does
    got, _ = batch("3", add("10.1000/b"), add("10.1000/a"))
    assert got == [("skipped", []), ("known", key)]
    got, _ = batch("4", add("10.1000/B"))
    assert got == [("known", ["unknown-0000-beta"])]
    rows = spark.read.parquet(f"{root}/responses/*").filter(F.col("origin").endswith("/2")).orderBy("nth").collect()
    assert [(r["status"], r["keys"]) for r in rows] == [("known", key), ("added", ["unknown-0000-beta"])]
    assert sorted(r["key"] for r in Library(spark, f"{root}/library", 2).works().collect()) == ["unknown-0000-alpha", "unknown-0000-beta"]
    # nothing that was added is asked of the services again
    assert [x for x in asked if x] == [["10.1000/a", "10.1000/b"], ["10.1000/b"], ["10.1000/b"], ["10.1000/b"]]


def test_cut_files_are_answered(spark):
    files = spark.createDataFrame([("a", framed("x", "yé")), ("b", b"\x09\x00\x00\x00hi"), ("c", b"")], "path string, content binary")
    assert sorted(map(tuple, requests.frames(files).collect())) == [("a", 0, "x"), ("a", 1, "yé"), ("b", 0, "")]
