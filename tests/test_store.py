"""Stores and the indexes kept in them."""

import pytest
from pyspark.sql import functions as F

from quillstack.operators import lexical
from quillstack.operators.lexical_index import LexicalIndex
from quillstack.sources.store import Conflict, Store, bucket_of


class Killed(RuntimeError):
    pass


def killed_after(store, n):
    """The store's writer ends before its n-th write."""
    left = [n]

    def step(what):
        left[0] -= 1
        if left[0] < 0:
            raise Killed(what)

    store.before_write = step


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.latest().number == 0 and store.numbers() == []
    df = spark.range(20).withColumn("bucket", bucket_of(F.col("id"), 4))
    paths = store.write(df, "t")
    first = store.commit(store.latest(), {"t": {b: [[1, p]] for b, p in paths.items()}}, {"t": df.drop("bucket").schema}, {"n": 20})
    assert (first.number, store.latest()) == (1, first)
    assert sorted(r[0] for r in store.read(first, "t").collect()) == list(range(20))
    some = store.read(first, "t", [0, 2])
    assert {f.split("bucket=")[1][0] for f in some.inputFiles()} <= {"0", "2"}
    # one bucket gone, the other folders as they were
    second = store.commit(first, {"t": {"0": []}}, {}, {"n": 1})
    assert second.tables["t"] == {b: v for b, v in first.tables["t"].items() if b != "0"}
    assert sorted(r[0] for r in store.read(first, "t").collect()) == list(range(20))
    with pytest.raises(Conflict):
        store.commit(first, {}, {}, {"n": 99})
    assert store.latest() == second
    store.write(df, "lost")
    assert store.vacuum(keep=1) == 1
    assert store.numbers() == [2]
    assert store.read(second, "t").count() > 0
    assert store.read(second, "t", []).count() == 0


DOCS = [
    ("a", "the art of x-y and X y", "the the cat"),
    ("b", "a x b y", "Élan x_y"),
    ("c", "cat", "art of the of the of the"),
    ("d", "", None),
    ("e", "of", "the art"),
    ("f", "nothing here", "x x x y y x y"),
]
QUERIES = ["the", "x-y", "cat art", '"of-the"', "art of", "élan", "zzz", "x x-y", "of-the-of"]


def scores(df):
    return {r["key"]: round(r["score"], 9) for r in df.collect()}


def same_as_plain(index, docs, queries=("the",)):
    for q in queries:
        assert scores(index.bm25(q)) == scores(lexical.bm25(docs, q, ("title", "body"))), q
    if len(queries) > 1:
        got = sorted(r[0] for r in index.with_all_terms("the art").collect())
        assert got == sorted(r[0] for r in lexical.with_all_terms(docs, "the art", ("title", "body"), "key").collect())


def test_lexical_index_follows_its_works(spark, tmp_path):
    schema = "key string, title string, body string"
    docs = spark.createDataFrame(DOCS, schema)
    index = LexicalIndex(spark, f"file://{tmp_path}/i", ("title", "body"), buckets=8)
    with pytest.raises(ValueError, match="not built"):
        index.bm25("x")
    built = index.build(docs)
    assert (built.facts["rows"], built.facts["tokens"]) == (6, index.store.read(built, "indexed").agg(F.sum("length")).first()[0])
    same_as_plain(index, docs, QUERIES)
    now = {r[0]: r for r in DOCS}
    for changed, gone in (([("b", "the cat", "x y")], []), ([("g", "art of the", "new"), ("b", "b again", "of the")], []), ([], ["c", "unknown"]), ([("c", "back", "the")], []), ([], ["a", "b"])):
        if changed:
            index.upsert(spark.createDataFrame(changed, schema))
        else:
            index.delete(spark.createDataFrame([(k,) for k in gone], "key string"))
        now |= {r[0]: r for r in changed}
        for k in gone:
            now.pop(k, None)
        same_as_plain(index, spark.createDataFrame(list(now.values()), schema))
    before = index.store.latest()
    merged = index.merge()
    assert merged.facts["rows"] == len(now)
    same_as_plain(index, spark.createDataFrame(list(now.values()), schema), ("art of", "x-y", "cat"))
    assert index.store.read(merged, "postings").count() < index.store.read(before, "postings").count()
    assert all(len(held) == 1 for t in merged.tables.values() for held in t.values())
    assert index.merge() == merged
    index.build(docs.limit(0))
    assert scores(index.bm25("the")) == {}


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    docs = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 40)).alias("title"))
    index = LexicalIndex(spark, f"file://{tmp_path}/i", ("title",), buckets=32)
    before = index.build(docs)
    after = index.upsert(spark.createDataFrame([("k7", "common fresh")], "key string, title string"))
    terms = spark.createDataFrame([("common",), ("fresh",)], "t string").select(bucket_of(F.col("t"), 32)).collect()
    changed = {b for b in after.tables["postings"] if after.tables["postings"][b] != before.tables["postings"].get(b)}
    assert changed == {str(r[0]) for r in terms}
    # and what those buckets had stays where it was
    assert all(before.tables["postings"].get(b, []) == after.tables["postings"][b][:-1] for b in changed)
    # a search opens the buckets of its terms only
    opened = {f.split("bucket=")[1].split("/")[0] for f in index.postings(["fresh", "w3"]).inputFiles() if "/postings-" in f}
    assert len(opened) <= 2
    plan = index.postings(["fresh"])._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(term,fresh)]" in plan.replace("IsNotNull(term), ", "") or "In(term" in plan
    merged = index.merge()
    # k7 held common and w7; only these and fresh are written again
    old = spark.createDataFrame([("common",), ("fresh",), ("w7",)], "t string").select(bucket_of(F.col("t"), 32)).collect()
    assert {b for b in merged.tables["postings"] if merged.tables["postings"][b] != after.tables["postings"][b]} == {str(r[0]) for r in old}


def test_a_killed_upsert_changes_nothing(spark, tmp_path):
    schema = "key string, title string, body string"
    index = LexicalIndex(spark, f"file://{tmp_path}/i", ("title", "body"), buckets=2)
    before = index.build(spark.createDataFrame(DOCS, schema))
    fresh = spark.createDataFrame([("a", "the end", "x"), ("z", "new", "the")], schema)
    original = index.store.before_write
    for step in range(4):
        killed_after(index.store, step)
        with pytest.raises(Killed):
            index.upsert(fresh)
        assert index.store.latest() == before
    index.store.before_write = original
    same_as_plain(index, spark.createDataFrame(DOCS, schema))
    index.upsert(fresh)
    assert index.store.vacuum(keep=1) > 0
    same_as_plain(index, spark.createDataFrame([r for r in DOCS if r[0] != "a"] + [("a", "the end", "x"), ("z", "new", "the")], schema))


def test_tokens_are_put_together_in_their_row(spark, tmp_path):
    """Postings of several columns, without a shuffle of single tokens."""
    rows = [("a", "The the café", None), ("b", None, "x, the x"), ("c", "", " . "), ("d", "cafe\n" * 3, "the")]
    docs = spark.createDataFrame(rows, "key string, s string, t string")
    index = LexicalIndex(spark, f"{tmp_path}/i", ("s", "t"), buckets=4)
    postings, works, *_ = index._analysed(docs, 1)
    assert "Exchange" not in postings._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in postings._jdf.queryExecution().optimizedPlan().toString()
    at = 1 << 32
    assert {(r["key"], r["term"]): (r["length"], r["places"]) for r in postings.collect()} == {
        ("a", "the"): (3, [0, 1]), ("a", "cafe"): (3, [2]), ("b", "x"): (3, [at, at + 2]), ("b", "the"): (3, [at + 1]), ("d", "cafe"): (4, [0, 1, 2]), ("d", "the"): (4, [at]),
    }
    assert {r["key"]: r["length"] for r in works.collect()} == {"a": 3, "b": 3, "c": 0, "d": 4}
    assert index._analysed(docs.limit(0), 1)[0].isEmpty()
