import hashlib
import random

import pytest

from quillstack.llm.point_in_time import label_versions, point_in_time


def brute(questions, versions):
    """{(source, t): version}, by looking at every version."""
    out = {}
    for s, t in set(questions):
        usable = [v for v in versions if None not in (s, t, *v[:3]) and v[0] == s and v[1] <= t < v[2]]
        out[s, t] = max((v[3:] for v in usable), key=lambda v: tuple((x is not None, x) for x in v), default=None)
    return out


@pytest.mark.parametrize(("bin", "levels"), [(1, 6), (1, 1), (8, 3), (5, 2)])
def test_against_all_versions(spark, bin, levels):
    r = random.Random(3)
    source = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    versions = []
    for i in range(400):
        start = r.randrange(-300, 900)
        versions.append((source(), start, start + r.choice([-5, 0, 1, 2, 7, 30, 200, 900]), r.choice([None, *range(20)]), r.choice([None, "x", "y"]), i % 50))
    versions += versions[:40] + [("a", None, 5, 1, "x", 1), ("a", 1, None, 1, "x", 1), ("far", -(10**15) - 3, -(10**15) + 4, 1, "x", 1)]
    questions = [(source(), r.choice([None, *range(-320, 1900, 7)])) for _ in range(600)]
    # both ends of every interval and the times beside them
    questions += [(v[0], t) for v in versions for t in (v[1], v[2], (v[2] or 0) - 1) if v[0] and t is not None]
    v = spark.createDataFrame(versions, "source string, start long, end long, event long, name string, id long").repartition(3)
    q = spark.createDataFrame(questions, "source string, t long").repartition(3)
    got = {(x["source"], x["t"]): x["version"] for x in point_in_time(q, v, bin=bin, levels=levels).collect()}
    want = brute(questions, versions)
    assert got.keys() == want.keys()
    assert {k: None if x is None else tuple(x) for k, x in got.items()} == want


def test_nothing(spark):
    v = spark.createDataFrame([], "source string, start long, end long, event long")
    q = spark.createDataFrame([("a", 1)], "source string, t long")
    assert [x["version"] for x in point_in_time(q, v).collect()] == [None]
    assert point_in_time(q.limit(0), v).count() == 0


def number(i, k):
    return int(hashlib.sha256(str(i).encode()).hexdigest()[8 * k : 8 * k + 8], 16)


def test_labels(spark, edge, nothing):
    """Against every pair of a label and a version; nulls, repeated rows, clashing names, a source that holds most rows."""
    rows = [(i, f"text {i}", "en" if i % 3 else None, "hot" if i % 4 else ("x" if i % 8 else None), i) for i in range(3000)]
    docs = spark.createDataFrame([*rows, *rows[:50], (None, "t", "en", "hot", 1)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as t", "2 as start", "3 as version", "4 as age")
    asked = [*range(0, 3100, 2), 4, 4, None]
    labels = spark.createDataFrame([(i,) for i in asked], "doc_id long").selectExpr("*", "'s' as source", "0 as quality")
    got = label_versions(docs, labels).collect()
    by_source = {}
    for i, _, lang, source, n in rows:
        event = number(i, 0) % 50000
        by_source.setdefault(source, []).append((event, -(event - 60 + number(i, 1) % 600), i, event + number(i, 2) % 900, n, lang))
    source_of = {x[0]: x[3] for x in rows}
    want = []
    for i in asked:
        if i is None:
            want.append((None, None, None, None, "none", None, None))
            continue
        t = number(i, 3) % 50000
        usable = [v for v in by_source[source_of[i]] if v[0] <= t and -v[1] <= t < v[3]] if source_of.get(i) else []
        if not usable:
            want.append((i, t, None, None, "none", None, None))
            continue
        v = max(usable, key=lambda v: v[:3])
        fresh = t - v[0] <= 120
        want.append((i, t, v[2], t - v[0], "fresh" if fresh else "stale", v[4] if fresh else None, v[5] if fresh else None))
    order = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {x[4] for x in want} == {"none", "stale", "fresh"}
    assert label_versions(edge, labels.limit(0)).count() == 0
    assert {x["status"] for x in label_versions(nothing, labels).collect()} == {"none"}
    assert label_versions(edge, edge).count() == edge.count()


def test_a_dense_source_meets_one_row_a_width(spark):
    """Ten times the versions of one source make no more joined rows."""

    def joined(n):
        docs = spark.range(n).selectExpr("id as doc_id", "'hot' as source", "id as n_chars", "'en' as lang")
        df = label_versions(docs, spark.range(500).selectExpr("id as doc_id"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        found = []

        def walk(node):
            if "Join" in node.nodeName() and "width" in node.simpleString(10000):
                found.append(node.metrics().apply("numOutputRows").value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))
            if node.nodeName() == "AdaptiveSparkPlan":
                walk(node.executedPlan())
            elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
                walk(node.plan())

        walk(plan)
        return found

    # 500 questions, six widths
    assert max(joined(5000)) <= 3000
    assert max(joined(50_000)) <= 3000
