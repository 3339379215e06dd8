import json
import random

from pyspark.sql import functions as F

from quillstack.operators import fallback


def test_against_one_by_one(spark):
    r = random.Random(6)
    items = [f"i{k}" for k in range(60)]
    lists = {s: {i: [f"{s}{r.randrange(40)}" for _ in range(r.randrange(5))] for i in items} for s in "abc"}
    works = {f"{s}{k}" for s in "abc" for k in range(40) if r.random() < 0.3}
    calls = []

    def get(addresses):
        calls.append(sorted(x[0] for x in addresses.collect()))
        return spark.createDataFrame([(a, a.upper()) for a in sorted(works)], "address string, body string")

    def source(s):
        rows = [(i, k, a) for i, found in lists[s].items() for k, a in enumerate(dict.fromkeys(found))] + [("unknown", 0, "x"), ("i0", 9, None)]
        return s, lambda open_: spark.createDataFrame(rows, "item string, place int, address string").join(open_, "item", "left_semi")

    df = spark.createDataFrame([(i,) for i in items] * 2, "item string")
    got, rounds = fallback.first_that_works(df, [source(s) for s in "abc"], get)
    want, asked = {}, {}
    for i in items:
        want[i] = None
        for s in "abc":
            for k, a in enumerate(dict.fromkeys(lists[s][i])):
                if want[i] is None:
                    asked.setdefault((s, k), set()).add(i)
                    if a in works:
                        want[i] = (s, a, a.upper())
    assert {x["item"]: x["source"] and (x["source"], x["address"], x["body"]) for x in got.collect()} == want
    told = rounds.orderBy("round").collect()
    assert [(x["source"], x["asked"]) for x in told] == [(s, len(asked[s, k])) for s in "abc" for k in range(5) if (s, k) in asked]
    assert sum(x["answered"] for x in told) == sum(w is not None for w in want.values())
    # nobody is asked twice in a round, and closed items not at all
    assert all(len(c) == len(set(c)) for c in calls) and len(calls) == len(told)
    none, empty = fallback.first_that_works(df.limit(0), [source("a")], get)
    assert none.count() == 0 and empty.count() == 0


def test_pdf_sources(spark):
    copies = lambda *urls: json.dumps({"oa_locations": [{"url_for_pdf": u, "host_type": h} for u, h in urls]})
    unpaywall = spark.createDataFrame([("a", copies(("http://pub/a", "publisher"), ("http://rep/a", "repository"))), ("b", copies(("http://rep/b", "repository"))), ("c", "no json")], "item string, body string")
    link = json.dumps({"message": {"link": [{"URL": "http://x/y.pdf", "content-type": "application/pdf"}]}})
    crossref = spark.createDataFrame([("a", link), ("b", link), ("d", "{}")], "item string, body string")
    have = spark.createDataFrame([("https://pub/a", "%PDF-a"), ("https://x/y.pdf", "%PDF-x")], "address string, body string")
    got, rounds = fallback.first_that_works(spark.createDataFrame([(x,) for x in "abcd"], "item string"), fallback.pdf_sources(unpaywall, crossref), lambda a: have.join(a, "address", "left_semi"))
    assert {r["item"]: (r["source"], r["body"]) for r in got.collect()} == {"a": ("Unpaywall", "%PDF-a"), "b": ("CrossRef", "%PDF-x"), "c": (None, None), "d": (None, None)}
    assert [tuple(r) for r in rounds.orderBy("round").collect()] == [(0, "Unpaywall", 2, 0), (1, "Unpaywall", 1, 1), (2, "CrossRef", 1, 1)]
