import zlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from quillstack.llm import sharding


@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 120))
def test_best_fit(sizes, capacity):
    """Against the rule itself: largest first, into the bin with the least room that holds it."""
    rooms, expected = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if not fits:
            rooms.append(capacity)
            fits = [(capacity, len(rooms) - 1)]
        room, b = min(fits)
        rooms[b] -= sizes[i]
        expected[i] = b
    assert sharding.best_fit_decreasing(sizes, capacity) == expected


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=80), st.integers(1, 8))
def test_near_equal(sizes, shards):
    placed = sharding.near_equal(sizes, shards)
    assert set(placed) <= set(range(shards))
    loads = [sum(s for s, p in zip(sizes, placed, strict=True) if p == b) for b in range(shards)]
    assert max(loads) <= max(max(sizes), -(-sum(sizes) // shards) + max(sizes))


def check(rows, docs, shards, slack):
    assert len(rows) == len(docs)
    by_shard, groups, load = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        groups[(r["size"], r["text_crc32"])].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(g) == 1 for g in groups.values())
    assert set(by_shard) <= set(range(shards))
    assert max(load.values()) - min(load.values()) <= slack
    assert sorted((str(d[0]), len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs) == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    largest = max(len(r["text"].encode()) + 1 for r in rows)
    check(sharding.pack_documents(docs).collect(), [tuple(r) for r in rows], 8, largest)


def test_edges(edge, edge_rows, nothing):
    check(sharding.pack_documents(edge).collect(), edge_rows, 8, 10**9)
    assert sharding.pack_documents(nothing).count() == 0
    packed = sharding.pack_documents(edge, shards=None, capacity=20_000).collect()
    load = defaultdict(int)
    for r in packed:
        load[r["shard"]] += r["size"]
    largest = max(load.values())
    assert all(v <= 20_000 for v in load.values() if v != largest)


def test_classes_and_runs(spark, monkeypatch):
    """Small classes and slot runs change no law."""
    monkeypatch.setattr(sharding, "CLASS", 3)
    monkeypatch.setattr(sharding, "SLOT_RUN", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(sharding.pack_documents(docs).collect(), rows, 8, max(len(r[1].encode()) + 1 for r in rows))


def test_groups_are_packed_by_the_rule(spark, edge, edge_rows):
    """The shards' loads are those of best-fit-decreasing over the groups of equal texts."""
    for docs, rows in ((edge, edge_rows), (spark.createDataFrame([(i, "x" * (i % 7)) for i in range(300)], "doc_id long, text string"), [(i, "x" * (i % 7)) for i in range(300)])):
        groups = defaultdict(int)
        for r in rows:
            groups[r[1] or ""] += len((r[1] or "").encode()) + 1
        sizes = list(groups.values())
        for shards, capacity in ((8, None), (3, None), (None, 20_000), (None, 40)):
            placed = sharding.near_equal(sizes, shards) if shards else sharding.best_fit_decreasing(sizes, capacity)
            expected = defaultdict(int)
            for size, place in zip(sizes, placed, strict=True):
                expected[place] += size
            load = defaultdict(int)
            for r in sharding.pack_documents(docs, shards, capacity).collect():
                load[r["shard"]] += r["size"]
            assert load == expected
