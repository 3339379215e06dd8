import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstack.llm import decontaminate, lm_scoring, suffix_dedup, toxicity
from quillstack.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


@pytest.mark.parametrize("block", [8 << 20, 500])
def test_contamination(spark, edge, edge_rows, nothing, monkeypatch, block):
    """One broadcast set, and many passes of small ones, find the same."""
    monkeypatch.setattr(decontaminate, "BLOCK_TEXT", block)
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [tuple(r) for r in bench.collect()]
    assert rows(decontaminate.contamination(docs, bench)) == brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    own = [(1, "one two"), (2, None), (3, ""), (None, "one"), (4, edge_rows[10][1]), (4, edge_rows[10][1]), (10, "ONE"), (5, "日本 naïve")]
    small = spark.createDataFrame(own, "item_id long, text string")
    assert rows(decontaminate.contamination(edge, small)) == brute_contamination([r[:2] for r in edge_rows], own)
    clash = edge.selectExpr("*", "1 AS _hit", "2 AS _ITEMS", "'x' AS _words")
    assert rows(decontaminate.contamination(clash, small)) == brute_contamination([r[:2] for r in edge_rows], own)
    assert decontaminate.decontaminate(clash, small).columns == clash.columns
    assert decontaminate.contamination(nothing, small).count() == 0
    assert decontaminate.contamination(edge, small.limit(0)).filter("contaminated").count() == 0


def test_decontaminate(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    before = decontaminate.contamination(docs, bench)
    cut = decontaminate.decontaminate(docs, bench)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert decontaminate.contamination(cut, bench).filter("contaminated").count() == 0
    assert cut.filter("n_chars != length(text)").count() == 0
    clean = before.filter("not contaminated").select("doc_id")
    assert cut.join(clean, "doc_id").exceptAll(docs.join(clean, "doc_id")).count() == 0
    dropped = decontaminate.decontaminate(docs, bench, "documents")
    assert dropped.columns == docs.columns
    assert dropped.count() == clean.count()
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "x")
    assert decontaminate.cut_words("a, B c! d", np.array([False, True, True, False])) == "a, ! d"


def brute_repeats(docs):
    key = lambda d: -(1 << 63) if d is None else d
    low = {}
    for d, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            low[b[k : k + 50]] = min(key(d), low.get(b[k : k + 50], key(d)))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if low[b[k : k + 50]] < key(d):
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
        out.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def repeats(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes(df).collect())


def test_order_finds_the_smallest():
    rng = np.random.default_rng(4)
    texts = list({bytes(rng.integers(97, 99, rng.integers(50, 81)).astype(np.uint8)) for _ in range(60)} | {b"a" * 50, b"a" * 80, b"ab" * 40, b"\x00\xff" * 30})
    texts += [t[5:55] for t in texts[:20] if len(t) >= 55 and t[5:55] not in texts]
    low = rng.permutation(len(texts)).astype(np.int64)
    got = suffix_dedup.smallest_by_window(texts, low)
    windows = [(t[i : i + 50], v) for t, v in zip(texts, low.tolist(), strict=True) for i in range(len(t) - 49)]
    best = {}
    for w, v in windows:
        best[w] = min(v, best.get(w, v))
    assert got.tolist() == [best[w] for w, _ in windows]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats(spark, edge, edge_rows, nothing, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", 8)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert repeats(docs) == brute_repeats([tuple(r) for r in docs.collect()])
    assert repeats(edge) == brute_repeats([r[:2] for r in edge_rows])
    assert suffix_dedup.repeated_bytes(nothing).count() == 0


def test_remove_repeats(spark, edge, edge_rows, nothing):
    cut = suffix_dedup.remove_repeats(edge)
    assert cut.schema == edge.schema and cut.count() == len(edge_rows)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(docs).collect()}
    for a in suffix_dedup.remove_repeats(docs).collect():
        assert a["n_chars"] == len(a["text"])
    same = [r["doc_id"] for r in docs.join(suffix_dedup.remove_repeats(docs).select("doc_id", F.col("text").alias("t")), "doc_id").filter("text = t").collect()]
    assert set(same) == {k for k, v in removed.items() if v == 0}
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_scores_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op4_lm_scoring"](spark, DATA).collect())
    assert got == sorted(db.execute(ORACLES["op4_lm_scoring"]).fetchall())


def test_score_edges(edge, edge_rows, nothing):
    got = lm_scoring.document_scores(edge).collect()
    assert len(got) == len(edge_rows)
    assert all(r["log_score"] <= 1e-9 and np.isfinite(r["log_score"]) for r in got)
    assert {r["log_score"] for r in got if r["n_words"] == 0} == {0.0}
    assert lm_scoring.document_scores(nothing).count() == 0


def test_counts_pack():
    keys = np.array([0, 3, 1 << 33, (1 << 40) - 1], dtype=np.uint64)
    back = lm_scoring.unpack_counts(lm_scoring.pack_counts(keys, np.array([1, 2, 3, 70000])))
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == [1, 2, 3, 70000]


def test_toxicity(spark, edge, edge_rows, nothing):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.scores(docs, model).withColumn("held_out", toxicity.held_out())
    rows = scored.filter("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    ranked = sum(a > b for a in toxic for b in clean) / len(toxic) / len(clean)
    assert ranked > 0.9
    assert sum(r["predicted"] for r in rows if not r["toxic"]) < 0.06 * len(clean)
    got = toxicity.scores(edge, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.drop_toxic(edge, model).schema == edge.schema
    assert toxicity.scores(nothing, model).count() == 0
    untrained = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scores(edge, untrained).agg(F.max("score")).first()[0] == 0.0


def test_fit_holds_little(spark, monkeypatch):
    """A fit takes its texts in bounded batches, whatever ran in the session before, and passes contexts on before they are many."""
    runs = []
    monkeypatch.setattr(toxicity, "map_arrow", lambda df, run, schema, real=toxicity.map_arrow: runs.append(run) or real(df, run, schema))
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"}
    for name, value in bounds.items():
        spark.conf.set(name, value)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    toxicity.train(spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "toxic int, text string"))
    assert [spark.conf.get(name) for name in bounds] == ["1000", "4m"]
    monkeypatch.setattr(toxicity, "HELD_CONTEXTS", 100)
    batch = pa.RecordBatch.from_pydict({"label": [i % 2 for i in range(30)], "text": texts})
    parts = [b.to_pylist() for b in runs[0](iter([batch, batch]))]
    assert max(map(len, parts)) <= 100 + 40
    got = {(x["label"], x["before"], x["word"]) for p in parts for x in p}
    assert got == {(i % 2, b, w) for i, t in enumerate(texts) for b, w in zip(["", *t.split()], t.split(), strict=False)}


def test_held_out_rows_teach_nothing(spark):
    """Labels of held-out rows may say anything."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.toxic == b.toxic and (a.weights == b.weights).all()


def test_counts_keep_all_bits():
    """Keys that agree in their upper 40 bits, and steps of up to 64 bits, come back as they were."""
    top = (1 << 64) - 1
    keys = np.array([0, 1, 2, 5 << 24, (5 << 24) + 1, (5 << 24) + 3, 1 << 63, (1 << 63) + (1 << 23), top - 1, top], dtype=np.uint64)
    back = lm_scoring.unpack_counts(lm_scoring.pack_counts(keys, np.arange(keys.size)))
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == list(range(keys.size))


def test_unknown_context_is_not_seen():
    """A trigram that is counted while its context is not falls back instead of dividing by nothing."""
    counts = [np.array([4.0, 2.0, 3.0]), np.array([0.0, 0.0, 0.0]), np.array([0.0, 0.0, 1.0])]
    score = lm_scoring.log_scores(counts, np.full(3, 50.0), np.arange(3), 0.5)
    assert np.allclose(score, [np.log(4 / 50), np.log(2 / 50) + np.log(0.5), np.log(3 / 50) + 2 * np.log(0.5)])


def test_one_sort_counts_a_block():
    """What other rows have, from one sort of a block, is what counting row by row gives."""
    r = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 6, n)) for n in (0, 1, 2, 40, 90, 0, 7)] + [" W1\x1cw2\x85\n w3 ", " "]
    grams = lm_scoring.Grams(texts, 3)
    assert grams.lengths.tolist() == [len(t.split()) for t in texts]
    hashes, counts = grams.counted()
    assert (np.diff(hashes.astype(object)) > 0).all() and counts[hashes == lm_scoring.ALL_WORDS].tolist() == [grams.lengths.sum()]
    others, found = grams.others(3.0 * counts)
    assert others.tolist() == [3 * grams.lengths.sum() - n for n in grams.lengths for _ in range(n)]
    split = [t.lower().split() for t in texts]
    for n, got in enumerate(found):
        rows = [[tuple(ws[i - n : i + 1]) if i >= n else None for i in range(len(ws))] for ws in split]
        every = [g for row in rows for g in row]
        assert got.tolist() == [0 if g is None else 3 * every.count(g) - row.count(g) for row in rows for g in row]
    nothing = lm_scoring.Grams([], 3)
    assert nothing.others(np.zeros(1))[1][2].size == 0


def test_order_of_hashes_that_agree_above():
    r = np.random.default_rng(9)
    hashes = r.integers(0, 3, 500).astype(np.uint64) << np.uint64(60) | r.integers(0, 9, 500).astype(np.uint64)
    out, place = lm_scoring.ranked(hashes)
    assert place.tolist() == np.argsort(hashes, kind="stable").tolist() and (out == hashes[place]).all()
    starts = lm_scoring.bucket_starts(7)
    assert starts[0] == 0 and (np.diff(starts.astype(object)) >= (1 << 64) // 7).all()
