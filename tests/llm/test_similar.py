import random
import re

import numpy as np
import xxhash

from quillstack.llm import minhash, simhash, similar

DATA = "/root/testdata/sf0.001/documents.parquet"


def brute_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{key: smallest key reached} of (key, print) pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [(k, low.get(find(i))) for i, (k, _) in enumerate(prints)]


def test_code_is_perfect():
    """Every 15-bit word lies within 1 of one anchor, and the table names all anchors within 2."""
    words = np.arange(1 << 15)
    code = words[simhash.SYNDROME == 0]
    assert code.size == 2048
    for w in random.Random(1).sample(range(1 << 15), 200):
        apart = np.bitwise_count(code ^ w)
        assert (apart <= 1).sum() == 1
        s = simhash.SYNDROME[w]
        assert set(code[apart <= 2].tolist()) == {int(w ^ f) for f in simhash.FLIPS[s][: simhash.FLIP_COUNT[s]]}


def test_all_close_pairs_meet():
    r = random.Random(2)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.choice([0, 1, 2])):
            b ^= 1 << bit
        keys = [set(simhash.anchor_keys(np.array([x], dtype=np.uint64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_large_keys_find_the_same(monkeypatch):
    r = random.Random(3)
    base = r.getrandbits(64)
    members = np.array([base ^ sum(1 << x for x in r.sample(range(64), r.choice([1, 2, 3, 9]))) for _ in range(500)], dtype=np.uint64)

    def classes():
        a, b = simhash.links_within(members)
        assert (np.bitwise_count(a ^ b) <= 2).all()
        parent = {x: x for x in members.tolist()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            parent[find(x)] = find(y)
        return sorted(sorted(y for y in parent if find(y) == x) for x in parent if find(x) == x)

    small = classes()
    monkeypatch.setattr(simhash, "LOOKUP_FROM", 10)
    assert classes() == small


def test_documents_and_edges(spark, edge, edge_rows, nothing):
    for df, rows in ((spark.read.parquet(DATA), None), (edge, edge_rows)):
        rows = rows or [(r["doc_id"], r["text"]) for r in df.collect()]
        prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
        got = simhash.near_duplicates(df).collect()
        assert sorted((str(r["doc_id"]), r["simhash"] & (1 << 64) - 1) for r in got) == sorted((str(k), p) for k, p in prints)
        assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, brute_components(prints)))
    assert simhash.near_duplicates(nothing).count() == 0


def test_sliced_texts(edge_rows):
    for r in edge_rows:
        assert simhash.fingerprint(r[1] or "", slice_words=7) == simhash.fingerprint(r[1] or "") == brute_fingerprint(r[1])


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_similar_documents(spark, edge, nothing):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, family = [], {}
    for f in range(40):
        words = [r.choice(vocabulary) for _ in range(400)]
        for c in range(4):
            changed = list(words)
            for at in r.sample(range(400), 2 * c):
                changed[at] = r.choice(vocabulary)
            rows.append((f * 4 + c, " ".join(changed)))
            family[f * 4 + c] = f * 4
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(family[v] == family[k] for k, v in got.items())  # no family meets another
    assert sum(got[k] == family[k] for k in family) >= 0.97 * len(family)
    kept = simhash.keep_first(edge, simhash.similar_documents(edge))
    assert kept.columns == edge.columns
    assert 0 < kept.count() < edge.count()
    assert simhash.keep_first(nothing, simhash.similar_documents(nothing)).count() == 0


def brute_similar(texts):
    """{i: smallest i reached} over true Jaccard similarities of 0.8 and more."""
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for j, y in enumerate(sets):
        for i in range(j):
            x = sets[i]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: find(i) for i in range(len(texts))}


def pair_texts(r, n, j):
    """Two texts of n words whose runs of five words have a similarity near j."""
    words = [f"w{r.randrange(10**9)}" for _ in range(n)]
    cut = round((n - 4) * 2 * j / (1 + j)) + 4  # words from the start that both have
    return " ".join(words), " ".join(words[:cut] + [f"v{r.randrange(10**9)}" for _ in range(n - cut)])


def similar_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(rows).collect()}


def test_similar_documents_find_all_pairs(spark):
    """At and just above the threshold, and in texts of 5 to 15 words, nothing is missed."""
    r = random.Random(6)
    texts = [t for j in (0.80, 0.81, 0.82, 0.85) for n in (30, 60, 104, 250, 1000) for _ in range(12) for t in pair_texts(r, n, j)]
    for n in range(5, 16):
        for _ in range(6):
            words = [f"w{r.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words[1:])]
    expected = brute_similar(texts)
    assert sum(k != v for k, v in expected.items()) > 150
    got = similar_of(spark, texts)
    assert {k: v for k, v in got.items() if v != expected[k]} == {}


def test_similar_documents_in_crowds(spark):
    """Bands that very many nodes share, near copies and unlike ones, give what all pairs give."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:180] + [f"x{r.randrange(10**9)}" for _ in range(20)]) for _ in range(90)]  # alike
    texts += [" ".join(base[100:] + [f"y{r.randrange(10**9)}" for _ in range(60)]) for _ in range(90)]  # not alike, half in common
    texts += [" ".join([f"z{i}" for i in range(100)] + [f"u{k // 2}-{i}" for i in range(60)] + [f"v{k}-{i}" for i in range(8)]) for k in range(80)]  # alike in twos
    expected = brute_similar(texts)
    assert similar_of(spark, texts) == expected
    assert len(set(expected.values())) == 1 + 90 + 40


def test_a_crowd_just_below_makes_no_pairs(spark, monkeypatch):
    """Texts that share a template and lie at 0.79: whatever their number, none of their shingles is left to pair by; a near copy among them is found."""
    seen = []
    rarest = similar._rarest

    def counted(*args):
        rows = rarest(*args)
        seen.append(rows.count())
        return rows

    monkeypatch.setattr(similar, "_rarest", counted)
    template = [f"c{i}" for i in range(92)]
    for n in (100, 400):
        rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(12)])) for i in range(n)]
        rows.append((n, rows[7][1] + " end"))
        got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert got == {i: i for i in range(n)} | {n: 7}
    assert seen and max(seen) <= 200


def test_similar_documents_keep_the_unlike(spark):
    """Pairs below the threshold stay apart, long and short, and chains of them too."""
    r = random.Random(8)
    texts = [t for j in (0.65, 0.70, 0.75, 0.78) for n in (60, 250, 504) for _ in range(12) for t in pair_texts(r, n, j)]
    for _ in range(30):
        words = [f"w{r.randrange(10**9)}" for _ in range(8)]
        texts += [" ".join(words), " ".join([*words[:7], "other"])]  # 3 of 5 runs in common
        texts += [" ".join([*words[:7], "a"]), " ".join([*words[:7], "a", "b"])[:-2]]  # a copy
        texts += [" ".join(["x", *words[:7]])]
    expected = brute_similar(texts)
    got = similar_of(spark, texts)
    assert {k: v for k, v in got.items() if v != expected[k]} == {}


def test_minhash_contract(spark, edge, edge_rows, nothing):
    docs = spark.read.parquet(DATA)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in minhash.fingerprints(docs, rows_a_range=30).collect()}
    whole = {r["doc_id"]: r for r in minhash.fingerprints(docs).collect()}
    assert got == whole
    off = []
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == __import__("hashlib").sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(following)
        off += [abs(r["near_edited"] - len(a & b) / max(1, len(a | b))), abs(r["near_next"] - len(a & c) / max(1, len(a | c)))]
    assert max(off) < 0.22 and sum(off) / len(off) < 0.04
    by_text = {}
    for k, t in rows:
        assert by_text.setdefault(t, got[k]["fingerprint"]) == got[k]["fingerprint"]
    found = minhash.fingerprints(edge).collect()
    assert len(found) == len(edge_rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert minhash.fingerprints(nothing).count() == 0
    alone = minhash.fingerprints(docs.filter("doc_id = 0")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_signatures_in_runs(monkeypatch):
    texts = ["", "a", " ".join(map(str, range(3000))), "b c d e f g h"]
    whole = minhash.signatures(texts)
    monkeypatch.setattr(minhash, "RUN", 100)
    assert (minhash.signatures(texts) == whole).all()


def test_near_duplicates_of_documents(spark, edge, edge_rows, nothing):
    """All links between the documents, against all pairs."""
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(DATA).collect())
    expected = brute_similar([t for _, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.read.parquet(DATA)).collect()}
    assert got == {k: rows[expected[i]][0] for i, (k, _) in enumerate(rows)}
    assert similar.near_duplicates(edge).count() == len(edge_rows)
    assert similar.near_duplicates(nothing).count() == 0


def test_few_simhash_bits_miss_similar_texts():
    """Why the anchors don't serve a similarity of 0.8: its pairs differ in far more than 2 bits."""
    r = random.Random(9)
    apart = [(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() for a, b in (pair_texts(r, n, 0.8) for n in (30, 100, 1000) for _ in range(60))]
    assert sum(x <= 2 for x in apart) < 0.1 * len(apart)
    assert sorted(apart)[len(apart) // 2] >= 7


def test_words_of_many_texts_are_hashed_together():
    """Words are those of ``str.split``, equal words alone have equal hashes, and sets are as large as those made text by text."""
    r = random.Random(12)
    alphabet = "abé日\U0001f600ZİSS"
    words = ["".join(r.choice(alphabet) for _ in range(n)) for n in (1, 1, 2, 3, 7, 8, 9, 15, 16, 17, 40, 63, 64, 65, 200) for _ in range(20)] + ["a", "a\x00", "a" * 8, "a" * 16, "a" * 64, "a" * 65]
    texts = ["", " \n", "one"] + [" \x1c".join(r.choice(words) for _ in range(r.randrange(60))) + r.choice(["", "　", "\x85"]) for _ in range(80)]
    hashes, lengths = minhash.word_hashes(texts)
    split = [t.lower().split() for t in texts]
    flat = [w for ws in split for w in ws]
    assert lengths.tolist() == [len(ws) for ws in split] and hashes.size == len(flat)
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist(), strict=True)))
    for size in (1, 5):
        for t, got in zip(texts, minhash.shingle_sets(texts, size), strict=True):
            assert got.size == np.unique(minhash.shingle_hashes(t, size)).size and (np.diff(got.astype(object)) > 0).all()
    assert minhash.shingle_sets([], 5) == [] and [x.size for x in minhash.shingle_sets(["", "a b"], 5)] == [0, 1]
    assert minhash.shingle_sets(["x y z", "a b"], 5)[1].tolist() == minhash.shingle_sets(["a b"], 5)[0].tolist()


def test_simhash_finds_links_without_bands(spark, monkeypatch):
    """The stage's documents are linked by their fingerprints at the anchors, though no band brought a pair; the unlike ones that meet there are not."""
    r = random.Random(21)
    rows = []
    for f in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(600)]
        rows += [(2 * f, " ".join(words)), (2 * f + 1, " ".join([*words, f"x{f}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {k: simhash.fingerprint(t, 5) for k, t in rows}
    near = {k for k in prints if (prints[k] ^ prints[k ^ 1]).bit_count() <= 2}
    assert len(near) > 12
    monkeypatch.setattr(similar, "_candidates", lambda nodes, similarity: spark.createDataFrame([], "band long, a binary, b binary, size int"))
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(docs).collect()}
    assert got == {k: k & ~1 if k in near else k for k in prints}
    # where all texts have one fingerprint, each is held against the first, and what the sets don't bear out is no link
    got = {x["doc_id"]: x["component_id"] for x in similar.near_duplicates(docs, fingerprint=lambda t, n: 5, print_links=simhash.links).collect()}
    assert all(v in (k, k & ~1) for k, v in got.items()) and sum(v != k for k, v in got.items()) == 1
