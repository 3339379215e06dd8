"""SimHash fingerprints and near duplicates by anchor covering (operator 3).

Two fingerprints of 64 bits that differ in at most two places are found so.  Cut
into three blocks, they agree in at least one block and differ by at most one
place in a second one; it is enough to look at the pairs of blocks (0, 1),
(1, 2) and (2, 0).  The first block of the pair must be equal.  On 15 bits of
the second one the anchors are the 2048 code words of the [15, 11] Hamming code,
a perfect code of covering radius 1: a fingerprint goes to every anchor within
radius 1 plus threshold 1, which is 1 or 8 of them.  The nearest anchor of one
lies within 2 of the other, so both meet there.  That makes about 23 copies of
each distinct fingerprint under 32-bit keys, and pairs are compared per key.

Copies of one fingerprint count once.  A key passes on the links that connect
its members, never all their pairs, and compares in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..plans.durable import durable, release
from . import similar
from .arrowtools import bound_arrow_batches, map_arrow, shuffle_partitions, with_columns
from .minhash import SIMILAR

#: (shift, width) of the three blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (1, 2), (2, 0))
CODE_BITS = 15
#: Members from which on a key looks up their neighbours instead of comparing them one by one.
LOOKUP_FROM = 2000
SEED = 42


def _syndromes() -> np.ndarray:
    """The syndrome of every 15-bit word: the xor of its set positions, counted from 1."""
    words = np.arange(1 << CODE_BITS)
    out = np.zeros_like(words)
    for i in range(CODE_BITS):
        out ^= np.where(words >> i & 1, i + 1, 0)
    return out


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome, the flips of at most two bits that lead to a code word, and how many there are."""
    by: list[list[int]] = [[] for _ in range(16)]
    by[0].append(0)
    for i in range(CODE_BITS):
        by[i + 1].append(1 << i)
        for j in range(i):
            by[(i + 1) ^ (j + 1)].append(1 << i | 1 << j)
    most = max(map(len, by))
    return np.array([x + [0] * (most - len(x)) for x in by]), np.array([len(x) for x in by])


SYNDROME = _syndromes()
FLIPS, FLIP_COUNT = _flips()


def anchor_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, key): every key of every fingerprint, and the fingerprint's place."""
    which, keys = [], []
    for n, (first, second) in enumerate(PAIRS):
        exact = prints >> np.uint64(BLOCKS[first][0]) & np.uint64((1 << BLOCKS[first][1]) - 1)
        word = (prints >> np.uint64(BLOCKS[second][0]) & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)
        syndrome = SYNDROME[word]
        count = FLIP_COUNT[syndrome]
        at = np.repeat(np.arange(prints.size), count)
        nth = np.arange(at.size) - np.repeat(np.cumsum(count) - count, count)
        anchor = word[at] ^ FLIPS[syndrome[at], nth]
        which.append(at)
        keys.append((np.int64(n) << 40) | exact.astype(np.int64)[at] << 15 | anchor)
    return np.concatenate(which), np.concatenate(keys)


def fingerprint(text: str, shingle: int = 3, slice_words: int = 200_000) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 of all shingles; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, slice_words):
        part = words[at : at + slice_words + shingle - 1]
        run = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.r_[0, ends[:-1] + 1].tolist()
        ends = ends.tolist()
        last = ends[shingle - 1 :] if len(part) >= shingle else ends[-1:]
        h = np.array([digest(run[s:e], SEED) for s, e in zip(starts, last, strict=False)], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """Every row of docs with simhash (long: the 64 bits, signed). Null counts as empty: 0."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            prints = np.array([fingerprint(x or "", shingle) for x in batch.column(at).to_pylist()], dtype=np.uint64)
            yield with_columns(batch, simhash=pa.array(prints.view(np.int64)))

    return map_arrow(docs, run, T.StructType([f for f in docs.schema if f.name != "simhash"] + [T.StructField("simhash", T.LongType())]))


def _neighbour_masks(bits: int) -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = np.array([one[i] | one[j] for i in range(64) for j in range(i)], dtype=np.uint64)
    return np.concatenate([one, two]) if bits == 2 else one


MASKS = _neighbour_masks(2)


def links_within(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect the members which differ by 1 or 2 bits, at most one less than there are members.

    Small sets are compared member by member.  In large ones each member looks up
    all its 2080 neighbours among the sorted members, so the work grows with the
    members and not with their pairs.
    """
    members = np.unique(members)
    n = members.size
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out_a, out_b = [], []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_a.append(i)
                out_b.append(j)

    if n <= LOOKUP_FROM:
        step = max(1, 1_000_000 // max(n, 1))
        for at in range(0, n, step):
            i, j = np.nonzero(np.bitwise_count(members[at : at + step, None] ^ members[None, :]) <= 2)
            later = j > i + at
            join(i[later] + at, j[later])
    else:
        for mask in MASKS:
            other = members ^ mask
            place = np.minimum(np.searchsorted(members, other), n - 1)
            i = np.flatnonzero((members[place] == other) & (other > members))
            join(i, place[i])
    return members[out_a], members[out_b]


def _key_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal keys; the rows come sorted by key."""
    held_key, held = None, []

    def emit(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pairs = [p for p in pairs if p[0].size]
        if pairs:
            a, b = (np.concatenate([p[i] for p in pairs]).view(np.int64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        prints = batch.column(1).to_numpy().view(np.uint64)
        if not keys.size:
            continue
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        found = []
        if held_key is not None:
            if keys[0] == held_key:
                end = int(cut[1]) if cut.size > 1 else keys.size
                held.append(prints[:end])
                if end == keys.size:
                    continue
                cut = cut[1:]
            if sum(map(len, held)) > 1:
                found.append(links_within(np.concatenate(held)))
        size = np.diff(np.r_[cut, keys.size])
        # pairs of neighbours settle the many keys of two members at once
        two = cut[:-1][size[:-1] == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= 2]
        near = near[prints[near] != prints[near + 1]]
        found.append((prints[near], prints[near + 1]))
        for s, n in zip(cut[:-1][size[:-1] > 2].tolist(), size[:-1][size[:-1] > 2].tolist(), strict=True):
            found.append(links_within(prints[s : s + n]))
        held_key, held = keys[-1], [prints[cut[-1] :].copy()]
        yield from emit(found)
    if sum(map(len, held)) > 1:
        yield from emit([links_within(np.concatenate(held))])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column simhash) of at most two differing bits.

    They connect whatever such links connect; not every link of a cluster is listed.
    """
    spark = prints.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            which, keys = anchor_keys(values)
            for at in range(0, keys.size, 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(values[which[part]].view(np.int64))], names=["key", "simhash"])

    bound_arrow_batches(spark, records=10_000)
    copies = map_arrow(prints.select("simhash").distinct(), replicate, "key long, simhash long")
    return map_arrow(copies.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key"), _key_links, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = 3, text: str = "text") -> DataFrame:
    """(key, simhash, component_id) for every row of docs.

    component_id is the smallest key that the row reaches over links of at most
    two differing bits.  A text without words, null too, has fingerprint 0 and is
    linked like any other.  Rows of a null key belong to components but don't
    name them: a component of such rows alone has a null id.  Repeated rows stay,
    each with the same id; an empty table gives no rows.
    """
    bound_arrow_batches(docs.sparkSession)
    rows = durable(fingerprints(docs.select(F.col(key).alias(key), F.col(text).alias("text")), shingle).select(key, "simhash"))
    smallest = durable(rows.groupBy("simhash").agg(F.min(key).alias("_low")))
    found = connected_components(links(smallest))
    joined = smallest.join(found.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    lows = durable(joined.groupBy("component").agg(F.min("_low").alias("component_id")))
    labels = durable(joined.select("simhash", "component").join(lows, "component").select("simhash", "component_id"))
    release(smallest, lows)
    return rows.join(labels, "simhash").select(key, "simhash", "component_id")


def keep_first(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without those rows that have a smaller key in their component: one document of each component stays.

    Rows that share a key stay together.  A null key never names a component, so
    such rows stay only where no row of their component has a key.
    """
    kept = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]), "left_semi")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """(key, component_id) of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    SimHash comes first: fingerprints of five-word shingles meet at the anchors, and a
    link whose sets have the similarity joins its documents.  Pairs of just that
    similarity differ in 7 to 9 of 64 bits on average and one in ten of them in 12 or
    more, where anchors no longer tell documents apart; so what the anchors leave apart
    meets in MinHash bands, verified alike: see ``similar.near_duplicates``.  Nulls,
    ties, repeated rows and texts without words are treated as there.
    """
    return similar.near_duplicates(docs, key, text, shingle, similarity, fingerprint, links)
