"""MinHash document fingerprints (operator 6).

A text's shingles of five words are hashed, and ``PERMUTATIONS`` universal hash
functions x -> a x + b (mod 2^64, a odd) permute the hashes; the least value under
each function is the signature.  The functions run over many texts' shingles at
once in numpy.  The fingerprint is the upper 16 bits of every least value.  The
share of equal places estimates the Jaccard similarity of the shingle sets.

The bands of these values are joined in Spark, and what meets is verified by the
Jaccard similarity of the shingles, in the module ``similar``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import bound_arrow_batches, map_arrow, shuffle_partitions, texts_of, word_hashes

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
SIMILAR = 0.8
#: Shingles that go through the hash functions at once, so that they stay in the cache.
RUN = 32_768
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = WordHashes()


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words; of all words where there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return _runs(np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words)), size)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes; of all where there are fewer."""
    n = max(1, h.size - size + 1)
    out = np.full(n, np.uint64(min(size, h.size)))
    for i in range(min(size, h.size)):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text, as ``shingle_hashes`` takes shingles; the words of all texts are hashed together."""
    h, lengths = word_hashes(texts)
    runs = _runs(h, size) if h.size >= size else np.empty(0, np.uint64)
    out, at = [], 0
    for n in lengths.tolist():
        out.append(np.unique(runs[at : at + n - size + 1] if n >= size else _runs(h[at : at + n], size)) if n else np.empty(0, np.uint64))
        at += n
    return out


def least_values(sets: Iterable[np.ndarray], count: int) -> np.ndarray:
    """One row of PERMUTATIONS 64-bit least values for each of ``count`` sets of hashes; all ones for an empty one."""
    least = np.full((count, PERMUTATIONS), np.iinfo(np.uint64).max, dtype=np.uint64)
    held, owners, size = [], [], 0

    def flush() -> None:
        nonlocal held, owners, size
        if not held:
            return
        x = np.concatenate(held)
        starts = np.cumsum([0, *(len(h) for h in held[:-1])])
        rows = np.array(owners)
        work = np.empty_like(x)
        part = np.empty((PERMUTATIONS, len(held)), dtype=np.uint64)
        for p in range(PERMUTATIONS):
            np.multiply(x, _A[p], out=work)
            np.add(work, _B[p], out=work)
            np.minimum.reduceat(work, starts, out=part[p])
        # a long text comes in several runs, each in a flush of its own
        least[rows] = np.minimum(least[rows], part.T)
        held, owners, size = [], [], 0

    for i, h in enumerate(sets):
        for at in range(0, h.size, RUN):
            if size + min(RUN, h.size - at) > RUN:
                flush()
            held.append(h[at : at + RUN])
            owners.append(i)
            size += len(held[-1])
    flush()
    return least


def signatures(texts: list[str]) -> np.ndarray:
    """One row of PERMUTATIONS 16-bit values per text; all ones for a text without words."""
    return (least_values(map(shingle_hashes, texts), len(texts)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of two signatures; a text without words is like another such text only."""
    same = (a == b).mean(axis=1)
    empty_a, empty_b = (a == 0xFFFF).all(axis=1), (b == 0xFFFF).all(axis=1)
    return np.where(empty_a ^ empty_b, 0.0, same)


def hex_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, key: str, text: str, rows_a_range: int) -> DataFrame:
    """(_range, _place, key, text), sorted so that each row's successor by key follows it in its range.

    The ranges are cut at quantiles of the key.  The first row of each range is
    dealt to the range before it as well, and the first of all to the last, as
    the successor of that range's last row (_place 1).  Only the ranges' first
    keys are gathered, and no text.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("k")).filter("k is not null")
    n = docs.count()
    parts = max(1, min(-(-n // rows_a_range), 50_000))
    cuts = sorted({*(narrow.approxQuantile("k", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else [])})

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([int(c) for c in cuts], dtype=np.int64)
        for batch in batches:
            k = batch.column(0)
            at = np.searchsorted(edges, k.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), k, batch.column(1)], names=["_range", "key", "text"])

    ranged = map_arrow(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), range_of, "_range int, key long, text string")
    firsts = dict(
        map_arrow(docs.select(F.col(key).cast("long").alias("key"), F.lit(None).cast("string").alias("text")), range_of, "_range int, key long, text string")
        .groupBy("_range")
        .agg(F.min(F.struct(F.coalesce(F.col("key"), F.lit(-(1 << 63))).alias("k"))).alias("m"))
        .select("_range", "m.k")
        .collect()
    )
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            extra = [(before[k], i) for i, k in enumerate(-(1 << 63) if k is None else k for k in keys) if k in before]
            rows = pa.array([*range(len(keys)), *(i for _, i in extra)], pa.int64())
            out = batch.take(rows)
            ranges = pa.concat_arrays([batch.column(0), pa.array([r for r, _ in extra], pa.int32())])
            place = pa.array([0] * len(keys) + [1] * len(extra), pa.int32())
            yield pa.RecordBatch.from_arrays([ranges, place, out.column(1), out.column(2)], names=["_range", "_place", "key", "text"])

    dealt = map_arrow(ranged, deal, "_range int, _place int, key long, text string")
    return dealt.repartition(shuffle_partitions(spark), "_range").sortWithinPartitions("_range", "_place", F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_a_range: int = 2_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one that follows by key, after the last the first.
    Null texts count as empty; rows without a key come first and, like repeated
    keys, follow each other by their texts; one row alone is its own successor.
    A text without words has a fingerprint of ones, like that of another such
    text (1) and unlike any other (0).  Keys are whole numbers, named doc_id in the
    result; others are an error.  An empty table gives no rows.
    """
    bound_arrow_batches(docs.sparkSession, records=500)
    dealt = with_next(docs, key, text, rows_a_range)

    def rows(held: list[tuple], following: tuple) -> pa.RecordBatch:
        texts = [h[1] for h in held]
        nexts = [*texts[1:], following[1]]
        edited = [edited_text(t, n) for t, n in zip(texts, nexts, strict=True)]
        own = signatures([*texts, following[1]])
        other = signatures(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([hex_of(s) for s in own[:-1]], pa.string()),
                pa.array([hex_of(s) for s in other], pa.string()),
                pa.array(likeness(own[:-1], other), pa.float64()),
                pa.array(likeness(own[:-1], own[1:]), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for _, place, k, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row = (k, t or "")
                if place:  # the successor of a range's last row; successors of equal key come in order and the first counts
                    if held:
                        yield rows(held, row)
                        held, size = [], 0
                    continue
                if size > 1 << 20:
                    yield rows(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            raise RuntimeError("a range came without its successor")

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(dealt, run, schema)
