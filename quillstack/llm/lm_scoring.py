"""Stupid-backoff scores of documents under the corpus they stand in (operator 4).

Every block of documents counts its distinct n-grams of all orders and sends
(n-gram, count) to the bucket of the n-gram's hash.  The buckets are the count
tables: each sums what all blocks sent and joins the totals back to the rows that
asked.  A block explodes its documents' n-grams again, takes off what the
document itself has, scores each position by the longest n-gram that other
documents have, and sums per document.

An n-gram is known by 64-bit hashes of its words, mixed.  All 64 bits travel.  A
bucket is a range of hashes, so a block's sorted n-grams lie in the order of the
buckets; one sort of a block gives its distinct n-grams and what each row has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtools import answer_buckets, ask_buckets, finish_blocks, pack_blocks, shuffle_partitions, texts_of, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Text in a block. A larger block repeats fewer of the others' n-grams.
BLOCK_BYTES = 8 << 20
#: The key under which every block counts all its words.
ALL_WORDS = np.uint64(0x5851F42D4C957F2D)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted, place): the hashes in order and where each stood; equal ones in the order of their places.

    The upper bits are sorted with the place below them; hashes that agree in those bits are put right afterwards.
    """
    bits = np.uint64(max(1, hashes.size.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = hashes & ~low | np.arange(hashes.size, dtype=np.uint64)
    packed.sort()
    place = (packed & low).astype(np.int64)
    out = hashes[place]
    wrong = np.flatnonzero(out[1:] < out[:-1])
    if wrong.size:
        upper = packed & ~low
        at = np.flatnonzero(np.isin(upper, upper[wrong]))
        right = place[at][np.lexsort((place[at], out[at]))]
        place[at], out[at] = right, hashes[right]
    return out, place


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of the values byte by byte, so that what they share packs well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their first one and the steps after it, with counts."""
    steps = np.diff(keys, prepend=keys[:1])
    widths = [max(1, -(-int(x.max(initial=0)).bit_length() // 8)) for x in (steps, counts)]
    head = np.array([keys.size, *widths], dtype="<u4").tobytes() + keys[:1].astype("<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + _planes(steps, widths[0]) + _planes(counts, widths[1]))


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width, count_width = np.frombuffer(raw, "<u4", 3).tolist()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = 20 + width * n
    return np.cumsum(_from_planes(raw[20:at], width), dtype=np.uint64) + np.frombuffer(raw, "<u8", 1, 12), _from_planes(raw[at:], count_width)


def bucket_starts(buckets: int) -> np.ndarray:
    """The least hash of every bucket: ranges of all 64-bit hashes of nearly one width."""
    return np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)


def log_scores(counts: list[np.ndarray], others: np.ndarray, nth: np.ndarray, backoff: float) -> np.ndarray:
    """The score of each position, from how often other rows have its n-grams of each order.

    An n-gram whose context no other row has is not seen.
    """
    order = len(counts)
    score = np.log(np.maximum(counts[0], 1) / np.maximum(others, 1)) + (order - 1) * np.log(backoff)
    for n in range(1, order):
        context = np.r_[0.0, counts[n - 1][:-1]] if nth.size else np.zeros(0)
        seen = (counts[n] > 0) & (context > 0) & (nth >= n)
        score[seen] = np.log(counts[n][seen] / context[seen]) + (order - 1 - n) * np.log(backoff)
    # a position near the start has no longer n-grams to back off from
    return score - np.maximum(order - 1 - nth, 0) * np.log(backoff)


class Grams:
    """The n-grams of a block: per order, a hash for each position that has one, and the row it is in."""

    def __init__(self, texts: list[str], order: int):
        words, self.lengths = word_hashes(texts)
        total = words.size
        self.row = np.repeat(np.arange(len(texts)), self.lengths)
        #: how many words of the row stand before a position
        self.nth = np.arange(total) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.by_order: list[np.ndarray] = []
        with np.errstate(over="ignore"):
            h = (words ^ _MIX[4]) * _MIX[0]
            self.by_order.append(h ^ h >> np.uint64(31))
            for n in range(1, order):
                # the n words before and the word itself; positions with fewer before them hold nothing of use
                h = (np.r_[self.by_order[-1][:1], self.by_order[-1][:-1]] + np.uint64(n)) * _MIX[n % 4] ^ self.by_order[0]
                h = (h ^ h >> np.uint64(29)) * _MIX[(n + 1) % 4]
                self.by_order.append(h ^ h >> np.uint64(32))
        self.has = [self.nth >= n for n in range(order)]

        #: the hashes of all n-grams, order by order
        self.every = np.concatenate([h[k] for h, k in zip(self.by_order, self.has, strict=True)])

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, counts): the distinct n-grams, sorted, and ALL_WORDS with the number of words."""
        hashes, counts = np.unique(self.every, return_counts=True)
        at = int(np.searchsorted(hashes, ALL_WORDS))
        return np.insert(hashes, at, ALL_WORDS), np.insert(counts, at, self.row.size)

    def others(self, totals: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many words other rows have, and how often they have each n-gram, per order and position.

        ``totals`` are the totals of all rows, in the order of ``counted``.
        """
        hashes, place = ranked(self.every)
        new, end = np.ones(place.size, bool), np.ones(place.size, bool)
        new[1:] = hashes[1:] != hashes[:-1]
        begins = np.flatnonzero(new)
        at = int(np.searchsorted(hashes[begins], ALL_WORDS))
        # within one order of n-grams, places are in the order of the rows
        row = np.concatenate([self.row[k] for k in self.has])[place]
        end[1:] = new[1:] | (row[1:] != row[:-1])
        own = np.diff(np.flatnonzero(end), append=place.size)
        found = np.empty(place.size)
        found[place] = np.repeat(np.delete(totals, at), np.diff(begins, append=place.size)) - np.repeat(own, own)
        counts, done = [], 0
        for has in self.has:
            n = int(has.sum())
            counts.append(np.zeros(has.size))
            counts[-1][has] = found[done : done + n]
            done += n
        return totals[at] - self.lengths[self.row], counts


def document_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(key, n_words, log_score, mean_log_score) for every row.

    Words are the runs between white space, lower-cased.  A position scores
    ln(count / count of its context) by the longest n-gram of up to ``order``
    words that other rows have too, times ``backoff`` for each word shorter; a
    word that no other row has counts as had once, in all other rows' words.
    log_score is the sum over the row's positions, mean_log_score that per word,
    0 without words.  Null texts have no words; a row's copies are other rows;
    an empty table gives no rows; in a corpus of one row every word is unseen.
    """
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    blocks = pack_blocks(docs.select(key, text), text, BLOCK_BYTES)

    def grams_of(table: pa.Table) -> Grams:
        return Grams([t for batch in table.to_batches() for t in texts_of(batch, text)], order)

    starts = bucket_starts(buckets)

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        hashes, counts = grams_of(table).counted()
        begin = [*np.searchsorted(hashes, starts).tolist(), hashes.size]
        for b in range(buckets):
            at = slice(begin[b], begin[b + 1])
            if begin[b] < begin[b + 1]:
                yield b, pack_counts(hashes[at], counts[at])

    def answer(asked: list[bytes]) -> list[bytes]:
        parts = [unpack_counts(x) for x in asked]
        _, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([c for _, c in parts]))
        out = total[place]
        return [zstandard.ZstdCompressor(level=1).compress(out[s : s + k.size].astype("<u8").tobytes()) for s, (k, _) in zip(np.cumsum([0, *(k.size for k, _ in parts[:-1])]), parts, strict=True)]

    def finish(table: pa.Table, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        grams = grams_of(table)
        # buckets are ranges, so their answers in order are those of the sorted n-grams
        totals = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(answers[b]), "<u8") for b in sorted(answers)]).astype(np.float64)
        n_rows = len(grams.lengths)
        others, counts = grams.others(totals)
        score = log_scores(counts, others, grams.nth, backoff)
        total = np.bincount(grams.row, weights=score, minlength=n_rows) if grams.row.size else np.zeros(n_rows)
        yield pa.RecordBatch.from_arrays(
            [table.column(key).combine_chunks(), pa.array(grams.lengths), pa.array(total), pa.array(total / np.maximum(grams.lengths, 1))],
            names=[key, "n_words", "log_score", "mean_log_score"],
        )

    added = [T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())]
    return finish_blocks(blocks, answer_buckets(ask_buckets(blocks, ask), answer), finish, T.StructType([docs.schema[key], *added]))
