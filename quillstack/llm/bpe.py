"""Byte-level BPE over numpy arrays: pre-tokens, rank-synchronous merges, token counts.

``token_counts`` is operator 1.  Every worker holds the distinct pre-tokens of a
batch as one ragged array and applies, in each round, the lowest-rank pair of
every sequence at all its places at once, until no sequence has a pair left that
merges.  A merge only ever makes pairs of a higher rank, so this gives what
merging one pair at a time gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrowtools import bound_arrow_batches, map_arrow, texts_of, with_columns

NEVER = np.iinfo(np.int64).max
#: White space as Unicode defines it; the pattern's \\s has to mean the same in every library.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same pattern with the letters, numbers and spaces below U+0250 spelt out, for the faster library.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
_LATIN = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: Words a worker remembers between batches, and the longest it remembers.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


def byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte in the vocabulary file: itself where it prints, else the next of U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _words(text: str) -> list[str]:
    return (_SPLIT if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


class Vocabulary:
    """Tables of a byte-level BPE file; small and fixed, so it travels with the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        stand_in = byte_chars()
        self.first = np.array([ids[stand_in[b]] for b in range(256)], dtype=np.int64)
        back = {c: b for b, c in stand_in.items()}
        self.pieces: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for piece, i in ids.items():
            self.pieces[i] = bytes(back[c] for c in piece)
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while symbols.size:
            rank = np.full(symbols.size, NEVER)
            if symbols.size > 1:
                key = symbols[:-1] << 32 | symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank[:-1] = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NEVER)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(lowest, np.diff(np.r_[starts, symbols.size]))
            stays = lowest == NEVER
            if stays.any():
                done_symbols.append(symbols[stays])
                done_owner.append(owner[stays])
                goes = ~stays
                symbols, owner, rank, lowest = symbols[goes], owner[goes], rank[goes], lowest[goes]
                if not symbols.size:
                    break
            hit = np.flatnonzero(rank == lowest)
            # of hits in a row, which only a pair of equal symbols has, every second one merges
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            nth = np.arange(hit.size) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[nth % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(symbols.size, dtype=bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string stands as one of its own."""
        if self.special_split is None or not any(x in text for x in self.special):
            return _words(text)
        out: list[str] = []
        for i, part in enumerate(self.special_split.split(text)):
            out.extend([part] if i % 2 else _words(part))
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Counter:
    """Token counts of words, remembering those seen."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, dict.fromkeys(vocab.special, 1)

    def counts(self, texts: list[str]) -> list[int]:
        words = [self.vocab.split(t) for t in texts]
        new = list({w for ws in words for w in ws} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict.fromkeys(self.vocab.special, 1)
            new = list({w for ws in words for w in ws} - self.known.keys())
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known.update(zip(part, self.vocab.merge([w.encode() for w in part])[1].tolist(), strict=True))
        known = self.known
        out = [sum(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del known[w]
        return out


_COUNTERS: dict[str, Counter] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, text: str = "text") -> DataFrame:
    """Every row of docs with n_bytes, n_tokens and over_limit (n_tokens > limit).

    One pass without a shuffle.  A null text counts as empty: 0 bytes, 0 tokens,
    false.  Texts of any length are counted whole; repeated rows are counted
    each; an empty table gives no rows.  Input columns of the added names are
    replaced.  The vocabulary file has to be readable at ``path`` on the
    executors.
    """
    spark: SparkSession = docs.sparkSession
    bound_arrow_batches(spark)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(vocabulary(path)))
        for batch in batches:
            texts = texts_of(batch, text)
            n = np.array(counter.counts(texts), dtype=np.int64)
            size = [len(t.encode()) for t in texts]
            yield with_columns(batch, n_bytes=pa.array(size, pa.int64()), n_tokens=pa.array(n), over_limit=pa.array(n > limit))

    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    schema = T.StructType([f for f in docs.schema if f.name not in added] + [T.StructField(k, v) for k, v in added.items()])
    return map_arrow(docs, run, schema)
