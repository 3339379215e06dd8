"""Exact substring dedup over a collection's suffix order (operator 7).

Removed is every byte covered by a string of ``LENGTH`` bytes that also starts in
a document with a smaller id, judged on the input.

Routing.  Every 50-byte window of a document has an anchor, the run of 20 bytes
in it with the least hash; equal windows have equal anchors.  The windows that
share one occurrence of an anchor stand next to each other, so a document falls
into pieces of at most 80 bytes, each with the anchor that all its windows
share, and a window stands in one piece only.  The blocks first ask which of
their anchors occur in more than one document; only pieces of those travel,
each distinct one once per block, with the smallest id that has it.  Of an
anchor of more than ``HOT`` documents not the pieces travel but their windows,
each under its own hash, so that no bucket gathers the surroundings of a passage
that a large part of the corpus has.

Order.  In a bucket, the pieces of an anchor class build their Burrows-Wheeler
transform column by column: each round inserts one more symbol of every piece,
from the end, at the place that the transform so far gives it, in a sequential
rewrite of the array.  When the last symbols are in, the suffixes' places are
walked out of the transform, and neighbours that share a prefix of 50 bytes form
a run; the run's smallest id goes back to everyone who asked.  Only whether a
common prefix reaches 50 is of interest, so that is settled once, between
neighbours of the finished order.  A class of one distinct piece has nothing to
order.  Classes are ordered in batches of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import answer_buckets, ask_buckets, map_arrow, pack_blocks, shuffle_partitions, unpack_table

LENGTH = 50
ANCHOR = 20
#: Documents from which an anchor's windows travel one by one.
HOT = 20_000
#: Pieces that are ordered together, and positions that are hashed together.
BATCH, RUN = 4096, 1 << 18
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_NONE = np.iinfo(np.int64).min


def _hashes(part: np.ndarray) -> np.ndarray:
    """A hash of the 20 bytes from each position."""
    with np.errstate(over="ignore"):
        h = part.astype(np.uint64)
        h += np.uint64(1)
        h = h[:-1] * _P[0] + h[1:]
        four = h[:-2] * _P[1] + h[2:]
        h = four[:-4] * _P[2] + four[4:]
        h = h[:-8] * _P[3] + h[8:]
        h = h[:-4] * _P[4] + four[16:]
        h ^= h >> np.uint64(32)
        h *= _P[1]
        h ^= h >> np.uint64(29)
    return h


def pieces_of(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash, document) of each piece of the concatenated documents."""
    owner = np.repeat(np.arange(lengths.size, dtype=np.int32), lengths)
    last = np.cumsum(lengths) - LENGTH
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, data.size - LENGTH + 1, RUN):
        h = _hashes(data[at : at + RUN + LENGTH - 1])
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(h.size, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:-15], low[15:])
        who = owner[at : at + low.size]
        starts = np.flatnonzero(np.arange(at, at + low.size) <= last[who])
        if not starts.size:
            continue
        place = (low[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        out.append((starts[first] + at, np.diff(np.r_[first, starts.size]), h[place[first]], who[starts[first]]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes() + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 * (n + 1)
    return [raw[s:e] for s, e in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Block:
    """The documents of one block and their pieces."""

    def __init__(self, table: pa.Table, key: str, text: str, buckets: int):
        self.table, self.buckets = table, buckets
        self.raw_texts = [(x or "").encode() for x in table.column(text).to_pylist()]
        self.raw = b"".join(self.raw_texts)
        self.lengths = np.array([len(x) for x in self.raw_texts], dtype=np.int64)
        self.ids = table.column(key).cast(pa.int64()).fill_null(_NONE).to_numpy().astype(np.int64)
        self.start, self.count, self.anchor, self.doc = pieces_of(np.frombuffer(self.raw, np.uint8), self.lengths)
        self.anchors, self.which = np.unique(self.anchor, return_inverse=True)
        bucket = (self.anchors % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.begin = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def ask_shared(self) -> Iterator[tuple[int, bytes]]:
        """The distinct anchors, 40 bits each beside their bucket, and in how many documents here, 255 at most."""
        pairs = np.unique(self.which.astype(np.int64) * max(1, len(self.ids)) + self.doc)
        docs = np.minimum(np.bincount(pairs // max(1, len(self.ids)), minlength=self.anchors.size), 255).astype(np.uint8)
        keys = (self.anchors >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        for b in range(self.buckets):
            at = self.order[self.begin[b] : self.begin[b + 1]]
            if at.size:
                yield b, _pack(np.ascontiguousarray(keys[at]), docs[at])

    def use_shared(self, answers: dict[int, bytes]) -> None:
        """Units of (first window, windows, text) from the answers: pieces of shared anchors, windows of hot ones."""
        status = np.zeros(self.anchors.size, dtype=np.uint8)
        for b, blob in answers.items():
            status[self.order[self.begin[b] : self.begin[b + 1]]] = np.frombuffer(_unpack(blob)[0], np.uint8)
        status = status[self.which] if self.which.size else np.empty(0, np.uint8)
        piece, hot = np.flatnonzero(status == 1), np.flatnonzero(status == 2)
        n = self.count[hot]
        hot_start = np.repeat(self.start[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.unit_start = np.r_[self.start[piece], hot_start]
        self.unit_count = np.r_[self.count[piece], np.ones(hot_start.size, dtype=np.int64)]
        self.unit_doc = np.r_[self.doc[piece], np.repeat(self.doc[hot], n)].astype(np.int64)
        raw, known = self.raw, {}
        ends = (self.unit_start + self.unit_count + LENGTH - 1).tolist()
        found = [raw[s:e] for s, e in zip(self.unit_start.tolist(), ends, strict=True)]
        self.unit_text = np.fromiter((known.setdefault(x, len(known)) for x in found), dtype=np.int64, count=len(found))
        self.texts = list(known)
        self.text_key = np.zeros(len(known), dtype=np.uint64)
        self.text_key[self.unit_text[: piece.size]] = self.anchor[piece]
        for i in np.unique(self.unit_text[piece.size :]).tolist():
            self.text_key[i] = xxhash.xxh64_intdigest(self.texts[i])
        self.text_low = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(self.text_low, self.unit_text, self.ids[self.unit_doc])
        bucket = (self.text_key % np.uint64(self.buckets)).astype(np.int64)
        self.text_order = np.argsort(bucket, kind="stable")
        self.text_begin = np.searchsorted(bucket[self.text_order], np.arange(self.buckets + 1))

    def ask_smallest(self) -> Iterator[tuple[int, bytes]]:
        for b in range(self.buckets):
            at = self.text_order[self.text_begin[b] : self.text_begin[b + 1]]
            if at.size:
                texts = [self.texts[i] for i in at.tolist()]
                yield b, _pack(self.text_key[at], self.text_low[at], np.array(list(map(len, texts)), dtype=np.uint8), b"".join(texts))

    def covered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes of the block go."""
        windows = np.array([len(x) - LENGTH + 1 for x in self.texts], dtype=np.int64)
        begin = np.cumsum(windows) - windows
        low = np.empty(int(windows.sum()), dtype=np.int64)
        for b, blob in answers.items():
            at = self.text_order[self.text_begin[b] : self.text_begin[b + 1]]
            n = windows[at]
            to = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            low[to] = np.frombuffer(_unpack(blob)[0], np.int64)
        n = self.unit_count
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = low[np.repeat(begin[self.unit_text], n) + inside] < np.repeat(self.ids[self.unit_doc], n)
        start = (np.repeat(self.unit_start, n) + inside)[gone]
        edge = np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
        return np.cumsum(edge[:-1]) > 0


def answer_shared(asked: list[bytes]) -> list[bytes]:
    parts = [_unpack(x) for x in asked]
    keys = []
    for raw, _ in parts:
        wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        keys.append(wide.reshape(-1).view("<u8"))
    docs = np.concatenate([np.frombuffer(x, np.uint8) for _, x in parts])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=docs)[place]
    status = np.where(total > HOT, 2, np.where(total >= 2, 1, 0)).astype(np.uint8)
    return [_pack(x) for x in np.split(status, np.cumsum([len(k) for k in keys])[:-1])]


def smallest_by_window(texts: list[bytes], low: np.ndarray) -> np.ndarray:
    """For each window of each text, the smallest ``low`` of all texts that hold an equal window.

    The suffixes of the texts are brought in order by building the transform one
    column a round; equal windows are then neighbours.
    """
    m = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array(list(map(len, texts)), dtype=np.int64)
    ends = np.cumsum(lengths)
    # the transform: the symbol before each suffix so far, from 1 on; 0 before a whole text
    column = data[ends - 1].astype(np.uint16) + np.uint16(1)
    live, place = np.arange(m), np.arange(m)
    j = 0
    while live.size:
        j += 1
        order = np.argsort(column, kind="stable")
        whole = int(np.count_nonzero(column == 0))
        rank = np.empty(order.size, dtype=np.int32)
        rank[order] = np.arange(order.size, dtype=np.int32)
        at = m - whole + rank[place].astype(np.int64)
        more = lengths[live] > j
        symbol = np.zeros(live.size, dtype=np.uint16)
        symbol[more] = data[ends[live[more]] - 1 - j].astype(np.uint16) + np.uint16(1)
        old = np.ones(column.size + live.size, dtype=bool)
        old[at] = False
        grown = np.empty(old.size, dtype=np.uint16)
        grown[old] = column
        grown[at] = symbol
        column = grown
        live, place = live[more], at[more]
    order = np.argsort(column, kind="stable")
    rank = np.empty(order.size, dtype=np.int64)
    rank[order] = np.arange(order.size)
    rank += m - int(np.count_nonzero(column == 0))
    live, place = np.arange(m), np.arange(m)
    places, owners, offsets = [], [], []
    for size in range(1, int(lengths.max()) + 1):
        keep = lengths[live] >= size
        live, place = live[keep], rank[place[keep]]
        if size >= LENGTH:
            places.append(place)
            owners.append(live)
            offsets.append(lengths[live] - size)
    place, owner, offset = (np.concatenate(x) for x in (places, owners, offsets))
    by = np.argsort(place, kind="stable")
    owner, offset = owner[by], offset[by]
    begin = (ends - lengths)[owner] + offset
    fresh = np.ones(owner.size, dtype=bool)
    for s in range(1, owner.size, 1 << 16):
        e = min(owner.size, s + (1 << 16))
        rows = data[begin[s - 1 : e, None] + np.arange(LENGTH)]
        fresh[s:e] = (rows[1:] != rows[:-1]).any(axis=1)
    runs = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(low[owner], runs), np.diff(np.r_[runs, owner.size]))
    windows = lengths - LENGTH + 1
    out = np.empty(int(windows.sum()), dtype=np.int64)
    out[(np.cumsum(windows) - windows)[owner] + offset] = least
    return out


def answer_smallest(asked: list[bytes]) -> list[bytes]:
    known: dict[bytes, int] = {}
    places, keys, lows = [], [], []
    for blob in asked:
        key, low, sizes, data = _unpack(blob)
        ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64))
        found = [data[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        places.append(np.fromiter((known.setdefault(x, len(known)) for x in found), dtype=np.int64, count=len(found)))
        keys.append(np.frombuffer(key, np.uint64))
        lows.append(np.frombuffer(low, np.int64))
    texts = list(known)
    place = np.concatenate(places)
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, place, np.concatenate(lows))
    key = np.zeros(len(texts), dtype=np.uint64)
    key[place] = np.concatenate(keys)
    windows = np.array([len(x) - LENGTH + 1 for x in texts], dtype=np.int64)
    begin = np.cumsum(windows) - windows
    out = np.repeat(low, windows)
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.diff(np.r_[cut, order.size])
    batch: list[np.ndarray] = []

    def settle() -> None:
        at = np.concatenate(batch)
        n = windows[at]
        to = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[to] = smallest_by_window([texts[i] for i in at.tolist()], low[at])
        batch.clear()

    for s, n in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        batch.append(order[s : s + n])
        if sum(map(len, batch)) >= BATCH:
            settle()
    if batch:
        settle()
    answers = []
    for at in places:
        n = windows[at]
        take = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        answers.append(_pack(out[take]))
    return answers


def dedup_blocks(docs: DataFrame, emit: Callable[[Block, np.ndarray], pa.RecordBatch], schema, key: str, text: str) -> DataFrame:
    """Rows that ``emit`` makes of a block and its covered bytes."""
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    blocks = pack_blocks(docs, text)

    def per_block(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(name)).hint("merge")

    shared = answer_buckets(ask_buckets(blocks, lambda table: Block(table, key, text, buckets).ask_shared()), answer_shared)
    told = blocks.join(per_block(shared, "shared"), "block", "left")

    def open_block(payload: pa.Scalar, got: list | None) -> Block:
        block = Block(unpack_table(payload.as_buffer()), key, text, buckets)
        block.use_shared({x["bucket"]: x["answer"] for x in got or []})
        return block

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload, got in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows = list(open_block(payload, got).ask_smallest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "block", "asked"]
                )

    smallest = answer_buckets(map_arrow(told.select("block", "payload", "shared"), ask, "bucket int, block long, asked binary"), answer_smallest)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, got, low in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                block = open_block(payload, got)
                yield emit(block, block.covered({x["bucket"]: x["answer"] for x in low or []}))

    return map_arrow(told.join(per_block(smallest, "smallest"), "block", "left").select("payload", "shared", "smallest"), finish, schema)


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Null texts count as empty; texts of under 50 bytes lose nothing; a null key
    is smaller than any other; rows that share a key take nothing from each
    other; an empty table gives no rows.  Keys are whole numbers, since their order
    decides; others are an error.
    """

    def emit(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        removed, spans, digests = [], [], []
        data = np.frombuffer(block.raw, np.uint8)
        at = 0
        for raw in block.raw_texts:
            mine = gone[at : at + len(raw)]
            n = int(mine.sum())
            removed.append(n)
            spans.append(int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(n > 0 and mine[0]))
            digests.append(hashlib.sha256(data[at : at + len(raw)][~mine].tobytes() if n else raw).hexdigest())
            at += len(raw)
        columns = [block.table.column(key).combine_chunks(), pa.array(block.lengths), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return dedup_blocks(docs.select(key, text), emit, T.StructType([docs.schema[key], *added]), key, text)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the repeated bytes; every row stays, and what is left of a cut character goes too.

    A text that loses nothing stays as it is, null too; a column n_chars, where
    there is one, follows the text.  Keys, ties and empty tables are as in
    ``repeated_bytes``.
    """
    names = docs.columns

    def emit(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        data = np.frombuffer(block.raw, np.uint8)
        texts = block.table.column(text).to_pylist()
        chars = block.table.column("n_chars").to_pylist() if "n_chars" in names else None
        at = 0
        for i, raw in enumerate(block.raw_texts):
            mine = gone[at : at + len(raw)]
            if mine.any():
                texts[i] = data[at : at + len(raw)][~mine].tobytes().decode("utf-8", "ignore")
                if chars:
                    chars[i] = len(texts[i])
            at += len(raw)
        new = {text: pa.array(texts, pa.string())}
        if chars:
            new["n_chars"] = pa.array(chars, block.table.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(x, None) if x in new else block.table.column(x).combine_chunks() for x in names], names=names)

    return dedup_blocks(docs, emit, docs.schema, key, text)
