"""Shared plumbing for the operators that run numpy over Arrow batches.

Nothing here keeps more than one block of documents in memory.  A *block* is a
run of rows of one input partition, at most ``block_bytes`` of text (a single
longer document is a block of its own), shipped as one zstd-packed Arrow IPC
buffer.  Block operators follow one pattern: every block asks hash buckets about
its distinct keys, each bucket answers for all blocks that asked, and the
answers go back to the block that sent them, in the order it asked in.  A key
counts once per block, however often it repeats, so a frequent key cannot make
one bucket hot.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
_LANE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def bound_arrow_batches(spark: SparkSession, records: int = 1000, size: str = "4m") -> None:
    """Bound what one Arrow batch holds, so that long documents don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _hand_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), whose workers hand back memory when a task ends."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _hand_back()

    return df.mapInArrow(lean, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): a 64-bit hash of every word of the lower-cased texts, and how many words each text has.

    Arrow takes for white space what ``str.split`` does, and leaves an empty piece where a text begins or ends with it.
    Words of up to 64 bytes are hashed together, eight bytes at a time; longer ones by XXH64.
    """
    pieces = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    words = pieces.values
    begin = np.frombuffer(words.buffers()[1] or b"", np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(begin)
    some = np.flatnonzero(size > 0)
    lengths = np.diff(np.searchsorted(some, pieces.offsets.to_numpy()))
    begin, size = begin[some], size[some].astype(np.uint64)
    data = np.frombuffer(bytes(words.buffers()[2] or b"") + bytes(8), np.uint8)
    eight = np.ndarray((data.size - 7,), "<u8", data, strides=(1,))
    out = (size + np.uint64(1)) * _LANE[2]
    longest = int(size.max(initial=0))
    at = np.arange(some.size)
    for lane in range(0, min(longest, 64), 8):
        if lane:
            at = at[size[at] > lane]
        left = np.minimum(size[at] - np.uint64(lane), 8)
        part = eight[begin[at] + lane] & np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        h = (out[at] ^ part) * _LANE[0]
        h = (h ^ h >> np.uint64(32)) * _LANE[1]
        out[at] = h ^ h >> np.uint64(29)
    if longest > 64:
        for i in np.flatnonzero(size > 64).tolist():
            out[i] = xxhash.xxh64_intdigest(data[begin[i] : begin[i] + int(size[i])], 7)
    return out, lengths


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with further columns; an input column of the same name gives way."""
    kept = [f.name for f in batch.schema if f.name not in columns]
    arrays = [batch.column(batch.schema.get_field_index(x)) for x in kept] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=kept + list(columns))


def _batch_bytes(batch: pa.RecordBatch, text: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.binary_length(column).fill_null(0)
    return np.asarray(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)


def pack_table(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for b in batches:
            writer.write_batch(b)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def unpack_table(payload: bytes) -> pa.Table:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def pack_blocks(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of df as blocks (block long, payload binary), dealt by block."""
    spark = df.sparkSession
    bound_arrow_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, seq = (context.partitionId() if context else 0) << 32, 0
        held: list[pa.RecordBatch] = []
        held_bytes = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([pack_table(held)], pa.binary())], names=["block", "payload"])

        for batch in batches:
            sizes = _batch_bytes(batch, text)
            at = 0
            while at < batch.num_rows:
                room = np.cumsum(sizes[at:]) + held_bytes
                n = int(np.searchsorted(room, block_bytes, side="right"))
                if n == 0 and not held:
                    n = 1
                if n:
                    held.append(batch.slice(at, n))
                    held_bytes = int(room[n - 1])
                    at += n
                if held and (at < batch.num_rows or held_bytes >= block_bytes):
                    yield out()
                    seq, held, held_bytes = seq + 1, [], 0
        if held:
            yield out()

    blocks = map_arrow(df, pack, "block long, payload binary")
    return blocks.repartition(shuffle_partitions(spark), "block")


def ask_buckets(blocks: DataFrame, ask: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(bucket int, block long, asked binary): what each block asks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(ask(unpack_table(payload.as_buffer())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())],
                    names=["bucket", "block", "asked"],
                )

    return map_arrow(blocks.select("block", "payload"), run, "bucket int, block long, asked binary")


def answer_buckets(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block long, bucket int, answer binary): one answer for each row asked.

    A bucket's rows come together in one task, one bucket at a time; buckets are
    hash classes, as many as the caller takes, so that each stays small.
    """
    n = shuffle_partitions(asked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, held = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), pa.array(answer(held), pa.binary())],
                names=["block", "bucket", "answer"],
            )

        for batch in batches:
            for b, block, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket and held:
                    yield out()
                    blocks, held = [], []
                bucket = b
                blocks.append(block)
                held.append(x)
        if held:
            yield out()

    dealt = asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    return map_arrow(dealt, run, "block long, bucket int, answer binary")


def finish_blocks(blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, dict[int, bytes]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Every block with the answers to what it asked, {bucket: answer}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, got in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                yield from finish(unpack_table(payload.as_buffer()), {x["bucket"]: x["answer"] for x in got or []})

    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return map_arrow(blocks.join(per_block.hint("merge"), "block", "left").select("payload", "answers"), run, schema)
