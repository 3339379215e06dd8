"""BPE encoding and decoding through a table of distinct words (operator 9).

Spark deals the documents in blocks.  A block splits its texts into pre-tokens
and sends its distinct ones, each to the bucket of its hash; a bucket encodes
every distinct word of the whole corpus once and returns the ids to the blocks
that asked; a block joins them back by position.  Decoding joins ids to pieces,
a table as large as the vocabulary, and glues the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtools import answer_buckets, ask_buckets, finish_blocks, map_arrow, pack_blocks, shuffle_partitions, texts_of
from .bpe import Vocabulary, default_path, vocabulary

#: Text in a block. A larger block repeats fewer of the others' words.
BLOCK_BYTES = 4 << 20


def pack_ragged(lengths: np.ndarray, data: bytes) -> bytes:
    head = np.array([lengths.size], dtype="<u4").tobytes() + lengths.astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + data)


def unpack_ragged(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    return np.frombuffer(raw, dtype="<u4", count=n, offset=4).astype(np.int64), raw[4 + 4 * n :]


def slices(lengths: np.ndarray, data: bytes, width: int = 1) -> list[bytes]:
    ends = np.cumsum(lengths) * width
    return [data[s:e] for s, e in zip((ends - lengths * width).tolist(), ends.tolist(), strict=True)]


def words_by_bucket(words: set[str], buckets: int) -> tuple[list[str], np.ndarray]:
    """The words ordered by bucket and hash, and where each bucket's begin (one more than there are buckets)."""
    listed = sorted(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, listed), dtype=np.uint64, count=len(listed))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return [listed[i] for i in order.tolist()], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _split_block(vocab: Vocabulary, table: pa.Table, text: str) -> tuple[list[list[str]], set[str]]:
    split = [vocab.split(t) for batch in table.to_batches() for t in texts_of(batch, text)]
    return split, set().union(*split) - vocab.special.keys()


def encode_blocks(docs: DataFrame, emit: Callable[[Vocabulary, pa.Table, list[bytes]], pa.RecordBatch], schema, path: str | None = None, text: str = "text") -> DataFrame:
    """Rows that ``emit`` makes of a block's rows and their ids (little-endian unsigned 32-bit, one string of bytes a row)."""
    path = path or default_path()
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    blocks = pack_blocks(docs, text, BLOCK_BYTES)

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        words, begin = words_by_bucket(_split_block(vocabulary(path), table, text)[1], buckets)
        raw = [w.encode() for w in words]
        for b in range(buckets):
            part = raw[begin[b] : begin[b + 1]]
            if part:
                yield b, pack_ragged(np.fromiter(map(len, part), dtype=np.int64, count=len(part)), b"".join(part))

    def answer(asked: list[bytes]) -> list[bytes]:
        known: dict[bytes, int] = {}
        places = []
        for blob in asked:
            found = slices(*unpack_ragged(blob))
            places.append(np.fromiter((known.setdefault(w, len(known)) for w in found), dtype=np.int64, count=len(found)))
        ids, counts = vocabulary(path).merge(list(known))
        starts = np.cumsum(counts) - counts
        out = []
        for at in places:
            n = counts[at]
            ends = np.cumsum(n)
            take = np.arange(int(ends[-1]) if n.size else 0) + np.repeat(starts[at] - (ends - n), n)
            out.append(pack_ragged(n, ids[take].astype("<u4").tobytes()))
        return out

    def finish(table: pa.Table, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        split, distinct = _split_block(vocab, table, text)
        words, begin = words_by_bucket(distinct, buckets)
        ids = {w: np.array([i], dtype="<u4").tobytes() for w, i in vocab.special.items()}
        for b in range(buckets):
            part = words[begin[b] : begin[b + 1]]
            if part:
                counts, data = unpack_ragged(answers[b])
                ids.update(zip(part, slices(counts, data, 4), strict=True))
        yield emit(vocab, table, [b"".join(map(ids.__getitem__, ws)) for ws in split])

    return finish_blocks(blocks, answer_buckets(ask_buckets(blocks, ask), answer), finish, schema)


def decode(vocab: Vocabulary, ids: bytes) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
    return b"".join(map(vocab.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def id_lists(ids: list[bytes]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Every row of docs with token_ids, an array of int. Null counts as empty and has none."""

    def emit(vocab: Vocabulary, table: pa.Table, ids: list[bytes]) -> pa.RecordBatch:
        kept = [x for x in table.schema.names if x != "token_ids"]
        return pa.RecordBatch.from_arrays([*(table.column(x).combine_chunks() for x in kept), id_lists(ids)], names=[*kept, "token_ids"])

    schema = T.StructType([f for f in docs.schema if f.name != "token_ids"] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return encode_blocks(docs, emit, schema, path, text)


def decode_rows(rows: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """Every row with its text decoded from ids; null ids give a null text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            out = [None if x is None else decode(vocab, np.array(x, dtype="<u4").tobytes()) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            kept = [x for x in batch.schema.names if x != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in kept), pa.array(out, pa.string())], names=[*kept, text])

    return map_arrow(rows, run, T.StructType([f for f in rows.schema if f.name != text] + [T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, key: str = "doc_id", path: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row, and token_ids if asked for.

    A null text counts as empty: 0 tokens and the digests of nothing.  Special
    strings inside texts become their one id.  Rows of any key stay, repeated
    ones too; an empty table gives no rows.
    """
    kind = docs.schema[key]

    def emit(vocab: Vocabulary, table: pa.Table, ids: list[bytes]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [
                table.column(key).combine_chunks(),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decode(vocab, x).encode()).hexdigest() for x in ids], pa.string()),
            ],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )
        return pa.RecordBatch.from_arrays([*out.columns, id_lists(ids)], names=[*out.schema.names, "token_ids"]) if with_ids else out

    schema = T.StructType([kind, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
    return encode_blocks(docs.select(key, text), emit, schema, path, text)
