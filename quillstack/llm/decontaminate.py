"""Benchmark decontamination (operator 5).

The windows of all benchmark items form a hash set that every worker holds; each
document's words are numbered by the benchmark's vocabulary, and where enough
benchmark words stand in a row the window is looked up.  The set holds the words'
numbers themselves, so a hit is an exact match and needs no second look.

The set is broadcast in blocks of items of at most ``BLOCK_TEXT`` bytes of text;
a larger benchmark takes several passes over the documents, one after another, and
each one's hits are merged, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import durable, release
from .arrowtools import bound_arrow_batches, map_arrow, with_columns

WINDOW = 10
#: Bytes of benchmark text in one broadcast set.
BLOCK_TEXT = 8 << 20
#: Bytes that part words: all of ASCII but digits and letters. Upper case folds to lower.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class WindowSet:
    """Windows of benchmark items, by length, over the numbers of their words."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.ids: list[str] = []
        for item_id, text in items:
            words = words_of(text)
            if item_id is None or not words:
                continue
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            place, size = len(self.ids), min(window, len(words))
            self.ids.append(str(item_id))
            found = self.windows.setdefault(size, {})
            for at in range(len(numbers) - size + 1):
                owners = found.setdefault(tuple(numbers[at : at + size]), [])
                if not owners or owners[-1] != place:
                    owners.append(place)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the ids of the items with occurring windows."""
        numbers = np.fromiter(map(self.numbers.get, words, _ZEROS), dtype=np.int64, count=len(words)) if words else np.empty(0, np.int64)
        hit, found = np.zeros(len(words) + 1, dtype=np.int64), set()
        known = np.r_[0, np.cumsum(numbers > 0)]
        for size, windows in self.windows.items():
            if len(words) < size:
                continue
            for at in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                owners = windows.get(tuple(numbers[at : at + size].tolist()))
                if owners:
                    hit[at] += 1
                    hit[at + size] -= 1
                    found.update(self.ids[x] for x in owners)
        return np.cumsum(hit[:-1]) > 0, found


class _Zeros:
    def __iter__(self):
        return iter(int, 1)


_ZEROS = _Zeros()


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most BLOCK_TEXT bytes; one block at a time is on the driver."""
    held, size = [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        held.append((row[0], row[1]))
        size += len((row[1] or "").encode()) + 64
        if size >= BLOCK_TEXT:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every word, in bytes."""
    folded = text.encode().translate(FOLD)
    out, at = [], 0
    for w in folded.split():
        at = folded.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def cut_words(text: str, hit: np.ndarray) -> str:
    """The text without its runs of hit words and what stands between the words of a run."""
    raw, spans = text.encode(), word_spans(text)
    out, at = [], 0
    for i in np.flatnonzero(hit).tolist():
        start, end = spans[i]
        if i and hit[i - 1]:
            at = end
            continue
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]]).decode()


def _free(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, whatever the case."""
    taken = {x.lower() for x in columns}
    while name in taken:
        name = f"_{name}"
    return name


def _passes(docs: DataFrame, benchmark: DataFrame, item: str, text: str, window: int) -> tuple[DataFrame, str, str, str]:
    """docs with the hit words as bits, the ids of the items and the number of words, and the names of these three columns.

    One pass for each block of items.  Every pass but the last is written to the
    shared folder and its set released before the next block is read, so one set is
    alive at a time.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    hit_name, items_name, words_name = (_free(x, docs.columns) for x in ("_hit", "_items", "_words"))
    added = [T.StructField(hit_name, T.BinaryType()), T.StructField(items_name, T.ArrayType(T.StringType())), T.StructField(words_name, T.LongType())]
    schema = T.StructType([*docs.schema, *added])

    def scan(current: DataFrame, one: Broadcast, first: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = one.value
            for batch in batches:
                column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
                texts = column(text)
                before = [(None, [])] * len(texts) if first else list(zip(column(hit_name), column(items_name), strict=True))
                hits, items, counts = [], [], []
                for x, (old, ids) in zip(texts, before, strict=True):
                    words = words_of(x)
                    hit, found = windows.scan(words)
                    if old is not None:
                        hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                        found.update(ids)
                    hits.append(np.packbits(hit).tobytes() if hit.any() else None)
                    items.append(sorted(found))
                    counts.append(len(words))
                yield with_columns(batch, **{hit_name: pa.array(hits, pa.binary()), items_name: pa.array(items, pa.list_(pa.string())), words_name: pa.array(counts, pa.int64())})

        return map_arrow(current, run, schema)

    blocks = item_blocks(benchmark, item, text)
    block, current, first = next(blocks, []), docs, True
    while block is not None:
        one = spark.sparkContext.broadcast(WindowSet(block, window))
        scanned, block = scan(current, one, first), next(blocks, None)
        if block is not None:
            scanned = durable(scanned)
            one.destroy()
            release(current)
        current, first = scanned, False
    return current, hit_name, items_name, words_name


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is ``window`` words in a row of one item; a shorter item that has
    words is one window.  n_hit counts the document's words inside any
    occurrence; the items are those with an occurring window, their digest that
    of the ids sorted as strings and joined by commas.  A null text has no words;
    items without words or id have no windows; repeated items are found under
    each id; an empty benchmark hits nothing.  Input columns of the added names
    are replaced.
    """
    plain = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    scanned, hit_name, items_name, words_name = _passes(plain, benchmark, item, text, window)
    names = [f.name for f in plain.schema]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [0 if x is None else int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in batch.column(batch.schema.get_field_index(hit_name)).to_pylist()]
            items = batch.column(batch.schema.get_field_index(items_name)).to_pylist()
            out = with_columns(
                batch,
                n_words=batch.column(batch.schema.get_field_index(words_name)),
                n_hit=pa.array(bits, pa.int64()),
                n_items=pa.array(list(map(len, items)), pa.int64()),
                items_sha256=pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                contaminated=pa.array([b > 0 for b in bits], pa.bool_()),
            )
            yield out.select([*names, *(f.name for f in added)])

    return map_arrow(scanned, count, T.StructType([*plain.schema, *added]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """docs without benchmark passages: remove="spans" cuts hit words and what lies between them, remove="documents" drops documents with a hit.

    Rows without a hit pass as they are, null texts too, and all rows where the
    benchmark is empty; a column n_chars, where there is one, follows the text.
    Passages that overlap are cut as one.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    scanned, hit_name, *_ = _passes(docs, benchmark, item, text, window)
    if remove == "documents":
        return scanned.filter(F.col(hit_name).isNull()).select(*docs.columns)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            hits = batch.column(batch.schema.get_field_index(hit_name)).to_pylist()
            for i, (x, h) in enumerate(zip(texts, hits, strict=True)):
                if h is not None:
                    texts[i] = cut_words(x, np.unpackbits(np.frombuffer(h, np.uint8), count=len(words_of(x))).astype(bool))
            out = {text: pa.array(texts, pa.string())}
            if "n_chars" in names:
                kept = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
                kind = batch.schema.field("n_chars").type
                out["n_chars"] = pa.array([len(x) if h is not None else k for x, h, k in zip(texts, hits, kept, strict=True)], kind)
            yield with_columns(batch, **out).select(names)

    return map_arrow(scanned, cut, docs.schema)
