"""Alignment of two tokenizers and corpus-wide counts of the id pairs they link (operator 12).

Workers tokenize blocks of documents by a byte-level BPE file (A) and a
sentencepiece model (B) and cut both into groups where their tokens end at the
same byte.  A block writes a row for every document and, for every id pair that
it links, a posting list: the documents and how often each links the pair.  The
lists are shuffled by pair and meet the pairs' counts in a merge join, two sorted
streams that spill; counts are summed on the mapping side first, and the highest
of an A id is taken over its pairs, of which there are no more than B has ids.
Each list then gives its documents' contributions, which are summed by document.
No key is ever one group in memory: a frequent A id is as many keys as it has
partners, and AQE splits a pair that is large in itself.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import durable
from .arrowtools import bound_arrow_batches, map_arrow, texts_of

#: Text of a block, and units that a worker remembers, of so many characters at most.
BLOCK_CHARS, REMEMBERED, REMEMBERED_CHARS = 2 << 20, 150_000, 48
#: Units that are tokenized as one text.
TOGETHER = 128
#: A group of more links than this is counted by distinct ids instead of link by link.
WIDE = 4096
#: A blank between two characters that are no white space: there both tokenizers begin a token.
_BREAK = re.compile(r" (?=\S)(?<=\S )")
_PAIR = 1 << 31


def _default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenizers of a worker, and what it remembers of the units it met.

    A unit is what stands between two breaks; tokens of neither side cross one, so a
    unit gives the same tokens and groups wherever it stands.  An entry is (n_a,
    n_b, n_groups, n_links, text of the groups, pairs, links of each pair), the last
    two as bytes of int64, or None where the joined tokens are not the text.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from .bpe import Vocabulary

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = Vocabulary(path_a).pieces
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Ids as text behind their marks: a group's first A token, further tokens, a group's first B token.
        self.marks = max(len(self.bytes_a), len(self.bytes_b))
        self.told = [mark + str(i) for mark in ";,|" for i in range(self.marks)]
        #: Whether texts may be divided at breaks: no piece goes on behind a blank inside it.
        self.divides = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        """The units of blank + text, each without the blank that begins it."""
        return _BREAK.split(text) if self.divides else [text]

    def entries(self, units: set[str]) -> dict[str, tuple | None]:
        """What is known or now found out of each unit."""
        found, new = {}, []
        for u in units:
            e = self.known.get(u, 0)
            if e == 0:
                e = self.before.get(u, 0)
                if e == 0:
                    new.append(u)
                    continue
                self.known[u] = e
            found[u] = e
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            for u, e in zip(part, self._align(part), strict=True):
                found[u] = e
                if len(u) <= REMEMBERED_CHARS:
                    self.known[u] = e
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        return found

    def _align(self, units: list[str]) -> list[tuple | None]:
        """The entry of each unit. Units without white space at their ends are tokenized many at once, a blank between them: a break."""
        out: list[tuple | None] = [None] * len(units)
        plain = [i for i, u in enumerate(units) if self.divides and u and not u[0].isspace() and not u[-1].isspace()]
        single = sorted(set(range(len(units))) - set(plain)) if len(plain) < len(units) else []
        again = self._align_runs(units, [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)], out)
        self._align_runs(units, [[i] for i in single + [i for run in again for i in run]], out)
        return out

    def _align_runs(self, units: list[str], runs: list[list[int]], out: list[tuple | None]) -> list[list[int]]:
        """Sets the entries of runs of units; returns the runs in which some unit's joined tokens are not its text."""
        if not runs:
            return []
        texts = [" ".join([units[i] for i in run]) for run in runs]
        ids_a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        bad, good = [], []
        for k, (t, x, y) in enumerate(zip(texts, ids_a, ids_b, strict=True)):
            raw = (" " + t).encode()
            same = b"".join(map(self.bytes_a.__getitem__, x)) == raw and b"".join(map(self.bytes_b.__getitem__, y)) == raw
            (good if same else bad).append(k)
        if not good:
            return [runs[k] for k in bad]
        at = [i for k in good for i in runs[k]]
        flat = lambda ids: np.fromiter(chain.from_iterable([ids[k] for k in good]), dtype=np.int64)
        a, b = flat(ids_a), flat(ids_b)
        unit_ends = np.cumsum(np.fromiter((len(units[i].encode()) + 1 for i in at), dtype=np.int64, count=len(at)))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_group = np.searchsorted(unit_ends, ends)
        if not np.isin(unit_ends, ends, assume_unique=True).all():
            raise ValueError("a token goes over a break")
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=ends.size), np.bincount(group_b, minlength=ends.size)
        links = in_a * in_b
        owner = of_group[group_a]  # of each A token
        unit, pair, times = self._pairs(a, b, group_a, in_a, in_b, links, owner, of_group)
        count = lambda weights: np.bincount(of_group, weights, len(at)).astype(np.int64)
        n_a, n_b, n_groups = count(in_a), count(in_b), count(None)
        n_links = np.add.reduceat(links, np.cumsum(n_groups) - n_groups)
        # the text of the groups: each token behind its mark, in the order of groups, A's before B's
        starts = lambda group: np.r_[True, group[1:] != group[:-1]]
        codes = np.empty(a.size + b.size, dtype=np.int64)
        codes[np.arange(a.size) + (np.cumsum(in_b) - in_b)[group_a]] = a + np.where(starts(group_a), 0, self.marks)
        codes[np.arange(b.size) + np.cumsum(in_a)[group_b]] = b + np.where(starts(group_b), 2 * self.marks, self.marks)
        told = list(map(self.told.__getitem__, codes.tolist()))
        cut = [0, *np.cumsum(n_a + n_b).tolist()]
        where = np.searchsorted(unit, np.arange(len(at) + 1)).tolist()
        raw_pair, raw_times = pair.tobytes(), times.tobytes()
        for k, (i, x, y, g, n) in enumerate(zip(at, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True)):
            lo, hi = 8 * where[k], 8 * where[k + 1]
            out[i] = (x, y, g, n, "".join(told[cut[k] : cut[k + 1]]), raw_pair[lo:hi], raw_times[lo:hi])
        return [runs[k] for k in bad]

    @staticmethod
    def _pairs(a, b, group_a, in_a, in_b, links, owner, of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, links) of all groups, sorted by unit; pair is A's id * 2^31 + B's."""
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        narrow = links[group_a] <= WIDE
        each = np.where(narrow, in_b[group_a], 0)  # links of each A token
        first = np.cumsum(each) - each
        other = np.arange(int(each.sum())) + np.repeat(start_b[group_a] - first, each)
        unit, pair, times = [np.repeat(owner, each)], [np.repeat(a, each) * _PAIR + b[other]], [np.ones(other.size, dtype=np.int64)]
        for g in np.flatnonzero(links > WIDE).tolist():
            x, nx = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            pair.append((x[:, None] * _PAIR + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            unit.append(np.full(pair[-1].size, of_group[g]))
        u, p, n = map(np.concatenate, (unit, pair, times))
        order = np.lexsort((p, u))
        u, p, n = u[order], p[order], n[order]
        head = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (p[1:] != p[:-1])]) if u.size else np.empty(0, np.int64)
        return u[head], p[head], np.add.reduceat(n, head) if head.size else n


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _block(al: Aligner, texts: list[str]) -> tuple[dict[str, list], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Columns of a block's documents, and its links as (pair, place of the document, links), sorted."""
    split = [al.units(t) if t else [] for t in texts]
    distinct = set(chain.from_iterable(split))
    entries = al.entries(distinct)
    if any(e is None for e in entries.values()):
        # what is not its own text in parts is judged as a whole
        for i, t in enumerate(texts):
            if any(entries[u] is None for u in split[i]):
                whole = al._align([t])[0]
                split[i] = [] if whole is None else [t]
                entries[t] = whole
        distinct = set(chain.from_iterable(split))
    used = {u: k for k, u in enumerate(distinct)}
    rows = [entries[u] for u in used]
    numbers = np.array([e[:4] for e in rows], dtype=np.int64).reshape(-1, 4)
    told = [e[4] for e in rows]
    counts = np.array([len(u) for u in split], dtype=np.int64)
    place = list(map(used.__getitem__, chain.from_iterable(split)))
    unit = np.array(place, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    before = np.r_[np.zeros((1, 4), np.int64), np.cumsum(numbers[unit], axis=0)]
    ends = np.cumsum(counts)
    sums = (before[ends] - before[ends - counts]).T
    columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), (x.tolist() for x in sums), strict=True))
    cuts = [0, *ends.tolist()]
    columns["groups_sha256"] = [hashlib.sha256("".join([told[k] for k in place[lo:hi]])[1:].encode()).hexdigest() if lo < hi else "" for lo, hi in zip(cuts, cuts[1:])]
    pairs = np.frombuffer(b"".join(e[5] for e in rows), dtype=np.int64)
    times = np.frombuffer(b"".join(e[6] for e in rows), dtype=np.int64)
    n = np.array([len(e[5]) // 8 for e in rows], dtype=np.int64)
    begin = (np.cumsum(n) - n)[unit] if n.size else unit
    each = n[unit] if n.size else unit
    take = np.arange(int(each.sum())) + np.repeat(begin - (np.cumsum(each) - each), each)
    listed, code = np.unique(pairs, return_inverse=True)
    key = code[take] * len(texts) + np.repeat(owner, each)
    order = np.argsort(key)
    key, weight = key[order], times[take][order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.empty(0, np.int64)
    at = key[head]
    return columns, (listed[at // len(texts)], at % len(texts), np.add.reduceat(weight, head) if head.size else weight)


_COLUMNS = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, rows array<long>, links array<long>"


def aligned_blocks(docs: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """A row for each document, (key, row, n_a, n_b, n_groups, n_links, groups_sha256), and for each block's pairs, (pair, rows, links)."""
    bound_arrow_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T._parse_datatype_string(_COLUMNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        kind = None

        def out(keys: list[pa.Array], texts: list[str], first: int) -> Iterator[pa.RecordBatch]:
            columns, (pair, at, links) = _block(al, texts)
            n = len(texts)
            whole = {"key": pa.concat_arrays(keys), "row": pa.array(range(first, first + n), pa.int64())} | {k: pa.array(v) for k, v in columns.items()}
            head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if pair.size else np.empty(0, np.int64)
            cuts = pa.array(np.r_[head, pair.size], pa.int32())
            lists = {"pair": pa.array(pair[head]), "rows": pa.ListArray.from_arrays(cuts, pa.array(at + first)), "links": pa.ListArray.from_arrays(cuts, pa.array(links))}
            types = {"key": kind, "groups_sha256": pa.string(), "rows": pa.list_(pa.int64()), "links": pa.list_(pa.int64())}
            for part, size in ((whole, n), (lists, head.size)):
                full = {f.name: part.get(f.name) if f.name in part else pa.nulls(size, types.get(f.name, pa.int64())) for f in schema}
                for lo in range(0, size, 20_000):
                    yield pa.RecordBatch.from_arrays([x.slice(lo, 20_000) for x in full.values()], names=list(full))

        keys, texts, chars = [], [], 0
        for batch in batches:
            kind = batch.column(0).type
            start, values = 0, texts_of(batch, "text")
            for i, t in enumerate(values):
                texts.append(t)
                chars += len(t)
                if chars >= BLOCK_CHARS:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    yield from out(keys, texts, row)
                    row, start, keys, texts, chars = row + len(texts), i + 1, [], [], 0
            if start < len(values):
                keys.append(batch.column(0).slice(start))
        if texts:
            yield from out(keys, texts, row)

    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether that is the highest count of its A id."""
    counts = postings.groupBy("pair").agg(F.sum(F.size("rows")).alias("n"))
    # a window holds the pairs of one A id, no more than B has ids
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", 31)))
    return counts.select("pair", "n", (F.col("n") == highest).alias("best"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    A text that is null or empty, or that either tokenizer doesn't give back byte
    for byte behind a blank, has zeros and an empty digest and counts in no pair.
    Rows count one by one, whether or not their keys or texts repeat, and rows of a
    null key too; ties for an A id's highest count are all best.  Other columns are
    left out; an empty table gives no rows.
    """
    a, b = _default_paths()
    table = durable(aligned_blocks(docs, key, text, path_a or a, path_b or b))
    postings = table.filter("pair is not null").select("pair", "rows", "links")
    met = postings.hint("merge").join(pair_counts(postings), "pair")
    one = met.select("n", "best", F.explode(F.arrays_zip("rows", "links")).alias("x"))
    sums = one.groupBy(F.col("x.rows").alias("row")).agg(F.sum(F.when(F.col("best"), F.col("x.links")).otherwise(0)).alias("n_best"), F.sum(F.col("x.links") * F.col("n")).alias("count_sum"))
    rows = table.filter("row is not null").join(sums, "row", "left")
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
