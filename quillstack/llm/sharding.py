"""Sharding by best-fit-decreasing bin packing (operator 2).

Equal texts form a group that is never divided.  Groups sorted by size, largest
first, enter the bin with the least room that still holds them; the bins stand
in a balanced tree ordered by remaining room.  Groups of one size are packed as a
run: the tightest bin takes as many as it holds, then the next one, which places
each group where one after another would.  So the driver holds a row for each
distinct size, not for each group: n distinct sizes come from at least n * n / 2
bytes, 14 million of them from 100 TB.  In Spark a group finds its place by its
rank among those of its size, in the order of hash classes and digests.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import durable, release

#: Groups of a size that are ranked in one class, about.
CLASS = 256
#: Rows a shard's slots are numbered in one run.
SLOT_RUN = 4096


class RoomTree:
    """Bins by remaining room: a treap of (room, bin), balanced by hashed priorities."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        return (key[0] * 0x9E3779B97F4A7C15 ^ key[1] * 0xC2B2AE3D27D4EB4F) * 0x165667B19E3779F9 & (1 << 64) - 1

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return (node[0], node[1], node[2], left), right
        left, right = self._split(node[2], key)
        return left, (node[0], node[1], right, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._merge(a[3], b)
        return b[0], b[1], self._merge(a, b[2]), b[3]

    def add(self, room: int, bin_: int) -> None:
        left, right = self._split(self.root, (room, bin_))
        node = ((room, bin_), self._priority((room, bin_)), None, None)
        self.root = self._merge(self._merge(left, node), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) of least room that holds size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            return None
        first = right
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(right, (first[0][0], first[0][1] + 1))
        self.root = self._merge(left, rest)
        return first[0]


def pack_runs(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, count) in the order of packing, for runs (size, count) of falling size.

    None when more than ``most`` bins would be needed.  An item above capacity has a
    bin of its own.
    """
    tree, bins, out = RoomTree(), 0, []
    for size, count in runs:
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            room, place = found
            n = min(count, room // size)
            out.append((size, place, n))
            tree.add(room - n * size, place)
            count -= n
    return out


def near_equal_runs(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """As pack_runs, into at most ``shards`` bins at the least capacity for which best-fit-decreasing needs no more.

    An item of more than a shard's share has a shard of its own, and the rest share
    the others.
    """
    rest, alone, total = list(runs), [], sum(size * n for size, n in runs)
    while rest and len(alone) < shards - 1 and rest[0][0] * (shards - len(alone)) > total:
        size, n = rest[0]
        alone.append((size, len(alone), 1))
        total -= size
        rest[:1] = [(size, n - 1)] if n > 1 else []
    if not rest:
        return alone
    bins = shards - len(alone)
    low, slack = -(-total // bins), 0
    # least room over the share that holds all; the largest item as slack always does
    while (best := pack_runs(rest, low + slack, bins)) is None:
        slack = min(2 * slack + 1, rest[0][0])
    least, slack = (slack + 1) // 2, slack
    while least < slack:
        middle = (least + slack) // 2
        found = pack_runs(rest, low + middle, bins)
        least, slack, best = (least, middle, found) if found else (middle + 1, slack, best)
    return alone + [(size, place + len(alone), n) for size, place, n in best]


def _spread(sizes: list[int], pack) -> list[int] | None:
    """The bin of each item, by a function of the runs of equal sizes."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    found = pack([(size, len(list(same))) for size, same in groupby(sizes[i] for i in order)])
    if found is None:
        return None
    placed = [0] * len(sizes)
    for i, place in zip(order, (place for _, place, n in found for _ in range(n)), strict=True):
        placed[i] = place
    return placed


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; None when more than ``most`` bins would be needed."""
    return _spread(sizes, lambda runs: pack_runs(runs, capacity, most))


def near_equal(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, of nearly equal bytes."""
    return _spread(sizes, lambda runs: near_equal_runs(runs, shards))


def pack_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and slot.

    Returns ``key``, size long (UTF-8 bytes and 1), text_crc32 long, shard int,
    slot long (0 to n-1 in each shard, by key).  Give ``shards`` for so many
    shards of nearly equal bytes, or ``capacity`` for as few shards of at most so
    many bytes as best-fit-decreasing finds.

    A null text counts as empty and belongs with the empty ones; a null key sorts
    first; repeated rows have a slot each; a group above the capacity has a shard
    of its own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = durable(docs.select(F.col(key).alias(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("_group")))
    groups = durable(rows.groupBy("_group").agg(F.sum("size").alias("bytes")))
    runs = sorted(((r[0], r[1]) for r in groups.groupBy("bytes").count().toLocalIterator()), reverse=True)
    packed = near_equal_runs(runs, shards) if capacity is None else pack_runs(runs, capacity)
    frame = pd.DataFrame(packed, columns=["bytes", "shard", "n"], dtype="int64")
    frame["until"] = frame.groupby("bytes")["n"].cumsum()
    segments = spark.createDataFrame(frame.assign(since=frame["until"] - frame["n"])[["bytes", "shard", "since", "until"]], "bytes long, shard int, since long, until long")

    classes = max(1, sum(n for _, n in runs) // CLASS)
    classed = groups.withColumn("_class", F.pmod(F.xxhash64("_group"), F.lit(classes)))
    lower = Window.partitionBy("bytes").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    offsets = classed.groupBy("bytes", "_class").agg(F.count("*").alias("_n")).select("bytes", "_class", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("bytes", "_class").orderBy("_group")) - 1
    ranked = classed.withColumn("_nth", nth).join(offsets, ["bytes", "_class"]).select("_group", "bytes", (F.col("_before") + F.col("_nth")).alias("rank"))
    shard_of = durable(ranked.join(segments, "bytes").filter("rank >= since and rank < until").select("_group", "shard"))
    release(groups)

    n_rows = rows.count()
    slot_runs = max(1, -(-n_rows // (SLOT_RUN * (1 + max((place for _, place, _ in packed), default=0)))))
    dealt = rows.join(shard_of, "_group").select(key, "size", "text_crc32", "shard", F.pmod(F.xxhash64(key, "_group"), F.lit(slot_runs)).alias("_run"))
    counts = dealt.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_run").orderBy(key, "text_crc32")
    numbered = dealt.withColumn("_nth", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "_run"]).select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_nth")).cast("long").alias("slot"))
