"""A ranking that is kept: pages by the last row seen, out of the files of their range.

A search's scored passages are written once, sorted over all files by similarity
and id, and again by work.  The manifest holds each file range's first row and
number of rows, a line for each range however many rows there are.  A page finds
its range by binary search and reads that range and as many after it as it needs,
so the thousandth page costs what the first one does.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import durable, release
from ..sources.store import Store, Version, bucket_of

Cursor = tuple[float, object]


def _order(similarity: float) -> float:
    """What similarities are ordered by, ascending: their negative, not-a-number before all, as a total order of floats has it."""
    return float("-inf") if similarity != similarity else -similarity + 0.0


class Ranking:
    """Scored passages (id, work, similarity) below a folder; ids are distinct and can be ordered."""

    def __init__(self, spark: SparkSession, root: str, ranges: int = 64):
        self.spark, self.ranges, self.store = spark, ranges, Store(spark, root)

    def _ranged(self, df: DataFrame, name: str) -> tuple[dict[str, str], list[list], int]:
        """df (order, id, ...) in files of ranges; their paths, [bucket, first order, first id, rows before, rows], and how many rows."""
        dealt = df.repartitionByRange(self.ranges, "order", "id").sortWithinPartitions("order", "id").withColumn("bucket", F.spark_partition_id())
        # ranges are sampled, so they are fixed before anything is read off them
        fixed = durable(dealt)
        heads = fixed.groupBy("bucket").agg(F.min(F.struct("order", "id")).alias("f"), F.count("*").alias("n")).select("bucket", "f.order", "f.id", "n").orderBy("order", "id").collect()
        paths = self.store.write(fixed.repartition(self.ranges, "bucket").sortWithinPartitions("bucket", "order", "id"), name)
        release(fixed)
        before, listed = 0, []
        for r in heads:
            listed.append([r["bucket"], None if r["order"] == float("-inf") else r["order"], r["id"], before, r["n"]])
            before += r["n"]
        return paths, listed, before

    def write(self, scored: DataFrame) -> Version:
        """Keeps a search's ranking in the place of the one before."""
        base = self.store.latest()
        order = F.when(F.isnan("similarity"), F.lit(float("-inf"))).otherwise(-F.col("similarity") + F.lit(0.0))
        rows = durable(scored.select("id", "work", "similarity", order.cast("double").alias("order")))
        best = rows.groupBy("work").agg(F.min(F.struct("order", "id", "similarity")).alias("b"), F.count("*").alias("matching")).select("b.order", "b.id", "work", "b.similarity", "matching")
        passages, of_passages, n = self._ranged(rows, "passages")
        works, of_works, n_works = self._ranged(best, "works")
        by_work = self.store.write(rows.withColumn("bucket", bucket_of(F.col("work"), self.ranges)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "work", "order", "id"), "by_work")
        schemas = {"passages": rows.select("id", "work", "similarity", "order").schema, "works": best.schema, "by_work": rows.schema}
        changes = {t: {b: [] for b in base.tables.get(t, {})} | {b: [[base.number + 1, p]] for b, p in found.items()} for t, found in (("passages", passages), ("works", works), ("by_work", by_work))}
        release(rows)
        return self.store.commit(base, changes, schemas, {"passages": of_passages, "works": of_works, "n_passages": n, "n_works": n_works})

    @staticmethod
    def _after(df: DataFrame, after: Cursor | None) -> DataFrame:
        if after is None:
            return df
        order = F.lit(_order(after[0]))
        return df.filter((F.col("order") > order) | ((F.col("order") == order) & (F.col("id") > F.lit(after[1]))))

    def page(self, name: str, after: Cursor | None = None, limit: int = 100, cap: int | None = None) -> tuple[DataFrame, dict]:
        """The rows of ``passages`` or ``works`` after one (similarity, id), best first, with their rank, and the page's numbers.

        With a cap, ranks beyond it are not shown.  numbers: total, returned, and next,
        the cursor of the page after, or null at the end.
        """
        if limit <= 0:
            raise ValueError("a page has at least one row")
        version = self.store.latest()
        listed = version.facts[name]
        total = version.facts[f"n_{name}"] if not cap else min(cap, version.facts[f"n_{name}"])
        keys = [(float("-inf") if r[1] is None else r[1], r[2]) for r in listed]
        at = 0 if after is None else max(0, bisect_right(keys, (_order(after[0]), after[1])) - 1)
        # the range of the cursor, and whole ranges until the page is full whatever that one still holds
        end, rows = at, 0
        while end < len(listed) and (end == at or rows < limit):
            rows += listed[end][4] if end > at or after is None else 0
            end += 1
        part = self.store.read(version, name, [r[0] for r in listed[at:end]])
        before = listed[at][3] if listed else 0
        # a page and the ranges it lies in bound this window
        ranked = part.withColumn("rank", F.row_number().over(Window.orderBy("order", "id")) + F.lit(before))
        found = self._after(ranked, after).filter(F.col("rank") <= total).orderBy("rank").limit(limit).drop("order")
        last = found.agg(F.max("rank").alias("rank"), F.max_by(F.struct("similarity", "id"), "rank").alias("x"), F.count("*").alias("n")).first()
        more = last["n"] and last["rank"] < total
        return found, {"total": total, "returned": last["n"], "next": (last["x"]["similarity"], last["x"]["id"]) if more else None}

    def of_work(self, work, after: Cursor | None = None, limit: int = 100) -> tuple[DataFrame, dict]:
        """The passages of one work after one, best first: drilled down to from a page of works, out of the work's bucket alone."""
        version = self.store.latest()
        bucket = self.spark.range(1).select(bucket_of(F.lit(work).cast(self._kind(version)), self.ranges)).first()[0]
        rows = self.store.read(version, "by_work", [bucket]).filter(F.col("work") == F.lit(work))
        found = self._after(rows, after).orderBy("order", "id").limit(limit + 1).collect()
        shown = found[:limit]
        page = self.spark.createDataFrame(shown, rows.schema).drop("order")
        return page, {"returned": len(shown), "next": (shown[-1]["similarity"], shown[-1]["id"]) if len(found) > limit else None}

    def _kind(self, version: Version):
        return self.store.read(version, "by_work", []).schema["work"].dataType
