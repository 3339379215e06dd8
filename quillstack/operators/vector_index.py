"""The index of passages: chunks with ids and embeddings that follow their sources, source by source.

Passages and the fingerprints of their sources are two tables of one store, in
buckets of source paths, and change in one commit.  An update rewrites the buckets
that hold a new, changed or deleted source; every other passage keeps its file, its
id and its embedding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import durable, release
from ..sources.store import Store, Version, bucket_of
from .catalogue import with_positions
from .incremental import PASSAGE_COLUMNS, healed, needs_rebuild, plan, sources_of, with_place

#: chunks (source_path, place, work_title, text) to (source_path, place, embedding)
Encoder = Callable[[DataFrame], DataFrame]
_TEXT, _LONG = T.StringType(), T.LongType()
PASSAGE = T.StructType([T.StructField(n, k) for n, k in zip((*PASSAGE_COLUMNS, "embedding"), (_LONG, *[_TEXT] * 3, _LONG, _TEXT, T.ArrayType(_TEXT), T.ArrayType(_LONG), _TEXT, T.ArrayType(T.FloatType())), strict=True)])
SOURCE = T.StructType([T.StructField("source_path", _TEXT), T.StructField("fingerprint", _TEXT)])


def paired(chunks: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """chunks (source_path, place, ...) with the embedding of their place.

    It is an error that a chunk has none, that an embedding is left over or comes
    twice, or that it has another dimension.
    """
    one = embeddings.groupBy("source_path", "place").agg(F.first("embedding").alias("embedding"), F.count("*").alias("_n"))
    both = chunks.withColumn("_chunk", F.lit(True)).join(one, ["source_path", "place"], "full_outer")
    where = F.concat(F.lit(" at place "), F.col("place").cast("string"), F.lit(" of "), "source_path")
    refuse = lambda what: F.raise_error(F.concat(F.lit(what), where)).cast("array<float>")
    checked = (
        F.when(F.col("embedding").isNull(), refuse("no embedding of the passage"))
        .when(F.col("_chunk").isNull() | (F.col("_n") > 1), refuse("an embedding too many"))
        .when(F.size("embedding") != dimension, refuse(f"not {dimension} dimensions"))
        .otherwise(F.col("embedding").cast("array<float>"))
    )
    return both.withColumn("embedding", checked).drop("_chunk", "_n")


class PassageIndex:
    """The index below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.buckets, self.store = spark, buckets, Store(spark, root)

    def _read(self, version: Version, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        if not version.number:
            return self.spark.createDataFrame([], {"passages": PASSAGE, "sources": SOURCE}[name])
        return self.store.read(version, name, buckets)

    def passages(self, version: Version | None = None) -> DataFrame:
        """(id, key, work_title, source_path, chunk_index, text, headings, pages, raw_json, embedding)."""
        return self._read(version or self.store.latest(), "passages")

    def sources(self, version: Version | None = None) -> DataFrame:
        """(source_path, fingerprint)."""
        return self._read(version or self.store.latest(), "sources")

    def adopt(self, stored: DataFrame, rows: DataFrame, model: str | None = None, dimension: int = 0) -> Version:
        """Takes over the passages of an older index, which knew no fingerprints, into an empty one.

        stored has the columns of passages.  Sources whose stored passages are what
        rows gives for them get the fingerprint of rows and are not encoded again; the
        next update takes the others as changed or deleted.
        """
        base = self.store.latest()
        if base.number:
            raise ValueError("an older index is taken over into an empty one")
        stored = durable(stored.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PASSAGE)))
        paths = stored.select("source_path").distinct()
        same = healed(rows, stored, paths)
        sources = paths.join(same, "source_path", "left").select("source_path", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
        changes = {}
        for name, df in (("passages", stored.sortWithinPartitions("source_path", "id")), ("sources", sources)):
            found = self.store.write(df.withColumn("bucket", bucket_of(F.col("source_path"), self.buckets)).hint("rebalance", "bucket"), name)
            changes[name] = {b: [[1, p]] for b, p in found.items()}
        n, last = stored.agg(F.count("*"), F.coalesce(F.max("id"), F.lit(0))).first()
        release(stored)
        return self.store.commit(base, changes, {"passages": PASSAGE, "sources": SOURCE}, {"model_id": model, "dimension": dimension, "next_id": last + 1, "count": n})

    def update(
        self, rows: DataFrame, encode: Encoder | None = None, model: str | None = None, dimension: int = 0, complete: bool = True, force: bool = False, batch: tuple[str, int] | None = None
    ) -> Version:
        """Brings the index up to date with rows as ``incremental.collect_rows`` gives them.

        Complete rows are all sources there are, and others are deleted; else they
        are some that came.  A forced run or one of another model makes the index
        anew.  New passages take the next ids in the order of source and line; ids
        are given once, also after deletions, until the index is made anew.  A batch
        (stream, number) that the index has seen changes nothing.
        """
        base = self.store.latest()
        batches = base.facts.get("batches", {})
        if batch and batches.get(batch[0], -1) >= batch[1]:
            return base
        anew = base.number > 0 and needs_rebuild(base.facts, model, force)
        facts = {"model_id": model, "dimension": dimension} | ({"batches": batches | {batch[0]: batch[1]}} if batch else {})
        if anew and not complete:
            raise ValueError("an index of another model is made anew from all sources")
        bucket = bucket_of(F.col("source_path"), self.buckets)
        current = sources_of(rows)
        stored = self._read(base, "sources", [] if anew else None)
        known = stored if complete else stored.join(current.select("source_path"), "source_path", "left_semi")
        actions = durable(plan(current, known).filter("action != 'unchanged'").withColumn("bucket", bucket))
        touched = {r[0] for r in actions.select("bucket").distinct().collect()}
        if anew:
            touched |= {int(b) for name in ("passages", "sources") for b in base.tables.get(name, {})}
        if not touched:
            release(actions)
            return self.store.commit(base, {}, {}, facts) if batch else base
        gone = actions.filter("action in ('changed', 'deleted')").select("source_path")
        came = actions.filter("action in ('changed', 'new')").select("source_path")
        first = 1 if anew else base.facts.get("next_id", 1)

        fresh = rows.filter("status = 'ok'").join(came, "source_path", "left_semi").select(*(c for c in PASSAGE_COLUMNS if c != "id"), "line")
        chunks = with_positions(with_place(fresh, "line").withColumnRenamed("_place", "place"), [F.col("source_path"), F.col("line")], "id")
        chunks = chunks.withColumn("id", F.col("id") + F.lit(first - 1))
        if encode is None:
            chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        else:
            chunks = paired(chunks, encode(chunks.select("source_path", "place", "work_title", "text")), dimension)
        like = lambda df, schema: df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        old = self._read(base, "passages", [] if anew else touched)
        # a source without a fingerprint may have passages all the same
        kept = old.join(actions.select("source_path"), "source_path", "left_anti")
        passages = like(kept, PASSAGE).unionByName(like(chunks, PASSAGE))
        sources = self._read(base, "sources", [] if anew else touched).join(gone, "source_path", "left_anti").unionByName(current.join(came, "source_path", "left_semi"))

        written = {}
        for name, df in (("passages", passages.sortWithinPartitions("source_path", "id")), ("sources", sources)):
            written[name] = self.store.write(df.withColumn("bucket", bucket).hint("rebalance", "bucket"), name)
        release(actions)
        changes = {name: {str(b): [[base.number + 1, found[str(b)]]] if str(b) in found else [] for b in touched} for name, found in written.items()}
        paths = [f"{self.store.root}/{p}" for p in written["passages"].values()]
        now = self.spark.read.schema(PASSAGE).parquet(*paths) if paths else self.spark.createDataFrame([], PASSAGE)
        n, last = now.agg(F.count("*"), F.coalesce(F.max("id"), F.lit(0))).first()
        had = 0 if anew else old.count()
        facts |= {"next_id": max(first, last + 1), "count": (0 if anew else base.facts.get("count", 0)) - had + n}
        return self.store.commit(base, changes, {"passages": PASSAGE, "sources": SOURCE}, facts)
