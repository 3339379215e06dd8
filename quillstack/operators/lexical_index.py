"""A full-text index that is stored: postings in buckets of terms, in segments that merge.

A posting is a term's places in one work, with the work's length beside it, so a
search reads nothing but the buckets of its terms.  An upsert adds a segment: new
postings in the buckets of the works' own terms and a line for each work; what
older segments hold of these works counts no longer, since only the last segment
that has a work speaks for it.  The numbers of works and of tokens are facts of the
version and are kept up by each change.  ``merge`` rewrites the buckets that hold
several segments or postings that no longer count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..llm.arrowtools import bound_arrow_batches
from ..plans.durable import durable, release
from ..sources.store import Store, Version, bucket_of
from .lexical import COLUMNS, NO_WORD, exact_terms, lexical_documents, normalised, parse_query, score_matches, snippet

#: Places of the columns of a work are so far apart that no phrase goes over a border.
COLUMN_SHIFT = 32


#: Letters of texts that are put together at once.
BLOCK = 4 << 20


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, length, terms, places) of rows (key, texts of tokens between blanks): each work's distinct terms and where they stand."""
    for batch in batches:
        sizes = sum(np.asarray(pc.binary_length(c), dtype=np.int64) for c in batch.columns[1:]).cumsum()
        at = 0
        while at < batch.num_rows:
            # a single longer work is a block of its own
            n = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, "right")) - at, 1)
            yield _grouped_block(batch.slice(at, n))
            at += n


def _grouped_block(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, row, place = [], [], []
    for i, column in enumerate(batch.columns[1:]):
        lists = pc.split_pattern(pc.utf8_trim(column, " "), " ")
        # an empty text has one empty piece
        flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        there = pc.not_equal(flat, "")
        keep = there.to_numpy(zero_copy_only=False)
        words.append(flat.filter(there))
        row.append(of[keep])
        place.append((np.arange(of.size) - starts[of] + (i << COLUMN_SHIFT))[keep])
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    row, place, code = np.concatenate(row).astype(np.int64), np.concatenate(place), coded.indices.to_numpy().astype(np.int64)
    group = row * max(len(coded.dictionary), 1) + code
    # columns come in order, so a stable sort leaves places ascending
    order = np.argsort(group, kind="stable")
    group = group[order]
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: group.size])
    firsts = order[cut]
    of_row = lambda rows: np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
    inner = pa.ListArray.from_arrays(np.r_[cut, group.size].astype(np.int32), pa.array(place[order]))
    terms = pa.ListArray.from_arrays(of_row(row[firsts]), coded.dictionary.take(pa.array(code[firsts])))
    places = pa.ListArray.from_arrays(of_row(row[firsts]), inner)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)), terms, places], names=["key", "length", "terms", "places"])


class LexicalIndex:
    """The index below a folder. Keys are the works' own; columns are text columns of what is indexed."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...] = COLUMNS, key: str = "key", buckets: int = 64):
        self.spark, self.columns, self.key, self.buckets = spark, columns, key, buckets
        self.store = Store(spark, root)

    # ---- what is written

    def _analysed(self, docs: DataFrame, segment: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings (bucket, term, key, segment, length, places) and works (bucket, key, segment, length, touched), and the table they read.

        A work's tokens are all in its row, so they are put together there and no
        token is shuffled by itself. (Arrow: no built-in groups within an array.)
        """
        plain = docs.select(F.col(self.key).alias("key"), *(F.regexp_replace(normalised(F.col(c)), NO_WORD, " ").alias(f"_t{i}") for i, c in enumerate(self.columns)))
        found = T.StructType([plain.schema["key"], *T._parse_datatype_string("length long, terms array<string>, places array<array<bigint>>").fields])
        bound_arrow_batches(self.spark)
        packed = durable(plain.mapInArrow(_grouped, found))
        posting = F.explode(F.arrays_zip("terms", "places"))
        postings = packed.select("key", "length", posting.alias("p")).select(
            bucket_of(F.col("p.terms"), self.buckets).alias("bucket"), F.col("p.terms").alias("term"), "key", F.lit(segment).alias("segment"), "length", F.col("p.places").alias("places")
        )
        touched = F.array_sort(F.array_distinct(F.transform("terms", lambda t: bucket_of(t, self.buckets))))
        works = packed.select(bucket_of(F.col("key"), self.buckets).alias("bucket"), "key", F.lit(segment).alias("segment"), "length", touched.alias("touched"))
        return postings, works, packed

    def _write(self, df: DataFrame, name: str, *order: str) -> dict[str, str]:
        """Rows by bucket, sorted, so that a term's row groups are found by their statistics; AQE splits a large bucket."""
        return self.store.write(df.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order), name)

    def _schemas(self, postings: DataFrame, works: DataFrame) -> dict:
        return {"postings": postings.drop("bucket").schema, "indexed": works.drop("bucket").schema}

    def build(self, docs: DataFrame) -> Version:
        """Indexes docs (key, columns) anew, one row a key; nothing of before counts."""
        base = self.store.latest()
        return self.store.commit(base, *self.built(base, docs))

    def built(self, base: Version, docs: DataFrame) -> tuple[dict, dict, dict]:
        """What a commit on base takes to index docs anew: changes, schemas and facts. The data is written."""
        segment = base.facts.get("segment", 0) + 1
        postings, works, packed = self._analysed(docs, segment)
        paths = {"postings": self._write(postings, "postings", "term", "key"), "indexed": self._write(works, "indexed", "key")}
        release(packed)
        changes = {name: {b: [] for b in base.tables.get(name, {})} | {b: [[segment, p]] for b, p in found.items()} for name, found in paths.items()}
        schemas = self._schemas(postings, works)
        written = [f"{self.store.root}/{p}" for p in paths["indexed"].values()]
        counts = (self.spark.read.schema(schemas["indexed"]).parquet(*written) if written else self.spark.createDataFrame([], schemas["indexed"])).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return changes, schemas, {"segment": segment, "merged": segment, "rows": counts[0], "tokens": counts[1]}

    def _latest(self, works: DataFrame) -> DataFrame:
        """(key, segment, length, touched) of each key's last segment; length is null where the work was deleted."""
        last = F.max_by(F.struct("length", "touched"), "segment")
        return works.groupBy("key").agg(F.max("segment").alias("segment"), last.alias("_l")).select("key", "segment", "_l.*")

    def upsert(self, docs: DataFrame) -> Version:
        """Puts docs (key, columns), one row a key, in the place of what the index has of their keys."""
        base = self._base()
        return self.store.commit(base, *self.changed(base, docs, None))

    def delete(self, keys: DataFrame) -> Version:
        """Takes the works of keys (key) out; unknown keys change nothing."""
        base = self._base()
        return self.store.commit(base, *self.changed(base, None, keys))

    def _base(self) -> Version:
        base = self.store.latest()
        if "segment" not in base.facts:
            raise ValueError("the index is not built")
        return base

    def changed(self, base: Version, docs: DataFrame | None, keys: DataFrame | None) -> tuple[dict, dict, dict]:
        """What a commit on base takes to put docs in or take keys out, so that other tables can change with it."""
        segment = base.facts["segment"] + 1
        if docs is not None:
            postings, works, packed = self._analysed(docs, segment)
        else:
            packed = None
            postings = self.store.read(base, "postings", []).withColumn("bucket", F.lit(0))
            works = keys.select(F.col(self.key).alias("key")).distinct().select(
                bucket_of(F.col("key"), self.buckets).alias("bucket"), "key", F.lit(segment).alias("segment"), F.lit(None).cast("long").alias("length"), F.array().cast("array<int>").alias("touched")
            )
        works = durable(works)
        # only the buckets of these keys are read to know what they had
        of_keys = [r[0] for r in works.select("bucket").distinct().collect()]
        before = self._latest(self.store.read(base, "indexed", of_keys)).join(works.select("key"), "key", "left_semi")
        had = before.agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
        has = works.agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
        changes = {}
        for name, found in (("postings", self._write(postings, "postings", "term", "key") if docs is not None else {}), ("indexed", self._write(works, "indexed", "key"))):
            changes[name] = {b: base.tables.get(name, {}).get(b, []) + [[segment, p]] for b, p in found.items()}
        release(works, *([] if packed is None else [packed]))
        return changes, {}, {"segment": segment, "rows": base.facts["rows"] - had[0] + has[0], "tokens": base.facts["tokens"] - had[1] + has[1]}

    def merge(self) -> Version:
        """Makes one segment of what changed since the last merge: the buckets that hold several, or postings that no longer count."""
        base = self._base()
        segment = base.facts["segment"]
        changed = [int(b) for b, held in base.tables.get("indexed", {}).items() if any(s > base.facts["merged"] for s, _ in held)]
        if not changed:
            return base
        works = self.store.read(base, "indexed", changed)
        latest = durable(self._latest(works))
        # what a replaced or deleted work once touched, and what changed works touch now
        stale = works.join(latest.select("key", F.col("segment").alias("_last")), "key").filter("segment < _last or segment > {}".format(base.facts["merged"]))
        touched = [r[0] for r in stale.select(F.explode("touched")).distinct().collect()]
        alive = self._alive(base, self.store.read(base, "postings", touched)).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        kept = latest.filter("length is not null").withColumn("bucket", bucket_of(F.col("key"), self.buckets))
        paths = {"postings": self._write(alive, "postings", "term", "key"), "indexed": self._write(kept, "indexed", "key")}
        release(latest)
        changes = {name: {str(b): [[segment, paths[name][str(b)]]] if str(b) in paths[name] else [] for b in old} for name, old in (("postings", touched), ("indexed", changed))}
        return self.store.commit(base, changes, {}, {"merged": segment})

    # ---- what is read

    def _alive(self, version: Version, postings: DataFrame) -> DataFrame:
        """Those of the postings that the last segment of their work made."""
        newer = self.store.read(version, "indexed", after=version.facts["merged"])
        if not version.paths("indexed", after=version.facts["merged"]):
            return postings
        last = newer.groupBy("key").agg(F.max("segment").alias("_last"))
        return postings.join(last, "key", "left").filter("_last is null or segment = _last").drop("_last")

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, key, segment, length, places) of the terms that count, out of the terms' buckets alone."""
        version = self._base()
        wanted = sorted(set(terms))
        buckets = {r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket_of(F.col("t"), self.buckets)).collect()} if wanted else set()
        return self._alive(version, self.store.read(version, "postings", buckets).filter(F.col("term").isin(*wanted) if wanted else F.lit(False)))

    def matches(self, phrases: list[list[str]]) -> DataFrame:
        """(key, length, f0, f1, ...) of the works that hold all terms of some phrase: how often each phrase stands in them."""
        found = self.postings([t for p in phrases for t in p]).groupBy("key").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_at"))
        none = F.array().cast("array<bigint>")
        at = lambda t: F.coalesce(F.try_element_at("_at", F.lit(t)), none)

        def often(phrase: list[str]) -> Column:
            starts = at(phrase[0])
            for i, t in enumerate(phrase[1:], 1):
                # starts of the phrase that this word follows
                starts = F.array_intersect(starts, self._shifted(at(t), i))
            return F.size(starts)

        return found.select("key", "length", *(often(p).alias(f"f{j}") for j, p in enumerate(phrases)))

    @staticmethod
    def _shifted(places: Column, by: int) -> Column:
        return F.transform(places, lambda p: p - by)

    def bm25(self, query: str) -> DataFrame:
        """(key, score) of the works that hold every phrase of the query, as ``lexical.bm25`` scores them."""
        phrases = parse_query(self.spark, query)
        version = self._base()
        counted = self.matches(phrases)
        if not phrases:
            return counted.select(F.col("key").alias(self.key), F.lit(0.0).alias("score")).limit(0)
        corpus = counted.agg(
            F.lit(version.facts["rows"]).alias("rows"), F.lit(version.facts["tokens"] / max(version.facts["rows"], 1)).alias("avg_length"), *(F.count_if(F.col(f"f{j}") > 0).alias(f"n{j}") for j in range(len(phrases)))
        )
        return score_matches(counted, corpus, len(phrases), "key").withColumnRenamed("key", self.key)

    def search(self, works: DataFrame, query: str, limit: int | None = None) -> DataFrame:
        """(key, title, authors, year, snippet, score) of the works that match, best first, ties by key."""
        hits = self.bm25(query).orderBy("score", self.key)
        hits = hits if limit is None else hits.limit(limit)
        found = works.select(self.key, "title", "authors", "year").join(hits, self.key)
        phrases = parse_query(self.spark, query)
        return found.select(self.key, "title", "authors", "year", snippet(F.col("title"), phrases).alias("snippet"), "score").orderBy("score", self.key)

    def with_all_terms(self, query: str) -> DataFrame:
        """The keys of works in which every term of the query stands."""
        phrases = [p for t in exact_terms(query, self.spark) for p in parse_query(self.spark, t)]
        counted = self.matches(phrases)
        return counted.filter(" and ".join(f"f{j} > 0" for j in range(len(phrases)))).select(F.col("key").alias(self.key))


def reindex(spark: SparkSession, root: str, works: DataFrame) -> int:
    """Builds the index of all works anew and returns how many there are."""
    return LexicalIndex(spark, root).build(lexical_documents(works)).facts["rows"]


def reindex_works(spark: SparkSession, root: str, works: DataFrame, texts: DataFrame) -> Version:
    """Indexes some works again, each with the text (key, name, text) of its first listed file, or without where that is missing."""
    first = works.withColumn("_name", F.get("files", F.lit(0))).drop("fulltext")
    found = first.join(texts.select("key", F.col("name").alias("_name"), F.col("text").alias("fulltext")), ["key", "_name"], "left")
    return LexicalIndex(spark, root).upsert(lexical_documents(found))
