"""Vector search: cosine ranking, groups by work, pages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .catalogue import page_bounds, with_positions


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector has no length; an error where the dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("double"))
    return checked.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def similarity_to(vector: Column, query: list[float]) -> Column:
    """Cosine against one query by numpy over Arrow batches: the fast path for many rows."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        sizes = vectors.map(len)
        if (sizes != q.size).any():
            raise ValueError(f"a vector has {sizes[sizes != q.size].iloc[0]} dimensions, the query {q.size}")
        rows = np.stack(vectors.to_numpy()).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * norm
        return pd.Series(np.divide(rows @ q, norms, out=np.zeros(len(rows)), where=norms > 0))

    return run(vector)


def query_vector(passages: DataFrame, id_: str, value, vector: str) -> list[float]:
    """The vector of one passage, as a query."""
    row = passages.filter(F.col(id_) == value).select(vector).first()
    if row is None:
        raise KeyError(value)
    return [float(x) for x in row[0]]


def score_passages(passages: DataFrame, query: list[float], id_: str = "id", work: str = "work", vector: str = "embedding", only: DataFrame | None = None) -> DataFrame:
    """(id, work, similarity) of every passage, or of those whose id is in ``only``. The payload stays behind."""
    narrow = passages.select(F.col(id_).alias("id"), F.col(work).alias("work"), F.col(vector).alias("_v"))
    if only is not None:
        narrow = narrow.join(only.select(F.col(id_).alias("id")).distinct(), "id", "left_semi")
    return narrow.select("id", "work", similarity_to(F.col("_v"), query).alias("similarity"))


def top_passages(scored: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """(rank, id, work, similarity): a page of passages, by similarity and id. Spark keeps offset + limit rows a task for it."""
    top = scored.orderBy(F.desc("similarity"), "id").limit(offset + limit)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))  # over at most offset + limit rows
    return top.withColumn("rank", rank).filter(F.col("rank") > offset)


def rank_passages(scored: DataFrame) -> DataFrame:
    """Every passage with its rank, for paging without end."""
    return with_positions(scored, [F.desc("similarity"), F.asc("id")], "rank")


def best_per_work(scored: DataFrame) -> DataFrame:
    """(work, best_id, similarity, matching): each work by its best passage, and how many it has."""
    best = F.max(F.struct(F.col("similarity"), (-F.col("id")).alias("m")))
    return scored.groupBy("work").agg(best.alias("b"), F.count("*").alias("matching")).select("work", (-F.col("b.m")).alias("best_id"), F.col("b.similarity").alias("similarity"), "matching")


def top_works(scored: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of works by their best passages, with rank."""
    top = best_per_work(scored).orderBy(F.desc("similarity"), "best_id").limit(offset + limit)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "best_id"))  # over at most offset + limit rows
    return top.withColumn("rank", rank).filter(F.col("rank") > offset)


def per_work(scored: DataFrame, most: int) -> DataFrame:
    """(work, k, id, similarity): the best passages of every work."""
    if most <= 0:
        raise ValueError("1 passage a work at least")
    k = F.row_number().over(Window.partitionBy("work").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("k", k).filter(F.col("k") <= most).select("work", "k", "id", "similarity")


def work_page(scored: DataFrame, offset: int = 0, limit: int = 100, most: int = 3) -> DataFrame:
    """A page of works with their best passages: rank, work, matching, k, id, similarity."""
    works = top_works(scored, offset, limit).select("rank", "work", "matching")
    return per_work(scored, most).join(F.broadcast(works), "work").select("rank", "work", "matching", "k", "id", "similarity").orderBy("rank", "k")


def work_passages(scored: DataFrame, work, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of one work's passages; refuses a work that there isn't."""
    own = scored.filter(F.col("work") == work)
    if own.isEmpty():
        raise KeyError(work)
    return top_passages(own, offset, limit)


def page_summary(scored: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: total works, total passages, returned, next_offset of a page of works."""
    counts = scored.agg(F.countDistinct("work").alias("total"), F.count("*").alias("total_passages"))
    end = F.least(F.lit(offset + limit), F.col("total"))
    return counts.select("total", "total_passages", F.greatest(end - offset, F.lit(0)).alias("returned"), F.when(end < F.col("total"), end).alias("next_offset"))


def hydrate(page: DataFrame, passages: DataFrame, id_: str = "id") -> DataFrame:
    """A page's rows with the payload of their passages, in the page's order; an id without a passage is an error when the rows are read."""
    found = passages.withColumn("_found", F.lit(True))
    joined = page.withColumnRenamed("id", "_id").join(found, F.col("_id") == F.col(id_), "left")
    missing = F.raise_error(F.concat(F.lit("no passage has the id "), F.col("_id").cast("string")))
    checked = joined.withColumn(id_, F.when(F.col("_found"), F.col(id_)).otherwise(missing.cast(passages.schema[id_].dataType)))
    return checked.select(*passages.columns, *(x for x in page.columns if x != "id")).orderBy("rank")


def check_query(text: str, meta: dict, model_id: str, dimension: int, count: int) -> str:
    """The trimmed query; refuses a blank one, another model, an empty index and another dimension."""
    text = text.strip()
    if not text:
        raise ValueError("the query is blank")
    if meta.get("model_id") != model_id:
        raise ValueError("the index was built with another model; build it again")
    if not count:
        raise ValueError("the index is empty")
    if meta.get("dimension") != dimension:
        raise ValueError(f"the query has {dimension} dimensions, the index {meta.get('dimension')}")
    return text


DEFAULT_PROFILE = {"repository": "default", "revision": "main", "query_template": "{query}", "document_template": "{title}\n{text}", "max_length": 2048, "batch_size": 32, "files": ()}


def model_id(profile: dict) -> str:
    """The identity of an embedding profile; refuses one that can't work."""
    p = DEFAULT_PROFILE | profile
    if not p["repository"].strip() or not p["revision"].strip() or p["max_length"] <= 0 or p["batch_size"] <= 0:
        raise ValueError("a repository, a revision and sizes above 0 are needed")
    if "{query}" not in p["query_template"] or "{text}" not in p["document_template"]:
        raise ValueError("a template lacks its place")
    if any(f.startswith("/") or ".." in f.split("/") for f in p["files"]):
        raise ValueError("a file lies outside the model")
    return "default" if p == DEFAULT_PROFILE else "config:" + json.dumps(p, sort_keys=True)


def hashing_encoder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: words hashed to signed places."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dimension] += 1.0 if h >> 63 else -1.0
        return out

    return encode


def embed(passages: DataFrame, encode: Callable[[list[str]], np.ndarray], dimension: int, template: str = "{title}\n{text}", title: str = "work_title", text: str = "text", batch: int = 32) -> DataFrame:
    """Passages with an embedding of their filled-in template, encoded in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            inputs = [template.replace("{title}", (a or "").strip()).replace("{text}", b or "") for a, b in zip(frame[title], frame[text], strict=True)]
            vectors = [v for at in range(0, len(inputs), batch) for v in encode(inputs[at : at + batch])]
            if len(vectors) != len(inputs) or any(len(v) != dimension for v in vectors):
                raise ValueError("the encoder returned other counts or dimensions than were asked for")
            yield frame.assign(embedding=[np.asarray(v, dtype=np.float32).tolist() for v in vectors])

    names = [f for f in passages.schema if f.name != "embedding"]
    schema = T.StructType([*names, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return passages.select(*(f.name for f in names)).mapInPandas(run, schema)


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    def one(b: bytes | None):
        if b is None:
            return None
        if len(b) % 4:
            raise ValueError("a vector's bytes are no multiple of 4")
        return np.frombuffer(b, dtype="<f4")

    return blobs.map(one)


def validated_page(scored: DataFrame, offset: int, limit: int) -> tuple[DataFrame, dict]:
    """A page of passages and its numbers, both checked."""
    total = scored.count()
    returned, _, following = page_bounds(total, offset, limit)
    return top_passages(scored, offset, limit), {"total": total, "offset": offset, "returned": returned, "next_offset": following}
