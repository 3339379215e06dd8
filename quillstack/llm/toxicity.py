"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries of raw content are chosen from labelled texts.  The ordinary one
holds the words that ordinary texts use in the most contexts.  The toxic one
holds the same and, behind them, the words and word beginnings that toxic texts
use in far more contexts than ordinary ones do.  A context is the distinct word
before, so copies of a text, however many, count as one piece of evidence.

Every window of a text is compressed with both.  Where the toxic dictionary
gives the shorter result, the window holds something of the toxic vocabulary;
how often and by how many bytes, against the number of windows, goes into a
logistic calibration fitted on the same labelled rows.

The fit uses at most ``FIT_ROWS`` labelled rows, those of the smallest hashed
keys; counting their contexts is a Spark aggregation, and the driver holds the
chosen words and one row of numbers per fitted text only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import durable, release
from .arrowtools import bound_arrow_batches, map_arrow, texts_of, with_columns

#: Labelled rows that a model is fitted on at most.
FIT_ROWS = 16_000
#: Distinct contexts from which on a worker passes on what it holds.
HELD_CONTEXTS = 200_000
#: Words of the ordinary dictionary, fragments of the toxic one, and what a fragment has to show.
ORDINARY_WORDS, TOXIC_FRAGMENTS = 6_000, 400
LEAST_CONTEXTS, LEAST_RATIO, LEAST_EVIDENCE = 4, 3.0, 20.0
WINDOW_WORDS = 16
LEVEL = 3
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows_of(text: str, size: int = WINDOW_WORDS) -> list[bytes]:
    words = words_of(text)
    return [f" {' '.join(words[i : i + size])} ".encode() for i in range(0, len(words), size)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights.size:
            return np.full(len(features), self.prior)
        z = np.c_[(features - self.mean) / self.scale, np.ones(len(features))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    out = np.empty(len(windows), dtype=np.int64)
    for at in range(0, len(windows), 10_000):
        packed = compressor.multi_compress_to_buffer(windows[at : at + 10_000], threads=0)
        out[at : at + len(packed)] = [len(packed[i]) for i in range(len(packed))]
    return out


def features_of(texts: list[str], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """One row of numbers per text: how far and how often the toxic dictionary compresses its windows better."""
    each = [windows_of(t) for t in texts]
    flat = [w for ws in each for w in ws]
    gain = _lengths(compressors[0], flat) - _lengths(compressors[1], flat)
    counts = np.array([len(ws) for ws in each])
    owner = np.repeat(np.arange(len(texts)), counts)
    n = np.maximum(counts, 1)
    most = np.zeros(len(texts))
    np.maximum.at(most, owner, gain)
    over = [np.bincount(owner[gain >= least], minlength=len(texts)) for least in (2, 3, 5)]
    total = np.bincount(owner, weights=gain, minlength=len(texts))
    return np.c_[most, *(np.log1p(x) for x in over), *(x / n for x in over), total / n, np.log1p(counts)]


def _feature_frame(rows: DataFrame, model: Model, label: str, text: str) -> DataFrame:
    bound_arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            found = features_of(texts_of(batch, text), compressors)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(label)).cast(pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["label", "features"])

    return map_arrow(rows, run, "label int, features array<double>")


def _contexts(rows: DataFrame, label: str, text: str) -> DataFrame:
    """(label, before, word): the distinct contexts of every word."""
    bound_arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, str, str]] = set()

        def out() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["label", "before", "word"])

        for batch in batches:
            labels = batch.column(batch.schema.get_field_index(label)).to_pylist()
            for y, t in zip(labels, texts_of(batch, text), strict=True):
                words = words_of(t)
                found.update(zip([y] * len(words), ["", *words[:-1]], words, strict=True))
                if len(found) >= HELD_CONTEXTS:
                    yield out()
                    found.clear()
        yield out()

    return map_arrow(rows, run, "label int, before string, word string").distinct()


def train(labelled: DataFrame, label: str = "toxic", text: str = "text") -> Model:
    """A model from rows of (label 0 or 1, text); at most FIT_ROWS of them are meant to be given.

    Null texts count as empty; ties between words go by the word.  Where one label
    is missing, or there are no rows, the model holds no toxic fragments and tells
    nothing apart.
    """
    words = durable(
        _contexts(labelled.select(F.col(label).cast("int").alias("label"), F.col(text).alias("text")), "label", "text")
        .groupBy("word")
        .agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    )
    all_a, all_b = (float(x or 0) for x in words.agg(F.sum("a"), F.sum("b")).first())
    ordinary = [r[0] for r in words.filter("b > 0").orderBy(F.desc("b"), "word").limit(ORDINARY_WORDS).select("word").collect()]
    fragments: list[str] = []
    if all_a and all_b:
        beginnings = [F.when(F.length("word") >= n, F.concat(F.lit(" "), F.substring("word", 1, n - 1))) for n in (5, 6, 7)]
        units = words.select("a", "b", F.explode(F.array_distinct(F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *beginnings)))).alias("unit"))
        a, b, share = F.col("a"), F.col("b"), all_a / (all_a + all_b)
        evidence = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0))
        chosen = (
            units.groupBy("unit")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
            .filter((a >= LEAST_CONTEXTS) & (a / all_a >= LEAST_RATIO * (b + 0.5) / all_b))
            .withColumn("evidence", evidence)
            .filter(F.col("evidence") >= LEAST_EVIDENCE)
            .orderBy(F.desc("evidence"), "unit")
            .limit(TOXIC_FRAGMENTS)
        )
        fragments = [r[0] for r in chosen.select("unit").collect()]
    release(words)
    base = f" {' '.join(reversed(ordinary))} "
    model = Model(base.encode(), (base + "".join(reversed(fragments))).encode())
    rows = _feature_frame(labelled, model, label, text).collect()
    if not rows:
        return model
    y = np.array([r[0] for r in rows], dtype=float)
    x = np.array([r[1] for r in rows], dtype=float)
    model.prior = float(y.mean())
    if 0 < y.sum() < len(y):
        model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        g = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
        w = np.zeros(g.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(g @ w, -60, 60)))
            hessian = (g * (p * (1 - p))[:, None]).T @ g + np.eye(len(w))
            step = np.linalg.solve(hessian, g.T @ (y - p) - w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        model.weights = w
    return model


def held_out(key: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents that are not held out, those of the smallest hashed keys."""
    usable = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter(F.col("_k").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_k"))
    one = usable.groupBy("_k").agg(F.max("_y").alias("_y"))
    chosen = one.orderBy(F.xxhash64("_k"), "_k").limit(rows)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    labelled = durable(texts.join(F.broadcast(chosen), "_k").select("_y", "_t").repartition(12))
    model = train(labelled, "_y", "_t")
    release(labelled)
    return model


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of docs with score (0 to 1) and predicted (1 from THRESHOLD on).

    One pass without a shuffle, over whole texts.  Null and empty texts get the
    score of a text without windows; repeated rows are scored each; an empty
    table gives no rows.  Input columns of the added names are replaced.
    """
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            p = model.score(features_of(texts_of(batch, text), compressors))
            yield with_columns(batch, score=pa.array(p, pa.float64()), predicted=pa.array((p >= THRESHOLD).astype(np.int32), pa.int32()))

    added = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    return map_arrow(docs, run, T.StructType([f for f in docs.schema if f.name not in added] + [T.StructField(k, v) for k, v in added.items()]))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that the model predicts to be toxic, columns as they are.

    Null and empty texts are scored like any other; repeated rows share a fate; an
    empty table stays one.
    """
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            yield batch.filter(pa.array(model.score(features_of(texts_of(batch, text), compressors)) < THRESHOLD))

    return map_arrow(docs, run, docs.schema)


def fit_and_score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    bound_arrow_batches(spark)
    return scores(docs, fit(docs, labels))
