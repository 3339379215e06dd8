"""The incremental index and the request loop as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identifiers import classify_input
from ..operators import incremental
from ..operators.vector_index import Encoder, PassageIndex

#: Bytes that a request may have (fixed value).
REQUEST_BYTES = 1 << 20


def follow_sources(
    spark: SparkSession, incoming: str, root: str, checkpoint: str, title: Callable[[DataFrame], DataFrame] | None = None, encode: Encoder | None = None, model: str | None = None, dimension: int = 0, buckets: int = 64
) -> StreamingQuery:
    """Bring the passage index below ``root`` up to date with JSONL files as they arrive in ``incoming``.

    A micro-batch is one commit of passages, fingerprints and its own number.  One
    that is cut off leaves the version before as it was, and one that is run again
    after its commit changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.jsonl").load(incoming)

    def apply(batch: DataFrame, number: int) -> None:
        key = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
        named = batch.select(key.alias("key"), key.alias("work_title"), F.col("path").alias("source_path"), "content")
        rows = incremental.collect_rows(named if title is None else title(named))
        # the same for every run from one checkpoint, another for another
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        PassageIndex(spark, root, buckets).update(rows, encode, model, dimension, complete=False, batch=(stream, number))

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def responses(requests: DataFrame, *, keep: str | None = None) -> DataFrame:
    """(request, ok, action, kind, id, error) of request frames (value string), and a column to keep; a bad frame is answered, not fatal."""
    kept = [keep] if keep else []
    parsed = F.from_json("value", "action string, input string", {"mode": "PERMISSIVE"})
    r = requests.select(*kept, F.col("value").alias("request"), parsed.alias("r"), F.octet_length("value").alias("n"))
    target = classify_input(F.col("r.input"))
    error = (
        F.when(F.col("n") > REQUEST_BYTES, "the request is too long")
        .when(F.col("r.action").isNull(), "not a request")
        .when(~F.col("r.action").isin("ping", "add"), F.concat(F.lit("unknown action: "), "r.action"))
        .when((F.col("r.action") == "add") & (target["kind"] == "unknown"), "not an input that can be added")
    )
    add = F.col("r.action") == "add"
    return r.select(*kept, "request", error.isNull().alias("ok"), F.col("r.action").alias("action"), F.when(add, target["kind"]).alias("kind"), F.when(add, target["id"]).alias("id"), error.alias("error"))


def unframe(data: bytes) -> list[str]:
    """The texts of length-prefixed frames (32 bits, little-endian); refuses one that is too long or cut."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        if n > REQUEST_BYTES:
            raise ValueError("a frame is too long")
        body = data[at + 4 : at + 4 + n]
        if len(data) < at + 4 or len(body) < n:
            raise ValueError("a frame is cut")
        out.append(body.decode("utf-8"))
        at += 4 + n
    return out
