"""The request loop with a memory: equal requests in any batches add a work once.

Frames come as files.  A processor with state, keyed by what a request asks for,
remembers what was added for it; requests that it does not know the answer to go
to the library in one run a batch, named by stream and batch, and the outcomes come
back as a second source, so a later trigger knows them; until then the library itself
skips what it has.  What failed is not remembered and may be asked for again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.catalogue import with_positions
from ..operators.importing import Library
from .index import responses, unframe

_OUTCOME = "identity string, status string, key string"
_ANSWER = "origin string, nth long, request string, input string, identity string, ok boolean, action string, status string, key string, error string, ask boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def frames(files: DataFrame) -> DataFrame:
    """(origin, nth, value) of files (path, content) of length-prefixed frames; a file that is cut gives one frame that is no request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = unframe(bytes(content))
                except (ValueError, UnicodeDecodeError):
                    found = [""]
                rows += [(path, i, x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["origin", "nth", "value"])

    return files.select("path", "content").mapInPandas(run, "origin string, nth long, value string")


class Memory(StatefulProcessor):
    """Per thing asked for: whether it was added or is there, and under which key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "status string, key string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows), ignore_index=True)
        for r in whole[whole["outcome"].notna()].itertuples():
            # a work that was added stays known under its key, whatever was asked before that was seen
            if r.outcome == "added" or (r.outcome == "skipped" and not self.known.exists()):
                self.known.update((r.outcome, r.key))
        asked = whole[whole["outcome"].isna()].sort_values(["origin", "nth"])
        known = self.known.get() if self.known.exists() else None
        out = []
        for r in asked.itertuples():
            add = bool(r.ok) and r.action == "add"
            first = add and known is None and not any(x["ask"] for x in out)
            status = None if not add or first else "known" if known is not None else "repeated"
            out.append({"origin": r.origin, "nth": r.nth, "request": r.request, "input": r.input, "identity": key[0], "ok": r.ok, "action": r.action, "status": status, "key": known[1] if add and known is not None else None, "error": r.error, "ask": first})
        if out:
            yield pd.DataFrame(out).astype({"status": object, "key": object})

    def close(self) -> None:
        pass


def serve(spark: SparkSession, incoming: str, root: str, checkpoint: str, answers: Callable[[DataFrame], tuple[DataFrame, DataFrame]], buckets: int = 32) -> StreamingQuery:
    """Answers the frames that arrive in ``incoming`` and adds what they ask for to the library below ``root``/library.

    ``answers`` is given the inputs (pos, input) of a batch and returns what services
    and files say of them, as ``importing.resolve`` takes it.  Responses stand below
    ``root``/responses, a folder a batch: (origin, nth, request, status, keys,
    response), a status of an add being added, skipped, failed, known where an
    earlier batch has it, or repeated where the same batch asks for it before.
    """
    outcomes = f"{root}/outcomes"
    spark.createDataFrame([], _OUTCOME).write.mode("ignore").parquet(f"{outcomes}/batch=none")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(incoming)
    told = responses(frames(files).select("value", F.struct("origin", "nth").alias("at")), keep="at")
    # the identity of a request without one is its text, so that no single key gathers bad frames
    identity = F.coalesce(F.concat_ws(":", "kind", F.lower("id")), F.concat(F.lit("?"), F.sha2("request", 256)))
    identity = F.when(F.col("id").isNull(), F.concat(F.lit("?"), F.sha2("request", 256))).otherwise(identity)
    asked = told.select(identity.alias("identity"), "at.origin", "at.nth", "request", F.get_json_object("request", "$.input").alias("input"), "ok", "action", "error", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("key"))
    back = spark.readStream.schema(_OUTCOME).parquet(f"{outcomes}/*")
    nothing = {"origin": "string", "nth": "long", "request": "string", "input": "string", "ok": "boolean", "action": "string", "error": "string"}
    back = back.select("identity", *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()), F.col("status").alias("outcome"), "key")
    library = Library(spark, f"{root}/library", buckets)

    def apply(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        # the state is read once: what it says is kept for this batch and any rerun of what follows
        batch.write.mode("overwrite").parquet(f"{root}/asked/batch={number}")
        kept = spark.read.schema(batch.schema).parquet(f"{root}/asked/batch={number}")
        wanted = with_positions(kept.filter("ask"), [F.col("origin"), F.col("nth")], "pos").select("pos", "input", "origin", "nth", "identity")
        inputs = wanted.select("pos", "input")
        done = library.add(f"{stream}:{number}", inputs, *answers(inputs)).select("pos", F.col("status").alias("_status"), "keys", F.col("message").alias("_message"))
        done = wanted.drop("input").join(done, "pos")
        done.select("identity", F.col("_status").alias("status"), F.get("keys", F.lit(0)).alias("key")).write.mode("overwrite").parquet(f"{outcomes}/batch={number}")
        out = kept.join(done.drop("identity", "pos"), ["origin", "nth"], "left")
        status = F.coalesce("_status", "status")
        ok = F.col("ok") & F.coalesce(status != "failed", F.lit(True))
        keys = F.coalesce("keys", F.when(F.col("key").isNotNull(), F.array("key")))
        out = out.select("origin", "nth", "request", status.alias("status"), keys.alias("keys"), F.to_json(F.struct(ok.alias("ok"), "action", status.alias("status"), keys.alias("keys"), F.coalesce("error", "_message").alias("error"))).alias("response"))
        out.write.mode("overwrite").parquet(f"{root}/responses/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        remembered = asked.unionByName(back).groupBy("identity").transformWithStateInPandas(Memory(), _ANSWER, "Update", "None")
        return remembered.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
