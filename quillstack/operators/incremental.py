"""Indexes that follow their sources: fingerprints, plans, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonrows import passage
from .catalogue import with_positions


def fingerprint(title, content):
    """SHA-256 of the title, a zero byte and the content."""
    return F.sha2(F.concat(title.cast("binary"), F.lit(b"\x00"), content.cast("binary")), 256)


def collect_rows(files: DataFrame) -> DataFrame:
    """(key, work_title, source_path, fingerprint, line, status, chunk_index, text, headings, pages, raw_json) of JSONL files (key, work_title, source_path, content)."""
    lines = files.select(
        "key", "work_title", "source_path", fingerprint(F.col("work_title"), F.col("content")).alias("fingerprint"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("line", "raw_json")
    )
    return lines.withColumn("p", passage(F.col("raw_json"), F.col("line"))).select("key", "work_title", "source_path", "fingerprint", "line", "p.status", "p.chunk_index", "p.text", "p.headings", "p.pages", "raw_json")


def counters(rows: DataFrame) -> DataFrame:
    """One row: files, chunks, skipped, malformed."""
    status = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.countDistinct("source_path").alias("files"), status("ok").alias("chunks"), status("skipped").alias("skipped"), status("malformed").alias("malformed"))


def sources_of(rows: DataFrame) -> DataFrame:
    return rows.select("source_path", "fingerprint").distinct()


def plan(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_path, action): new, changed, unchanged or deleted, of two tables (source_path, fingerprint)."""
    both = current.select("source_path", F.col("fingerprint").alias("_c")).join(stored.select("source_path", F.col("fingerprint").alias("_s"), F.lit(True).alias("_had")), "source_path", "full_outer")
    action = F.when(F.col("_c").isNull(), "deleted").when(F.col("_had").isNull(), "new").when(F.col("_c").eqNullSafe(F.col("_s")), "unchanged").otherwise("changed")
    return both.select("source_path", action.alias("action"))


def needs_rebuild(meta: dict, model_id: str, force: bool = False) -> bool:
    """Another model, an index without one, or a forced run."""
    return force or meta.get("model_id") != model_id


def healed(current_rows: DataFrame, stored_passages: DataFrame, unknown: DataFrame) -> DataFrame:
    """(source_path, fingerprint) of sources without a stored fingerprint whose stored passages equal the parsed ones, row by row.

    The rows are compared by an order-free digest of (place, content) and their
    number, so no source is gathered in one place.
    """
    fields = ("key", "work_title", "chunk_index", "text", "headings", "pages", "raw_json")

    def digest(df: DataFrame, place: str, name: str) -> DataFrame:
        row = F.xxhash64(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), F.col(place))
        return df.groupBy("source_path").agg(F.struct(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).alias(name))

    parsed = with_place(current_rows.filter("status = 'ok'"), "line")
    held = with_place(stored_passages, "id")
    same = digest(parsed, "_place", "_p").join(digest(held, "_place", "_h"), "source_path").filter("_p = _h")
    return sources_of(current_rows).join(unknown.select("source_path"), "source_path", "left_semi").join(same.select("source_path"), "source_path", "left_semi")


def with_place(rows: DataFrame, order: str) -> DataFrame:
    """_place: the row's number in its source."""
    from pyspark.sql.window import Window

    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("source_path").orderBy(order)))


def adopt(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored fingerprints with those of healed sources."""
    return stored.join(found.select("source_path"), "source_path", "left_anti").unionByName(found.select("source_path", "fingerprint"))


PASSAGE_COLUMNS = ("id", "key", "work_title", "source_path", "chunk_index", "text", "headings", "pages", "raw_json")


def replace_index(rows: DataFrame) -> DataFrame:
    """Passages numbered from 1 by source and line: a whole new index."""
    numbered = with_positions(rows.filter("status = 'ok'").select("key", "work_title", "source_path", "line", "chunk_index", "text", "headings", "pages", "raw_json"), [F.col("source_path"), F.col("line")], "id")
    return numbered.select(*PASSAGE_COLUMNS)


def update_index(stored: DataFrame, rows: DataFrame, actions: DataFrame) -> DataFrame:
    """The next passages: those of changed and deleted sources go, new ones take ids after the last; the others keep theirs."""
    gone = actions.filter(F.col("action").isin("changed", "deleted")).select("source_path")
    fresh = rows.join(actions.filter(F.col("action").isin("changed", "new")).select("source_path"), "source_path", "left_semi")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = replace_index(fresh).withColumn("id", F.col("id") + F.lit(last))
    return stored.join(gone, "source_path", "left_anti").unionByName(added, allowMissingColumns=True)


def upsert(base: DataFrame, delta: DataFrame, key: str = "key") -> DataFrame:
    """Base with the rows of delta in the place of those of the same key."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def refresh_postings(stored: DataFrame, docs: DataFrame, affected: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Stored postings with those of affected keys made anew."""
    from .lexical import postings

    keys = affected.select("key").distinct()
    return stored.join(keys, "key", "left_anti").unionByName(postings(docs.join(keys, "key", "left_semi"), columns))


def summary(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """One row on an index run: counters, embedded_files, embedded_passages, unchanged, removed, up_to_date."""
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    done = actions.agg(n("new", "changed").alias("embedded_files"), n("unchanged").alias("unchanged"), n("deleted").alias("removed"))
    fresh = rows.filter("status = 'ok'").join(actions.filter(F.col("action").isin("new", "changed")).select("source_path"), "source_path", "left_semi").agg(F.count("*").alias("embedded_passages"))
    return counters(rows).crossJoin(F.broadcast(done)).crossJoin(F.broadcast(fresh)).withColumn("up_to_date", (F.col("embedded_files") == 0) & (F.col("removed") == 0))


def index_meta(passages: DataFrame, model_id: str | None, dimension: int | None) -> dict:
    """model_id, dimension and the number of passages; refuses an index without its facts."""
    if not model_id or not dimension:
        raise ValueError("the index has no model or no dimension")
    return {"model_id": model_id, "dimension": dimension, "count": passages.count()}
