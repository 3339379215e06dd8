"""The engine's tables as projections of the test tables, each with its counterpart in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """A scan over as many tasks as there are cores, where its files make fewer; for work that is heavy per row."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORKS = """
  'doc-' || doc_id AS key, doc_id,
  CASE WHEN doc_id % 7 = 0 THEN 'book' ELSE 'paper' END AS kind,
  {first_line} AS title,
  CASE WHEN doc_id % 6 = 0 THEN {no_list}
       WHEN doc_id % 6 = 1 THEN {list}('Quill' || doc_id % 17 || ', Ada')
       WHEN doc_id % 6 = 2 THEN {list}('Ada Mae Quill' || doc_id % 17, 'Bo Stack' || doc_id % 5)
       WHEN doc_id % 6 = 3 THEN {list}('Wren' || doc_id % 11 || ' George M.')
       WHEN doc_id % 6 = 4 THEN {list}('Ada Quill' || doc_id % 17, 'Stack, Bo', 'Cy', 'Di Reed' || doc_id % 3)
       ELSE {list}('Ada Quill' || doc_id % 17, 'Bo Stack', 'Cy Fern', 'Di Reed', 'Ed Moss') END AS authors,
  CAST(CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 0 ELSE 2000 + doc_id % 25 END AS INT) AS year,
  CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN doc_id % 2 = 0 THEN '10.1234/Q.' ELSE '10.1234/q.' END) || doc_id % 1260 END AS doi,
  CASE WHEN doc_id % 5 = 0 THEN '2101.' || lpad(CAST(doc_id % 100000 AS {text}), 5, '0') END AS arxiv,
  CASE WHEN doc_id % 4 <> 1 THEN 'Journal of ' || source END AS journal,
  CASE WHEN doc_id % 14 = 0 THEN 'Second' END AS edition,
  CASE WHEN doc_id % 21 = 0 THEN 'Press ' || lang END AS publisher,
  CASE WHEN doc_id % 35 = 0 THEN 'Series ' || lang END AS series,
  CASE WHEN doc_id % 28 = 0 THEN {list}('978-' || doc_id, '979-' || doc_id) ELSE {no_list} END AS isbn,
  CASE WHEN doc_id % 10 = 0 THEN {no_list} WHEN doc_id % 9 = 0 THEN {list}(lang, source, upper(lang), lang) ELSE {list}(lang, source) END AS tags,
  CASE WHEN doc_id % 4 = 0 THEN {no_list} WHEN doc_id % 20 = 3 THEN {list}('doc-' || doc_id || '.pdf', 'notes.txt') ELSE {list}('doc-' || doc_id || '.pdf') END AS files,
  CASE WHEN n_chars > 500 THEN text END AS abstract,
  doc_id % 4 <> 0 AND doc_id % 20 <> 1 AS has_pdf,
  text AS fulltext
"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _WORKS.format(first_line="substring_index(text, '\\n', 1)", no_list="array()", list="array", text="STRING")
    return spark.sql(f"SELECT {sql} FROM {{docs}}", docs=spread(table(spark, sf_dir, "documents")))


#: A CTE of the same rows for DuckDB.
WORKS_SQL = "works AS (SELECT" + _WORKS.format(first_line="split_part(text, chr(10), 1)", no_list="[]::VARCHAR[]", list="list_value", text="VARCHAR") + "FROM documents)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, is_pdf) of the works' files: some are missing, some no PDFs, some of temporary names."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return spark.sql(
        """SELECT 'doc-' || doc_id AS key, explode(array_compact(array(
             CASE WHEN doc_id % 4 <> 0 AND doc_id % 20 <> 1 THEN 'doc-' || doc_id || '.pdf' END,
             CASE WHEN doc_id % 15 = 4 THEN 'tmp' || doc_id || '.pdf' END,
             CASE WHEN doc_id % 40 = 3 THEN 'notes.txt' END))) AS name, doc_id FROM {docs}""",
        docs=docs,
    ).select("key", "name", (F.col("name").endswith(".pdf") & (F.col("doc_id") % 8 != 5)).alias("is_pdf"))


LISTING_SQL = """listing AS (SELECT 'doc-' || doc_id AS key, n.name, n.name LIKE '%.pdf' AND doc_id % 8 <> 5 AS is_pdf FROM documents, LATERAL (
  SELECT 'doc-' || doc_id || '.pdf' AS name WHERE doc_id % 4 <> 0 AND doc_id % 20 <> 1
  UNION ALL SELECT 'tmp' || doc_id || '.pdf' WHERE doc_id % 15 = 4
  UNION ALL SELECT 'notes.txt' WHERE doc_id % 40 = 3) n)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as passages of works."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("work"), F.col("turn").alias("chunk_index"), F.col("role").alias("heading"), "text", F.concat("conv_id", F.lit("#"), "turn").alias("id"))


def jsonl_files(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """(key, work_title, source_path, content): a file of JSON lines for every conversation, under varying names.

    Every seventh turn's line is cut short and so malformed, every eleventh has
    no text; blank lines stand between some.  Edited, some conversations stand
    under another path and others have changed.
    """
    c = spread(table(spark, sf_dir, "conversations")).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    row = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.col("turn").alias("chunk_index"), "text", F.array("role").alias("headings"), F.array(F.col("turn") + 1, F.lit(1)).alias("page_numbers"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.col("text").alias("page_content"), F.struct(F.col("role").alias("section"), F.col("turn").cast("string").alias("page"), F.col("turn").cast("string").alias("chunk_id")).alias("metadata"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.lit("  ").alias("text"), F.col("text").alias("content"), F.col("role").alias("title"), (F.col("turn") + 0.5).alias("id"))))
        .otherwise(F.to_json(F.struct(F.col("role").alias("heading"), F.col("turn").alias("page"))))
    )
    line = F.when((F.col("conv_id") + F.col("turn")) % 7 == 6, F.left(row, F.lit(9))).otherwise(row)
    line = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("\n"), line)).otherwise(line)
    if edited:
        line = F.when(F.col("conv_id") % 5 == 1, F.concat(line, F.lit(" "))).otherwise(line)
    files = c.select("conv_id", F.struct("turn", line.alias("line")).alias("l")).groupBy("conv_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    moved = F.when(F.col("conv_id") % 10 == 3, "moved/") if edited else F.lit(None).cast("string")
    path = F.concat(F.coalesce(moved, F.lit("")), F.lit("conv-"), "conv_id", F.lit("/derived/turns.jsonl"))
    return files.select(F.concat(F.lit("conv-"), "conv_id").alias("key"), F.concat(F.lit("Conversation "), "conv_id").alias("work_title"), path.alias("source_path"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))
