"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import spread

QUERIES = {}
ORACLES = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES["op1_token_counts"] = op1_token_counts


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .sharding import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op2_sharding"] = op2_sharding


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op3_simhash_dedup"] = op3_simhash_dedup


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES["op5_decontamination"] = op5_decontamination


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_and_score, held_out

    scored = fit_and_score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES["op10_toxicity"] = op10_toxicity


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op6_minhash"] = op6_minhash


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, fold_events, read_back, render, streamed_events

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(read_back(render(fold_events(streamed_events(rows.unionByName(extra))))))


QUERIES["op8_chat_format"] = op8_chat_format


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op9_bpe_codec"] = op9_bpe_codec


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op7_suffix_dedup"] = op7_suffix_dedup


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lm_scoring import document_scores

    found = document_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


QUERIES["op4_lm_scoring"] = op4_lm_scoring
ORACLES["op4_lm_scoring"] = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents
), pos AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM split
), g AS (
  SELECT doc_id, i, ws[i] AS g1,
         CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
         CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3 FROM pos
), c AS (
  SELECT *, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS c1,
         CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) ELSE 0 END AS c2,
         CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) ELSE 0 END AS c3,
         count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others FROM g
), s AS (
  SELECT *, lag(c1) OVER w AS x1, lag(c2) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), p AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / x2) WHEN c2 > 0 THEN ln(c2 / x1) + (CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END)
    ELSE ln(greatest(c1, 1) / greatest(others, 1)) + least(i - 1, 2) * ln(0.4) END AS v FROM s
), t AS (SELECT doc_id, sum(v) AS v, count(*) AS n FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_words, round(coalesce(t.v, 0.0), 4) AS log_score, round(coalesce(t.v / t.n, 0.0), 4) AS mean_log_score FROM documents d LEFT JOIN t USING (doc_id)
"""


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .similar import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("component_id").alias("class_id"))


QUERIES["minhash_near_duplicates"] = minhash_near_duplicates
ORACLES["minhash_near_duplicates"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM split
), nodes AS (
  SELECT sh, min(doc_id) AS low FROM sets GROUP BY sh
), rows AS (
  SELECT low, len(sh) AS n, unnest(sh) AS s FROM nodes
), links AS (
  SELECT x.low AS a, y.low AS b FROM rows x JOIN rows y ON x.s = y.s AND x.low < y.low AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n)
  GROUP BY x.low, y.low, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT low, low FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
), class AS (
  SELECT a AS low, min(b) AS class_id FROM reach GROUP BY a
)
SELECT s.doc_id, c.class_id FROM sets s JOIN nodes n ON n.sh = s.sh JOIN class c ON c.low = n.low
"""


def op11_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .point_in_time import label_versions

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars", "lang")
    return label_versions(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES["op11_point_in_time"] = op11_point_in_time
ORACLES["op11_point_in_time"] = r"""
WITH hashed AS (
  SELECT doc_id, source, n_chars, lang, sha256(doc_id::VARCHAR) AS h FROM documents
), numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS a, ('0x' || h[9:16])::BIGINT AS b, ('0x' || h[17:24])::BIGINT AS c, ('0x' || h[25:32])::BIGINT AS d FROM hashed
), versions AS (
  SELECT doc_id, source, n_chars, lang, a % 50000 AS event, a % 50000 - 60 + b % 600 AS arrival, a % 50000 + c % 900 AS expiry FROM numbers WHERE source IS NOT NULL
), asks AS (
  SELECT row_number() OVER () AS ask, l.doc_id, ('0x' || sha256(l.doc_id::VARCHAR)[25:32])::BIGINT % 50000 AS t, d.source FROM labels l LEFT JOIN documents d USING (doc_id)
), ranked AS (
  SELECT a.ask, a.t, v.*, row_number() OVER (PARTITION BY a.ask ORDER BY v.event DESC, v.arrival, v.doc_id DESC) AS nth
  FROM asks a JOIN versions v ON v.source = a.source AND v.event <= a.t AND v.arrival <= a.t AND a.t < v.expiry
)
SELECT a.doc_id, a.t, r.doc_id AS version_id, a.t - r.event AS age,
       CASE WHEN r.event IS NULL THEN 'none' WHEN a.t - r.event > 120 THEN 'stale' ELSE 'fresh' END AS status,
       CASE WHEN a.t - r.event <= 120 THEN r.n_chars END AS n_chars, CASE WHEN a.t - r.event <= 120 THEN r.lang END AS lang
FROM asks a LEFT JOIN ranked r ON r.ask = a.ask AND r.nth = 1
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op12_alignment"] = op12_alignment


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


QUERIES["op13_warc"] = op13_warc
ORACLES["op13_warc"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
