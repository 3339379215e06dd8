"""The registered queries and their DuckDB counterparts.

Ranks and orders are columns, arrays are joined to strings and floating-point
results rounded, so that results compare without regard to the order of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers, math, pages, text
from ..operators import catalogue, duplicates, edits, export, fallback, formula, importing, incremental, layout, lexical, quality, vectors
from ..operators.lexical_index import LexicalIndex
from ..operators.ranking import Ranking
from ..operators.vector_index import PassageIndex
from ..sources import fixtures, library
from ..sources.fixtures import LISTING_SQL, WORKS_SQL, spread, table
from .durable import checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function's name, with SQL where SQL can express it."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.replace("{works}", WORKS_SQL).replace("{listing}", LISTING_SQL)
        return fn

    return register


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/quillstack-{name}-{uuid.uuid4().hex}"


# ---- vectors

_SIM = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS sim FROM e, q)"""


def scored_embeddings(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.score_passages(e, vectors.query_vector(e, "vec_id", 0, "embedding"), "vec_id", "label", only=only)


def _round(df: DataFrame, column: str = "similarity") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS matching FROM s)
SELECT row_number() OVER (ORDER BY sim DESC, vec_id)::INT AS rank, label AS work, vec_id AS best_id, round(sim, 6) AS similarity, matching FROM r WHERE k = 1""")
def vector_top_works(spark, sf_dir):
    return _round(vectors.top_works(scored_embeddings(spark, sf_dir))).select("rank", "work", "best_id", "similarity", "matching")


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id)::INT AS rank FROM s)
SELECT rank, vec_id AS id, label AS work, round(sim, 6) AS similarity FROM r WHERE rank BETWEEN 11 AND 60""")
def vector_top_passages(spark, sf_dir):
    return _round(vectors.top_passages(scored_embeddings(spark, sf_dir), 10, 50)).select("rank", "id", "work", "similarity")


@query(f"WITH {_SIM} SELECT row_number() OVER (ORDER BY sim DESC, vec_id) AS rank, vec_id AS id, label AS work, round(sim, 6) AS similarity FROM s")
def vector_full_ranking(spark, sf_dir):
    return _round(vectors.rank_passages(scored_embeddings(spark, sf_dir))).select("rank", "id", "work", "similarity")


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id)::INT AS k FROM s)
SELECT label AS work, k, vec_id AS id, round(sim, 6) AS similarity FROM r WHERE k <= 3""")
def vector_per_work_topk(spark, sf_dir):
    return _round(vectors.per_work(scored_embeddings(spark, sf_dir), 3))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id)::INT AS k, count(*) OVER (PARTITION BY label) AS matching FROM s),
w AS (SELECT label, row_number() OVER (ORDER BY sim DESC, vec_id)::INT AS rank, matching FROM r WHERE k = 1)
SELECT w.rank, r.label AS work, w.matching, r.k, r.vec_id AS id, round(r.sim, 6) AS similarity FROM r JOIN w USING (label) WHERE r.k <= 2 AND w.rank BETWEEN 3 AND 7""")
def vector_work_page(spark, sf_dir):
    return _round(vectors.work_page(scored_embeddings(spark, sf_dir), 2, 5, 2))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id)::INT AS rank FROM s WHERE label = 3)
SELECT rank, vec_id AS id, round(sim, 6) AS similarity FROM r WHERE rank <= 100""")
def vector_work_passages(spark, sf_dir):
    return _round(vectors.work_passages(scored_embeddings(spark, sf_dir), 3)).select("rank", "id", "similarity")


@query(f"""WITH {_SIM}, t AS (SELECT count(DISTINCT label) AS total, count(*) AS total_passages FROM s)
SELECT total, total_passages, greatest(least(7, total) - 4, 0)::BIGINT AS returned, CASE WHEN 7 < total THEN 7::BIGINT END AS next_offset FROM t""")
def vector_page_summary(spark, sf_dir):
    return vectors.page_summary(scored_embeddings(spark, sf_dir), 4, 3).select("total", "total_passages", F.col("returned").cast("long"), F.col("next_offset").cast("long"))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id)::INT AS rank FROM s)
SELECT rank, vec_id AS id, label AS work, round(sim, 6) AS similarity, false AS drilled FROM r WHERE rank BETWEEN 101 AND 150 UNION ALL
SELECT row_number() OVER (ORDER BY rank)::INT, vec_id, label, round(sim, 6), true FROM r WHERE label = (SELECT label FROM r WHERE rank = 1)""")
def ranking_pages(spark, sf_dir):
    """The third page of a kept ranking, by cursors, and all passages of its first work, page by page."""
    ranking = Ranking(spark, _scratch(spark, "ranking"), ranges=16)
    ranking.write(scored_embeddings(spark, sf_dir))
    after = None
    for _ in range(3):
        page, numbers = ranking.page("passages", after, 50)
        after = numbers["next"]
    first = ranking.page("works", None, 1)[0].first()["work"]
    drilled, after, at = [], None, 0
    while True:
        part, numbers = ranking.of_work(first, after, 1000)
        drilled.append(part.select((F.row_number().over(Window.orderBy(F.desc("similarity"), "id")) + at).alias("rank"), "id", "work", "similarity", F.lit(True).alias("drilled")))
        after, at = numbers["next"], at + numbers["returned"]
        if after is None:
            break
    out = page.select("rank", "id", "work", "similarity", F.lit(False).alias("drilled"))
    for part in drilled:
        out = out.unionByName(part)
    return _round(out)


_TOK = r"list_filter(regexp_split_to_array(lower(strip_accents(coalesce({c}, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def tok(c: str) -> str:
    return _TOK.replace("{c}", c)


@query(f"""WITH {_SIM}, hit AS (SELECT doc_id FROM documents WHERE list_contains({tok("text")}, 'the') AND list_contains({tok("text")}, 'of'))
SELECT row_number() OVER (ORDER BY sim DESC, vec_id) AS rank, vec_id AS id, label AS work, round(sim, 6) AS similarity FROM s WHERE vec_id IN (SELECT doc_id FROM hit)""")
def vector_exact_filtered(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("vec_id"), "text")
    only = lexical.with_all_terms(docs, "the of", ("text",), "vec_id")
    return _round(vectors.rank_passages(scored_embeddings(spark, sf_dir, only))).select("rank", "id", "work", "similarity")


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 20)
SELECT r.rank, r.vec_id AS id, e.label, round(e.embedding[1]::DOUBLE, 6) AS first_value FROM r JOIN embeddings e USING (vec_id)""")
def vector_hydrated_page(spark, sf_dir):
    page = vectors.top_passages(scored_embeddings(spark, sf_dir), 0, 20).select("rank", "id")
    found = vectors.hydrate(page, table(spark, sf_dir, "embeddings"), "vec_id")
    return found.select("rank", F.col("vec_id").alias("id"), "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(list_dot_product(v, v) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(v, v))), 6) AS own FROM e""")
def vector_cosine_expression(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("embedding")), 6).alias("own"))


@query("SELECT vec_id, len(embedding) * 4 AS n_bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_codec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("b", vectors.encode_vector(F.col("embedding")))
    return e.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), F.round(F.aggregate(vectors.decode_vector(F.col("b")), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


# ---- full text

_LEN = f"len({tok('text')})"


def _bm25_sql(terms: list[str], source: str, key: str) -> str:
    counts = ", ".join(f"len(list_filter(ts, lambda x: x = '{t}'))::DOUBLE AS f{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0)::DOUBLE AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((rows - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((rows - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avg_d))" for i in range(len(terms)))
    return f"""t AS ({source}), c AS (SELECT {key}, len(ts) AS d, {counts} FROM t), k AS (SELECT count(*)::DOUBLE AS rows, avg(d) AS avg_d, {dfs} FROM c),
      h AS (SELECT {key}, -({score}) AS score FROM c, k WHERE {" AND ".join(f"f{i} > 0" for i in range(len(terms)))})"""


def _bm25_rank(spark, sf_dir, words: str, source: str, key: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, source))
    if source == "conversations":
        docs = docs.withColumn("id", F.concat("conv_id", F.lit("#"), "turn"))
    return lexical.bm25(docs, words, ("text",), key).select(key, F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(['idiot'], f'SELECT doc_id, {tok('text')} AS ts FROM documents', 'doc_id')} SELECT doc_id, round(score, 6) AS score FROM h")
def bm25_search(spark, sf_dir):
    return _bm25_rank(spark, sf_dir, "Idiot", "documents", "doc_id")


@query(f"WITH {_bm25_sql(['reth', 'that'], f'SELECT doc_id, {tok('text')} AS ts FROM documents', 'doc_id')} SELECT doc_id, round(score, 6) AS score FROM h")
def bm25_two_terms(spark, sf_dir):
    return _bm25_rank(spark, sf_dir, 'reth "that"', "documents", "doc_id")


@query(f"WITH {_bm25_sql(['la', 'que'], f'SELECT conv_id || chr(35) || turn AS id, {tok('text')} AS ts FROM conversations', 'id')} SELECT id, round(score, 6) AS score FROM h")
def bm25_passages(spark, sf_dir):
    return _bm25_rank(spark, sf_dir, "la que", "conversations", "id")


@query(f"WITH {_bm25_sql(['que', 'assistant'], f'SELECT conv_id || chr(35) || turn AS id, list_concat({tok("text")}, {tok("role")}) AS ts FROM conversations', 'id')} SELECT id, round(score, 6) AS score FROM h")
def bm25_passages_headings(spark, sf_dir):
    """Passages by their texts and headings; a word of the query may stand in either."""
    rows = spread(table(spark, sf_dir, "conversations")).select(F.concat("conv_id", F.lit("#"), "turn").alias("id"), "text", F.col("role").alias("headings"))
    return lexical.bm25(rows, "que assistant", ("text", "headings"), "id").select("id", F.round("score", 6).alias("score"))


_LEX_TS = "list_concat(" + tok("title") + ", list_concat(" + tok("array_to_string(authors, '; ')") + ", list_concat(" + tok("abstract") + ", list_concat(" + tok("array_to_string(tags, ', ')") + ", " + tok("fulltext") + "))))"


@query(f"""WITH {{works}}, {_bm25_sql(['quill3', 'ada'], f'SELECT key, {_LEX_TS} AS ts FROM works', 'key')}
SELECT key, w.year, array_to_string(w.authors, '; ') AS authors, round(score, 6) AS score FROM h JOIN works w USING (key)""")
def search_works(spark, sf_dir):
    return lexical.search(fixtures.works(spark, sf_dir), "quill3 ada").select("key", "year", F.array_join("authors", "; ").alias("authors"), F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id, {tok("text")} AS ts FROM documents), p AS (SELECT doc_id, unnest(range(1, len(ts))) AS i, ts FROM t)
SELECT doc_id, count(*) AS n FROM p WHERE ts[i] = 'of' AND ts[i + 1] = 'the' GROUP BY doc_id""")
def phrase_matches(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return lexical.matches(docs, [["of", "the"]], ("text",), "doc_id").filter("f0 > 0").select("doc_id", F.col("f0").cast("long").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, unnest({tok("text")}) AS term FROM documents), r AS (SELECT term, doc_id, count(*) AS n FROM t GROUP BY ALL)
SELECT term, count(*) AS df, sum(n)::BIGINT AS cf FROM r GROUP BY term""")
def postings_stats(spark, sf_dir):
    return lexical.postings_statistics(lexical.postings(spread(table(spark, sf_dir, "documents")), ("text",), "doc_id"), "doc_id")


@query(f"SELECT doc_id, {_LEN} AS length FROM documents")
def doc_lengths(spark, sf_dir):
    return lexical.document_lengths(table(spark, sf_dir, "documents"), ("text",), "doc_id").select("doc_id", F.col("length").cast("long").alias("length"))


@query(r"""WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws, string_split_regex(text, '[\p{L}\p{N}]+') AS seps FROM conversations),
k AS (SELECT *, len(ws) AS n, list_filter(range(len(ws)), lambda i: lower(strip_accents(ws[i + 1])) IN ('the', 'la')) AS hits,
 list_filter(range(len(ws)), lambda i: i = 0 OR regexp_matches(seps[i + 1], '[.:][ \t\n\r]+$')) AS firsts FROM t),
h AS (SELECT *, unnest(hits) AS io FROM k), j AS (SELECT *, list_max(list_filter(firsts, lambda f: f <= io)) AS f FROM h),
w AS (SELECT conv_id, turn, n, ws, hits, io AS pos, 0 AS extra, 2 * io AS nr, 0 AS own FROM j UNION ALL SELECT conv_id, turn, n, ws, hits, f, CASE WHEN f = 0 THEN 120 ELSE 100 END, 2 * io + 1, 1 FROM j WHERE n > 20 AND f < io),
s AS (SELECT *, list_filter(hits, lambda x: x >= pos AND x < pos + 20) AS ins FROM w),
c AS (SELECT conv_id, turn, nr, len(ins) + 999 * len(list_distinct(list_transform(ins, lambda x: lower(strip_accents(ws[x + 1]))))) + extra AS score,
 CASE WHEN own = 1 THEN pos ELSE greatest(least(ins[1] - trunc((20 - (ins[-1] + 1 - ins[1])) / 2.0)::BIGINT, n - 20), 0) END AS first FROM s),
b AS (SELECT conv_id, turn, arg_max(first, score * 1000000 - nr) AS first FROM c GROUP BY conv_id, turn),
o AS (SELECT k.*, coalesce(b.first, 0) AS st, least(coalesce(b.first, 0) + 19, n - 1) AS en FROM k LEFT JOIN b USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN n = 0 THEN text ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || array_to_string(list_transform(range(st, en + 1), lambda i: CASE WHEN i = st AND st > 0 THEN '' ELSE seps[i + 1] END ||
 CASE WHEN list_contains(hits, i) THEN '{{' || ws[i + 1] || '}}' ELSE ws[i + 1] END), '') || CASE WHEN st + 19 >= n - 1 THEN seps[n + 1] ELSE '...' END END AS snippet FROM o""")
def lexical_snippet(spark, sf_dir):
    return spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", lexical.snippet(F.col("text"), [["the"], ["la"]]).alias("snippet"))


@query()
def lexical_snippet_window(spark, sf_dir):
    """Phrases of two words, overlapping ones too; the test holds these against the full-text extension."""
    return spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", lexical.snippet(F.col("text"), [["of", "the"], ["the"]]).alias("snippet"))


# ---- catalogue

_HAY = """lower(key || ' ' || title || ' ' || array_to_string(authors, ' ') || ' ' || array_to_string(tags, ' ') || ' ' || coalesce(doi, '') || ' ' || coalesce(arxiv, '') || ' '
 || coalesce(publisher, '') || ' ' || coalesce(series, '') || ' ' || coalesce(edition, '') || ' ' || array_to_string(isbn, ' '))"""


@query(f"WITH {{works}} SELECT key FROM works WHERE contains({_HAY}, 'quill3')")
def list_substring(spark, sf_dir):
    return catalogue.list_works(fixtures.works(spark, sf_dir), "Quill3").select("key")


@query("WITH {works} SELECT key FROM works WHERE len(list_filter(tags, lambda t: lower(t) IN ('fr', 'src3'))) > 0")
def list_tag_ci(spark, sf_dir):
    return catalogue.list_works(fixtures.works(spark, sf_dir), tags=["FR", "Src3"]).select("key")


@query("WITH {works} SELECT key FROM works WHERE list_has_any(tags, ['FR', 'src3'])")
def export_tag_cs(spark, sf_dir):
    return catalogue.with_any_tag(fixtures.works(spark, sf_dir), ["FR", "src3"]).select("key")


@query("WITH {works} SELECT key FROM works WHERE list_contains(tags, 'de')")
def browse_tag(spark, sf_dir):
    return catalogue.with_tag(fixtures.works(spark, sf_dir), "de").select("key")


_SURNAME = "coalesce(lower(CASE WHEN contains(authors[1], ',') THEN trim(split_part(authors[1], ',', 1)) ELSE list_last(string_split(authors[1], ' ')) END), '')"


@query(f"WITH {{works}} SELECT key, row_number() OVER (ORDER BY {_SURNAME}, key) AS rank FROM works")
def sort_author(spark, sf_dir):
    return catalogue.ranked_by(fixtures.works(spark, sf_dir), "author")


@query("WITH {works} SELECT key, row_number() OVER (ORDER BY coalesce(year, 0) DESC, key) AS rank FROM works")
def sort_year(spark, sf_dir):
    return catalogue.ranked_by(fixtures.works(spark, sf_dir), "year")


@query("WITH {works} SELECT key, row_number() OVER (ORDER BY lower(title), key) AS rank FROM works")
def sort_title(spark, sf_dir):
    return catalogue.ranked_by(fixtures.works(spark, sf_dir), "title")


@query("WITH {works} SELECT key, row_number() OVER (ORDER BY key DESC) AS rank FROM works")
def sort_reverse(spark, sf_dir):
    return catalogue.ranked_by(fixtures.works(spark, sf_dir), "name", reverse=True)


@query("""WITH {works}, t AS (SELECT unnest(tags) AS tag FROM works)
SELECT tag, count(*) AS n FROM t GROUP BY tag UNION ALL SELECT '(all)', count(*) FROM works""")
def tag_facet(spark, sf_dir):
    return catalogue.tag_facet(fixtures.works(spark, sf_dir))


@query("WITH {works} SELECT DISTINCT unnest(tags) AS tag FROM works")
def tag_distinct(spark, sf_dir):
    return catalogue.distinct_tags(fixtures.works(spark, sf_dir))


@query("WITH {works}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM works UNION ALL SELECT '(all)') SELECT tag FROM t WHERE contains(lower(tag), 'e')")
def tag_name_filter(spark, sf_dir):
    return catalogue.tags_like(fixtures.works(spark, sf_dir), "E")


@query("""WITH {works}, r AS (SELECT key, title, year, row_number() OVER (ORDER BY key) AS rank FROM works)
SELECT rank, key || chr(9) || coalesce(year::VARCHAR, '') || chr(9) || title AS line FROM r WHERE rank BETWEEN 101 AND 150""")
def list_page(spark, sf_dir):
    ranked = catalogue.with_positions(fixtures.works(spark, sf_dir).select("key", "title", "year"), [F.col("key").asc()], "rank")
    return catalogue.page(ranked, "rank", 100, 50).select("rank", export.table_line().alias("line"))


@query("WITH {works} SELECT count(*) FILTER (list_contains(tags, 'fr')) AS matched, count(*) AS total FROM works")
def result_counter(spark, sf_dir):
    return catalogue.result_counter(fixtures.works(spark, sf_dir), F.array_contains("tags", "fr"))


def _fuzzy_sql(letters: str) -> str:
    """The best alignment of an atom's letters, a window over the places of each line for every letter."""
    window = "WINDOW w AS (PARTITION BY key ORDER BY j)"
    steps = [f"m0 AS (SELECT *, CASE WHEN c = '{letters[0]}' THEN 16 + 2 * bonus END AS m FROM s)"]
    for n, x in enumerate(letters[1:], 1):
        far = "max(m + j) OVER (PARTITION BY key ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 3 - (j - 2) + bonus"
        steps.append(f"m{n} AS (SELECT key, j, c, bonus, CASE WHEN c = '{x}' THEN 16 + greatest(lag(m) OVER w + greatest(bonus, 4), {far}) END AS m FROM m{n - 1} {window})")
    return ", ".join(steps) + f" SELECT key, greatest(max(m), 0)::BIGINT AS score FROM m{len(letters) - 1} GROUP BY key HAVING max(m) IS NOT NULL"


@query(r"""WITH {works}, d AS (SELECT key, array_to_string(list_filter([CASE WHEN len(authors) > 1 THEN authors[1] || ' et al.' ELSE authors[1] END,
 '(' || year || ')', CASE WHEN title <> '' THEN title END], lambda x: x IS NOT NULL), '  ') AS line FROM works),
p AS (SELECT key, j, line[j] AS ch FROM (SELECT *, unnest(range(1, length(line) + 1)) AS j FROM d)),
k AS (SELECT key, j, strip_accents(lower(ch)) AS c, CASE WHEN regexp_matches(ch, '\s') THEN 0 WHEN contains('/,:;|', ch) THEN 1 WHEN regexp_matches(ch, '\p{Nd}') THEN 5 WHEN NOT regexp_matches(ch, '\p{L}') THEN 2 WHEN lower(ch) <> ch THEN 4 ELSE 3 END AS kind FROM p),
b AS (SELECT *, lag(kind, 1, 0) OVER (PARTITION BY key ORDER BY j) AS prev FROM k),
s AS (SELECT key, j, c, CASE WHEN kind = 0 THEN 10 WHEN kind < 3 THEN 8 WHEN prev = 0 THEN 10 WHEN prev = 1 THEN 9 WHEN prev = 2 THEN 8 WHEN kind = 4 AND prev = 3 THEN 5 WHEN kind = 5 AND prev <> 5 THEN 5 ELSE 0 END AS bonus FROM b),
""" + _fuzzy_sql("adaq"))
def fuzzy_rank(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return catalogue.fuzzy_filter(w, "adaq", text.display_line(F.col("authors"), F.col("year"), F.col("title"))).select("key", "score")


@query("""WITH {works} SELECT key, array_to_string(list_filter([CASE WHEN len(authors) > 1 THEN authors[1] || ' et al.' ELSE authors[1] END,
 '(' || year || ')', CASE WHEN title <> '' THEN title END], lambda x: x IS NOT NULL), '  ') AS line FROM works""")
def display_line(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", text.display_line(F.col("authors"), F.col("year"), F.col("title")).alias("line"))


@query("""WITH {works} SELECT key, CASE WHEN len(authors) <= 3 THEN array_to_string(authors, ' · ') ELSE authors[1] || ' · ' || authors[2] || ' · ' || authors[-1] || ' · +'
 || (len(authors) - 3) || CASE WHEN len(authors) = 4 THEN ' author' ELSE ' authors' END END AS line FROM works""")
def author_preview(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", text.author_preview(F.col("authors")).alias("line"))


@query("WITH {works} SELECT key, coalesce('https://doi.org/' || doi, 'https://arxiv.org/abs/' || arxiv) AS url FROM works")
def external_url(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", text.external_url(F.col("doi"), F.col("arxiv")).alias("url"))


@query("""WITH p AS (SELECT doc_id, list_filter([doc_id % 3, doc_id % 5 + 3], lambda x: x > 0 AND x < 7) AS pages FROM documents)
SELECT doc_id, CASE WHEN len(pages) = 1 THEN 'p. ' || pages[1] WHEN len(pages) > 1 THEN 'pp. ' || array_to_string(pages, ', ') END AS location FROM p""")
def page_location(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pages_ = F.filter(F.array(F.col("doc_id") % 3, F.col("doc_id") % 5 + 3), lambda x: (x > 0) & (x < 7))
    return d.select("doc_id", text.page_location(pages_).alias("location"))


@query("""WITH {works} SELECT key, lpad(coalesce(year::VARCHAR, ''), 4, ' ') || '  ' || lpad(left(coalesce(CASE WHEN contains(authors[1], ',') THEN trim(regexp_extract(authors[1], '^(.*),', 1))
 ELSE list_last(string_split(authors[1], ' ')) END, ''), 12), 12, ' ') || '  ' || title AS line FROM works""")
def browser_row(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", text.list_row(F.col("key"), F.col("authors"), F.col("year"), F.col("title")).alias("line"))


@query(r"""WITH {works}, l AS (SELECT key, list_concat(['', title],
 CASE WHEN year IS NOT NULL OR journal IS NOT NULL OR kind = 'book' THEN ['', array_to_string(list_filter([year::VARCHAR, journal, CASE WHEN kind = 'book' THEN 'book' END, CASE WHEN kind = 'book' THEN edition || ' ed.' END], lambda x: x IS NOT NULL), ' · ')] ELSE [] END,
 [''], CASE WHEN len(authors) > 0 THEN [CASE WHEN len(authors) <= 3 THEN array_to_string(authors, ' · ') ELSE authors[1] || ' · ' || authors[2] || ' · ' || authors[-1] || ' · +' || (len(authors) - 3) || CASE WHEN len(authors) = 4 THEN ' author' ELSE ' authors' END END, ''] ELSE [] END,
 CASE WHEN kind = 'book' AND (publisher IS NOT NULL OR series IS NOT NULL OR len(isbn) > 0) THEN [array_to_string(list_filter([publisher, series, CASE WHEN len(isbn) > 0 THEN 'ISBN ' || array_to_string(isbn, ', ') END], lambda x: x IS NOT NULL), ' · '), ''] ELSE [] END,
 CASE WHEN doi IS NOT NULL THEN ['doi   ' || doi] ELSE [] END, CASE WHEN arxiv IS NOT NULL THEN ['arxiv ' || arxiv] ELSE [] END,
 CASE WHEN len(tags) > 0 THEN CASE WHEN doi IS NOT NULL OR arxiv IS NOT NULL THEN ['', 'tags  ' || array_to_string(tags, ', ')] ELSE ['tags  ' || array_to_string(tags, ', ')] END ELSE [] END,
 CASE WHEN abstract IS NOT NULL THEN ['', abstract] ELSE [] END) AS lines FROM works)
SELECT key, array_to_string(lines, chr(10)) AS shown FROM l""")
def detail_view(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return w.select("key", text.detail_view({c: F.col(c) for c in w.columns}).alias("shown"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 80 THEN left(x, 79) || '…' ELSE x END AS preview FROM t""")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 80).alias("preview"))


@query("SELECT conv_id, turn, 'title: ' || trim('Conversation ' || conv_id) || ' | ' || text AS input FROM conversations")
def prompt_template(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.fill_template("title: {title} | {text}", title=F.trim(F.concat(F.lit("Conversation "), "conv_id")), text=F.col("text")).alias("input"))


@query("WITH s AS (SELECT doc_id, n_chars * 1000 AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f', n / 1048576.0) || ' MB' ELSE greatest(ceil(n / 1024.0)::BIGINT, 1) || ' KB' END AS size FROM s")
def human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.human_size(F.col("n_chars") * 1000).alias("size"))


# ---- identifiers and names

_INPUT = """inp AS (SELECT doc_id, CASE doc_id % 12
 WHEN 0 THEN 'https://arxiv.org/abs/2101.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || 'v2' WHEN 1 THEN '2101.' || lpad((doc_id % 100000)::VARCHAR, 5, '0')
 WHEN 2 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/pmc' || doc_id || '/' WHEN 3 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (10000 + doc_id) || '/'
 WHEN 4 THEN 'PMID: ' || (10000 + doc_id) WHEN 5 THEN 'https://doi.org/10.1234/abc.' || doc_id
 WHEN 6 THEN 'http://example.org/a?id=10.1371%2Fjournal.' || doc_id || '&x=1' WHEN 7 THEN 'see 10.5555/xyz' || doc_id || ' there'
 WHEN 8 THEN 'https://example.org/10.1000/q' || doc_id || '.pdf#page=2' WHEN 9 THEN 'just words ' || doc_id
 WHEN 10 THEN 'http://dx.doi.org/10.4321/z' || doc_id ELSE 'https://example.org/files/paper' || doc_id || '.pdf' END AS x FROM documents)"""
_INPUT_SPARK = _INPUT.replace("inp AS (", "").removesuffix(")").replace("::VARCHAR", "").replace("FROM documents", "FROM {docs}")


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_INPUT_SPARK, docs=table(spark, sf_dir, "documents").select("doc_id"))


_ARXIV_SQL = r"nullif(regexp_extract(x, '^(?:(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5}(?:v\d+)?)(?:\.pdf)?$', 1), '')"
_DOI_SQL = r"nullif(regexp_extract({x}, '(10\.\d{4,9}/\S+)', 1), '')"
_PMC_SQL = r"upper(nullif(regexp_extract(x, '(?i)^https?://(?:www\.)?pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC\d+)(?:/.*)?$', 1), ''))"
_PMID_SQL = r"coalesce(nullif(regexp_extract(x, '(?i)^https?://(?:www\.)?pubmed\.ncbi\.nlm\.nih\.gov/(\d{4,9})/?$', 1), ''), nullif(regexp_extract(x, '(?i)^pmid:\s*(\d{4,9})$', 1), ''))"
_WEB_SQL = "(starts_with(x, 'http://') OR starts_with(x, 'https://'))"
_RES_SQL = f"CASE WHEN regexp_matches(x, '^https?://(dx\\.)?doi\\.org/') THEN {_DOI_SQL.replace('{x}', 'x')} END"


@query(f"WITH {_INPUT} SELECT doc_id, {_ARXIV_SQL} AS arxiv, {_DOI_SQL.replace('{x}', 'x')} AS doi, {_RES_SQL} AS resolver, {_PMC_SQL} AS pmc, {_PMID_SQL} AS pmid FROM inp")
def detect_ids(spark, sf_dir):
    x = F.col("x")
    return inputs(spark, sf_dir).select("doc_id", identifiers.arxiv_id(x).alias("arxiv"), identifiers.doi(x).alias("doi"), identifiers.resolver_doi(x).alias("resolver"), identifiers.pmc_id(x).alias("pmc"), identifiers.pmid(x).alias("pmid"))


@query(f"""WITH {_INPUT}, d AS (SELECT doc_id, x, {_ARXIV_SQL} AS a, {_PMC_SQL} AS p, {_PMID_SQL} AS m, {_RES_SQL} AS r, {_DOI_SQL.replace('{x}', 'x')} AS d, {_WEB_SQL} AS w FROM inp)
SELECT doc_id, CASE WHEN a IS NOT NULL THEN 'arxiv' WHEN p IS NOT NULL THEN 'pmc' WHEN m IS NOT NULL THEN 'pmid' WHEN w AND r IS NOT NULL THEN 'doi' WHEN w THEN 'url' WHEN d IS NOT NULL THEN 'doi' ELSE 'unknown' END AS kind,
 CASE WHEN a IS NOT NULL THEN a WHEN p IS NOT NULL THEN p WHEN m IS NOT NULL THEN m WHEN w THEN coalesce(r, x) ELSE d END AS id, (a IS NOT NULL OR d IS NOT NULL OR w) AS importable FROM d""")
def classify_input(spark, sf_dir):
    c = identifiers.classify_input(F.col("x"))
    return inputs(spark, sf_dir).select("doc_id", c["kind"].alias("kind"), c["id"].alias("id"), identifiers.is_importable(F.col("x")).alias("importable"))


@query(rf"""WITH {_INPUT}, f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_DOI_SQL.replace('{x}', "replace(x, '%2F', '/')")}, '[?#&].*$', ''), '[.,;)/]+$', ''), '\.pdf$', '') AS d FROM inp)
SELECT doc_id, CASE WHEN length(d) > 3 THEN d END AS doi FROM f""")
def doi_in_url(spark, sf_dir):
    return inputs(spark, sf_dir).select("doc_id", identifiers.doi_in_url(F.col("x")).alias("doi"))


@query(r"""WITH """ + _INPUT + r""", p AS (SELECT doc_id, list_last(list_filter(string_split(regexp_extract(x, '^https?://[^/]+(/[^?#]*)', 1), '/'), lambda s: s <> '')) AS l FROM inp)
SELECT doc_id, CASE WHEN ends_with(lower(l), '.pdf') THEN l ELSE 'download.pdf' END AS name FROM p""")
def url_file_name(spark, sf_dir):
    return inputs(spark, sf_dir).select("doc_id", identifiers.url_file_name(F.col("x")).alias("name"))


@query(rf"""WITH {_INPUT}, h AS (SELECT doc_id, x, regexp_replace(lower(regexp_extract(x, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS h, regexp_extract(x, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1) AS p FROM inp),
f AS (SELECT *, regexp_extract(p, '/(?:abs|pdf)/([0-9]{{4}}\.[0-9]{{4,5}})', 1) AS a, regexp_extract(p, '/(\d+)', 1) AS m, regexp_extract(p, '(?i)PMC(\d+)', 1) AS c, regexp_extract(x, '10\.\d{{4,9}}/[^\s"''<>?#]+') AS d FROM h)
SELECT doc_id, CASE WHEN h = '' THEN x WHEN ends_with(h, 'arxiv.org') AND a <> '' THEN a WHEN h IN ('doi.org', 'dx.doi.org') THEN url_decode(regexp_replace(p, '^/', ''))
 WHEN h = 'pubmed.ncbi.nlm.nih.gov' AND m <> '' THEN m WHEN ends_with(h, 'ncbi.nlm.nih.gov') AND c <> '' THEN 'PMC' || c WHEN d <> '' THEN d ELSE x END AS reduced FROM f""")
def reduce_url(spark, sf_dir):
    return inputs(spark, sf_dir).select("doc_id", identifiers.reduce_url(F.col("x")).alias("reduced"))


@query(r"""WITH {works}, n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS a,
 trim(regexp_replace(regexp_replace(lower(left(title, 30) || '!'), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS b FROM works)
SELECT doc_id, a <> '' AND b <> '' AND (starts_with(a, b) OR starts_with(b, a)) AS same FROM n""")
def title_match(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return w.select("doc_id", text.titles_match(F.col("title"), F.concat(F.left("title", F.lit(30)), F.lit("!"))).alias("same"))


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<jats:title>Abstract</jats:title><jats:p>' WHEN 1 THEN ' ABSTRACT: ' ELSE '' END || text || '</jats:p>' AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '(?i)^\s*abstract\s*[.:]\s*', '') AS x FROM d)
SELECT doc_id, trim(regexp_replace(regexp_replace(x, '(?s)^\s*Abstract\s*([A-Z].*)$', '\1'), '\s+', ' ', 'g')) AS abstract FROM a""")
def clean_abstract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, "<jats:title>Abstract</jats:title><jats:p>").when(F.col("doc_id") % 3 == 1, " ABSTRACT: ").otherwise("")
    return d.select("doc_id", text.clean_abstract(F.concat(head, "text", F.lit("</jats:p>"))).alias("abstract"))


_RAW_NAMES = "CASE c_custkey % 4 WHEN 0 THEN 'Quill, Ada; ' || c_name || ' ;' WHEN 1 THEN 'Ada Quill, Bo Stack, ' || c_name WHEN 2 THEN 'Ada Quill and ' || c_name ELSE ' ' || c_name || ' ' END"


@query(f"""WITH r AS (SELECT c_custkey, {_RAW_NAMES} AS raw FROM customer)
SELECT c_custkey, array_to_string(CASE WHEN contains(raw, ';') THEN list_filter(list_transform(string_split(raw, ';'), lambda x: trim(x)), lambda x: x <> '')
 WHEN len(string_split(raw, ',')) > 2 THEN list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '')
 WHEN contains(raw, ' and ') THEN list_transform(string_split(raw, ' and '), lambda x: trim(x)) ELSE [trim(raw)] END, '|') AS authors FROM r""")
def author_split(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_RAW_NAMES).alias("raw")).select("c_custkey", F.array_join(text.split_authors(F.col("raw")), "|").alias("authors"))


_FAMILY = """CASE WHEN contains({a}, ',') THEN trim(regexp_replace(trim({a}), ',+$', '')) WHEN contains(trim({a}), ' ') THEN list_last(string_split(trim({a}), ' ')) || ', ' || array_to_string(string_split(trim({a}), ' ')[:-2], ' ') ELSE trim({a}) END"""


@query("WITH {works} SELECT key, array_to_string(list_transform(authors, lambda a: " + _FAMILY.replace("{a}", "a") + "), ' and ') AS authors FROM works")
def family_given(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", F.array_join(F.transform("authors", text.family_given), " and ").alias("authors"))


_KEY_NAME = """CASE WHEN contains(authors[1], ',') THEN trim(regexp_extract(authors[1], '^(.*),', 1))
 WHEN regexp_matches(list_last(string_split(authors[1], ' ')), '^\\p{L}\\.*$') AND contains(authors[1], ' ') THEN coalesce(list_filter(string_split(authors[1], ' '), lambda w: NOT regexp_matches(w, '^\\p{L}\\.*$'))[1], list_last(string_split(authors[1], ' ')))
 ELSE list_last(string_split(authors[1], ' ')) END"""
_KEY_WORD = "list_filter(string_split_regex(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND lower(w) NOT IN ('a', 'an', 'the', 'on', 'of', 'for', 'in', 'to', 'and', 'with'))[1]"
_SLUG = "regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace({x}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_WORK_KEY = _SLUG.replace("{x}", f"(coalesce({_KEY_NAME}, 'unknown') || '-' || coalesce(year::VARCHAR, '0000') || '-' || coalesce({_KEY_WORD}, 'untitled'))")


@query(f"WITH {{works}} SELECT key, {_WORK_KEY} AS work_key FROM works")
def work_key(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", text.work_key(F.col("authors"), F.col("year"), F.col("title")).alias("work_key"))


_FREE = "list_filter(range(0, n + len(u) + {first} + 1), lambda p: NOT list_contains(u, p) AND (p = 0 OR p >= {first}))[r]"


@query(f"""WITH {{works}}, k AS (SELECT doc_id, key, {_SLUG.replace("{x}", f"coalesce({_KEY_NAME}, 'unknown')")} || '-' || coalesce(year, 0) AS base_key FROM works),
there AS (SELECT DISTINCT base_key, unnest(CASE doc_id % 4 WHEN 0 THEN [0] WHEN 1 THEN [2, 5] WHEN 2 THEN [3] ELSE [1] END) AS p FROM k),
u AS (SELECT base_key, list(DISTINCT p) AS u FROM there GROUP BY base_key),
n AS (SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY key) AS r, count(*) OVER (PARTITION BY base_key) AS n FROM k JOIN u USING (base_key)),
f AS (SELECT *, {_FREE.format(first=2)} AS p FROM n)
SELECT key, base_key, CASE WHEN p = 0 THEN base_key ELSE base_key || '-' || p END AS final_key FROM f""")
def key_collisions(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    base = F.concat_ws("-", text.slug(F.coalesce(text.key_surname(F.get("authors", F.lit(0))), F.lit("unknown"))), F.coalesce("year", F.lit(0)).cast("string"))
    taken = F.expr("explode(CASE doc_id % 4 WHEN 0 THEN array('') WHEN 1 THEN array('-2', '-5') WHEN 2 THEN array('-3') ELSE array('-1') END)")
    there = w.select(base.alias("b"), taken.alias("n")).select(F.concat("b", "n").alias("key")).distinct()
    return catalogue.final_keys(w, base, there)


# ---- pages and records

_HTML = """h AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '<meta name="citation_doi" content=" doi:10.1234/p.' || page_id || '"><meta content=''/files/' || page_id || '.pdf'' name=''citation_pdf_url''>'
 WHEN 1 THEN '<META content="10.5555/x' || page_id || '" name="prism.doi"/><meta name="citation_author" content="Ada Quill"><meta name="citation_author" content="Bo Stack"><meta content="Ada Quill" name="citation_author">'
 WHEN 2 THEN '<meta name="dc.identifier" content="https://doi.org/10.7777/d' || page_id || '">' ELSE '<meta name="citation_doi" content=""><meta name="dc.identifier" content="isbn">' END || html AS html FROM pages)"""
_HTML_SPARK = _HTML.replace("h AS (", "", 1).removesuffix(")").replace("''", "\\'").replace("FROM pages", "FROM {pages}")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HTML_SPARK, pages=table(spark, sf_dir, "pages"))


def _meta_sql(name: str) -> str:
    first = rf"""(?is)<meta\b[^>]*?\bname\s*=\s*["'']{name}["''][^>]*?\bcontent\s*=\s*["'']([^"'']*)["'']"""
    second = rf"""(?is)<meta\b[^>]*?\bcontent\s*=\s*["'']([^"'']*)["''][^>]*?\bname\s*=\s*["'']{name}["'']"""
    return f"coalesce(nullif(trim(regexp_extract(html, '{first}', 1)), ''), nullif(trim(regexp_extract(html, '{second}', 1)), ''))"


@query(rf"WITH {_HTML} SELECT page_id, {_meta_sql('citation_doi')} AS citation_doi, {_meta_sql(r'prism\.doi')} AS prism_doi FROM h")
def meta_content(spark, sf_dir):
    h = html_pages(spark, sf_dir)
    return h.select("page_id", pages.meta_content(F.col("html"), "citation_doi").alias("citation_doi"), pages.meta_content(F.col("html"), "prism.doi").alias("prism_doi"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'Ada Quill|Bo Stack' ELSE '' END AS authors FROM pages")
def meta_contents(spark, sf_dir):
    return html_pages(spark, sf_dir).select("page_id", F.array_join(pages.meta_contents(F.col("html"), "citation_author"), "|").alias("authors"))


@query(rf"""WITH {_HTML}, n AS (SELECT page_id, url, {_meta_sql('citation_pdf_url')} AS pdf, coalesce({_meta_sql('citation_doi')}, {_meta_sql(r'prism\.doi')}, CASE WHEN contains({_meta_sql(r'dc\.identifier')}, '10.') THEN {_meta_sql(r'dc\.identifier')} END) AS d FROM h)
SELECT page_id, nullif(regexp_extract(regexp_replace(d, '^(?:doi:|DOI:)', ''), '(10\.\d{{4,9}}/\S+)', 1), '') AS doi, regexp_extract(url, '^(https?://[^/]+)', 1) || pdf AS pdf_url FROM n""")
def landing_info(spark, sf_dir):
    return html_pages(spark, sf_dir).select("page_id", pages.landing_info(F.col("url"), F.col("html")).alias("i")).select("page_id", "i.doi", "i.pdf_url")


def _json_rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, part=spread(table(spark, sf_dir, "part")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'Untitled' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Journal ' || p_size END AS journal,
 CASE WHEN p_partkey % 2 = 0 THEN 'Ada Quill|Stack' ELSE '' END AS authors, CASE p_partkey % 4 WHEN 0 THEN 1990 + p_size WHEN 1 THEN 2000 + p_size WHEN 2 THEN NULL END::INT AS year, '10.1/' || p_partkey AS doi FROM part""")
def csl_parse(spark, sf_dir):
    rows = _json_rows(
        spark,
        sf_dir,
        """SELECT p_partkey, '{{"DOI":"10.1/' || p_partkey || '"' ||
          CASE WHEN p_partkey % 5 = 4 THEN '' WHEN p_partkey % 5 = 0 THEN ',"title":["' || p_name || '","other"]' ELSE ',"title":"' || p_name || '"' END ||
          CASE WHEN p_partkey % 3 = 0 THEN ',"container-title":["Journal ' || p_size || '"]' ELSE '' END ||
          CASE WHEN p_partkey % 2 = 0 THEN ',"author":[{{"family":"Quill","given":"Ada"}},{{"family":"Stack"}},{{"given":"Nobody"}}]' ELSE '' END ||
          CASE p_partkey % 4 WHEN 0 THEN ',"issued":{{"date-parts":[[' || (1990 + p_size) || ',1]]}}' WHEN 1 THEN ',"published-online":{{"date-parts":[[' || (2000 + p_size) || ']]}}'
            WHEN 2 THEN ',"issued":{{"date-parts":[[99999]]}},"created":{{"date-parts":[[2001]]}}' ELSE '' END || '}}' AS j FROM {part}""",
    )
    c = pages.csl_record(F.col("j"))
    return rows.select("p_partkey", c.alias("c")).select("p_partkey", "c.title", "c.journal", F.array_join("c.authors", "|").alias("authors"), "c.year", "c.doi")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'https://x.org/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/get' ELSE '.PDF' END END AS url FROM part")
def crossref_pdf(spark, sf_dir):
    rows = _json_rows(
        spark,
        sf_dir,
        """SELECT p_partkey, '{{"message":{{"link":[{{"URL":"https://x.org/landing","content-type":"text/html"}}' || CASE p_partkey % 3 WHEN 0 THEN ',{{"URL":"http://x.org/' || p_partkey || '/get","content-type":"application/PDF"}}'
          WHEN 1 THEN ',{{"URL":"https://x.org/' || p_partkey || '.PDF","content-type":"unspecified"}}' ELSE '' END || ']}}}}' AS j FROM {part}""",
    )
    return rows.select("p_partkey", pages.crossref_pdf(F.col("j")).alias("url"))


@query("SELECT p_partkey, 'https://r.org/' || p_partkey || '|https://p.org/a|https://p.org/' || p_size || '|https://p.org/a' AS urls, CASE WHEN p_partkey % 2 = 0 THEN 'http://b.org' END AS best FROM part")
def oa_candidates(spark, sf_dir):
    rows = _json_rows(
        spark,
        sf_dir,
        """SELECT p_partkey, '{{"oa_locations":[{{"url_for_pdf":"http://p.org/a","host_type":"publisher"}},{{"url_for_pdf":"https://p.org/a","host_type":"publisher"}},{{"url_for_pdf":null,"host_type":"repository"}},
          {{"url_for_pdf":"http://r.org/' || p_partkey || '","host_type":"repository"}},{{"url_for_pdf":"https://p.org/' || p_size || '"}},{{"url_for_pdf":"https://p.org/a","host_type":"publisher"}}],"best_oa_location":' ||
          CASE WHEN p_partkey % 2 = 0 THEN '{{"url_for_pdf":"http://b.org"}}' ELSE 'null' END || '}}' AS j FROM {part}""",
    )
    return rows.select("p_partkey", F.array_join(pages.oa_candidates(F.col("j")), "|").alias("urls"), pages.oa_best(F.col("j")).alias("best"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '10.9/' || p_partkey END AS doi, 'https://f.org/' || p_partkey || '.tar.gz' AS package FROM part")
def pmc_records(spark, sf_dir):
    rows = _json_rows(
        spark,
        sf_dir,
        """SELECT p_partkey, '{{"records":[{{"pmcid":"PMCX","doi":"x"}},{{"pmcid":"pmc' || p_partkey || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"doi":"10.9/' || p_partkey || '"' ELSE '' END || '}}]}}' AS j,
          '<OA><records><record><link format="pdf" href="ftp://f.org/x.pdf"/><link format="tgz" href="ftp://f.org/' || p_partkey || '.tar.gz"/></record></records></OA>' AS x FROM {part}""",
    )
    return rows.select("p_partkey", pages.pmc_doi(F.col("j"), F.concat(F.lit("PMC"), "p_partkey")).alias("doi"), identifiers.ftp_to_https(pages.oa_package_url(F.col("x"))).alias("package"))


@query("SELECT p_partkey, p_name AS title, 'Ada Quill|Bo Stack' AS authors, 2000 + p_size AS year, 'Words of ' || p_size AS abstract, CASE WHEN p_partkey % 2 = 0 THEN '10.8/' || p_partkey END AS doi FROM part")
def atom_parse(spark, sf_dir):
    rows = _json_rows(
        spark,
        sf_dir,
        """SELECT p_partkey, '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>feed</title><entry><title> ' || replace(p_name, ' ', '  ') || '
 </title><summary>Abstract. Words of ' || p_size || ' </summary><published>' || (2000 + p_size) || '-01-02</published><author><name>Ada Quill</name></author><author><name>Bo Stack</name></author>' ||
          CASE WHEN p_partkey % 2 = 0 THEN '<arxiv:doi>10.8/' || p_partkey || '</arxiv:doi>' ELSE '' END || '</entry><entry><title>other</title></entry></feed>' AS x FROM {part}""",
    )
    return rows.select("p_partkey", pages.atom_record(F.col("x")).alias("r")).select("p_partkey", "r.title", F.array_join("r.authors", "|").alias("authors"), "r.year", "r.abstract", "r.doi")


# ---- duplicates

_NORM = "nullif(lower(trim(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))), '')"
_COMPONENTS = f"""k AS (SELECT key, {_NORM.replace('{c}', 'title')} AS t, {_NORM.replace('{c}', 'doi')} AS d FROM works),
e AS (SELECT a.key AS x, b.key AS y FROM k a JOIN k b ON a.t = b.t UNION SELECT a.key, b.key FROM k a JOIN k b ON a.d = b.d),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
g AS (SELECT x AS key, min(y) AS group_id FROM reach GROUP BY x), dup AS (SELECT group_id, key FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY 1 HAVING count(*) > 1))"""
_SCORE = """((coalesce(title <> '', false))::INT + (len(authors) > 0)::INT + coalesce(year <> 0, false)::INT + (doi IS NOT NULL)::INT + (arxiv IS NOT NULL)::INT + (journal IS NOT NULL)::INT + (publisher IS NOT NULL)::INT
 + (edition IS NOT NULL)::INT + (series IS NOT NULL)::INT + (abstract IS NOT NULL)::INT + (len(isbn) > 0)::INT + (len(tags) > 0)::INT + (len(files) > 0)::INT)"""


@query(f"WITH {{works}} SELECT {_NORM.replace('{c}', 'title')} AS value, count(*) AS n, min(key) AS first FROM works GROUP BY 1 HAVING count(*) > 1 AND {_NORM.replace('{c}', 'title')} IS NOT NULL")
def dup_exact_groups(spark, sf_dir):
    return duplicates.exact_groups(fixtures.works(spark, sf_dir), text.normal_key(F.col("title")))


@query(f"WITH RECURSIVE {{works}}, {_COMPONENTS} SELECT group_id, key FROM dup")
def dup_components(spark, sf_dir):
    return duplicates.duplicate_groups(fixtures.works(spark, sf_dir))


@query(f"""WITH RECURSIVE {{works}}, {_COMPONENTS}, m AS (SELECT dup.group_id, key, has_pdf, {_SCORE} AS metadata_score FROM dup JOIN works USING (key))
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY has_pdf DESC, metadata_score DESC, key DESC) = 1 AS recommended,
 row_number() OVER (PARTITION BY group_id ORDER BY metadata_score DESC, key DESC) = 1 AS by_score FROM m""")
def dup_best(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    groups = duplicates.duplicate_groups(w)
    by_score = duplicates.describe_groups(groups, w, prefer_pdf=False).select("key", F.col("recommended").alias("by_score"))
    return duplicates.describe_groups(groups, w).select("group_id", "key", "has_pdf", "metadata_score", "recommended").join(by_score, "key")


@query(f"""WITH RECURSIVE {{works}}, {_COMPONENTS}, m AS (SELECT dup.group_id, key, has_pdf, {_SCORE} AS s FROM dup JOIN works USING (key)),
r AS (SELECT key, row_number() OVER (PARTITION BY group_id ORDER BY has_pdf DESC, s DESC, key DESC) AS n FROM m), mv AS (SELECT doc_id, key, key IN (SELECT key FROM r WHERE n > 1) AS trashed FROM works)
SELECT key, trashed, CASE WHEN trashed THEN key || CASE WHEN doc_id % 6 = 0 THEN '-2' WHEN doc_id % 3 = 0 THEN '-1' ELSE '' END END AS trash_key FROM mv""")
def dup_trash_split(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    there = w.filter("doc_id % 3 = 0").select(F.explode(F.expr("CASE WHEN doc_id % 6 = 0 THEN array(key, concat(key, '-1'), concat(key, '-3')) ELSE array(key) END")).alias("trash_key"))
    kept, gone = duplicates.split_trash(w, duplicates.describe_groups(duplicates.duplicate_groups(w), w), there)
    moved = gone.filter("key is not null").select("key", F.lit(True).alias("trashed"), "trash_key")
    return kept.select("key", F.lit(False).alias("trashed"), F.lit(None).cast("string").alias("trash_key")).unionByName(moved)


@query(f"""WITH {{works}}, k AS (SELECT key, {_NORM.replace('{c}', 'title')} AS t, {_NORM.replace('{c}', 'doi')} AS d FROM works), c AS (SELECT 'new-' || key AS candidate, t, CASE WHEN d IS NULL THEN '10.1234/q.3' ELSE d END AS d FROM k),
h AS (SELECT candidate, key AS match, 0 AS o, 'doi' AS reason FROM c JOIN k ON c.d = k.d UNION ALL SELECT candidate, key, 1, 'title' FROM c JOIN k ON c.t = k.t)
SELECT candidate, match, reason FROM h QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY match, o) = 1""")
def dup_probe(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    asked = w.select(F.concat(F.lit("new-"), "key").alias("key"), "title", F.coalesce("doi", F.lit("10.1234/Q.3")).alias("doi"))
    return duplicates.probe(asked, w)


@query("WITH {works} SELECT replace(key, 'doc-1', 'new-1') AS key FROM works WHERE key LIKE '%doc-1%'")
def new_keys(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return catalogue.new_keys(w.withColumn("key", F.replace("key", F.lit("doc-1"), F.lit("new-1"))), w)


# ---- quality

@query(f"WITH {{works}} SELECT key, {_SCORE} AS score FROM works")
def completeness(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", quality.completeness().alias("score"))


@query("""WITH {works} SELECT key, coalesce(year, 0) = 0 OR len(authors) = 0 OR CASE WHEN kind = 'book' THEN publisher IS NULL ELSE abstract IS NULL OR doi IS NULL END AS incomplete,
 abstract IS NULL AS want_abstract, NOT has_pdf AS want_pdf FROM works""")
def needs_enrich(spark, sf_dir):
    w = quality.wants()
    return fixtures.works(spark, sf_dir).select("key", quality.needs_enrichment().alias("incomplete"), w["abstract"].alias("want_abstract"), w["pdf"].alias("want_pdf"))


@query("WITH {works} SELECT count(*) AS total, count(*) FILTER (NOT has_pdf) AS missing_pdf, count(*) FILTER (NOT has_pdf AND doi IS NOT NULL) AS missing_pdf_with_doi, count(*) FILTER (abstract IS NULL) AS missing_abstract FROM works")
def gap_report(spark, sf_dir):
    return quality.gap_report(fixtures.works(spark, sf_dir))


_FETCHED = """fetched AS (SELECT key, doc_id % 3 = 0 AS pdf, CASE WHEN doc_id % 2 = 0 THEN 'An abstract' END AS abstract, 1999::INT AS year, ['New Author'] AS authors, '10.99/' || doc_id AS doi,
 '2202.00001' AS arxiv, 'Fetched Journal' AS journal FROM works)"""


def fetched_works(works: DataFrame) -> DataFrame:
    return works.select(
        "key", (F.col("doc_id") % 3 == 0).alias("pdf"), F.when(F.col("doc_id") % 2 == 0, "An abstract").alias("abstract"), F.lit(1999).alias("year"), F.array(F.lit("New Author")).alias("authors"),
        F.concat(F.lit("10.99/"), "doc_id").alias("doi"), F.lit("2202.00001").alias("arxiv"), F.lit("Fetched Journal").alias("journal"),
    )


@query(f"""WITH {{works}}, {_FETCHED}, w AS (SELECT key, NOT has_pdf AND f.pdf AS p, w.abstract IS NULL AND f.abstract IS NOT NULL AS a FROM works w JOIN fetched f USING (key) WHERE w.abstract IS NULL OR NOT has_pdf)
SELECT count(*) AS considered, count(*) FILTER (p) AS pdfs_added, count(*) FILTER (a) AS abstracts_added, count(*) FILTER (NOT p AND NOT a) AS unresolved FROM w""")
def backfill_report(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return quality.backfill_report(w, fetched_works(w))[1]


@query("""WITH {works}, {listing}, f AS (SELECT key, unnest(files) AS name FROM works), i AS (
 SELECT key, 'missing title: ' || key AS issue FROM works WHERE title = '' UNION ALL SELECT key, 'missing authors: ' || key FROM works WHERE len(authors) = 0 UNION ALL SELECT key, 'missing year: ' || key FROM works WHERE year IS NULL
 UNION ALL SELECT f.key, CASE WHEN l.key IS NULL THEN 'listed but missing: ' ELSE 'not a PDF: ' END || f.key || '/' || f.name FROM f LEFT JOIN listing l ON l.key = f.key AND l.name = f.name WHERE l.key IS NULL OR NOT l.is_pdf
 UNION ALL SELECT key, 'no PDF: ' || key FROM works WHERE len(files) = 0 AND key NOT IN (SELECT key FROM listing WHERE is_pdf AND lower(name) LIKE '%.pdf')
 UNION ALL SELECT key, 'temp name: ' || key || '/' || name FROM listing WHERE name LIKE 'tmp%') SELECT key, issue FROM i""")
def validation_issues(spark, sf_dir):
    return quality.validation_issues(fixtures.works(spark, sf_dir), fixtures.listing(spark, sf_dir)).select("key", "issue")


@query("""WITH {works}, {listing}, f AS (SELECT key, unnest(files) AS name FROM works)
SELECT l.key, 'remove' AS action, l.name AS old, NULL::VARCHAR AS new FROM listing l JOIN f ON f.key = l.key AND f.name = l.name WHERE NOT is_pdf
UNION ALL SELECT key, 'rename', min(name), key || '.pdf' FROM listing WHERE is_pdf AND name LIKE 'tmp%.pdf' GROUP BY key""")
def fix_plan(spark, sf_dir):
    return quality.fix_plan(fixtures.works(spark, sf_dir), fixtures.listing(spark, sf_dir))


# ---- edits

@query("""WITH {works} SELECT key, array_to_string(list_concat(list_filter(tags, lambda t: lower(t) <> 'src3'), list_concat(CASE WHEN len(list_filter(tags, lambda t: lower(t) = 'de')) = 0 THEN ['De'] ELSE [] END, ['fresh'])), '|') AS tags FROM works""")
def tag_edit(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", F.array_join(edits.edit_tags(F.col("tags"), ["De", "fresh", "FRESH"], ["SRC3"]), "|").alias("tags"))


@query(f"""WITH {{works}}, {_FETCHED} SELECT key, CASE WHEN coalesce(w.year, 0) <> 0 THEN w.year ELSE f.year END AS year, array_to_string(CASE WHEN len(w.authors) > 0 THEN w.authors ELSE f.authors END, '; ') AS authors,
 coalesce(w.abstract, f.abstract) AS abstract, coalesce(w.doi, f.doi) AS doi, coalesce(w.arxiv, f.arxiv) AS arxiv, coalesce(w.journal, f.journal) AS journal FROM works w JOIN fetched f USING (key)""")
def enrich_merge(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return edits.merge_missing(w, fetched_works(w)).select("key", "year", F.array_join("authors", "; ").alias("authors"), "abstract", "doi", "arxiv", "journal")


@query(f"""WITH {{works}}, {_FETCHED}, m AS (SELECT w.key, w.year AS y, CASE WHEN coalesce(w.year, 0) <> 0 THEN w.year ELSE f.year END AS y2, w.doi AS d, coalesce(w.doi, f.doi) AS d2, w.arxiv AS x, coalesce(w.arxiv, f.arxiv) AS x2,
 w.journal AS j, coalesce(w.journal, f.journal) AS j2, w.authors AS a, CASE WHEN len(w.authors) > 0 THEN w.authors ELSE f.authors END AS a2, w.abstract AS b, coalesce(w.abstract, f.abstract) AS b2 FROM works w JOIN fetched f USING (key)),
c AS (SELECT key, 'year' AS field, coalesce(y::VARCHAR, 'null') AS before, y2::VARCHAR AS after FROM m UNION ALL SELECT key, 'doi', coalesce('"' || d || '"', 'null'), '"' || d2 || '"' FROM m
 UNION ALL SELECT key, 'arxiv', coalesce('"' || x || '"', 'null'), '"' || x2 || '"' FROM m UNION ALL SELECT key, 'journal', coalesce('"' || j || '"', 'null'), '"' || j2 || '"' FROM m
 UNION ALL SELECT key, 'authors', to_json(a)::VARCHAR, to_json(a2)::VARCHAR FROM m UNION ALL SELECT key, 'abstract', coalesce(to_json(b)::VARCHAR, 'null'), coalesce(to_json(b2)::VARCHAR, 'null') FROM m)
SELECT * FROM c WHERE before <> after""")
def field_diff(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return edits.field_changes(w, edits.merge_missing(w, fetched_works(w)))


@query(f"""WITH {{works}}, {_FETCHED}, m AS (SELECT w.key, w.year AS y, f.year AS y2, w.doi AS d, f.doi AS d2, w.arxiv AS x, f.arxiv AS x2, w.journal AS j, f.journal AS j2, w.authors AS a, f.authors AS a2, w.abstract AS b, f.abstract AS b2 FROM works w JOIN fetched f USING (key)),
c AS (SELECT key, 'year' AS field, coalesce(y::VARCHAR, '') AS before, y2::VARCHAR AS after FROM m WHERE y IS DISTINCT FROM y2 UNION ALL SELECT key, 'doi', coalesce(d, ''), d2 FROM m WHERE d IS DISTINCT FROM d2 UNION ALL SELECT key, 'arxiv', coalesce(x, ''), x2 FROM m WHERE x IS DISTINCT FROM x2
 UNION ALL SELECT key, 'journal', coalesce(j, ''), j2 FROM m WHERE j IS DISTINCT FROM j2 UNION ALL SELECT key, 'authors', array_to_string(a, ', '), array_to_string(a2, ', ') FROM m UNION ALL SELECT key, 'abstract', '', '(fetched)' FROM m WHERE b IS NULL AND b2 IS NOT NULL) SELECT * FROM c""")
def reviewer_diff(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return edits.reviewer_changes(w, fetched_works(w))


@query("WITH {works} SELECT key, CASE WHEN arxiv IS NOT NULL THEN 'arxiv' WHEN doi IS NOT NULL THEN 'doi' WHEN title <> '' THEN 'title' ELSE 'none' END AS source, coalesce(arxiv, doi, nullif(title, '')) AS id FROM works")
def enrichment_source(spark, sf_dir):
    s = identifiers.enrichment_source(F.col("arxiv"), F.col("files"), F.col("doi"), F.col("key"), F.col("title"))
    return fixtures.works(spark, sf_dir).select("key", s["source"].alias("source"), s["id"].alias("id"))


# ---- export

@query("""WITH {works} SELECT key, array_to_string(list_filter([CASE WHEN kind = 'book' THEN '@book{' ELSE '@article{' END || key || ',', '  title = {' || title || '},',
 CASE WHEN len(authors) > 0 THEN '  author = {' || array_to_string(list_transform(authors, lambda a: """ + _FAMILY.replace("{a}", "a") + """), ' and ') || '},' END, '  year = {' || year || '},', '  journal = {' || journal || '},',
 '  publisher = {' || publisher || '},', '  edition = {' || edition || '},', '  series = {' || series || '},', CASE WHEN len(isbn) > 0 THEN '  isbn = {' || array_to_string(isbn, ', ') || '},' END, '  doi = {' || doi || '},',
 '  eprint = {' || arxiv || '},', CASE WHEN arxiv IS NOT NULL THEN '  archiveprefix = {arXiv},' END, '}'], lambda x: x IS NOT NULL), chr(10)) AS entry FROM works""")
def export_bibtex(spark, sf_dir):
    return export.rendered(fixtures.works(spark, sf_dir), "bib")


_J = lambda c: f"coalesce(to_json({c})::VARCHAR, 'null')"


@query(
    "WITH {works} SELECT key, '{\"key\":' || to_json(key) || CASE WHEN kind <> 'paper' THEN ',\"kind\":' || to_json(kind) ELSE '' END"
    + "".join(f" || ',\"{n}\":' || {_J(n)}" for n in ("title", "authors", "year", "doi", "arxiv", "journal", "edition", "publisher", "series"))
    + " || CASE WHEN len(isbn) > 0 THEN ',\"isbn\":' || to_json(isbn) ELSE '' END"
    + "".join(f" || ',\"{n}\":' || {_J(n)}" for n in ("tags", "files", "abstract"))
    + " || '}' AS entry FROM works"
)
def export_json(spark, sf_dir):
    return export.rendered(fixtures.works(spark, sf_dir), "json")


@query("""WITH {works} SELECT key, '{"type":"' || CASE WHEN kind = 'book' THEN 'book' ELSE 'article' END || '","title":' || to_json(title)
 || CASE WHEN len(authors) > 0 THEN ',"author":' || to_json(list_transform(authors, lambda a: """ + _FAMILY.replace("{a}", "a") + """)) ELSE '' END || coalesce(',"date":' || year, '')
 || coalesce(',"parent":{"type":"periodical","title":' || to_json(journal) || '}', '') || CASE WHEN doi IS NOT NULL AND arxiv IS NOT NULL THEN ',"serial-number":{"doi":' || to_json(doi) || ',"arxiv":' || to_json(arxiv) || '}'
 WHEN doi IS NOT NULL THEN ',"serial-number":{"doi":' || to_json(doi) || '}' WHEN arxiv IS NOT NULL THEN ',"serial-number":{"arxiv":' || to_json(arxiv) || '}' ELSE '' END
 || CASE WHEN doi IS NULL AND arxiv IS NOT NULL THEN ',"url":"https://arxiv.org/abs/' || arxiv || '"' ELSE '' END || coalesce(',"abstract":' || to_json(abstract), '') || '}' AS entry FROM works""")
def export_hayagriva(spark, sf_dir):
    return export.rendered(fixtures.works(spark, sf_dir), "hayagriva")


@query("WITH {works} SELECT key, key AS plain, '\\cite{' || key || '}' AS latex, '@' || key AS typst FROM works")
def citation(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", *(export.citation(F.col("key"), k).alias(k) for k in ("plain", "latex", "typst")))


# ---- passages and incremental indexes

@query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 7 = 6 AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + count(*) FILTER (turn % 3 = 2) OVER (PARTITION BY conv_id ORDER BY turn) AS line, role, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM conversations)
SELECT 'conv-' || conv_id || '/derived/turns.jsonl' AS source_path, line, CASE WHEN cut THEN 'malformed' WHEN turn % 4 = 3 THEN 'skipped' ELSE 'ok' END AS status,
 CASE WHEN NOT cut AND turn % 4 < 2 THEN turn WHEN NOT cut AND turn % 4 = 3 THEN line ELSE line END AS chunk_index,
 CASE WHEN NOT cut AND turn % 4 < 3 THEN text END AS text, CASE WHEN cut THEN '' ELSE role END AS headings,
 CASE WHEN cut THEN '' WHEN turn % 4 = 0 THEN CASE WHEN turn = 0 THEN '1' ELSE '1,' || (turn + 1) END WHEN turn % 4 IN (1, 3) THEN turn::VARCHAR ELSE '' END AS pages FROM c""")
def row_normalise(spark, sf_dir):
    rows = incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir)).filter("status != 'blank'")
    return rows.select("source_path", F.col("line").cast("long").alias("line"), "status", "chunk_index", "text", F.array_join("headings", ",").alias("headings"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 7 = 6 AS cut FROM conversations)
SELECT count(DISTINCT conv_id) AS files, count(*) FILTER (NOT cut AND turn % 4 < 3) AS chunks, count(*) FILTER (NOT cut AND turn % 4 = 3) AS skipped, count(*) FILTER (cut) AS malformed FROM c""")
def ingest_counters(spark, sf_dir):
    return incremental.counters(incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir)))


@query("SELECT conv_id, turn, sha256(role || chr(0) || text) AS fingerprint FROM conversations")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", incremental.fingerprint(F.col("role"), F.col("text")).alias("fingerprint"))


@query("""WITH c AS (SELECT DISTINCT conv_id, conv_id % 10 = 3 AS moved, conv_id % 5 = 1 AS edited FROM conversations)
SELECT 'conv-' || conv_id || '/derived/turns.jsonl' AS source_path, CASE WHEN moved THEN 'deleted' WHEN edited THEN 'changed' ELSE 'unchanged' END AS action FROM c
UNION ALL SELECT 'moved/conv-' || conv_id || '/derived/turns.jsonl', 'new' FROM c WHERE moved""")
def index_plan(spark, sf_dir):
    stored = incremental.sources_of(incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir)))
    current = incremental.sources_of(incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir, edited=True)))
    return incremental.plan(current, stored)


@query("""WITH c AS (SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 7 <> 6 AND turn % 4 < 3)
SELECT CASE WHEN conv_id % 10 = 3 THEN 'moved/' ELSE '' END || 'conv-' || conv_id || '/derived/turns.jsonl' AS source_path, count(*) AS passages FROM c GROUP BY conv_id""")
def index_update(spark, sf_dir):
    before = incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir))
    after = incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir, edited=True))
    actions = incremental.plan(incremental.sources_of(after), incremental.sources_of(before))
    updated = incremental.update_index(incremental.replace_index(before), after, actions)
    return updated.groupBy("source_path").agg(F.count("*").alias("passages"))


@query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 7 = 6 AS cut FROM conversations), s AS (SELECT DISTINCT conv_id FROM c),
n AS (SELECT count(*) FILTER (conv_id % 10 = 3 OR conv_id % 5 = 1) AS embedded_files, count(*) FILTER (conv_id % 10 <> 3 AND conv_id % 5 <> 1) AS unchanged, count(*) FILTER (conv_id % 10 = 3) AS removed FROM s)
SELECT count(DISTINCT conv_id) AS files, count(*) FILTER (NOT cut AND turn % 4 < 3) AS chunks, count(*) FILTER (NOT cut AND turn % 4 = 3) AS skipped, count(*) FILTER (cut) AS malformed, max(embedded_files) AS embedded_files,
 max(unchanged) AS unchanged, max(removed) AS removed, count(*) FILTER (NOT cut AND turn % 4 < 3 AND (conv_id % 10 = 3 OR conv_id % 5 = 1)) AS embedded_passages, max(embedded_files) = 0 AND max(removed) = 0 AS up_to_date FROM c, n""")
def index_summary(spark, sf_dir):
    before = incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir))
    after = incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir, edited=True))
    return incremental.summary(after, incremental.plan(incremental.sources_of(after), incremental.sources_of(before)))


@query("""SELECT DISTINCT 'conv-' || conv_id || '/derived/turns.jsonl' AS source_path FROM conversations
WHERE (conv_id + turn) % 7 <> 6 AND turn % 4 < 3 AND conv_id % 5 <> 1 AND conv_id % 10 <> 3""")
def index_heal(spark, sf_dir):
    stored = incremental.replace_index(incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir)))
    rows = incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir, edited=True))
    return incremental.healed(rows, stored, incremental.sources_of(rows)).select("source_path")


def _digits(c):
    """Four numbers from 0 to 1 that a text gives: a stand-in for a model that SQL can follow."""
    return F.transform(F.array(*(F.substring(F.md5(c), i, 2) for i in (1, 3, 5, 7))), lambda h: (F.conv(h, 16, 10).cast("int") / 255).cast("float"))


_KEPT_IDS = """WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 7 = 6 AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + count(*) FILTER (turn % 3 = 2) OVER (PARTITION BY conv_id ORDER BY turn) AS line, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM conversations),
ok AS (SELECT *, 'conv-' || conv_id || '/derived/turns.jsonl' AS p, conv_id % 10 = 3 OR conv_id % 5 = 1 AS fresh FROM c WHERE NOT cut AND turn % 4 < 3),
b AS (SELECT *, row_number() OVER (ORDER BY p, line) AS id FROM ok),
a AS (SELECT id, p, line, text, true AS kept FROM b WHERE NOT fresh UNION ALL
 SELECT row_number() OVER (ORDER BY CASE WHEN conv_id % 10 = 3 THEN 'moved/' ELSE '' END || p, line) + (SELECT coalesce(max(id), 0) FROM b), CASE WHEN conv_id % 10 = 3 THEN 'moved/' ELSE '' END || p, line, text, false FROM ok WHERE fresh)
SELECT id, p AS source_path, text, round(('0x' || md5(text)[1:2])::INT / 255.0, 5) AS v0, round(('0x' || md5(text)[7:8])::INT / 255.0, 5) AS v3, kept FROM a"""


@query(_KEPT_IDS)
def vector_index_update(spark, sf_dir):
    """Ids and embeddings after an update, and which rows have them from before."""
    encode = lambda chunks: chunks.select("source_path", "place", _digits(F.col("text")).alias("embedding"))
    index = PassageIndex(spark, _scratch(spark, "passages"), buckets=16)
    before = index.update(incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir)), encode, "digits", 4)
    after = index.update(incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir, edited=True)), encode, "digits", 4)
    return _with_kept(index, before, after)


def _with_kept(index: PassageIndex, before, after) -> DataFrame:
    had = index.passages(before).select("id", F.struct("source_path", "text", "embedding").alias("had"))
    now = index.passages(after).join(had, "id", "left")
    value = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 5)
    return now.select("id", "source_path", "text", value(0).alias("v0"), value(3).alias("v3"), F.coalesce(F.col("had") == F.struct("source_path", "text", "embedding"), F.lit(False)).alias("kept"))


@query(_KEPT_IDS)
def legacy_adoption(spark, sf_dir):
    """The same from an older index without fingerprints: what is as it was is taken over, the rest encoded."""
    encode = lambda chunks: chunks.select("source_path", "place", _digits(F.col("text")).alias("embedding"))
    old = incremental.replace_index(incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir))).withColumn("embedding", _digits(F.col("text")))
    rows = incremental.collect_rows(fixtures.jsonl_files(spark, sf_dir, edited=True))
    index = PassageIndex(spark, _scratch(spark, "legacy"), buckets=16)
    before = index.adopt(old, rows, "digits", 4)
    return _with_kept(index, before, index.update(rows, encode, "digits", 4))


@query(f"""WITH now AS (SELECT d.doc_id, CASE WHEN l.quality = 0 THEN split_part(d.text, chr(10), 1) ELSE d.text END AS text FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1),
{_bm25_sql(['reth', 'that'], f'SELECT doc_id, {tok("text")} AS ts FROM now', 'doc_id')} SELECT doc_id, round(score, 6) AS score, merged FROM h, (SELECT unnest([true, false]) AS merged)""")
def lexical_index_search(spark, sf_dir):
    """A stored index, after labelled documents have been cut to a line or taken out, before and after its segments merge."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    index = LexicalIndex(spark, _scratch(spark, "lexical"), ("text",), "doc_id", buckets=32)
    index.build(spread(docs))
    index.upsert(docs.join(labels.filter("quality = 0"), "doc_id", "left_semi").select("doc_id", F.split("text", "\n")[0].alias("text")))
    index.delete(labels.filter("toxic = 1").select("doc_id"))
    before = index.bm25('reth "that"').withColumn("merged", F.lit(False))
    index.merge()
    return before.unionByName(index.bm25('reth "that"').withColumn("merged", F.lit(True))).withColumn("score", F.round("score", 6))


@query(f"""WITH w AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, ['Ada Quill' || doc_id % 17] AS authors, 2000 + doc_id % 25 AS year FROM documents WHERE n_chars >= 200),
i AS (SELECT 'a' AS run, * FROM w WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'b', * FROM w),
t AS (SELECT *, {_NORM.replace('{c}', 'title')} AS norm, {_WORK_KEY} AS base FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY norm, CASE WHEN norm IS NULL THEN doc_id END ORDER BY run, doc_id) AS nth FROM t),
k AS (SELECT run, doc_id, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY run, doc_id) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY base ORDER BY run, doc_id) END AS key FROM n WHERE nth = 1),
a AS (SELECT 'a' AS run, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'b', doc_id, n_chars FROM documents)
SELECT a.run, a.doc_id AS pos, CASE WHEN k.key IS NOT NULL THEN 'added' WHEN n_chars >= 200 THEN 'skipped' ELSE 'failed' END AS status, k.key FROM a LEFT JOIN k USING (run, doc_id)""")
def import_runs(spark, sf_dir):
    """Two runs: labelled documents, then all, as DOIs, addresses of DOIs and PubMed ids; short ones have no answer. The first run again changes nothing."""
    docs = spread(table(spark, sf_dir, "documents"))
    doi_, pm = F.concat(F.lit("10.5555/w."), "doc_id"), (10_000_000 + F.col("doc_id")).cast("string")
    as_pubmed = F.col("lang") == "es"
    given = F.when(as_pubmed, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pm, F.lit("/"))).when(F.col("lang") == "fr", F.concat(F.lit("https://doi.org/"), doi_)).otherwise(doi_)
    inputs = docs.select(F.col("doc_id").alias("pos"), given.alias("input"))
    item = F.to_json(F.struct(
        F.split("text", "\n")[0].alias("title"), doi_.alias("DOI"), F.array(F.struct(F.concat(F.lit("Quill"), F.col("doc_id") % 17).alias("family"), F.lit("Ada").alias("given"))).alias("author"),
        F.struct(F.array(F.array(2000 + F.col("doc_id") % 25)).alias("date-parts")).alias("issued"),
    ))
    answers = docs.filter("n_chars >= 200").select(F.when(as_pubmed, "pubmed").otherwise("crossref").alias("service"), F.when(as_pubmed, pm).otherwise(doi_).alias("id"), item.alias("body"))
    pdfs = spark.createDataFrame([], importing.PDF)
    library = importing.Library(spark, _scratch(spark, "library"), buckets=8)
    labelled = inputs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")), "pos", "left_semi")
    library.add("a", labelled, answers, pdfs)
    second = library.add("b", inputs, answers, pdfs)
    return second.unionByName(library.add("a", inputs, answers, pdfs)).select("run", "pos", "status", F.get("keys", F.lit(0)).alias("key"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS a0, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http:', 'https:') AS a1, url AS a2 FROM pages), u AS (SELECT DISTINCT url FROM pages),
h AS (SELECT c.*, a0 IN (SELECT url FROM u) AS h0, a1 IN (SELECT url FROM u) AS h1 FROM c),
w AS (SELECT page_id, CASE WHEN h0 THEN 'bare' WHEN h1 THEN 'secure' ELSE 'own' END AS source, CASE WHEN h0 THEN a0 WHEN h1 THEN a1 ELSE a2 END AS address FROM h),
n AS (SELECT 'bare' AS source, count(*) AS asked FROM h UNION ALL SELECT 'secure', count(*) FILTER (NOT h0) FROM h UNION ALL SELECT 'own', count(*) FILTER (NOT h0 AND NOT h1) FROM h)
SELECT page_id, w.source, address, asked FROM w JOIN n USING (source)""")
def fallback_rounds(spark, sf_dir):
    """Which address of a page answers first: the bare one, the bare one as https, its own; and how many were asked in that round."""
    pages_ = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), "url")
    bare = F.regexp_replace("url", "[?#].*$", "")
    one = lambda address: lambda open_: pages_.join(open_, "item", "left_semi").select("item", F.lit(0).alias("place"), address.alias("address"))
    there = pages_.select(F.col("url").alias("address"), F.col("item").cast("string").alias("body"))
    sources = [("bare", one(bare)), ("secure", one(F.regexp_replace(bare, "^http:", "https:"))), ("own", one(F.col("url")))]
    won, rounds = fallback.first_that_works(pages_, sources, lambda asked: there.join(asked, "address", "left_semi"))
    return won.join(rounds.select("round", "asked"), "round").select(F.col("item").alias("page_id"), "source", "address", "asked")


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, regexp_matches(line, '^#+ ') AS header, starts_with(line, '- ') AS item, regexp_replace(line, '^(#+|-) ', '') AS text FROM t WHERE line <> ''),
f AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS size, 0 AS parts, 0 AS chunk FROM (SELECT DISTINCT doc_id FROM b) UNION ALL
 SELECT b.doc_id, b.k, CASE WHEN header THEN 0 WHEN parts > 0 AND size + length(b.text) + 8 <= 1800 THEN size + length(b.text) + 2 * item::INT + 2 ELSE length(b.text) + 2 * item::INT END,
  CASE WHEN header THEN 0 WHEN parts > 0 AND size + length(b.text) + 8 <= 1800 THEN parts + 1 ELSE 1 END,
  CASE WHEN parts > 0 AND (header OR size + length(b.text) + 8 > 1800) THEN chunk + 1 ELSE chunk END FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1)
SELECT doc_id::VARCHAR AS doc, chunk AS chunk_index, string_agg(CASE WHEN item THEN '- ' ELSE '' END || b.text, chr(10) || chr(10) ORDER BY k) AS text,
 array_to_string(list_sort(list(DISTINCT CASE WHEN item THEN 'list_item' ELSE 'text' END)), ',') AS labels FROM f JOIN b USING (doc_id, k) WHERE NOT header GROUP BY doc_id, chunk""")
def passage_fold(spark, sf_dir):
    folded = layout.fold_passages(layout.paragraph_blocks(spread(table(spark, sf_dir, "documents")), "doc_id", "text"))
    return folded.select("doc", "chunk_index", "text", F.array_join("labels", ",").alias("labels"))


# ---- mathematics

_MATH = "CASE doc_id % 4 WHEN 0 THEN 'for | x + y | in N and ( a , b ]' WHEN 1 THEN 'x 1 , x 2 ; y i j over R' WHEN 2 THEN 'cases ( i i ) and { z }, f : Q' ELSE 'a 1 - 2 , Z' END || ' ' || doc_id"


@query(r"""WITH d AS (SELECT doc_id, """ + _MATH + r""" AS x FROM documents), s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\|\s*([^|\n]+?)\s*\|', '|\1|', 'g'), '([(\[{])\s+', '\1', 'g'),
 '\s+([)\]}])', '\1', 'g'), '\s+([,.;:])', '\1', 'g'), ',\s*([A-Za-z\-+])', ', \1', 'g') AS x FROM d)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\bN\b', 'ℕ', 'g'), '\bQ\b', 'ℚ', 'g'), '\bR\b', 'ℝ', 'g'), '\bZ\b', 'ℤ', 'g') AS tidy FROM s""")
def math_tidy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", math.tidy_notation(F.expr(_MATH)).alias("tidy"))


@query()
def math_subscripts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", math.normalise_math(F.expr(_MATH)).alias("text"))


@query("SELECT conv_id, turn, 'E = ' || turn AS first, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS n FROM conversations")
def formula_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("\\[\nE = "), "turn", F.lit("\n$$\n"), "text", F.when(F.col("turn") % 2 == 0, F.lit("\n $$ \na\nb\n\\]\n")).otherwise(F.lit("\n\\[\nopen")))
    found = math.display_formulas(body)
    return c.select("conv_id", "turn", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("n"))


_BOX = "double({l}) / 8 l, double({l}) / 8 + 40 + {w} / 3.0D r, 30 + double({t}) / 7 b, 30 + double({t}) / 7 + {h} / 9.0D t".format(l="p_size * 71 % 4300", w="p_size % 37", t="p_size * 113 % 5000", h="(p_size * 5 % 23 - 2)")


@query("""WITH p AS (SELECT p_partkey, (p_size * 71 % 4300)::DOUBLE / 8 AS l, (p_size * 71 % 4300)::DOUBLE / 8 + 40 + (p_size % 37) / 3.0::DOUBLE AS r, 30 + (p_size * 113 % 5000)::DOUBLE / 7 AS b,
 30 + (p_size * 113 % 5000)::DOUBLE / 7 + (p_size * 5 % 23 - 2) / 9.0::DOUBLE AS t FROM part),
c AS (SELECT p_partkey, t > b AS any_, greatest(l - 1, 0) AS x0, greatest(792 - t - 1, 0) AS y0, least(r + 1, 612) AS x1, least(792 - b + 1, 792) AS y1 FROM p)
SELECT p_partkey, CASE WHEN any_ THEN floor(x0 * 2.5)::BIGINT END AS x, CASE WHEN any_ THEN floor(y0 * 2.5)::BIGINT END AS y,
 CASE WHEN any_ THEN greatest(ceil((x1 - x0) * 2.5), 1)::BIGINT END AS width, CASE WHEN any_ THEN greatest(ceil((y1 - y0) * 2.5), 1)::BIGINT END AS height FROM c""")
def pixel_crop(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", *_BOX.split(", "))
    crop = math.pixel_crop(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(612.0), F.lit(792.0), F.lit(180))
    return p.select("p_partkey", crop.alias("c")).select("p_partkey", "c.x", "c.y", "c.width", "c.height")


@query("""WITH o AS (SELECT conv_id, turn, unnest([1, 2]) AS k FROM conversations)
SELECT conv_id || '#' || turn AS id, 'x = ' || (turn % 2) AS text, k AS nth, (turn % 2 * 10 + k - 1)::BIGINT AS place FROM o""")
def formula_places(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("$$\nx = "), F.col("turn") % 2, F.lit("\n$$\ntext\n\\[\nx = "), F.col("turn") % 2, F.lit("\n\\]"))
    hits = c.select(F.concat("conv_id", F.lit("#"), "turn").alias("id"), F.lit("d").alias("doc"), body.alias("text"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("pages"))
    known = [(i * 10 + k, f"x = {i}", k + 1) for i in range(2) for k in range(3)]
    catalog = spark.createDataFrame([("d", o, t, p, 1.0, 2.0, 3.0, 1.0, 10.0, 10.0) for o, t, p in known], "doc string, ord long, text string, page long, l double, t double, r double, b double, page_width double, page_height double")
    return formula.locate_formulas(hits, catalog).select("id", "text", "nth", "place")


# ---- facets over labels

@query("""SELECT coalesce(l.quality, -1) AS quality, d.lang, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def label_facets(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").groupBy(F.coalesce("quality", F.lit(-1)).alias("quality"), "lang").agg(F.count("*").alias("n"))


# ---- records, files and layout documents

_TOML = """'kind = "' || CASE WHEN {k} % 7 = 3 THEN 'film' WHEN {k} % 5 = 0 THEN 'book' ELSE 'paper' END || '"' || {nl} || CASE WHEN {k} % 11 = 4 THEN '' ELSE 'title = "Of ' || {k} || '"' || {nl} END
 || 'year = ' || CASE WHEN {k} % 13 = 5 THEN '-1' ELSE CAST(1900 + {k} % 100 AS {s}) END || {nl} || 'tags = ["' || lang || '", "x"]' || {nl} || CASE WHEN {k} % 17 = 6 THEN 'broken = [' ELSE '' END"""


@query("""WITH r AS (SELECT doc_id, doc_id % 7 = 3 OR doc_id % 11 = 4 OR doc_id % 13 = 5 OR doc_id % 17 = 6 AS corrupt, lang FROM documents)
SELECT 'doc-' || doc_id AS key, corrupt, CASE WHEN NOT corrupt THEN CASE WHEN doc_id % 5 = 0 THEN 'book' ELSE 'paper' END END AS kind, CASE WHEN NOT corrupt THEN 'Of ' || doc_id END AS title,
 CASE WHEN NOT corrupt THEN 1900 + doc_id % 100 END AS year, CASE WHEN NOT corrupt THEN lang || ',x' END AS tags FROM r""")
def record_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    content = F.expr(_TOML.format(k="doc_id", nl="'\\n'", s="STRING")).cast("binary")
    parsed = library.parse_records(docs.select(F.concat(F.lit("doc-"), "doc_id").alias("key"), content.alias("content")))
    return parsed.select("key", F.col("_corrupt").isNotNull().alias("corrupt"), "kind", "title", F.col("year").cast("long").alias("year"), F.array_join("tags", ",").alias("tags"))


@query("""WITH {works}, {listing} SELECT key, coalesce(bool_or(lower(name) LIKE '%.pdf'), false) AS has_pdf, CASE WHEN len(any_value(files)) > 0 AND bool_or(name = files[1]) THEN any_value(files)[1] ELSE min(name) FILTER (lower(name) LIKE '%.pdf') END AS pdf
FROM works LEFT JOIN listing USING (key) GROUP BY key""")
def pdf_resolution(spark, sf_dir):
    works, files = fixtures.works(spark, sf_dir), fixtures.listing(spark, sf_dir)
    return library.resolve_pdf(works, files).select("key", "has_pdf", "pdf")


@query("WITH {listing} SELECT key, bool_or(lower(name) LIKE '%.pdf') AS has_pdf FROM listing GROUP BY key")
def pdf_flags(spark, sf_dir):
    return library.has_pdf(fixtures.listing(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN '%PDF' WHEN 2 THEN ' %PDF-' ELSE '' END || text AS c FROM documents)
SELECT doc_id, starts_with(c, '%PDF-') AS download, starts_with(c, '%PDF') AS file FROM c""")
def pdf_marks(spark, sf_dir):
    content = F.expr("CASE doc_id % 4 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN '%PDF' WHEN 2 THEN ' %PDF-' ELSE '' END || text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", pages.is_pdf(content).alias("download"), pages.is_pdf_file(content).alias("file"))


@query("SELECT p_partkey, regexp_replace('n' || p_partkey || '.' || p_size || '.PDF', '\\.[^.]*$', '') AS title FROM part")
def file_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", library.file_title(F.expr("'n' || p_partkey || '.' || p_size || '.PDF'")).alias("title"))


_LAYOUT = """'{"schema_name":"' || CASE WHEN turn % 9 = 8 THEN 'Other' ELSE 'DoclingDocument' END || '","body":{"children":[{"$ref":"#/texts/0"},{"$ref":"#/groups/0"},{"$ref":"#/pictures/0"},{"$ref":"#/texts/3"},{"$ref":"#/texts/0"}]},'
 || '"groups":[{"children":[{"$ref":"#/texts/2"},{"$ref":"#/texts/1"}]}],"pictures":[{"children":[{"$ref":"#/texts/4"}]}],"texts":[{"label":"section_header","level":' || (turn % 3 + 1) || ',"text":" Part ' || turn || ' ","prov":[{"page_no":' || (turn + 1) || '}]},'
 || '{"label":"formula","text":"a_' || turn || '"},{"content_layer":"' || CASE WHEN turn % 2 = 0 THEN 'furniture' ELSE 'body' END || '","label":"list_item","orig":"item"},{"label":"' || CASE WHEN turn % 3 = 0 THEN 'page_footer' ELSE 'text' END || '","text":"end"},{"label":"text","text":"in a picture"}]}'"""


@query("""WITH b AS (SELECT conv_id || '#' || turn AS doc, turn, unnest([0, 1, 2, 3]) AS k FROM conversations),
r AS (SELECT doc, turn, k, CASE k WHEN 0 THEN 'section_header' WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN 'furniture' ELSE 'list_item' END WHEN 2 THEN 'formula' ELSE 'text' END AS label,
 CASE k WHEN 0 THEN 'Part ' || turn WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN '' ELSE 'item' END WHEN 2 THEN 'a_' || turn ELSE 'end' END AS text,
 CASE WHEN k = 0 THEN turn + 1 END AS page, CASE WHEN k = 0 THEN turn % 3 + 1 END AS level FROM b WHERE turn % 9 <> 8 AND NOT (k = 3 AND turn % 3 = 0))
SELECT doc, k AS ord, label, text, page, level FROM r UNION ALL SELECT conv_id || '#' || turn, 0, 'error', 'not a layout document', NULL, NULL FROM conversations WHERE turn % 9 = 8""")
def layout_flatten(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select(F.expr("conv_id || '#' || turn").alias("doc"), F.expr(_LAYOUT).alias("content"))
    return layout.layout_blocks(docs).select("doc", "ord", "label", "text", "page", "level")


@query("""WITH b AS (SELECT turn, unnest([0, 1, 2, 3]) AS k FROM conversations WHERE turn % 9 <> 8)
SELECT count(*) FILTER (k = 2) AS formulas, count(*) FILTER (k = 1 AND turn % 2 = 0) AS furniture, count(*) FILTER (NOT (k = 3 AND turn % 3 = 0) AND NOT (k = 1 AND turn % 2 = 0)) AS blocks FROM b""")
def layout_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select(F.expr("conv_id || '#' || turn").alias("doc"), F.expr(_LAYOUT).alias("content"))
    n = lambda c, name: F.count_if(c).alias(name)
    label = F.col("label")
    return layout.layout_blocks(docs).agg(n(label == "formula", "formulas"), n(label == "furniture", "furniture"), n(~label.isin("error", "furniture"), "blocks"))


@query("""SELECT page_id, 'On ' || page_id AS title, 'Ada Q' || (page_id % 7) || '|Bo' AS authors, CASE WHEN page_id % 3 < 2 THEN 1990 + page_id % 30 END AS year, CASE WHEN page_id % 4 = 0 THEN '10.48550/a.' || page_id END AS doi FROM pages""")
def abs_page(spark, sf_dir):
    html = F.expr("""html || '<meta name="citation_title" content="On ' || page_id || '"><meta name="citation_author" content="Ada Q' || page_id % 7 || '"/><meta content="Bo" name="citation_author">'
      || CASE page_id % 3 WHEN 0 THEN '<meta name="citation_date" content="' || (1990 + page_id % 30) || '/02/03">' WHEN 1 THEN '<meta name="citation_date" content="' || (1990 + page_id % 30) || '-05">' ELSE '<meta name="citation_date" content="soon">' END
      || CASE WHEN page_id % 4 = 0 THEN '<meta name="citation_doi" content="10.48550/a.' || page_id || '">' ELSE '' END""")
    found = table(spark, sf_dir, "pages").select("page_id", pages.abs_page_record(html).alias("r"))
    return found.select("page_id", "r.title", F.array_join("r.authors", "|").alias("authors"), F.col("r.year").cast("long").alias("year"), "r.doi")


# ---- works one by one

@query("WITH {works} SELECT key, title, year FROM works WHERE key = 'doc-3'")
def show_work(spark, sf_dir):
    return catalogue.show(fixtures.works(spark, sf_dir), "doc-3").select("key", "title", "year")


@query(f"""WITH {{works}}, hit AS (SELECT key FROM works WHERE contains({_HAY}, 'quill1') AND list_has_any(list_transform(tags, lambda t: lower(t)), ['en', 'web']) ORDER BY key LIMIT 25)
SELECT row_number() OVER (ORDER BY key)::INT AS place, key FROM hit""")
def list_limited(spark, sf_dir):
    found = catalogue.list_works(fixtures.works(spark, sf_dir), "Quill1", ["EN", "web"], 25)
    return found.select("key").withColumn("place", F.row_number().over(Window.orderBy("key"))).select("place", "key")


@query(f"""WITH {{works}}, k AS (SELECT key, doc_id, {_NORM.replace('{c}', 'title')} AS t, {_NORM.replace('{c}', 'doi')} AS d FROM works),
asked AS (SELECT 'new-' || key AS key, CASE WHEN doc_id % 2 = 0 THEN t ELSE 'unseen ' || doc_id END AS t, CASE WHEN doc_id % 3 = 1 THEN '10.1234/q.3' WHEN doc_id % 3 = 2 THEN '10.9/x' END AS d FROM k)
SELECT a.key FROM asked a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.t = a.t) AND NOT EXISTS (SELECT 1 FROM k WHERE k.d = a.d)""")
def import_skip(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    doi = F.when(F.col("doc_id") % 3 == 1, "10.1234/Q.3").when(F.col("doc_id") % 3 == 2, "10.9/x")
    asked = w.select(F.concat(F.lit("new-"), "key").alias("key"), F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(F.concat(F.lit("Unseen "), "doc_id")).alias("title"), doi.alias("doi"))
    return duplicates.without_duplicates(asked, w).select("key")


@query(f"WITH {{works}} SELECT key, key || CASE WHEN has_pdf THEN ' [PDF]' ELSE '' END || ' ' || {_SCORE} || '/13' AS label FROM works")
def dup_labels(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    return w.select("key", duplicates.group_label(F.col("key"), F.col("has_pdf"), quality.completeness(w)).alias("label"))


@query("""WITH {works} SELECT key, CASE WHEN key = 'doc-4' THEN 1999 ELSE year END AS year, CASE WHEN key = 'doc-4' THEN NULL ELSE journal END AS journal,
 array_to_string(CASE WHEN key = 'doc-4' THEN list_append(list_filter(tags, lambda t: lower(t) <> lower(source_)), 'Kept') ELSE tags END, ',') AS tags FROM works, (SELECT source AS source_ FROM documents WHERE doc_id = 4)""")
def work_update(spark, sf_dir):
    w = fixtures.works(spark, sf_dir)
    source = table(spark, sf_dir, "documents").filter("doc_id = 4").first()["source"]
    after, _ = edits.update_works(w, "doc-4", {"year": 1999}, ("journal",), ["Kept"], [source.upper()])
    return after.select("key", F.col("year").cast("long").alias("year"), "journal", F.array_join("tags", ",").alias("tags"))


@query("WITH {works} SELECT key, 'book' AS kind, '2nd' AS edition, 'P' AS publisher, NULL::VARCHAR AS series, 1850 AS year, title FROM works")
def import_options(spark, sf_dir):
    done = edits.import_overrides(fixtures.works(spark, sf_dir), "book", {"edition": " 2nd ", "publisher": "P", "year": 1850})
    return done.select("key", "kind", "edition", "publisher", "series", F.col("year").cast("long").alias("year"), "title")


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ', ' || c_mktsegment WHEN 1 THEN c_name || ' ,A, ' || c_mktsegment ELSE c_name END AS n FROM customer)
SELECT c_custkey, CASE WHEN contains(n, ',') THEN trim(substr(n, strpos(n, ',') + 1)) || ' ' || trim(left(n, strpos(n, ',') - 1)) ELSE n END AS name FROM n""")
def names_flipped(spark, sf_dir):
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN c_name || ', ' || c_mktsegment WHEN 1 THEN c_name || ' ,A, ' || c_mktsegment ELSE c_name END")
    return table(spark, sf_dir, "customer").select("c_custkey", text.given_family(name).alias("name"))


@query("SELECT doc_id, left(text, list_max(list_filter(range(0, 61), lambda k: strlen(left(text, k)) <= 60))) AS cut FROM documents")
def bytes_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 60).alias("cut"))


@query("WITH {works} SELECT key, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM works")
def slugs_migrated(spark, sf_dir):
    return fixtures.works(spark, sf_dir).select("key", text.migration_slug(F.col("title")).alias("slug"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Semantic index not built.' || chr(10) || 'Run `quillstack semantic-index` first.' WHEN 1 THEN 'Semantic index was built with an older model; run `quillstack semantic-index`'
 WHEN 2 THEN 'Semantic index not built.' || chr(10) || 'Run `quillstack semantic-index` first.' ELSE 'Semantic search: ' || o_orderkey || ' semantic index is empty' END AS message FROM orders""")
def search_errors(spark, sf_dir):
    error = F.expr("o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN ': Semantic index is empty' WHEN 1 THEN ': Semantic index uses model x' WHEN 2 THEN ' Semantic index is not initialized' ELSE ' semantic index is empty' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.search_error(error).alias("message"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 1200 AS done, p_size * 20 AS total, p_partkey * 7 % 5000 AS s FROM part), q AS (SELECT p_partkey, least(done, greatest(total, 1)) AS done, greatest(total, 1) AS total, s FROM p)
SELECT p_partkey, 'Embedding passages [' || repeat('=', (done * 30 // total)::INT) || repeat(' ', 30 - (done * 30 // total)::INT) || '] ' || lpad((done * 100 // total)::VARCHAR, 3, ' ') || '% ' || done || '/' || total || ' '
 || lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS line FROM q""")
def progress_lines(spark, sf_dir):
    big = lambda e: F.expr(e).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", text.progress_line(big("p_partkey % 1200"), big("p_size * 20"), big("p_partkey * 7 % 5000"), 30).alias("line"))


# ---- passages on a screen

@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'H2' || chr(10) || 'body ' || turn WHEN 1 THEN 'body ' || turn WHEN 2 THEN 'body' || chr(10) || 'H1' ELSE 'H1 x' END AS shown FROM conversations""")
def heading_strip(spark, sf_dir):
    given = F.expr("CASE turn % 4 WHEN 0 THEN 'H1\\n\\nH2\\nbody ' || turn WHEN 1 THEN ' h2\\r\\nH1 \\n\\n \\nbody ' || turn WHEN 2 THEN '\\nbody\\nH1\\n' ELSE 'H1 x' END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", math.without_headings(given, F.array(F.lit("H1"), F.lit(" H2 "))).alias("shown"))


@query("SELECT p_partkey, 'x' || translate(p_partkey::VARCHAR || '+-=()', '0123456789-', '₀₁₂₃₄₅₆₇₈₉₋') AS low FROM part")
def subscript_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("x"), math.subscript(F.concat(F.col("p_partkey").cast("string"), F.lit("+-=()")))).alias("low"))


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 7 % 256)::BIGINT AS r, (p_partkey * 13 % 256)::BIGINT AS g, (p_partkey * 29 % 256)::BIGINT AS b FROM part), k AS (SELECT *, 255 - (77 * r + 150 * g + 29 * b + 128) // 256 AS ink FROM c),
e AS (SELECT *, least((ink * 5 + 3) // 4, 255) AS strong FROM k) SELECT p_partkey, ink, strong, (20 * (255 - strong) + 230 * strong) // 255 AS red FROM e""")
def ink_pixels(spark, sf_dir):
    channel = lambda n: F.expr(f"p_partkey * {n} % 256").cast("long")
    ink = table(spark, sf_dir, "part").select("p_partkey", math.ink_coverage(channel(7), channel(13), channel(29)).alias("ink"))
    strong = ink.withColumn("strong", math.emphasise(F.col("ink")).cast("long"))
    return strong.withColumn("red", math.blend(F.lit(230), F.lit(20), F.col("strong")))


@query("""WITH n AS (SELECT p_partkey, greatest((p_size * 37 % 900 + 7) // 8, 1) AS c, greatest((p_size * 11 % 700 + 15) // 16, 1) AS r FROM part), s AS (SELECT *, least(1.0::DOUBLE, 40::DOUBLE / c, 12::DOUBLE / r) AS s FROM n)
SELECT p_partkey, greatest(ceil(c * s), 1)::BIGINT AS columns, greatest(ceil(r * s), 1)::BIGINT AS rows FROM s""")
def formula_cells(spark, sf_dir):
    size = math.cell_size(F.expr("p_size * 37 % 900"), F.expr("p_size * 11 % 700"), F.lit(40), F.lit(12))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", F.col("s.columns").cast("long").alias("columns"), F.col("s.rows").cast("long").alias("rows"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN {tok("text")} ELSE {tok("'old ' || lang")} END AS ts FROM documents)
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY ALL""")
def postings_refresh(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    stored = lexical.postings(docs.select("doc_id", F.concat(F.lit("old "), "lang").alias("text")).withColumnRenamed("doc_id", "key"), ("text",))
    now = docs.select(F.col("doc_id").alias("key"), "text")
    fresh = incremental.refresh_postings(stored, now, now.filter("key % 5 = 0"), ("text",))
    return fresh.groupBy(F.col("key").alias("doc_id"), "term").agg(F.count("*").alias("n"))
