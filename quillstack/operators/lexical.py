"""Full-text search: postings, BM25, phrases, snippets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LOOSE_MARKS, fold_marks
from ..plans.durable import durable

#: BM25's constants and the least inverse document frequency (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: The columns that a work is found by (fixed values).
COLUMNS = ("title", "authors", "abstract", "tags", "fulltext")
#: Words a snippet shows at most, and its marks (fixed values).
SNIPPET_WORDS, MARK_OPEN, MARK_CLOSE, ELLIPSIS = 20, "{{", "}}", "..."
#: ASCII letters and digits stand first, which is looked up and not worked out.
NO_WORD, A_WORD = r"[^a-z0-9\p{L}\p{N}\p{Co}]+", rf"[a-zA-Z0-9\p{{L}}\p{{N}}\p{{Co}}][a-zA-Z0-9\p{{L}}\p{{N}}\p{{Co}}{LOOSE_MARKS}]*"
#: A token as it stands in a text, with the loose marks that it loses.
_WORD = rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{LOOSE_MARKS}]*"


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, marks off."""
    return F.filter(F.split(fold_marks(F.coalesce(c, F.lit(""))), NO_WORD), lambda t: t != "")


def lexical_documents(works: DataFrame) -> DataFrame:
    """(key, title, authors, abstract, tags, fulltext) as text columns."""
    text = lambda n, sep: F.array_join(n, sep)
    return works.select("key", "title", text("authors", "; ").alias("authors"), F.coalesce("abstract", F.lit("")).alias("abstract"), text("tags", ", ").alias("tags"), F.coalesce("fulltext", F.lit("")).alias("fulltext"))


def postings(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "key") -> DataFrame:
    """(key, col, pos, term): one row per word. What a stored index holds; searches of a few phrases don't need it."""
    cols = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("ts")) for c in columns))
    return docs.select(key, F.explode(cols).alias("c")).select(key, "c.col", F.posexplode("c.ts").alias("pos", "term"))


def postings_statistics(terms: DataFrame, key: str = "key") -> DataFrame:
    """(term, df, cf): rows and occurrences of each term."""
    per_row = terms.groupBy("term", key).agg(F.count("*").alias("n"))
    return per_row.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def document_lengths(docs: DataFrame, columns: tuple[str, ...], key: str = "key") -> DataFrame:
    return docs.select(key, sum((token_count(F.col(c)) for c in columns), F.lit(0)).alias("length"))


def parse_query(spark: SparkSession, query: str) -> list[list[str]]:
    """The phrases of a query: each word is one, of the tokens it falls into; words without tokens are ignored beside others."""
    if not query.strip():
        raise ValueError("the query is blank")
    listed = [w.replace('"', "") for w in query.split()]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(listed)], "i int, w string").select("i", tokens(F.col("w")).alias("t")).orderBy("i").collect()
    return [list(r["t"]) for r in rows if r["t"]]


def normalised(c: Column) -> Column:
    return fold_marks(F.coalesce(c, F.lit("")))


def token_count(text: Column) -> Column:
    """How many tokens a text has; it need not be folded for that, as marks only part tokens where something else does."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(A_WORD))


def phrase_pattern(phrase: list[str]) -> str:
    """A pattern of a phrase's first token where the others follow; what follows is only looked at, so phrases may overlap."""
    word, edge = r"[\p{IsAlphabetic}\p{N}]", r"(?![\p{IsAlphabetic}\p{N}])"
    rest = "".join(f"{NO_WORD}{t}" for t in phrase[1:])
    # the token is looked for first, what stands before it only where it is found
    first = rf"{phrase[0]}(?<!{word}{phrase[0]})"
    return rf"{first}(?={rest}{edge})" if rest else rf"{first}{edge}"


def matches(docs: DataFrame, phrases: list[list[str]], columns: tuple[str, ...], key: str = "key") -> DataFrame:
    """(key, length, f0, f1, ...): every row with its length and how often each phrase stands in it.

    Counted on the texts as they are, without arrays of tokens: a phrase never
    goes over the border of two columns.
    """
    lengths = sum((token_count(F.col(c)) for c in columns), F.lit(0))
    plain = docs.select(key, lengths.alias("length"), *(normalised(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)))
    total = lambda count: sum((count(F.col(f"_t{i}")) for i in range(len(columns))), F.lit(0))

    def often(t: Column, phrase: list[str]) -> Column:
        there = reduce(Column.__and__, (F.contains(t, F.lit(w)) for w in phrase))
        return F.when(there, F.regexp_count(t, F.lit(phrase_pattern(phrase)))).otherwise(0)

    counts = [total(lambda t, p=p: often(t, p)).alias(f"f{j}") for j, p in enumerate(phrases)]
    return plain.select(key, "length", *counts)


def bm25(docs: DataFrame, query: str, columns: tuple[str, ...] = COLUMNS, key: str = "key") -> DataFrame:
    """(key, score) of the rows that hold every phrase of the query; a smaller score is better.

    One pass tokenises and counts, and what it finds is written to the shared
    folder; the corpus statistics are one aggregated row, joined back to the few
    rows that match.
    """
    phrases = parse_query(docs.sparkSession, query)
    if not phrases:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = durable(matches(docs, phrases, columns, key))
    n = len(phrases)
    corpus = counted.agg(F.count("*").alias("rows"), F.avg("length").alias("avg_length"), *(F.count_if(F.col(f"f{j}") > 0).alias(f"n{j}") for j in range(n)))
    return score_matches(counted, corpus, n, key)


def score_matches(counted: DataFrame, corpus: DataFrame, n: int, key: str) -> DataFrame:
    """(key, score) of rows (key, length, f0, ...) with all n phrases, by the one row (rows, avg_length, n0, ...) of corpus."""
    hits = counted.filter(" and ".join(f"f{j} > 0" for j in range(n))).crossJoin(F.broadcast(corpus))

    def part(j: int) -> Column:
        f, df = F.col(f"f{j}").cast("double"), F.col(f"n{j}")
        idf = F.log((F.col("rows") - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))

    return hits.select(key, (-sum((part(j) for j in range(n)), F.lit(0.0))).alias("score"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _instances(folded: Column, phrases: list[list[str]]) -> Column:
    """Where phrases stand among tokens: structs (at, phrase, last), by place and phrase."""
    found = F.array().cast("array<struct<at:int,phrase:int,last:int>>")
    for i, p in enumerate(phrases):
        found = F.concat(found, _of_phrase(folded, i, p))
    return F.array_sort(found)


def _of_phrase(folded: Column, i: int, phrase: list[str]) -> Column:
    size, same = len(phrase), F.array(*map(F.lit, phrase))
    at = F.filter(F.transform(folded, lambda t, k: k), lambda k: F.slice(folded, k + 1, size) == same)
    return F.transform(at, lambda k: F.struct(k.alias("at"), F.lit(i).alias("phrase"), (k + (size - 1)).alias("last")))


def _window(instances: Column, at: Column, n: Column) -> Column:
    """(score, start) of the window at a place: each phrase in it counts 1000, each further instance 1; start puts what it holds in the middle."""

    def scored(inside: Column) -> Column:
        phrases = F.size(F.array_distinct(F.transform(inside, lambda x: x["phrase"])))
        first, last = F.get(inside, F.lit(0))["at"], F.try_element_at(inside, F.lit(-1))["last"] + 1
        # half of what is left over, towards zero
        rest = F.lit(SNIPPET_WORDS) - (last - first)
        half = F.when(rest >= 0, F.floor(rest / 2)).otherwise(F.ceil(rest / 2)).cast("int")
        start = F.greatest(F.least(first - half, n - SNIPPET_WORDS), F.lit(0))
        return F.struct((phrases * 1000 + F.size(inside) - phrases).alias("score"), start.alias("start"))

    return _let(F.filter(instances, lambda x: (x["at"] >= at) & (x["at"] < at + SNIPPET_WORDS)), scored)


def _best_start(instances: Column, between: Column, n: Column) -> Column:
    """The first token shown: of the windows around each instance and at the sentence before it the first of the highest score."""
    sentences = F.filter(F.transform(between, lambda s, i: F.when((i == 0) | F.rlike(s, F.lit("[.:][ \\t\\n\\r]+$")), i)), lambda i: i.isNotNull() & (i < n))

    def windows(x: Column, k: Column, sentences: Column) -> Column:
        before = F.array_max(F.filter(sentences, lambda i: i <= x["at"]))
        own = _let(_window(instances, x["at"], n), lambda w: F.struct(w["score"].alias("score"), (-2 * k).alias("order"), w["start"].alias("start")))
        extra = F.when(before == 0, 120).otherwise(100)
        led = _let(_window(instances, before, n), lambda w: F.struct((w["score"] + extra).alias("score"), (-2 * k - 1).alias("order"), before.alias("start")))
        return F.array(own, F.when((n > SNIPPET_WORDS) & (before < x["at"]), led))

    best = _let(sentences, lambda ss: F.array_max(F.array_compact(F.flatten(F.transform(instances, lambda x, k: windows(x, k, ss))))))
    return F.coalesce(best["start"], F.lit(0))


def _runs(instances: Column) -> Column:
    """Instances that overlap as one: structs (at, last)."""

    def merge(runs: Column, x: Column) -> Column:
        end = F.try_element_at(runs, F.lit(-1))
        fresh = F.struct(x["at"].alias("at"), x["last"].alias("last"))
        joined = F.struct(end["at"].alias("at"), F.greatest(end["last"], x["last"]).alias("last"))
        return F.when(F.coalesce(x["at"] <= end["last"], F.lit(False)), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(joined))).otherwise(F.concat(runs, F.array(fresh)))

    return F.aggregate(instances, F.array().cast("array<struct<at:int,last:int>>"), merge)


def snippet(title: Column, phrases: list[list[str]]) -> Column:
    """The title with what the phrases match marked, cut to 20 words around most of it; overlapping matches are marked as one.

    The window is the one that the standard full-text extension chooses: it holds as
    many phrases as any, starts at a sentence where that holds no fewer, and has its
    matches in the middle elsewhere.  Null stays null.
    """

    def shown(t: Column, folded: Column, instances: Column) -> Column:
        n, words_, between = F.size(folded), t["words"], t["between"]

        def cut(start: Column) -> Column:
            end = F.least(start + (SNIPPET_WORDS - 1), n - 1)
            runs = F.filter(_runs(instances), lambda r: (r["at"] >= start) & (r["at"] <= end))
            opens, closes = F.transform(runs, lambda r: r["at"]), F.transform(runs, lambda r: F.least(r["last"], end))

            def word(i: Column, marks: Column) -> Column:
                led = F.when((i == start) & (start > 0), "").otherwise(F.get(between, i))
                mark = lambda of, text: F.when(F.array_contains(of, i), text).otherwise("")
                return F.concat(led, mark(marks["opens"], MARK_OPEN), F.get(words_, i), mark(marks["closes"], MARK_CLOSE))

            body = _let(F.struct(opens.alias("opens"), closes.alias("closes")), lambda m: F.array_join(F.transform(F.sequence(start, end), lambda i: word(i, m)), ""))
            rest = F.when(start + (SNIPPET_WORDS - 1) >= n - 1, F.get(between, n)).otherwise(ELLIPSIS)
            return F.concat(F.when(start > 0, ELLIPSIS).otherwise(""), body, rest)

        return F.when(n == 0, title).otherwise(_let(_best_start(instances, between, n), cut))

    parts = F.struct(F.regexp_extract_all(title, F.lit(_WORD), F.lit(0)).alias("words"), F.split(title, _WORD, -1).alias("between"))
    made = _let(parts, lambda t: _let(F.transform(t["words"], fold_marks), lambda f: _let(_instances(f, phrases), lambda x: shown(t, f, x))))
    return F.when(title.isNotNull(), made)


def search(works: DataFrame, query: str, limit: int | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(key, title, authors, year, snippet, score) of the works that match, best first."""
    docs = lexical_documents(works)
    phrases = parse_query(works.sparkSession, query)
    hits = bm25(docs, query, columns).orderBy("score", "key")
    hits = hits if limit is None else hits.limit(limit)
    found = works.select("key", "title", "authors", "year").join(hits, "key")
    return found.select("key", "title", "authors", "year", snippet(F.col("title"), phrases).alias("snippet"), "score").orderBy("score", "key")


def exact_terms(query: str, spark) -> list[str]:
    """The distinct words of over one character, lower-cased and sorted, underscores kept inside; refuses a query without any."""
    row = spark.createDataFrame([(query,)], "q string").select(
        F.array_sort(F.array_distinct(F.filter(F.transform(F.split("q", r"[^\p{IsAlphabetic}\p{N}_]+"), lambda t: F.lower(F.regexp_replace(t, "^_+|_+$", ""))), lambda t: F.length(t) > 1))).alias("t")
    ).first()
    if not row["t"]:
        raise ValueError("the query has no words to match exactly")
    return list(row["t"])


def with_all_terms(rows: DataFrame, query: str, columns: tuple[str, ...], key: str) -> DataFrame:
    """The keys of rows in which every term of the query stands, as a phrase, in any of the columns."""
    phrases = [p for t in exact_terms(query, rows.sparkSession) for p in parse_query(rows.sparkSession, t)]
    counted = matches(rows, phrases, columns, key)
    return counted.filter(" and ".join(f"f{j} > 0" for j in range(len(phrases)))).select(key)
