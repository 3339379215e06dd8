"""Changing works: tag edits, updates, additive merges, and what they changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a record in the order that changes are listed in.
FIELDS = ("abstract", "arxiv", "authors", "doi", "edition", "files", "isbn", "journal", "kind", "publisher", "series", "tags", "title", "year")
LISTS = ("authors", "files", "isbn", "tags")
BOOK_ONLY = ("edition", "publisher", "series", "isbn")


def edit_tags(tags: Column, add: list[str] = (), remove: list[str] = ()) -> Column:
    """Tags without those to remove, and with those to add that aren't there, case aside; the first spelling stays."""
    gone = [t.lower() for t in remove]
    kept = F.filter(tags, lambda t: ~F.lower(t).isin(*gone)) if gone else tags

    def with_one(acc: Column, tag: str) -> Column:
        return F.when(F.exists(acc, lambda t: F.lower(t) == tag.lower()), acc).otherwise(F.array_append(acc, F.lit(tag)))

    return reduce(with_one, add, kept)


def _shown(df: DataFrame, name: str) -> Column:
    """A field as its record would hold it: null where the record leaves it out."""
    c = F.col(name)
    if name == "kind":
        return F.when(c != "paper", F.to_json(F.struct(c.alias("v"))))
    if name == "isbn":
        return F.when(F.size(c) > 0, F.to_json(F.struct(c.alias("v"))))
    return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})


def field_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, field, before, after) as JSON, of the fields that both records hold, by name.

    A kind of paper and an empty isbn aren't held, so changes from or to them
    aren't listed.
    """
    pack = lambda df, name: df.select("key", *(_shown(df, f).alias(f) for f in FIELDS)).select("key", F.array(*FIELDS).alias(name))
    both = pack(before, "_b").join(pack(after, "_a"), "key")
    rows = both.select("key", F.posexplode(F.arrays_zip("_b", "_a")).alias("i", "x"))
    named = rows.select("key", F.get(F.array(*map(F.lit, FIELDS)), F.col("i")).alias("field"), F.col("x._b").alias("b"), F.col("x._a").alias("a"))
    body = lambda c: F.regexp_extract(c, r'(?s)^\{"v":(.*)\}$', 1)
    return named.filter("b is not null and a is not null and b != a").select("key", "field", body(F.col("b")).alias("before"), body(F.col("a")).alias("after"))


def merge_missing(works: DataFrame, fetched: DataFrame) -> DataFrame:
    """Works with what they lack from fetched rows of the same key: a year of none or 0, no authors, null abstract, doi, arxiv, journal."""
    f = fetched.select("key", *(F.col(n).alias(f"_{n}") for n in ("year", "authors", "abstract", "doi", "arxiv", "journal")))
    joined = works.join(f, "key", "left")
    has_year = F.coalesce(F.col("year") != 0, F.lit(False))
    return (
        joined.withColumn("year", F.when(has_year, F.col("year")).otherwise(F.coalesce("_year", "year")))
        .withColumn("authors", F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("_authors", "authors")))
        .withColumns({n: F.coalesce(n, f"_{n}") for n in ("abstract", "doi", "arxiv", "journal")})
        .select(*works.columns)
    )


def reviewer_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, field, before, after) for a reader: year, authors, doi, arxiv, journal; an abstract only when there was none, as (fetched)."""
    a = after.select("key", *(F.col(n).alias(f"_{n}") for n in ("year", "authors", "doi", "arxiv", "journal", "abstract")))
    both = before.join(a, "key")
    text = {"year": lambda c: c.cast("string"), "authors": lambda c: F.array_join(c, ", ")}
    one = lambda name, b, x: F.when(~b.eqNullSafe(x), F.struct(F.lit(name).alias("field"), F.coalesce(b, F.lit("")).alias("before"), F.coalesce(x, F.lit("")).alias("after")))
    rows = [one(n, text.get(n, lambda c: c)(F.col(n)), text.get(n, lambda c: c)(F.col(f"_{n}"))) for n in ("year", "authors", "doi", "arxiv", "journal")]
    rows.append(F.when(F.col("abstract").isNull() & F.col("_abstract").isNotNull(), F.struct(F.lit("abstract").alias("field"), F.lit("").alias("before"), F.lit("(fetched)").alias("after"))))
    return both.select("key", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("key", "c.field", "c.before", "c.after")


def update_works(works: DataFrame, key: str, values: dict | None = None, clear: tuple[str, ...] = (), add_tags: list[str] = (), remove_tags: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(works after, changes): one work's fields set or cleared and its tags edited; refuses an edit of nothing and a field both set and cleared."""
    values = values or {}
    if not values and not clear and not add_tags and not remove_tags:
        raise ValueError("no changes requested")
    if both := set(values) & set(clear):
        raise ValueError(f"set and cleared: {sorted(both)}")
    mine = F.col("key") == key
    columns = {}
    for name in clear:
        kind = works.schema[name].dataType.simpleString()
        columns[name] = F.when(mine, F.array().cast(kind) if name in LISTS else F.lit(None).cast(kind)).otherwise(F.col(name))
    for name, value in values.items():
        kind = works.schema[name].dataType.simpleString()
        new = F.array(*map(F.lit, value)).cast(kind) if name in LISTS else F.lit(value).cast(kind)
        columns[name] = F.when(mine, new).otherwise(F.col(name))
    if add_tags or remove_tags:
        columns["tags"] = F.when(mine, edit_tags(F.col("tags"), list(add_tags), list(remove_tags))).otherwise(F.col("tags"))
    after = works.withColumns(columns)
    return after, field_changes(works.filter(mine), after.filter(mine))


def import_overrides(record: DataFrame, kind: str, options: dict, inputs: int = 1) -> DataFrame:
    """An imported record with the options of the import; book fields are refused for papers, blank values and several inputs too.

    Edition, publisher and series take the option's value even where it has none.
    """
    given = {k: v for k, v in options.items() if v is not None}
    if given and inputs != 1:
        raise ValueError("options go with a single input")
    if kind != "book" and (wrong := sorted(set(given) & set(BOOK_ONLY))):
        raise ValueError(f"only for books: {wrong}")
    clean = {}
    for name, value in given.items():
        clean[name] = [x.strip() for x in value] if isinstance(value, list) else value.strip() if isinstance(value, str) else value
        if clean[name] == "" or clean[name] == [] or (isinstance(clean[name], list) and "" in clean[name]):
            raise ValueError(f"{name} is blank")
    columns = {"kind": F.lit(kind)} | {n: F.lit(clean.get(n)).cast("string") for n in ("edition", "publisher", "series")}
    for name, value in clean.items():
        if name not in columns:
            columns[name] = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value).cast(record.schema[name].dataType)
    return record.withColumns(columns)
