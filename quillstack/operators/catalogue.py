"""Listing, filtering, sorting, faceting and paging works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sort_surname
from .fuzzy import fuzzy_score

#: Works a page of results shows unless told otherwise (fixed value).
PAGE = 100


def haystack(df: DataFrame) -> Column:
    """What listing searches in, lower-cased: key, title, authors, tags, doi, arxiv, publisher, series, edition, isbn."""
    flat = {"authors", "tags", "isbn"}
    names = ("key", "title", "authors", "tags", "doi", "arxiv", "publisher", "series", "edition", "isbn")
    parts = [F.array_join(n, " ") if n in flat else F.coalesce(F.col(n), F.lit("")) for n in names]
    return F.lower(F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit(" "), p))))


def list_works(works: DataFrame, query: str = "", tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Works that contain the query, and have any of the tags whatever their case; by key, at most limit."""
    out = works
    if query.strip():
        out = out.filter(F.contains(haystack(works), F.lit(query.strip().lower())))
    if tags:
        wanted = [t.lower() for t in tags]
        out = out.filter(F.exists("tags", lambda t: F.lower(t).isin(*wanted)))
    out = out.orderBy("key")
    return out if limit is None else out.limit(limit)


def with_any_tag(works: DataFrame, tags: list[str]) -> DataFrame:
    """Works that have one of the tags exactly; all works without tags given."""
    return works.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else works


def with_tag(works: DataFrame, tag: str) -> DataFrame:
    return works.filter(F.array_contains("tags", tag))


def fuzzy_filter(works: DataFrame, query: str, shown: Column) -> DataFrame:
    """Works whose shown line matches, best first, ties by key."""
    return works.withColumn("score", fuzzy_score(query, shown)).filter("score is not null").orderBy(F.desc("score"), "key")


SORTS = ("name", "author", "year", "title")


def sort_columns(by: str, reverse: bool = False) -> list[Column]:
    """The order of a sort; by year the newest come first; ties go by key, reversed or not."""
    lead = {
        "name": F.col("key"),
        "author": sort_surname(F.get("authors", F.lit(0))),
        "year": F.coalesce("year", F.lit(0)),
        "title": F.lower("title"),
    }[by]
    return [lead.desc() if (by == "year") != reverse else lead.asc(), F.col("key").asc()]


def sort_works(works: DataFrame, by: str = "name", reverse: bool = False, query: str = "") -> DataFrame:
    """Sorted works; a query's own order takes the place of a sort."""
    return works if query.strip() else works.orderBy(*sort_columns(by, reverse))


def ranked_by(works: DataFrame, by: str, reverse: bool = False) -> DataFrame:
    """(key, rank) of a sort. The rank needs the order of all rows; only keys and what they sort by travel for it."""
    return with_positions(works.select("key", "authors", "year", "title"), sort_columns(by, reverse), "rank").select("key", "rank")


def with_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in an order of all of them, without bringing them into one partition.

    Range-partitioned and sorted, each partition numbers its rows, and the
    partitions' row counts, one number each, say where each one begins.  The
    sorted rows are written to the shared folder first, so both steps see the
    same partitions.
    """
    from ..plans.durable import durable

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = durable(keyed.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_nth") + 1).cast("long")).drop("_part", "_nth", "_start")


def tag_facet(works: DataFrame) -> DataFrame:
    """(tag, n): every occurrence of every tag, and (all) for the number of works."""
    tags = works.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.unionByName(works.agg(F.count("*").alias("n")).select(F.lit("(all)").alias("tag"), "n"))


def distinct_tags(works: DataFrame) -> DataFrame:
    return works.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def tags_like(works: DataFrame, part: str) -> DataFrame:
    """(all) and the tags, those that contain a string whatever its case."""
    every = distinct_tags(works).unionByName(works.sparkSession.createDataFrame([("(all)",)], "tag string"))
    return every.filter(F.contains(F.lower("tag"), F.lit(part.lower()))).orderBy("tag")


def page_bounds(total: int, offset: int = 0, limit: int = PAGE) -> tuple[int, int, int | None]:
    """(returned, end, next offset or None); refuses a limit of 0 and an offset beyond the end."""
    if limit <= 0:
        raise ValueError("the limit is 1 at least")
    if not 0 <= offset <= total:
        raise ValueError(f"the offset {offset} is beyond {total}")
    end = min(offset + limit, total)
    return end - offset, end, end if end < total else None


def page_limit(total: int, offset: int, limit: int | None, all_rows: bool) -> int:
    """How many rows a page may have: what is given, everything that is left, or the default."""
    if all_rows and limit is not None:
        raise ValueError("a limit and all rows exclude each other")
    return max(total - offset, 1) if all_rows else PAGE if limit is None else limit


def capped(total: int, cap: int) -> int:
    """The rows that are shown at most; a cap of 0 is none."""
    return total if cap == 0 else min(total, cap)


def page(ranked: DataFrame, rank: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Rows of ranks offset + 1 to offset + limit, in order."""
    return ranked.filter(F.col(rank).between(offset + 1, offset + limit)).orderBy(rank)


def new_keys(after: DataFrame, before: DataFrame) -> DataFrame:
    return after.select("key").join(before.select("key"), "key", "left_anti").distinct().orderBy("key")


def free_names(wanted: DataFrame, base: str, taken: DataFrame, first: int, name: str) -> DataFrame:
    """wanted (key, base and more) with a name of its own for each row: the base, else base-first, base-(first + 1), the first that is free.

    Rows of one base take the free names in the order of their keys.  ``taken`` has
    one column, the names that there are.  A name is its base's place 0 or, from
    ``first`` on, the place that its number says; of a base's rows the one of rank r
    takes place r and one more for each taken place that lies below.  Where two bases
    come to the same name, the smaller key keeps it and the other tries again.
    """
    from ..plans.durable import durable

    def ranked(df: DataFrame, by: list[str], column: str) -> DataFrame:
        placed = with_positions(df, [F.col(c) for c in by], "_at")
        return placed.join(placed.groupBy(by[0]).agg(F.min("_at").alias("_low")), by[0]).withColumn(column, F.col("_at") - F.col("_low")).drop("_at", "_low")

    done, left, taken = None, wanted, taken.toDF("_name")
    while True:
        number = F.regexp_extract("_name", r"-(0|[1-9]\d{0,8})$", 1)
        bare = taken.select(F.col("_name").alias("_base"), F.lit(0).cast("long").alias("_place"))
        numbered = taken.filter((number != "") & (F.try_to_number(number, F.lit("999999999")) >= first)).select(F.regexp_replace("_name", r"-\d+$", "").alias("_base"), (number.cast("long") - first + 1).alias("_place"))
        used = bare.unionByName(numbered).join(left.select(F.col(base).alias("_base")).distinct(), "_base", "left_semi").distinct()
        # taken places in a row share their distance to their rank
        runs = ranked(used, ["_base", "_place"], "_nth").groupBy("_base", (F.col("_place") - F.col("_nth")).alias("from")).agg(F.count("*").alias("n"))
        below = runs.groupBy("_base").agg(F.collect_list(F.struct("from", "n")).alias("_runs"))
        placed = ranked(left.withColumn("_base", F.col(base)), ["_base", "key"], "_rank").join(below, "_base", "left")
        skipped = F.aggregate(F.filter("_runs", lambda r: r["from"] <= F.col("_rank")), F.lit(0).cast("long"), lambda acc, r: acc + r["n"])
        place = F.col("_rank") + F.coalesce(skipped, F.lit(0))
        own = F.when(place == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), (place - 1 + first).cast("string")))
        named = durable(placed.withColumn(name, own).drop("_base", "_rank", "_runs"))
        owners = named.groupBy(name).agg(F.min("key").alias("_owner"), F.count("*").alias("_n"))
        clash = owners.filter("_n > 1").select(name, "_owner")
        if clash.isEmpty():
            return named if done is None else done.unionByName(named)
        lost = named.join(clash, name).filter("key != _owner").drop(name, "_owner")
        kept = named.join(lost.select("key"), "key", "left_anti").select(*named.columns)
        done = kept if done is None else done.unionByName(kept)
        taken, left = taken.unionByName(kept.select(F.col(name).alias("_name"))), lost


def final_keys(works: DataFrame, base: Column, existing: DataFrame | None = None) -> DataFrame:
    """(key, base_key, final_key): the base key where no work has it, else with -2, -3 and so on, the first that is free."""
    keyed = works.select("key", base.alias("base_key"))
    taken = works.sparkSession.createDataFrame([], "key string") if existing is None else existing.select("key")
    return free_names(keyed, "base_key", taken, 2, "final_key").select("key", "base_key", "final_key")


def show(works: DataFrame, key: str) -> DataFrame:
    """The work of a key; refuses what isn't a single name, and a key that there isn't."""
    if not key or "/" in key or "\\" in key or key in (".", ".."):
        raise ValueError(f"not a key: {key!r}")
    found = works.filter(F.col("key") == key)
    if found.isEmpty():
        raise KeyError(key)
    return found


def result_counter(works: DataFrame, matches: Column) -> DataFrame:
    return works.agg(F.count_if(matches).alias("matched"), F.count("*").alias("total"))
