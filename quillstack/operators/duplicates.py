"""Works that are the same: probes, groups, the best of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_key
from .catalogue import free_names
from .components import connected_components
from .quality import completeness


def probe(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """(candidate, match, reason): the first work, by key, of equal DOI or else title; a work that has both counts by its DOI.

    Two equi-joins, each with the first work of a value, and a choice between what they find.
    """
    known = library.select(F.col("key").alias("match"), normal_key(F.col("doi")).alias("_d"), normal_key(F.col("title")).alias("_t"))
    asked = candidates.select(F.col("key").alias("candidate"), normal_key(F.col("doi")).alias("_d"), normal_key(F.col("title")).alias("_t"))
    first = lambda by: known.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("match").alias("match"))
    by_doi = asked.join(first("_d"), "_d").select("candidate", "match", F.lit(0).alias("_o"), F.lit("doi").alias("reason"))
    by_title = asked.join(first("_t"), "_t").select("candidate", "match", F.lit(1).alias("_o"), F.lit("title").alias("reason"))
    best = by_doi.unionByName(by_title).groupBy("candidate").agg(F.min(F.struct("match", "_o", "reason")).alias("b"))
    return best.select("candidate", "b.match", "b.reason")


def without_duplicates(candidates: DataFrame, library: DataFrame, force: bool = False) -> DataFrame:
    """Candidates that the library doesn't have yet; all of them where forced."""
    if force:
        return candidates
    return candidates.join(probe(candidates, library).select(F.col("candidate").alias("key")), "key", "left_anti")


def duplicate_groups(works: DataFrame) -> DataFrame:
    """(group_id, key): works linked by equal titles or equal DOIs, to any distance; groups of two and more.

    Works are linked to the smallest key of their title and of their DOI, which
    is an aggregation, and the links' components are what is left; titles that
    many works share never make pairs.  group_id is the smallest key.
    """
    ids = works.select("key", normal_key(F.col("title")).alias("t"), normal_key(F.col("doi")).alias("d"))

    def links(by: str) -> DataFrame:
        named = ids.filter(F.col(by).isNotNull()).select("key", by)
        low = named.groupBy(by).agg(F.min("key").alias("b"))
        return named.join(low, by).filter("key != b").select(F.col("key").alias("a"), "b")

    found = connected_components(links("t").unionByName(links("d")))
    return found.select(F.col("component").alias("group_id"), F.col("node").alias("key"))


def exact_groups(works: DataFrame, by: Column) -> DataFrame:
    """(value, n, first): values that several works share."""
    return works.select("key", by.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1")


def describe_groups(groups: DataFrame, works: DataFrame, prefer_pdf: bool = True) -> DataFrame:
    """Members with title, doi, metadata_score, has_pdf and recommended: a PDF first, then the score, then the last key."""
    full = groups.join(works.select("key", "title", "doi", "has_pdf", completeness(works).alias("metadata_score")), "key")
    lead = [F.desc("has_pdf")] if prefer_pdf else []
    first = F.row_number().over(Window.partitionBy("group_id").orderBy(*lead, F.desc("metadata_score"), F.desc("key"))) == 1
    return full.select("group_id", "key", "title", "doi", "metadata_score", "has_pdf", first.alias("recommended"))


def group_label(key: Column, has_pdf: Column, score: Column) -> Column:
    return F.concat_ws(" ", key, F.when(has_pdf, F.lit("[PDF]")), F.concat(score.cast("string"), F.lit("/13")))


def split_trash(works: DataFrame, described: DataFrame, trash: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, trashed): of every group all but the recommended member go, under the first free name: key, key-1, key-2."""
    gone = described.filter(~F.col("recommended")).select("key")
    kept = works.join(gone, "key", "left_anti")
    moved = works.join(gone, "key", "left_semi")
    if trash is None:
        return kept, moved.withColumn("trash_key", F.col("key"))
    # names are found for keys alone; works that share a key take theirs one by one
    nth = lambda *by: F.row_number().over(Window.partitionBy("key").orderBy(*by))
    named = free_names(moved.select("key", F.col("key").alias("_own")), "_own", trash.select("trash_key"), 1, "trash_key")
    named = moved.withColumn("_nth", nth(F.lit(0))).join(named.select("key", "trash_key", nth(F.length("trash_key"), "trash_key").alias("_nth")), ["key", "_nth"]).drop("_nth")
    return kept, trash.unionByName(named, allowMissingColumns=True)
