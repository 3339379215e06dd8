"""Ordered fallback: one source after the other, each asked only for what is still open.

A round takes the next address of every open item, gets all of them at once and
closes the items that answered; what an item would have tried later is never asked
for.  A source is called for its addresses when the sources before it are through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pages
from ..plans.durable import durable, release

#: Open items (item) to their addresses (item, place, address).
Source = Callable[[DataFrame], DataFrame]
#: Addresses (address), each once, to those that answered (address, body).
Get = Callable[[DataFrame], DataFrame]


def first_that_works(items: DataFrame, sources: list[tuple[str, Source]], get: Get) -> tuple[DataFrame, DataFrame]:
    """(item, source, place, address, body, round) of every item, null where nothing answered, and (round, source, asked, answered) of every round.

    items (item) count once each.  An item's addresses are tried by place, ties by
    address; addresses that are null are passed over.
    """
    spark = items.sparkSession
    every = durable(items.select("item").distinct())
    open_, won, told, n = every, [], [], 0
    for name, source in sources:
        placed = source(open_).filter("address is not null").select("item", "place", "address").distinct()
        turns = durable(placed.withColumn("turn", F.row_number().over(Window.partitionBy("item").orderBy("place", "address"))))
        turn = 1
        while True:
            # an item of fewer addresses than rounds has none at this turn
            asked = durable(turns.filter(F.col("turn") == turn).join(open_, "item", "left_semi"))
            n_asked = asked.count()
            if not n_asked:
                release(asked)
                break
            answered = get(asked.select("address").distinct()).filter("body is not null").groupBy("address").agg(F.min("body").alias("body"))
            got = durable(asked.join(answered, "address").select("item", F.lit(name).alias("source"), "place", "address", "body", F.lit(n).alias("round")))
            won.append(got)
            told.append((n, name, n_asked, got.count()))
            open_ = durable(open_.join(got.select("item"), "item", "left_anti"))
            release(asked)
            turn, n = turn + 1, n + 1
    rounds = spark.createDataFrame(told, "round int, source string, asked long, answered long")
    if not won:
        nothing = {"source": "string", "place": "int", "address": "string", "body": "string", "round": "int"}
        return every.select("item", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())), rounds
    return every.join(reduce(DataFrame.unionByName, won), "item", "left"), rounds


def listed(answers: DataFrame, addresses: Callable[[Column], Column]) -> Source:
    """A source whose answers (item, body) list addresses: those of open items only are looked at."""

    def source(open_: DataFrame) -> DataFrame:
        found = open_.join(answers.groupBy("item").agg(F.min("body").alias("body")), "item")
        return found.select("item", F.posexplode(addresses(F.col("body"))).alias("place", "address"))

    return source


def pdf_sources(unpaywall: DataFrame, crossref: DataFrame) -> list[tuple[str, Source]]:
    """Where a DOI's PDF may be had, from answers (item, body) by DOI: open copies, repositories first, then the publisher's link."""
    return [("Unpaywall", listed(unpaywall, pages.oa_candidates)), ("CrossRef", listed(crossref, lambda c: F.array(pages.crossref_pdf(c))))]
