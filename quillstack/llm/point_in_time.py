"""Point-in-time feature joins over fixed time bins (operator 11).

A version of a source is usable from ``start`` up to, not including, ``end``.
Its interval is cut into fixed bins, of ``bin`` time units and of 4, 16, 64 ...
times as many, as few as cover it; a question at a time ``t`` looks into the one
bin of each width that holds t.  Both meet in an equi-join on (source, width,
bin).  A bin that a version covers whole needs only the best of the versions that
cover it, so those are reduced to one row by an ordered max struct before they are
joined, on the mapping side already: however dense a source is, a question meets
one row a width.  Only bins of the least width that an interval covers in part
keep their versions apart; the filter after the join decides about them.  Where
``bin`` is the resolution of the times, there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each width is so many times the one before.
FANOUT = 4


def _floor(x: Column, width: int) -> Column:
    """x // width, exact for any long."""
    return x if width == 1 else F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width)).cast("long")


def _bins(first: Column, after: Column, width: int, whole: bool = True) -> Column:
    """The bins first, first + 1, ... up to after - 1 of a width; none where that is nothing."""
    numbers = F.when(first < after, F.sequence(first, after - 1)).otherwise(F.lit([]).cast("array<bigint>"))
    return F.transform(numbers, lambda b: F.struct(F.lit(width).cast("long").alias("width"), b.alias("bin"), F.lit(whole).alias("whole")))


def cover(start: Column, end: Column, bin: int, levels: int) -> Column:
    """Bins that make up [start, end): an array of (width, bin, whole), whole where the interval covers the bin; null if it is empty."""
    widths = [bin * FANOUT**k for k in range(levels)]
    first, after = [-_floor(-start, w) for w in widths], [_floor(end, w) for w in widths]
    parts = []
    for k, w in enumerate(widths[:-1]):
        inside = first[k + 1] < after[k + 1]
        around = F.concat(_bins(first[k], first[k + 1] * FANOUT, w), _bins(after[k + 1] * FANOUT, after[k], w))
        parts.append(F.when(inside, around).otherwise(_bins(first[k], after[k], w)))
    parts.append(_bins(first[-1], after[-1], widths[-1]))
    if bin > 1:
        at_start, at_end = _floor(start, bin), _floor(end, bin)
        # the bin of the end is not a second time the bin of the start
        parts.append(_bins(at_start, first[0], bin, whole=False))
        parts.append(_bins(F.greatest(at_end, first[0]), -_floor(-end, bin), bin, whole=False))
    return F.when(start < end, F.concat(*parts))


def point_in_time(questions: DataFrame, versions: DataFrame, source: str = "source", t: str = "t", start: str = "start", end: str = "end", order: tuple[str, ...] = ("event",), bin: int = 1, levels: int = 6) -> DataFrame:
    """(source, t, version): for every distinct (source, t) the version in use, a struct of all other columns of versions, or null.

    Of the versions of an equal source with start <= t < end the greatest by the
    columns ``order`` wins, ties by the other columns in their order, null being
    least; repeated versions count once.  Times are long.  Versions with a null
    source, start or end, or with end <= start, are never usable; a question of a
    null source or time has no version.  Empty tables give no rows, or rows without
    versions.  Columns of questions but source and t are left out.

    An interval makes a row for each bin of its cover, 2 * (FANOUT - 1) a level at
    most and one for each bin of the greatest width; ``levels`` should make that width
    about the length of an interval.
    """
    rest = [c for c in versions.columns if c not in (source, start, end, *order)]
    best = F.struct(*order, *rest)
    cut = versions.filter(F.col(source).isNotNull()).select(F.col(source).alias("_source"), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"), best.alias("_version"))
    cut = cut.select("_source", "_start", "_end", "_version", F.explode(cover(F.col("_start"), F.col("_end"), bin, levels)).alias("_b")).select("_source", "_start", "_end", "_version", "_b.*")
    # a whole bin is usable at all its times, whatever interval it came from
    whole = cut.filter("whole").groupBy("_source", "width", "bin").agg(F.max("_version").alias("_version")).select("*", (F.col("bin") * F.col("width")).alias("_start"), ((F.col("bin") + 1) * F.col("width")).alias("_end"))
    bins = whole
    if bin > 1:
        bins = whole.unionByName(cut.filter("not whole").drop("whole"))
    asked = questions.select(F.col(source).alias("_source"), F.col(t).cast("long").alias("_t")).distinct()
    widths = F.array(*(F.struct(F.lit(bin * FANOUT**k).cast("long").alias("width"), _floor(F.col("_t"), bin * FANOUT**k).alias("bin")) for k in range(levels)))
    looks = asked.filter("_source is not null and _t is not null").select("_source", "_t", F.explode(widths).alias("_b")).select("_source", "_t", "_b.*")
    met = looks.join(bins, ["_source", "width", "bin"], "left").select("_source", "_t", F.when(F.col("_t").between(F.col("_start"), F.col("_end") - 1), F.col("_version")).alias("_version"))
    found = met.groupBy("_source", "_t").agg(F.max("_version").alias("version"))
    without = asked.filter("_source is null or _t is null").select("_source", "_t", F.lit(None).cast(found.schema["version"].dataType).alias("version"))
    return found.unionByName(without).select(F.col("_source").alias(source), F.col("_t").alias(t), "version")


def document_numbers(key: str = "doc_id") -> list[Column]:
    """a, b, c and d of a document: the first four groups of eight digits of the hex sha256 of its decimal id."""
    digest = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(name) for i, name in enumerate("abcd")]


def document_versions(docs: DataFrame) -> DataFrame:
    """(source, start, end, event, neg_arrival, doc_id, n_chars, lang) of each document as a version of its source."""
    numbered = docs.select("doc_id", "source", "n_chars", "lang", *document_numbers())
    event, arrival = F.col("a") % 50000, F.col("a") % 50000 - 60 + F.col("b") % 600
    return numbered.select(
        "source",
        F.greatest(event, arrival).alias("start"),
        (event + F.col("c") % 900).alias("end"),
        event.alias("event"),
        (-arrival).alias("neg_arrival"),
        "doc_id",
        "n_chars",
        "lang",
    )


def label_versions(docs: DataFrame, labels: DataFrame, stale_after: int = 120) -> DataFrame:
    """(doc_id, t, version_id, age, status, n_chars, lang) for every row of labels.

    The latest event wins, then the earliest arrival, then the largest doc_id.  A
    label whose document is missing, has no source or whose id is null has status
    ``none``; of several rows of a document, the smallest source counts.  Repeated
    labels stay, each with the same answer; an empty table of labels gives no rows.
    """
    # labels of a third of a source share neither key: documents by id, questions by second
    sources = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    asks = labels.select("doc_id", (document_numbers()[3] % 50000).alias("t")).join(sources, "doc_id", "left")
    found = point_in_time(asks, document_versions(docs), order=("event", "neg_arrival", "doc_id"))
    found = found.filter("version is not null").select(F.col("source").alias("_source"), F.col("t").alias("_t"), "version")
    joined = asks.join(found, (F.col("source") == F.col("_source")) & (F.col("t") == F.col("_t")), "left")
    age = F.col("t") - F.col("version.event")
    fresh = age <= stale_after
    return joined.select(
        "doc_id",
        "t",
        F.col("version.doc_id").alias("version_id"),
        age.alias("age"),
        F.when(age.isNull(), "none").when(fresh, "fresh").otherwise("stale").alias("status"),
        F.when(fresh, F.col("version.n_chars")).alias("n_chars"),
        F.when(fresh, F.col("version.lang")).alias("lang"),
    )
