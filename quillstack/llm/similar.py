"""Links between shingle sets of a Jaccard similarity, found by MinHash bands and verified.

A node is a distinct set of shingles, known by its digest.  Nodes that agree in a
band of four MinHash values are candidates; a pair of similarity 0.8 has one of 32
bands in common but for 5 in 10^8.  Whatever meets is verified by the two sets.

A band that few nodes share pairs them all.  One that many share (a *crowd*)
verifies them against one member.  Members that these links leave apart are not
paired either.  A shingle that one component has alone is in no link between
components, so a member with too few others is done; one that is left meets a few
more members of each of its crowds.  Those that even then have enough such shingles
are joined by the rarest fifth of them, of which two sets of similarity 0.8 have at
least one in common, as far as what they share may suffice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.components import connected_components
from ..plans.durable import durable, release
from .arrowtools import bound_arrow_batches, map_arrow, shuffle_partitions, texts_of
from .minhash import BANDS, PERMUTATIONS, SIMILAR, least_values, shingle_sets

#: Members from which on a band is a crowd.
CROWD = 32
#: How many members of each of its crowds a member is verified against that one of each left apart.
PROBES = 8
#: Digests that a task remembers in order to send a text once.
REMEMBERED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def node_of(hashes: np.ndarray) -> bytes:
    """The digest of a sorted set of shingle hashes."""
    return hashlib.sha256(hashes.tobytes()).digest()[:16]


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of every row of least values."""
    parts = least.reshape(len(least), BANDS, PERMUTATIONS // BANDS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), 1))
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            out = (out ^ parts[:, :, i]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def text_digest() -> Column:
    """SHA-256 of the text, by which a set's text is found again without making the sets of all."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")


def set_rows(docs: DataFrame, key: str, shingle: int, fingerprint: Callable[[str, int], int] | None = None) -> DataFrame:
    """(key, digest, node, size, bands binary) for every row of docs (key, text); digest is that of the text.

    With a fingerprint of text and shingle there is a column simhash (long) as well.
    """
    bound_arrow_batches(docs.sparkSession, records=500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch, "text"), shingle)
            bands = band_keys(least_values(sets, len(sets)))
            columns = [batch.column(0), batch.column(2), pa.array(map(node_of, sets), pa.binary()), pa.array([x.size for x in sets], pa.int32()), pa.array([b.tobytes() for b in bands], pa.binary())]
            if fingerprint:
                columns.append(pa.array(np.array([fingerprint(t, shingle) for t in texts_of(batch, "text")], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[key, *(f.name for f in added)])

    added = [T.StructField("digest", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.BinaryType())]
    if fingerprint:
        added.append(T.StructField("simhash", T.LongType()))
    return map_arrow(docs.select(key, "text", text_digest()), run, T.StructType([docs.schema[key], *added]))


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(band, a, b, size): candidate pairs; where b is null, a member of a crowd and the size of its set.

    Sets whose sizes alone forbid the similarity are no candidates.
    """
    spark = nodes.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            which = pa.array(np.repeat(np.arange(n), BANDS))
            for at in range(0, n * BANDS, 50_000):
                part = which.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000]), batch.column(0).take(part), batch.column(1).take(part)], names=["band", "node", "size"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, crowd, out = None, [], False, []

        def settle() -> None:
            """The pairs of the run that is held; a crowd's members one by one."""
            nonlocal held
            if crowd or len(held) > CROWD:
                out.extend((held_key, a, None, n) for a, n in held)
            else:
                out.extend((held_key, min(a, b), max(a, b), 0) for i, (a, n) in enumerate(held) for b, m in held[:i] if min(n, m) >= similarity * max(n, m))
            held = []

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not keys.size:
                continue
            first = np.r_[True, keys[1:] != keys[:-1]]
            last = np.r_[first[1:], True]
            # a node alone under its key has no candidates, but the first and the last run may go on in another batch
            some = ~(first & last)
            some[[0, -1]] = True
            at = pa.array(np.flatnonzero(some))
            for k, node, n in zip(keys[some].tolist(), batch.column(1).take(at).to_pylist(), batch.column(2).take(at).to_pylist(), strict=True):
                if k != held_key:
                    settle()
                    held_key, crowd = k, False
                held.append((node, n))
                if len(held) > CROWD:
                    crowd = True
                    settle()
            yield _pairs_batch(out)
            out.clear()
        settle()
        yield _pairs_batch(out)

    copies = map_arrow(nodes.filter("size > 0").select("node", "size", "bands"), replicate, "band long, node binary, size int")
    return map_arrow(copies.repartition(shuffle_partitions(spark), "band").sortWithinPartitions("band"), pair, "band long, a binary, b binary, size int")


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["band", "a", "b", "size"])


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the sets of the wanted nodes (node, digest), each made from the text of that digest."""
    bound_arrow_batches(docs.sparkSession, records=500)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for i, digest in enumerate(batch.column(0).to_pylist()):
                if digest not in seen:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int64()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(texts_of(batch, "text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    texts = map_arrow(docs.select(text_digest(), "text"), once, "digest binary, text string")
    return map_arrow(texts.join(wanted, "digest").groupBy("node").agg(F.first("text").alias("text")), sets, "node binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (s, t) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                common = np.intersect1d(x, y, assume_unique=True).size
                if common >= similarity * (x.size + y.size - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    return map_arrow(both.select("a", "b", "s", "t"), run, "a binary, b binary")


def _anchored(nodes: DataFrame, print_links: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(a, b): candidates of equal or linked fingerprints: each node with the first of its fingerprint, and the first of linked ones."""
    some = nodes.filter("size > 0").select("node", "size", "simhash")
    lead = durable(some.groupBy("simhash").agg(F.min(F.struct("node", "size")).alias("l")).select("simhash", F.col("l.node").alias("a"), F.col("l.size").alias("m")))
    same = some.join(lead, "simhash").select("a", F.col("node").alias("b"), "m", F.col("size").alias("n"))
    near = print_links(lead.select("simhash")).toDF("p", "q")
    first = near.join(lead.select(F.col("simhash").alias("p"), "a", "m"), "p")
    linked = first.join(lead.select(F.col("simhash").alias("q"), F.col("a").alias("b"), F.col("m").alias("n")), "q").select("a", "b", "m", "n")
    pairs = same.unionByName(linked).filter(f"a != b and least(m, n) >= {similarity} * greatest(m, n)")
    out = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(lead)
    return out


def similar_links(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, print_links: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """Tables (a, b) of verified links between nodes (node, size, bands, digest) of docs (text), written to the shared folder.

    They connect whatever the similarity connects among all candidates; not every
    link of a crowd is listed.  With ``print_links``, links of fingerprints (column
    simhash), these come first, and bands are asked only for what they leave apart.
    """
    candidates = durable(_candidates(nodes, similarity))
    anchored = _anchored(nodes, print_links, similarity) if print_links else None
    met = candidates.select("a", "b") if anchored is None else candidates.select("a", "b").unionByName(anchored)
    wanted = met.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    sets = durable(_sets_of(docs, nodes.select("node", "digest").join(wanted, "node"), shingle))
    ordered = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs.distinct())
        out = durable(_verified(pairs, sets, similarity))
        release(pairs)
        return out

    pairs = candidates.filter("b is not null").select("a", "b")
    crowds = candidates.filter("b is null").select("band", F.col("a").alias("node"), "size", F.col("a").alias("component"))
    links, found = [], None
    if anchored is not None:
        links.append(checked(anchored))
        found = durable(connected_components(links[0]))
        for end in ("a", "b"):
            pairs = pairs.join(found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
        pairs = pairs.filter("coalesce(_a, a) != coalesce(_b, b)").select("a", "b")
        crowds = crowds.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    links.append(checked(pairs))

    def probed(crowds: DataFrame, probes: int) -> DataFrame:
        """Verified links between the members of each crowd and so many of them."""
        # the order by hash is the same for all bands, so that bands of the same members take the same ones
        least = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "size", "component")) for i in range(probes)]
        chosen = durable(crowds.groupBy("band").agg(F.array_distinct(F.transform(F.array(*least), lambda m: F.struct(m["node"], m["size"], m["component"]))).alias("probes")))
        # a member's probes of all its crowds come together, so that each of them is met once
        met = crowds.join(chosen, "band").groupBy("node", "size", "component").agg(F.array_distinct(F.flatten(F.collect_list("probes"))).alias("probes"))
        # a node without a link yet is a component of its own
        other = F.expr(f"filter(probes, y -> y.component != component and least(y.size, size) >= {similarity} * greatest(y.size, size))")
        pairs = met.select("node", F.explode(F.transform(other, lambda y: y["node"])).alias("probe"))
        out = checked(pairs.select(F.least("node", "probe").alias("a"), F.greatest("node", "probe").alias("b")))
        release(chosen)
        return out

    if not crowds.isEmpty():
        links.append(probed(crowds, 1))
        crowds = _apart(crowds, reduce(DataFrame.unionByName, links))
        members = _disputed(durable(crowds.select("node", "size", "component").distinct()), sets, similarity)
        links.append(probed(crowds.select("band", "node").join(members, "node"), PROBES))
        release(crowds)
        labelled = durable(_labelled(members.drop("component"), reduce(DataFrame.unionByName, links)))
        release(members)
        members = _disputed(labelled, sets, similarity)
        rare = durable(_rarest(members, sets, similarity))
        # at the first shingle that a pair has in common, what either has left must do
        enough = f"least(x.left, y.left) + 1 >= (x.size + y.size) * {similarity / (1 + similarity)}D - 1e-6D"
        pairs = rare.alias("x").join(rare.alias("y"), F.expr(f"x.shingle = y.shingle and x.component < y.component and {enough}")).select(*ordered)
        links.append(checked(pairs))
        release(members, rare)
    release(candidates, sets, *(x for x in (anchored, found) if x is not None))
    return links


def _spread(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, shingle, size, component): the members' shingles one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(batch.column(1)):
                hashes = np.frombuffer(found.as_buffer(), np.int64)
                one = [batch.column(c).take(pa.array([i] * hashes.size, pa.int64())) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([one[0], pa.array(hashes), *one[1:]], names=["node", "shingle", "size", "component"])

    return map_arrow(sets.join(members, "node").select("node", "shingles", "size", "component"), run, "node binary, shingle long, size int, component binary")


def _shared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, shingle, size, component, often, least): of each member's shingles those that another component has too; least is the smallest size of a member with it."""
    rows = _spread(members, sets)
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("size").alias("least"))
    return rows.join(often.filter("lo != hi").select("shingle", "often", "least"), "shingle")


def _needed(similarity: float) -> Column:
    """How many shingles a member must share with any partner: one is no smaller than the similarity says, nor than the smallest it shares a shingle with."""
    return F.lit(similarity / (1 + similarity)) * (F.col("size") + F.greatest(F.col("least"), F.lit(similarity) * F.col("size"))) - F.lit(1e-6)


def _disputed(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the members (node, size, component) that have enough shingles in common with other components.

    Members that go leave others with fewer such shingles, so it goes on while most go.
    """
    while True:
        may = _shared(members, sets).groupBy("node", "size", "component").agg(F.count("*").alias("may"), F.min("least").alias("least"))
        fewer = durable(may.filter(F.col("may") >= _needed(similarity)).select("node", "size", "component"))
        before, after = members.count(), fewer.count()
        release(members)
        members = fewer
        if 2 * after > before or not after:
            return members


def _rarest(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, size, component, left): of each member's shared shingles as many of the rarest as a partner cannot lack altogether.

    Rare is what few members have; left is how many more shared ones follow.  Only
    where these are enough for the smallest that has the shingle can a pair begin.
    """
    per_node = Window.partitionBy("node")
    ranked = _shared(members, sets).withColumn("nth", F.row_number().over(per_node.orderBy("often", "shingle"))).withColumn("left", F.count("*").over(per_node) - F.col("nth"))
    return ranked.filter(F.col("left") + 1 >= _needed(similarity)).select("shingle", "node", "size", "component", "left")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (node, ...) with the component that the links give each node; a node without links is its own."""
    labels = connected_components(links).withColumnRenamed("component", "_found")
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("_found", "node")).drop("_found")


def _apart(crowds: DataFrame, links: DataFrame) -> DataFrame:
    """The members of those crowds that the links leave in more than one component, with their components."""
    now = durable(_labelled(crowds.drop("component"), links))
    open_bands = durable(now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("band"))
    out = durable(now.join(open_bands, "band", "left_semi"))
    release(now, open_bands)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = SIMILAR, fingerprint: Callable[[str, int], int] | None = None, print_links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, component_id) for every row: the smallest key reached over links of the similarity.

    With a fingerprint and what links fingerprints, their links are verified first
    and join their documents; what these leave apart meets in bands.

    Distinct shingle sets are the nodes, so copies count once.  A pair of similarity
    0.8 meets in a band but for 5 in 10^8, whatever its length, and no link stands
    unverified.  Texts without words, null too, are alike.  Rows of a null key belong
    to components but don't name them: a component of such rows alone has a null id.
    Repeated rows stay, each with the same id; an empty table gives no rows.
    """
    source = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    rows = durable(set_rows(source, key, shingle, fingerprint))
    # texts of one set may differ in the order and number of their shingles, and so in their fingerprints
    prints = [F.min("simhash").alias("simhash")] if fingerprint else []
    nodes = durable(rows.groupBy("node").agg(F.min(key).alias("_low"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("digest").alias("digest"), *prints))
    links = similar_links(nodes, source, shingle, similarity, print_links if fingerprint else None)
    found = connected_components(reduce(DataFrame.unionByName, links))
    joined = nodes.select("node", "_low").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = durable(joined.groupBy("component").agg(F.min("_low").alias("component_id")))
    labels = durable(joined.select("node", "component").join(lows, "component").select("node", "component_id"))
    release(nodes, lows, *links)
    return rows.select(key, "node").join(labels, "node").select(key, "component_id")
