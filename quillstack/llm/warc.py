"""WARC archives and a two-level index of their captures (operator 13).

Tasks write records, each a gzip member of its own, to archives in a shared
folder; of records with equal payloads one is a response and the others revisit
it.  The capture index is a line for each record, led by the URL with its host
reversed, so that a domain's captures stand together: the lines are sorted over
all shards and packed into compressed blocks, and beside each shard lies a sparse
directory with the first line of every block.  A look-up finds its shard among
the shards' first keys, its blocks by binary search in the directory, its lines
by binary search in the block, and then reads the bytes of the records only.

Archives and index files carry the name of the attempt that wrote them; they count
only where the tables of captures and shards, which Spark commits, name them, so a
lost executor leaves no half-written file in use.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import checkpoint_dir, durable, release
from .arrowtools import bound_arrow_batches, map_arrow, shuffle_partitions

#: Payloads of fewer bytes are always written whole.
LEAST_REVISITED = 100
#: Bytes of an archive, lines of an index block, characters of a shard's first key on the driver.
ARCHIVE_BYTES, BLOCK_LINES, BOUND_CHARS = 256 << 20, 1000, 256
DATE, STAMP = "1970-01-01T00:00:00Z", "19700101000000"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_CAPTURES = "url string, page string, record_type string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """The URL with its host reversed and without scheme, user, port and fragment: ``org,example)/path?query``."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), r"^.*@", ""), r":\d*$", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def record(kind: str, headers: list[tuple[str, str]], block: bytes, level: int = 4) -> bytes:
    """A WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, of lower-case names, and the payload: what follows the HTTP headers of the block."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def page_record(page: str | None, url: str | None, digest: str, payload: bytes, first: str | None, level: int = 4) -> bytes:
    """The record of a page: a response, or where first is given a revisit of that page."""
    headers = [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>"),
        ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        headers.append(("Page-ID", json.dumps(page)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is None:
        return record("response", headers, http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload, level)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", json.dumps(first))]
    return record("revisit", headers, http + b"\r\n", level)


def _out_file(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    """A new file in the shared folder, named by partition and attempt."""
    context = TaskContext.get()
    path = f"{folder}/{name.format(context.partitionId() if context else 0, uuid.uuid4().hex)}"
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(at, compression=None)


def _read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def with_firsts(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """(page, url, html, digest, first) for each row; first is the page whose payload a row repeats, its html then null.

    Of rows of an equal payload of LEAST_REVISITED bytes or more the smallest page
    is repeated; rows of a null page only where they are among themselves, and then
    none is.  Rows that repeat that page itself are not said to repeat it.
    """
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    firsts = rows.filter(F.octet_length("html") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page").alias("first"))
    # small payloads, which may be equal in a third of all rows, look for nothing and go anywhere
    key = F.when(F.octet_length("html") >= LEAST_REVISITED, F.col("digest")).otherwise(F.hex(F.xxhash64("page", "url")))
    met = rows.withColumn("_key", key).join(firsts.withColumnRenamed("digest", "_key").hint("shuffle_hash"), "_key", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    return met.select("page", "url", F.when(~again, F.col("html")).alias("html"), "digest", F.when(again, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", level: int = 4, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row and returns the captures (url, page, record_type, file, offset, length), written to the shared folder.

    A null html is an empty payload, a null URL is written as about:blank; control
    characters and blanks of a URL are written as %XX.  Repeated rows are records of
    their own; an empty table writes no archive.  Other columns are left out.
    """
    bound_arrow_batches(pages.sparkSession)
    rows = with_firsts(pages, page, url, html).select(F.col("page").cast("string"), "url", "html", "digest", F.col("first").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at = None, None, 0
        for batch in batches:
            found: list[tuple] = []
            for p, u, h, digest, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    path, out = _out_file(folder, "archive-{:05d}-{}.warc.gz")
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    at = len(info)
                member = page_record(p.as_py(), u.as_py(), digest.as_py(), h.as_buffer().to_pybytes() if h.is_valid else b"", first.as_py(), level)
                out.write(member)
                found.append((u.as_py(), p.as_py(), "revisit" if first.is_valid else "response", path, at, len(member)))
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    out = None
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()] * 2, strict=True)], names=["url", "page", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    return durable(map_arrow(rows, run, _CAPTURES))


@dataclass
class CaptureIndex:
    """Shards of an index: (shard, first, path, directory), in the shared folder."""

    shards: DataFrame
    n: int

    def bounds(self) -> list[tuple[str, str, str]]:
        """(first key cut to BOUND_CHARS, path of the blocks, path of the directory) of each shard in order; as many rows as shards were asked for, at most."""
        rows = self.shards.select(F.left("first", F.lit(BOUND_CHARS)).alias("first"), "path", "directory").orderBy("first", "path").take(self.n)
        return [tuple(r) for r in rows]


def write_index(captures: DataFrame, folder: str, shards: int | None = None, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts the captures into shards of compressed blocks, each shard with a sparse directory beside it.

    A line is ``key stamp {json}``.  Repeated captures stand as often as they are;
    an empty table makes an index without shards.
    """
    spark = captures.sparkSession
    bound_arrow_batches(spark)
    n = shards or shuffle_partitions(spark)
    line = F.concat_ws(" ", url_key(F.col("url")), F.lit(STAMP), F.to_json(F.struct("page", "record_type", "file", "offset", "length")))
    # whole lines are the key, so captures of one URL may spread over shards
    lines = captures.select(line.alias("line")).repartitionByRange(n, "line").sortWithinPartitions("line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at, first, held, directory = None, None, 0, None, [], []

        def flush() -> None:
            nonlocal at, held
            packed = zlib.compress("\n".join(held).encode(), 6)
            out.write(packed)
            directory.append([held[0], at, len(packed)])
            at, held = at + len(packed), []

        for batch in batches:
            for x in batch.column(0).to_pylist():
                if out is None:
                    path, out = _out_file(folder, "index-{:05d}-{}.cdx.z")
                    first = x
                held.append(x)
                if len(held) == block_lines:
                    flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        beside, sparse = _out_file(folder, "index-{:05d}-{}.idx")
        sparse.write(zlib.compress(json.dumps(directory).encode()))
        sparse.close()
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (first, path, beside)], names=["first", "path", "directory"])

    return CaptureIndex(durable(map_arrow(lines, run, "first string, path string, directory string")), n)


def _between(items: list[str], key: str) -> tuple[int, int]:
    """Where among sorted lines those of a key begin and end."""
    return bisect_left(items, key + " "), bisect_left(items, key + "!")


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """(key, page, record_type, file, offset, length) of all captures of each distinct key of keys (key).

    Keys without captures, null ones too, give no rows.
    """
    spark = keys.sparkSession
    bounds = index.bounds()
    firsts, cut = [b[0] for b in bounds], BOUND_CHARS
    bound_arrow_batches(spark)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, asked = [], []
            for key in batch.column(0).to_pylist():
                # a cut bound is at most the shard's first line, so the shard before it may hold lines as well
                for s in range(max(0, bisect_left(firsts, key[:cut]) - 1), bisect_right(firsts, (key + "!")[:cut])):
                    shards.append(s)
                    asked.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(asked, pa.string())], names=["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, directory, heads, block, lines = None, [], [], None, []
        for batch in batches:
            out: list[tuple] = []
            for s, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard:
                    shard, block = s, None
                    directory = json.loads(zlib.decompress(_read(bounds[s][2])))
                    heads = [d[0] for d in directory]
                begin, end = _between(heads, key)
                for b in range(max(0, begin - 1), end):
                    if b != block:
                        block, lines = b, zlib.decompress(_read(bounds[s][1], *directory[b][1:])).decode().split("\n")
                    for x in lines[slice(*_between(lines, key))]:
                        c = json.loads(x[len(key) + len(STAMP) + 2 :])
                        out.append((key, c.get("page"), c["record_type"], c["file"], c["offset"], c["length"]))
                    if len(out) >= 10_000:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "page", "record_type", "file", "offset", "length"])

    routed = map_arrow(keys.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct(), route, "shard int, key string")
    dealt = routed.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "key")
    return map_arrow(dealt, search, "key string, page string, record_type string, file string, offset long, length long")


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """(page, url, record_type, digest, payload, payload_bytes, payload_digest, refers_to) of the captures (file, offset, length), each read by its range.

    digest is what the header says, payload_digest what the payload gives; a revisit
    has a null payload, payload_bytes and payload_digest here.
    """
    spark = captures.sparkSession
    bound_arrow_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        path, f = None, None
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for p, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != path:
                    if f is not None:
                        f.close()
                    system, at = fs.FileSystem.from_uri(p)
                    path, f = p, system.open_input_file(at)
                headers, payload = parse_record(f.read_at(length, offset))
                whole = headers["warc-type"] == "response"
                out.append((
                    json.loads(headers.get("page-id", "null")),
                    headers["warc-target-uri"],
                    headers["warc-type"],
                    headers["warc-payload-digest"].removeprefix("sha256:"),
                    payload if whole and payloads else None,
                    len(payload) if whole else None,
                    hashlib.sha256(payload).hexdigest() if whole else None,
                    json.loads(headers.get("refers-to-page-id", "null")),
                ))
                held += len(payload) if payloads else 0
                if held >= 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)
        if f is not None:
            f.close()

    names = ["page", "url", "record_type", "digest", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    dealt = captures.select("file", "offset", "length").repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "offset")
    return map_arrow(dealt, run, "page string, url string, record_type string, digest string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def resolved(records: DataFrame) -> DataFrame:
    """The records (page, record_type, digest, payload_bytes, payload_digest, refers_to), revisits with size and digest of the response of their digest.

    A revisit without such a response is an error.
    """
    whole = records.filter("record_type = 'response'").select("page", "record_type", "payload_bytes", "payload_digest", "refers_to")
    again = records.filter("record_type = 'revisit'").select("page", "record_type", "digest", "refers_to")
    sizes = whole.filter(F.col("payload_bytes") >= LEAST_REVISITED).groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    met = again.join(sizes, again["digest"] == sizes["payload_digest"], "left")
    there = F.when(F.col("payload_bytes").isNull(), F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce("page", F.lit("null"))))).otherwise(F.col("payload_bytes"))
    return whole.unionByName(met.select("page", "record_type", there.cast("long").alias("payload_bytes"), "payload_digest", "refers_to"))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete archives and index files that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def round_trip(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", shards: int | None = None) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to) for each row, written, indexed, looked up by URL and read back.

    Archives and index are deleted when they have been read.
    """
    spark = pages.sparkSession
    kind = pages.schema[page].dataType
    folder = f"{checkpoint_dir(spark)}/quillstack-warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder, page, url, html)
    index = write_index(captures, folder, shards)
    found = lookup(index, captures.select(url_key(F.col("url")).alias("key")))
    records = durable(read_records(found, payloads=False).drop("payload", "url"))
    release(captures, index.shards)
    drop_folder(spark, folder)
    out = resolved(records)
    return out.select(F.col("page").cast(kind).alias(page), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
