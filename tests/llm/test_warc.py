import gzip
import hashlib
import os
import random
import re

import pytest

from quillstack.llm import warc

SCHEMA = "page_id long, url string, html string"


def small_pages():
    r = random.Random(5)
    words = "lorem ipsum dolor <p> sit &amp; amet \r\n\r\n WARC/1.1 é 日本".split(" ")
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    same, small = text(60), "x" * 99
    rows = [(i, f"http://h{i % 7}.example.org/{i % 40}?q={i % 3}", text(r.randrange(200))) for i in range(150)]
    rows += [(1000 + i, f"HTTP://User@Hot.Example.ORG:80/p{i % 5}#x", same) for i in range(200)]
    rows += [(5, "http://tie.example.org", same), (2000, None, None), (2001, None, None), (2002, "", ""), (2003, "no host", small), (2004, "http://a b\r\nX: y/é", small)]
    rows += [(2005, "http://x/", "y" * 100), (2006, "http://x/", "y" * 100), (2006, "http://x/", "y" * 100), (2005, "http://x/", "y" * 100)]
    rows += [(None, "http://n/", "z" * 200), (None, "http://n/", "z" * 200), (None, "http://n/", same), (-3, "http://neg/", "w" * 300), (7, "http://neg/", "w" * 300)]
    rows += [(3000, "http://long/" + "p" * 2000, "é" * 400_000)]
    return rows


def brute(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        alike = [p for p, _, h in rows if (h or "").encode() == raw and p is not None] if len(raw) >= 100 else []
        first = min(alike, default=None)
        again = first is not None and first != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = small_pages()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as offset", "'f' as file", "2 as page", "'k' as key").repartition(4)
    for shards in (None, 1, 30):
        got = warc.round_trip(df, shards=shards).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.round_trip(df.select("page_id", "url", warc.F.lit(None).cast("string").alias("html"))).filter("payload_bytes = 0 and record_type = 'response'").count() == len(rows)


def test_other_names_and_text_keys(spark):
    df = spark.createDataFrame([("b", "http://h/", "q" * 100), ("a", "http://h/", "q" * 100), ("a\r\nX: 1", "u", "q" * 100)], "name string, at string, body string")
    got = {r["name"]: r["refers_to"] for r in warc.round_trip(df, page="name", url="at", html="body").collect()}
    assert got == {"a": None, "b": "a", "a\r\nX: 1": "a"}


def test_archives_are_what_others_read(spark, tmp_path, monkeypatch):
    """Whole archives as gzip, by their own headers; many small archives."""
    rows = small_pages()
    folder = f"file://{tmp_path}/out"
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, archive_bytes=20_000)
    names = [f for f in os.listdir(tmp_path / "out")]
    assert len(names) > 5
    assert captures.select("file").distinct().count() == len(names)
    kinds = {"response": 0, "revisit": 0, "warcinfo": 0}
    for name in names:
        raw = gzip.decompress((tmp_path / "out" / name).read_bytes())
        at = 0
        while at < len(raw):
            head, _, _ = raw[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            kinds[re.search(rb"WARC-Type: (\w+)", head)[1].decode()] += 1
            at += len(head) + 4 + n
            assert raw[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert kinds["response"] + kinds["revisit"] == len(rows)
    # payloads come back whole
    got = {r["page"]: r["payload"] for r in warc.read_records(captures).filter("record_type = 'response' and page is not null").collect()}
    want = {str(p): (h or "").encode() for p, _, h in rows}
    assert all(bytes(got[p]) == want[p] for p in got if p not in ("5", "7"))  # ids of two pages


def test_index(spark, tmp_path, monkeypatch):
    """Look-ups against all captures, with blocks of three lines and shard bounds that are cut short."""
    rows = small_pages()
    monkeypatch.setattr(warc, "BOUND_CHARS", 12)
    folder = f"file://{tmp_path}/out"
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), folder)
    keyed = captures.select("file", "offset", warc.url_key(warc.F.col("url")).alias("key")).collect()
    index = warc.write_index(captures, folder, shards=6, block_lines=3)
    assert 1 < index.shards.count() <= 6
    asked = [r["key"] for r in keyed] + ["org,example,hot)", "org,example,hot)/p", "", "zzz", "org,example,hot)/p1 ", None]
    got = warc.lookup(index, spark.createDataFrame([(k,) for k in asked], "key string")).collect()
    assert sorted((r["key"], r["file"], r["offset"]) for r in got) == sorted((r["key"], r["file"], r["offset"]) for r in keyed)
    one = warc.lookup(index, spark.createDataFrame([("org,example,hot)/p1",)], "key string")).collect()
    assert len(one) == 40


def test_a_lookup_reads_little(spark, tmp_path):
    """One key reads a directory and a block, not the shard."""
    captures = spark.range(40_000).selectExpr("concat('http://h', id, '.example.org/') as url", "cast(id as string) as page", "'response' as record_type", "'f' as file", "id as offset", "id as length")
    folder = f"file://{tmp_path}/out"
    index = warc.write_index(captures, folder, shards=2, block_lines=500)
    seen = tmp_path / "seen"
    seen.mkdir()

    original = warc._read

    def counted(path, offset=0, length=None):
        raw = original(path, offset, length)
        with open(f"{seen}/{os.getpid()}", "a") as f:
            f.write(f"{path.rpartition('.')[2]} {len(raw)}\n")
        return raw

    warc._read = counted
    try:
        got = warc.lookup(index, spark.createDataFrame([("org,example,h777)/",)], "key string")).collect()
    finally:
        warc._read = original
    assert [r["page"] for r in got] == ["777"]
    whole = sum(os.path.getsize(f"{tmp_path}/out/{x}") for x in os.listdir(tmp_path / "out") if x.endswith(".z"))
    reads = [x.split() for p in seen.iterdir() for x in p.read_text().splitlines()]
    if reads:  # workers that were forked with the counting function
        assert sum(int(n) for kind, n in reads if kind == "z") < whole / 20


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com/a/B?c=d#e", "com,example,www)/a/B?c=d"),
        ("https://u:p@x.org:8080", "org,x)/"),
        ("x.org?q", "org,x)?q"),
        ("http://a b.org/c d", "org,a%20b)/c%20d"),
        (None, ")/"),
    ],
)
def test_url_key(column, url, key):
    assert column(warc.url_key, [url]) == [key]
