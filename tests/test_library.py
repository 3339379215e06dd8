import json

import pytest
from pyspark.sql import functions as F

from quillstack.operators import incremental
from quillstack.operators.vector_index import PassageIndex, paired
from quillstack.sources import library
from quillstack.sources.store import Store, bucket_of
from quillstack.streaming import index


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "lib"
    for key, record in {"a": 'title = "A"\nyear = 2001\nauthors = ["Ada Quill"]\nfiles = ["a.pdf"]\nextra = 1\n', "b": 'kind = "book"\ntitle = "B"\nfiles = ["gone.pdf"]\n', "c": "year = 1\n", "d": "title = [", "e": 'title = "E"\nyear = 70000\n'}.items():
        (root / key).mkdir(parents=True)
        (root / key / "info.toml").write_text(record)
    (root / "deep" / "er").mkdir(parents=True)
    (root / "deep" / "er" / "info.toml").write_text('title = "deep"')
    (root / "a" / "a.pdf").write_bytes(b"%PDF-1.4")
    (root / "b" / "Z.PDF").write_bytes(b"html")
    (root / "a" / "derived" / "x").mkdir(parents=True)
    (root / "a" / "derived" / "x" / "p.JSONL").write_text(json.dumps({"text": "hi"}))
    return str(root)


def test_scan(spark, folder):
    works, warnings = library.read_works(spark, folder)
    got = {r["key"]: r for r in works.collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"]["kind"], got["a"]["year"], got["a"]["authors"], got["a"]["tags"], got["a"]["doi"]) == ("paper", 2001, ["Ada Quill"], [], None)
    assert got["b"]["kind"] == "book"
    assert sorted(r["key"] for r in warnings.collect()) == ["c", "d", "e"]
    assert all(r["warning"].startswith(f"Skipping {r['key']}: ") for r in warnings.collect())
    listing = library.file_listing(spark, folder)
    files = {r["key"]: (r["pdf"], r["has_pdf"]) for r in library.resolve_pdf(works, listing).collect()}
    assert files == {"a": ("a.pdf", True), "b": ("Z.PDF", True)}
    assert {r["name"]: r["is_pdf"] for r in listing.filter("lower(name) like '%.pdf'").collect()} == {"a.pdf": True, "Z.PDF": False}
    sources = library.jsonl_sources(spark, folder, works)
    assert [(r["key"], r["text"]) for r in incremental.collect_rows(sources).collect()] == [("a", "hi")]


def test_missing_library(spark, tmp_path):
    assert library.scan_records(spark, str(tmp_path / "none")).count() == 0


def test_write_and_read_again(spark, folder, tmp_path):
    works, _ = library.read_works(spark, folder)
    out = str(tmp_path / "copy")
    library.write_records(works, out)
    again, warnings = library.read_works(spark, out)
    assert warnings.count() == 0
    assert sorted(map(str, again.collect())) == sorted(map(str, works.collect()))


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('library = "x"\npage = 5\n')
    c = library.Config.load(str(tmp_path / "c.toml"), {"QUILLSTACK_LIBRARY": "y"})
    assert (c.library, c.page, c.citation) == ("y", 5, "plain")
    (tmp_path / "d.toml").write_text('library = "~/x"\neditor = ["ed", "-w"]\nreader = "pdf"\nbrowser = []\nsemantic_results = 0\nunknown = 1\n[embedding]\nbatch_size = 8\n')
    d = library.Config.load(str(tmp_path / "d.toml"))
    assert d.library.endswith("/x") and "~" not in d.library and d.semantic_results is None and d.embedding == {"batch_size": 8}
    assert d.command("editor") == ["ed", "-w"] and d.command("editor", {"EDITOR": "nano"}) == ["nano"]
    assert d.command("editor", {"EDITOR": "nano", "QUILLSTACK_EDITOR": "own"}) == ["own"] and d.command("reader", {"EDITOR": "nano"}) == ["pdf"]
    assert library.Config().command("editor") == ["vi"]
    for empty in ({}, {"BROWSER": ""}):
        with pytest.raises(ValueError, match="empty"):
            d.command("browser", empty)


def test_foreign(spark):
    rows = [("k", "T", [], "A B and C D", 2000, None, None, "2101.00001", None, [], ["x.pdf.pdf"], None), ("l", "U", [("Ada", "Quill")], "ignored", None, None, "1", "2", None, [], [], None)]
    df = spark.createDataFrame(rows, "id string, title string, author_list array<struct<given:string,family:string>>, author string, year int, doi string, arxiv string, eprint string, journal string, tags array<string>, files array<string>, abstract string")
    got = library.foreign_works(df).collect()
    assert (got[0]["authors"], got[0]["arxiv"], got[0]["files"]) == (["A B", "C D"], "2101.00001", ["x.pdf"])
    assert (got[1]["authors"], got[1]["arxiv"]) == (["Ada Quill"], "1")


def test_stream_follows_sources(spark, tmp_path, monkeypatch):
    """Batches end between any two writes; nothing is lost, doubled or numbered again, also where a pointer could have gone."""
    incoming, root = tmp_path / "in", tmp_path / "index"
    incoming.mkdir()
    held = PassageIndex(spark, f"file://{root}", buckets=4)

    def arrive(name, *texts):
        (incoming / name).write_text("\n".join(json.dumps({"text": t}) for t in texts))
        index.follow_sources(spark, str(incoming), f"file://{root}", str(tmp_path / "checkpoint"), buckets=4).awaitTermination(120)

    rows = lambda: sorted((r["text"], r["id"]) for r in held.passages().collect())
    arrive("a.jsonl", "one", "two")
    arrive("b.jsonl", "three")
    before = rows()
    assert before == [("one", 1), ("three", 3), ("two", 2)]
    original = Store.before_write
    for step in range(4):
        left = [step]

        def cut_off(self, what, left=left):
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("cut off")

        monkeypatch.setattr(Store, "before_write", cut_off)
        with pytest.raises(Exception, match="cut off"):
            arrive("c.jsonl", "four")
        assert rows() == before
    monkeypatch.setattr(Store, "before_write", original)
    arrive("d.jsonl", "five")
    assert [x[0] for x in rows()] == ["five", "four", "one", "three", "two"]
    assert sorted(x[1] for x in rows()) == [1, 2, 3, 4, 5]
    assert {(t, i) for t, i in rows() if t in ("one", "two", "three")} == set(before)
    # a batch that is run again after its commit finds its number there
    (stream, number), = held.store.latest().facts["batches"].items()
    again = incremental.collect_rows(spark.createDataFrame([("e", "e", "e.jsonl", '{"text": "six"}')], "key string, work_title string, source_path string, content string"))
    held.update(again, complete=False, batch=(stream, number))
    assert "six" not in {x[0] for x in rows()}
    held.update(again, complete=False, batch=("another stream", 0))
    assert ("six", 6) in rows()


def files(spark, **texts):
    content = {k: "\n".join(json.dumps({"text": t}) for t in ts.split()) for k, ts in texts.items()}
    return incremental.collect_rows(spark.createDataFrame([(k, f"title {k}", f"{k}.jsonl", c) for k, c in content.items()], "key string, work_title string, source_path string, content string"))


def test_passage_index_keeps_ids_and_embeddings(spark, tmp_path):
    held = PassageIndex(spark, f"file://{tmp_path}/i", buckets=8)
    asked = []

    def encode(chunks):
        asked.append(sorted(r["text"] for r in chunks.collect()))
        return chunks.select("source_path", "place", F.array(F.length("text").cast("float"), F.lit(float(len(asked)))).alias("embedding"))

    now = lambda: {r["text"]: (r["id"], list(r["embedding"])) for r in held.passages().collect()}
    first = held.update(files(spark, a="x xx", b="y", c="z zz zzz"), encode, "m", 2)
    assert now() == {"x": (1, [1, 1]), "xx": (2, [2, 1]), "y": (3, [1, 1]), "z": (4, [1, 1]), "zz": (5, [2, 1]), "zzz": (6, [3, 1])}
    same = held.update(files(spark, a="x xx", b="y", c="z zz zzz"), encode, "m", 2)
    assert same == first and len(asked) == 1
    second = held.update(files(spark, a="x xx", c="z q", d="new"), encode, "m", 2)
    assert asked[-1] == ["new", "q", "z"]
    assert now() == {"x": (1, [1, 1]), "xx": (2, [2, 1]), "z": (7, [1, 2]), "q": (8, [1, 2]), "new": (9, [3, 2])}
    assert (second.facts["count"], second.facts["next_id"]) == (5, 10)
    assert held.sources().count() == 3
    # folders of buckets that nothing touched are the same
    untouched = set(first.tables["passages"]) - {str(r[0]) for r in spark.createDataFrame([("b.jsonl",), ("c.jsonl",), ("d.jsonl",)], "p string").select(bucket_of(F.col("p"), 8)).collect()}
    assert all(first.tables["passages"][b] == second.tables["passages"][b] for b in untouched)
    # a deleted last id is not given again; another model numbers from 1
    held.update(files(spark, a="x xx", c="z q"), encode, "m", 2)
    assert held.update(files(spark, a="x xx", c="z q", d="back"), encode, "m", 2).facts["next_id"] == 11
    other = held.update(files(spark, b="y yy"), encode, "other", 2)
    assert now() == {"y": (1, [1, len(asked)]), "yy": (2, [2, len(asked)])} and other.facts["count"] == 2
    assert len(held.passages(second).collect()) == 5


def test_an_older_index_is_taken_over(spark, tmp_path):
    old = incremental.replace_index(files(spark, a="x xx", b="y", c="z zz", d="gone")).withColumn("embedding", F.array(F.lit(7.0)))
    held = PassageIndex(spark, f"file://{tmp_path}/i", buckets=4)
    asked = []

    def encode(chunks):
        asked.extend(sorted(r["text"] for r in chunks.collect()))
        return chunks.select("source_path", "place", F.array(F.lit(1.0)).alias("embedding"))

    rows = files(spark, a="x xx", b="y", c="z other", e="fresh")
    assert held.adopt(old, rows, "m", 1).facts["count"] == 6
    held.update(rows, encode, "m", 1)
    assert asked == ["fresh", "other", "z"]
    assert {r["text"]: (r["id"], r["embedding"][0]) for r in held.passages().collect()} == {"x": (1, 7), "xx": (2, 7), "y": (3, 7), "z": (7, 1), "other": (8, 1), "fresh": (9, 1)}
    with pytest.raises(ValueError, match="empty"):
        held.adopt(old, rows, "m", 1)


def test_pairing_refuses_other_counts(spark):
    chunks = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "source_path string, place int, text string")
    vectors = lambda *rows: spark.createDataFrame(rows, "source_path string, place int, embedding array<float>")
    good = [("s", 1, [1.0]), ("s", 2, [2.0])]
    assert {r["text"]: r["embedding"] for r in paired(chunks, vectors(*good), 1).collect()} == {"a": [1.0], "b": [2.0]}
    for bad in (good[:1], [*good, ("s", 3, [1.0])], [*good, good[0]], [good[0], ("s", 2, [1.0, 2.0])], [good[0], ("s", 2, None)]):
        with pytest.raises(Exception, match="embedding|dimensions"):
            paired(chunks, vectors(*bad), 1).collect()


def test_requests(spark):
    rows = [('{"action":"ping"}',), ('{"action":"add","input":"2101.00001"}',), ('{"action":"add","input":"no"}',), ('{"action":"x"}',), ("no",)]
    got = {r["request"]: (r["ok"], r["kind"], r["error"]) for r in index.responses(spark.createDataFrame(rows, "value string")).collect()}
    assert got['{"action":"ping"}'] == (True, None, None)
    assert got['{"action":"add","input":"2101.00001"}'] == (True, "arxiv", None)
    assert [got[r[0]][0] for r in rows[2:]] == [False, False, False]
    assert index.unframe(b"\x02\x00\x00\x00hi\x00\x00\x00\x00") == ["hi", ""]
    for bad in (b"\x05\x00\x00\x00hi", b"\x00\x00\x20\x00"):
        with pytest.raises(ValueError):
            index.unframe(bad)
