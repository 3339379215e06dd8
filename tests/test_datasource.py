import pytest
from pyarrow import fs

from quillstack.sources import datasource, library
from quillstack.sources.datasource import LibraryReader


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "lib"
    for i in range(30):
        (root / f"k{i:02}").mkdir(parents=True)
        (root / f"k{i:02}" / "info.toml").write_text(f'title = "T{i}"\nyear = {2000 + i}\n' if i % 7 else "title = [")
        (root / f"k{i:02}" / "a.pdf").write_bytes((b"%PDF-1.4" if i % 2 else b"<html>") + b"x" * 100_000)
    (root / "bare").mkdir()
    (root / "stray.toml").write_text("title = 'no'")
    (root / "k01" / "deep").mkdir()
    return root


def test_tables(spark, folder, tmp_path):
    datasource.register(spark)
    works = spark.read.format("quillstack").option("folders", 7).load(str(folder))
    assert works.rdd.getNumPartitions() == 5
    read, warned = library.read_works(spark, str(folder))
    columns = [c for c in works.columns if c != "_corrupt"]
    good = works.filter("_corrupt is null").select(*columns)
    assert sorted(map(str, good.collect())) == sorted(map(str, read.select(*columns).collect()))
    assert works.filter("_corrupt is not null").count() == warned.count() == 5
    files = spark.read.format("quillstack").option("table", "files").load(f"file://{folder}")
    # what lies beside the folders is no work's
    listed = library.file_listing(spark, str(folder)).select(*files.columns).filter("key != 'lib'")
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, listed.collect()))
    assert spark.read.format("quillstack").load(str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(Exception, match="no table"):
        spark.read.format("quillstack").option("table", "x").schema("key string").load(str(folder)).count()


def test_a_key_is_taken_over(spark, folder):
    datasource.register(spark)
    works = spark.read.format("quillstack").option("folders", 7).load(str(folder))
    one = works.filter("key = 'k03' and year > 1")
    assert [(r["key"], r["title"]) for r in one.collect()] == [("k03", "T3")]
    assert one.rdd.getNumPartitions() == 1
    assert sorted(r["key"] for r in works.filter("key in ('k03', 'k04', 'gone', '../lib')").collect()) == ["k03", "k04"]
    assert works.filter("key = 'k03' and key = 'k04'").count() == 0


def test_bytes_read(folder, monkeypatch):
    """Four bytes of each file, and nothing of folders that a key leaves out."""
    taken = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def get_file_info(self, x):
            return self.inner.get_file_info(x)

        def open_input_file(self, path):
            f = self.inner.open_input_file(path)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    f.close()

                def read(self, n=None):
                    out = f.read(n)
                    taken.append((path, len(out)))
                    return out

            return File()

    original = fs.FileSystem.from_uri
    monkeypatch.setattr(datasource.fs, "FileSystem", type("S", (), {"from_uri": staticmethod(lambda uri: (Counting(original(uri)[0]), original(uri)[1]))}))
    reader = LibraryReader({"path": str(folder), "table": "files"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 60 and sum(n for _, n in taken) == 4 * 60
    taken.clear()
    reader = LibraryReader({"path": str(folder), "table": "works"})
    assert list(reader.pushFilters([datasource.EqualTo(("key",), "k05"), datasource.EqualTo(("year",), 3)])) == [datasource.EqualTo(("year",), 3)]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["k05"]
    assert [p.rsplit("/", 2)[1:] for p, _ in taken] == [["k05", "info.toml"]]
