"""A library on disk as a Spark data source: ``spark.read.format("quillstack").load(folder)``.

Tables, by the option ``table``: ``works`` (the default), the records with
``_corrupt`` saying why one can't be read, and ``files`` (key, name, length,
is_pdf), the files of the works' folders, of which the first four bytes are read.
Partitions are runs of folders; filters on ``key`` by equality are taken over, and
then neither other folders nor the list of folders are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .library import read_record
from .schemas import WORK

SCHEMAS = {"works": f"{WORK}, _corrupt string", "files": "key string, name string, length long, is_pdf boolean"}
#: Folders of one partition.
FOLDERS = 1000
RECORD = "info.toml"


@dataclass
class Folders(InputPartition):
    keys: list[str]


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the folder of the library is missing: load(path)")
        self.table = options.get("table", "works")
        if self.table not in SCHEMAS:
            raise ValueError(f"no table of a library: {self.table}")
        self.path = options["path"].rstrip("/")
        self.folders = int(options.get("folders", FOLDERS))
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == ("key",):
                found = set(f.value)
            else:
                yield f
                continue
            self.keys = found if self.keys is None else self.keys & found

    def partitions(self) -> Sequence[Folders]:
        if self.keys is not None:
            # a key is the name of one folder, nothing that leads elsewhere
            keys = sorted(k for k in self.keys if k and "/" not in k and "\\" not in k and k not in (".", ".."))
        else:
            system, at = fs.FileSystem.from_uri(self.path)
            listed = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
            keys = sorted(x.base_name for x in listed if x.type == fs.FileType.Directory)
        return [Folders(keys[i : i + self.folders]) for i in range(0, len(keys), self.folders)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        system, at = fs.FileSystem.from_uri(self.path)
        for key in partition.keys:
            yield from getattr(self, f"_{self.table}")(system, f"{at}/{key}", key)

    def _works(self, system: fs.FileSystem, folder: str, key: str) -> Iterator[tuple]:
        if system.get_file_info(f"{folder}/{RECORD}").type != fs.FileType.File:
            return
        with system.open_input_file(f"{folder}/{RECORD}") as f:
            content = f.read()
        names = [c.split()[0] for c in WORK.split(", ")]
        try:
            found = {"key": key, **read_record(content)}
            yield (*(found[n] for n in names), None)
        except (ValueError, UnicodeDecodeError) as e:
            yield (key, *[None] * (len(names) - 1), str(e))

    def _files(self, system: fs.FileSystem, folder: str, key: str) -> Iterator[tuple]:
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File:
                with system.open_input_file(info.path) as f:
                    yield key, info.base_name, info.size, f.read(4) == b"%PDF"


class LibrarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillstack"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "works")]

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters taken over by it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LibrarySource)
