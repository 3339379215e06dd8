"""A library on disk: one folder per work with its record, files and derived passages."""

from __future__ import annotations

import tomllib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import is_pdf_file
from .schemas import WORK

LISTS = ("authors", "isbn", "tags", "files")
TEXTS = ("doi", "arxiv", "journal", "edition", "publisher", "series", "abstract")


def _folder(path: Column, depth: int = 1) -> Column:
    """The name of the folder a file stands in, or of one further up."""
    return F.try_element_at(F.split(path, "/"), F.lit(-1 - depth))


def _files(spark: SparkSession, library: str, pattern: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        return reader.option("recursiveFileLookup", True).load(library)
    return reader.load(f"{library}/*")


def scan_records(spark: SparkSession, library: str) -> DataFrame:
    """(key, content) of every work's record. Only folders right below the library count; one that doesn't exist is empty."""
    try:
        found = _files(spark, library, "info.toml")
    except Exception as e:  # a library without works has no path to read
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "key string, content binary")
        raise
    return found.select(_folder(F.col("path")).alias("key"), "content")


def read_record(content: bytes) -> dict:
    """The fields of a record; a ValueError says what is wrong with it."""
    raw = tomllib.loads(content.decode("utf-8"))
    out: dict = {"kind": raw.get("kind", "paper"), "title": raw.get("title"), "year": raw.get("year")}
    if not isinstance(out["title"], str):
        raise ValueError("the title is missing or no text")
    if out["kind"] not in ("paper", "book"):
        raise ValueError(f"not a kind: {out['kind']}")
    if out["year"] is not None and (not isinstance(out["year"], int) or isinstance(out["year"], bool) or not 0 <= out["year"] < 1 << 16):
        raise ValueError("the year is no number of a year")
    for name in LISTS:
        out[name] = raw.get(name, [])
        if not isinstance(out[name], list) or not all(isinstance(x, str) for x in out[name]):
            raise ValueError(f"{name} is no list of texts")
    for name in TEXTS:
        out[name] = raw.get(name)
        if out[name] is not None and not isinstance(out[name], str):
            raise ValueError(f"{name} is no text")
    return out


def parse_records(records: DataFrame) -> DataFrame:
    """Works of (key, content), with _corrupt saying why one can't be read. (pandas: TOML has no built-in reader.)"""
    columns = [c.split()[0] for c in WORK.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content in zip(frame["key"], frame["content"], strict=True):
                try:
                    rows.append({"key": key, **read_record(bytes(content)), "_corrupt": None})
                except (ValueError, UnicodeDecodeError) as e:
                    rows.append({"key": key, "_corrupt": str(e)})
            out = pd.DataFrame([{c: r.get(c) for c in [*columns, "_corrupt"]} for r in rows], columns=[*columns, "_corrupt"], dtype=object)
            out["year"] = out["year"].astype("Int32")
            yield out

    return records.mapInPandas(run, f"{WORK}, _corrupt string")


def read_works(spark: SparkSession, library: str) -> tuple[DataFrame, DataFrame]:
    """(works, warnings (key, warning)): records that can't be read are passed over."""
    parsed = parse_records(scan_records(spark, library))
    warnings = parsed.filter("_corrupt is not null").select("key", F.concat(F.lit("Skipping "), "key", F.lit(": "), "_corrupt").alias("warning"))
    return parsed.filter("_corrupt is null").drop("_corrupt"), warnings


def file_listing(spark: SparkSession, library: str) -> DataFrame:
    """(key, name, length, is_pdf) of the files in the works' folders; is_pdf by their first bytes."""
    found = _files(spark, library, "*")
    return found.select(_folder(F.col("path")).alias("key"), F.try_element_at(F.split("path", "/"), F.lit(-1)).alias("name"), "length", is_pdf_file(F.col("content")).alias("is_pdf"))


def has_pdf(listing: DataFrame) -> DataFrame:
    """(key, has_pdf): a file that ends .pdf, whatever its case."""
    return listing.groupBy("key").agg(F.max(F.lower("name").endswith(".pdf")).alias("has_pdf"))


def resolve_pdf(works: DataFrame, listing: DataFrame) -> DataFrame:
    """Works with pdf: the first listed file if it is there, else the folder's first PDF by name; and has_pdf."""
    names = listing.groupBy("key").agg(F.collect_set("name").alias("_there"), F.min(F.when(F.lower("name").endswith(".pdf"), F.col("name"))).alias("_any"))
    first = F.get("files", F.lit(0))
    listed = F.when(F.array_contains("_there", first), first)
    return works.join(names, "key", "left").withColumn("pdf", F.coalesce(listed, "_any")).withColumn("has_pdf", F.col("_any").isNotNull()).drop("_there", "_any")


def file_title(name: Column) -> Column:
    """What stands in for a title: the file's name without its ending."""
    return F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1)


def with_fulltext(works: DataFrame, texts: DataFrame, longest: int = 50 << 20, pages: int = 100) -> DataFrame:
    """Works with the text of their files' pages (key, length, pages): files of up to 50 MB, the first 100 pages, null when blank."""
    kept = texts.filter(F.col("length") <= longest).select("key", F.trim(F.array_join(F.slice("pages", 1, pages), "\n")).alias("fulltext"))
    return works.drop("fulltext").join(kept.withColumn("fulltext", F.when(F.col("fulltext") != "", F.col("fulltext"))), "key", "left")


def jsonl_sources(spark: SparkSession, library: str, works: DataFrame) -> DataFrame:
    """(key, work_title, source_path, content) of the JSONL files below each work's ``derived``, endings in any case."""
    found = _files(spark, f"{library}/*/derived", "*", recursive=True).filter(F.lower("path").endswith(".jsonl"))
    after = F.regexp_extract("path", r"/([^/]+)/derived/.*$", 1)
    return found.select(after.alias("key"), F.col("path").alias("source_path"), "content").join(works.select("key", F.col("title").alias("work_title")), "key")


def layout_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, content) of layout JSON files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.col("path").alias("doc"), F.col("content").cast("string").alias("content"))


def write_records(works: DataFrame, library: str) -> None:
    """Every work's record in its folder, each replaced at once. For a library that all executors can write to."""

    def toml(value) -> str:
        import json

        return "[" + ", ".join(map(toml, value)) + "]" if isinstance(value, (list, tuple)) else json.dumps(value, ensure_ascii=False)

    def write(rows) -> None:
        for row in rows:
            folder = Path(library) / row["key"]
            folder.mkdir(parents=True, exist_ok=True)
            kept = {k: v for k, v in row.asDict().items() if k != "key" and v is not None and not (k == "kind" and v == "paper") and not (k == "isbn" and not v)}
            part = folder / f".info-{uuid.uuid4().hex}"
            part.write_text("".join(f"{k} = {toml(v)}\n" for k, v in kept.items()), encoding="utf-8")
            part.replace(folder / "info.toml")

    works.select(*(c.split()[0] for c in WORK.split(", "))).foreachPartition(write)


def foreign_works(entries: DataFrame) -> DataFrame:
    """Works of another manager's entries (id, title, author_list, author, year, doi, arxiv, eprint, journal, tags, files, abstract), as parsed from its files.

    Names come from given and family, or a text split at " and " or else at
    commas; an eprint stands in for an arxiv id; a doubled .pdf ending is single.
    """
    names = F.transform("author_list", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    text = F.when(F.contains("author", F.lit(" and ")), F.split("author", " and ")).otherwise(F.split("author", ","))
    authors = F.when(F.size(F.coalesce("author_list", F.array().cast("array<struct<given:string,family:string>>"))) > 0, names).otherwise(F.coalesce(text, F.array().cast("array<string>")))
    clean = F.filter(F.transform(authors, F.trim), lambda a: a != "")
    files = F.transform("files", lambda f: F.regexp_replace(f, r"(?i)\.pdf\.pdf$", ".pdf"))
    return entries.select(F.col("id").alias("key"), F.lit("paper").alias("kind"), "title", clean.alias("authors"), "year", "doi", F.coalesce("arxiv", "eprint").alias("arxiv"), "journal", "tags", files.alias("files"), "abstract")


#: Programs that settings name: what else the environment calls them, and what they are if nothing says (fixed values).
COMMANDS = {"editor": (("EDITOR",), "vi"), "reader": ((), "xdg-open"), "browser": (("BROWSER",), "xdg-open")}


@dataclass
class Config:
    """Settings: what the environment says, else the file, else these."""

    library: str = "library"
    page: int = 100
    result_cap: int = 0
    citation: str = "plain"
    theme: str | None = None
    layout: str | None = None
    semantic_results: int | None = None
    editor: str | list[str] | None = None
    reader: str | list[str] | None = None
    browser: str | list[str] | None = None
    embedding: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, environment: dict | None = None) -> Config:
        """Settings that the class doesn't know are passed over; a cap of results counts from 1 on; ~ is the home folder."""
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else {}
        out = cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})
        out.library = str(Path(out.library).expanduser())
        out.semantic_results = out.semantic_results if out.semantic_results and out.semantic_results > 0 else None
        for name in ("library", "citation"):
            out.__dict__[name] = (environment or {}).get(f"QUILLSTACK_{name.upper()}", out.__dict__[name])
        return out

    def command(self, name: str, environment: dict | None = None) -> list[str]:
        """The program and arguments of editor, reader or browser; a program that the environment names has no arguments."""
        others, default = COMMANDS[name]
        said = next((environment[v] for v in (f"QUILLSTACK_{name.upper()}", *others) if v in (environment or {})), None)
        found = said if said is not None else getattr(self, name) if getattr(self, name) is not None else default
        parts = [found] if isinstance(found, str) else list(found)
        if not parts or not parts[0]:
            raise ValueError(f"the command of {name} is empty")
        return parts
