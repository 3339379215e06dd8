"""Works as JSON, YAML, BibTeX, Hayagriva, citations, tables and envelopes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import external_url, family_given
from .catalogue import with_any_tag

FORMATS = {"json": "json", "yaml": "yaml", "yml": "yaml", "bibtex": "bibtex", "bib": "bibtex", "hayagriva": "hayagriva"}


def bibtex() -> Column:
    """One entry; fields without a value are left out."""
    field = lambda name, c: F.concat(F.lit(f"  {name} = {{"), c, F.lit("},"))
    authors = F.array_join(F.transform("authors", family_given), " and ")
    return F.concat_ws(
        "\n",
        F.concat(F.when(F.col("kind") == "book", "@book{").otherwise("@article{"), F.col("key"), F.lit(",")),
        field("title", F.col("title")),
        F.when(authors != "", field("author", authors)),
        field("year", F.col("year").cast("string")),
        *(field(n, F.col(n)) for n in ("journal", "publisher", "edition", "series")),
        F.when(F.size("isbn") > 0, field("isbn", F.array_join("isbn", ", "))),
        field("doi", F.col("doi")),
        field("eprint", F.col("arxiv")),
        F.when(F.col("arxiv").isNotNull(), F.lit("  archiveprefix = {arXiv},")),
        F.lit("}"),
    )


def record_json() -> Column:
    """A record as JSON: null fields shown, kind left out for papers and isbn when empty."""
    shown = lambda *names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    first = inner(F.to_json(F.struct("key", F.when(F.col("kind") != "paper", F.col("kind")).alias("kind"))))
    middle = inner(shown("title", "authors", "year", "doi", "arxiv", "journal", "edition", "publisher", "series"))
    isbn = F.when(F.size("isbn") > 0, inner(F.to_json(F.struct("isbn"))))
    return F.concat(F.lit("{"), F.concat_ws(",", first, middle, isbn, inner(shown("tags", "files", "abstract"))), F.lit("}"))


def hayagriva_json() -> Column:
    """An entry of a Hayagriva bibliography as JSON; an address only for what has an arXiv id and no DOI."""
    serial = F.when(F.coalesce("doi", "arxiv").isNotNull(), F.struct("doi", "arxiv"))
    return F.to_json(
        F.struct(
            F.when(F.col("kind") == "book", "book").otherwise("article").alias("type"),
            "title",
            F.when(F.size("authors") > 0, F.transform("authors", family_given)).alias("author"),
            F.col("year").alias("date"),
            F.when(F.col("journal").isNotNull(), F.struct(F.lit("periodical").alias("type"), F.col("journal").alias("title"))).alias("parent"),
            serial.alias("serial-number"),
            F.when(F.col("doi").isNull(), external_url(F.lit(None).cast("string"), F.col("arxiv"))).alias("url"),
            "abstract",
        )
    )


def _scalar(value) -> str:
    """A scalar as JSON, which is YAML."""
    return json.dumps(value, ensure_ascii=False)


def yaml_lines(value, indent: int = 0) -> list[str]:
    """Block-style YAML of what JSON holds; strings are quoted, so every one is safe."""
    pad = "  " * indent
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            out.extend([f"{pad}{k}:", *yaml_lines(v, indent + 1)] if isinstance(v, (dict, list)) and v else [f"{pad}{k}: {_scalar(v)}"])
        return out
    out = []
    for v in value:
        if isinstance(v, dict) and v:
            lines = yaml_lines(v, indent + 1)
            out.extend([f"{pad}- {lines[0].lstrip()}", *lines[1:]])
        else:
            out.append(f"{pad}- {_scalar(v)}")
    return out


def rendered(works: DataFrame, kind: str) -> DataFrame:
    """(key, entry) of every work in a format."""
    name = FORMATS.get(kind.lower())
    if name is None:
        raise ValueError(f"not a format: {kind}")
    column = {"bibtex": bibtex, "hayagriva": hayagriva_json}.get(name, record_json)()
    return works.select("key", column.alias("entry"))


def write_export(works: DataFrame, kind: str, path: str, tags: list[str] | None = None) -> None:
    """The works of any of the tags, by key, as one text file in the folder ``path``.

    Entries are rendered by all executors; only finished lines are brought
    together to be written in order.  JSON is one record a line.
    """
    name = FORMATS.get(kind.lower(), kind)
    entries = rendered(with_any_tag(works, tags or []), kind)
    if name in ("yaml", "hayagriva"):

        def as_yaml(rows):
            for batch in rows:
                if name == "yaml":
                    text = ["\n".join(yaml_lines([json.loads(e)])) for e in batch["entry"]]
                else:
                    text = ["\n".join(yaml_lines({k: json.loads(e)})) for k, e in zip(batch["key"], batch["entry"], strict=True)]
                yield batch.assign(entry=text)

        entries = entries.mapInPandas(as_yaml, "key string, entry string")
    separator = "\n\n" if name == "bibtex" else "\n"
    entries.orderBy("key").select("entry").coalesce(1).write.mode("overwrite").option("lineSep", separator).text(path)


def citation(key: Column, kind: str, strict: bool = True) -> Column:
    """The key as text, \\cite{key} or @key; another kind is refused, or taken as text where not strict."""
    shapes = {"plain": key, "latex": F.concat(F.lit("\\cite{"), key, F.lit("}")), "typst": F.concat(F.lit("@"), key)}
    if kind not in shapes and strict:
        raise ValueError(f"not a citation format: {kind}")
    return shapes.get(kind, key)


def table_line() -> Column:
    """key, year and title parted by tabs, a blank for no year."""
    return F.concat_ws("\t", "key", F.coalesce(F.col("year").cast("string"), F.lit("")), "title")


def score_line(position: Column, similarity: Column, work: Column, where: Column, text: Column) -> Column:
    return F.concat_ws("\t", F.concat(position.cast("string"), F.lit(".")), F.format_string("%.3f", similarity), work, F.coalesce(where, F.lit("")), text)


def envelope(spark: SparkSession, data: DataFrame | None, warnings: list[str] = (), errors: list[str] = ()) -> str:
    """{ok, data, warnings, errors} as indented JSON; data is null where there are errors. For results of a page's size."""
    rows = None if errors or data is None else [json.loads(r) for r in data.toJSON().collect()]
    return json.dumps({"ok": not errors, "data": rows, "warnings": list(warnings), "errors": list(errors)}, indent=2, ensure_ascii=False)
