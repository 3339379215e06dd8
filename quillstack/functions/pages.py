"""Columns over HTML and over the answers of bibliographic services."""

from __future__ import annotations

import io
import re
import tarfile
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .identifiers import doi, http_to_https
from .text import blank_to_null, clean_abstract, collapse_space, trim_space


def _meta_patterns(name: str) -> tuple[str, str]:
    n = re.escape(name)
    return (
        rf"""(?is)<meta\b[^>]*?\bname\s*=\s*["']{n}["'][^>]*?\bcontent\s*=\s*["']([^"']*)["']""",
        rf"""(?is)<meta\b[^>]*?\bcontent\s*=\s*["']([^"']*)["'][^>]*?\bname\s*=\s*["']{n}["']""",
    )


def meta_content(html: Column, name: str) -> Column:
    """The content of the first such tag, in either order of attributes; null when empty."""
    first, second = _meta_patterns(name)
    return F.coalesce(blank_to_null(trim_space(F.regexp_extract(html, first, 1))), blank_to_null(trim_space(F.regexp_extract(html, second, 1))))


def meta_contents(html: Column, name: str) -> Column:
    """The contents of all such tags, each once."""
    first, second = _meta_patterns(name)
    every = F.concat(F.regexp_extract_all(html, F.lit(first), 1), F.regexp_extract_all(html, F.lit(second), 1))
    return F.array_distinct(F.filter(F.transform(every, trim_space), lambda x: x != ""))


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """link against its page. (pandas: the rules of relative references aren't a built-in function.)"""
    return pd.Series([None if x is None else urljoin(b or "", x) for b, x in zip(base, link, strict=True)])


def landing_doi(html: Column) -> Column:
    """The page's DOI: citation_doi, prism.doi, or a dc.identifier that has one."""
    dc = meta_content(html, "dc.identifier")
    named = F.coalesce(meta_content(html, "citation_doi"), meta_content(html, "prism.doi"), F.when(F.contains(dc, F.lit("10.")), dc))
    return doi(F.regexp_replace(named, "^(?:doi:|DOI:)", ""))


def landing_info(url: Column, html: Column) -> Column:
    return F.struct(landing_doi(html).alias("doi"), absolute_url(url, meta_content(html, "citation_pdf_url")).alias("pdf_url"))


def abs_page_record(html: Column) -> Column:
    """title, authors, year and doi of an abstract page's citation tags."""
    year = F.regexp_extract(meta_content(html, "citation_date"), r"^([^/-]*)", 1)
    return F.struct(
        meta_content(html, "citation_title").alias("title"),
        meta_contents(html, "citation_author").alias("authors"),
        year.try_cast("int").alias("year"),
        meta_content(html, "citation_doi").alias("doi"),
    )


_ATOM = ("title", "summary", "published", "doi")


def _atom_texts(xml: str | None) -> tuple:
    """The text of the first element of each name in _ATOM, and the names of authors, in elements that are the first entry of theirs."""
    if not xml:
        return (*[None] * len(_ATOM), None)
    root = ElementTree.fromstring(xml)
    local = lambda e: e.tag.rpartition("}")[2]
    entries = {next((c for c in e if local(c) == "entry"), None) for e in root.iter()}
    if local(root) == "entry":
        entries.add(root)
    found, names = {}, []
    for entry in root.iter():
        if entry not in entries:
            continue
        for e in entry:
            name = local(e)
            if name in _ATOM:
                found.setdefault(name, "".join(e.itertext()))
            elif name == "author":
                names += [t for n in e if local(n) == "name" for t in (n.text, *(c.tail for c in n)) if t]
    return (*map(found.get, _ATOM), names)


def atom_record(xml: Column) -> Column:
    """title, authors, year, abstract and doi of the first entry; null without a title. (pandas: a path of XPath would parse a feed again for each field.)"""
    kind = T.StructType([*(T.StructField(n, T.StringType()) for n in _ATOM), T.StructField("names", T.ArrayType(T.StringType()))])

    @F.pandas_udf(kind)
    def run(xml: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_atom_texts(x) for x in xml], columns=kind.names)

    parts = run(xml)
    at = lambda tag: blank_to_null(trim_space(parts[tag]))
    title = collapse_space(at("title"))
    return F.when(
        title.isNotNull(),
        F.struct(
            title.alias("title"),
            F.transform(parts["names"], trim_space).alias("authors"),
            F.left(at("published"), F.lit(4)).try_cast("int").alias("year"),
            clean_abstract(at("summary")).alias("abstract"),
            at("doi").alias("doi"),
        ),
    )




def csl_record(json: Column) -> Column:
    """title, authors, journal, year, doi, abstract of a CSL item; titles may be strings or arrays."""
    return csl_fields(F.try_parse_json(json))


def csl_fields(v: Column) -> Column:
    """csl_record of an item that is parsed already; where that is a column of its own, it is parsed once."""
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    either = lambda name: F.coalesce(F.try_variant_get(v, f"$['{name}'][0]", "string"), F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant")) == "STRING", get(f"$['{name}']")))
    people = F.try_variant_get(v, "$.author", "array<struct<family:string,given:string>>")
    names = F.transform(F.filter(people, lambda p: p["family"].isNotNull()), lambda p: F.concat_ws(" ", p["given"], p["family"]))
    years = [F.try_variant_get(v, f"$['{k}']['date-parts'][0][0]", "bigint") for k in ("issued", "published-print", "published-online", "created")]
    year = F.coalesce(*years)
    return F.struct(
        F.coalesce(either("title"), F.lit("Untitled")).alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        either("container-title").alias("journal"),
        F.when(year.between(0, 65535), year.cast("int")).alias("year"),
        get("$.DOI").alias("doi"),
        clean_abstract(get("$.abstract")).alias("abstract"),
    )


def first_or_self(json: Column) -> Column:
    """The first element of a JSON array, or the value itself."""
    v = F.try_parse_json(json)
    return F.coalesce(F.to_json(F.try_variant_get(v, "$[0]", "variant")), json)


def pmc_doi(json: Column, pmc: Column) -> Column:
    """The DOI of the record with this id, in whatever case."""
    records = F.from_json(json, "struct<records:array<struct<pmcid:string,doi:string>>>")["records"]
    return F.get(F.filter(records, lambda r: F.lower(r["pmcid"]) == F.lower(pmc)), F.lit(0))["doi"]


def crossref_pdf(json: Column) -> Column:
    """The first link to a PDF, by its type or its ending, as https."""
    links = F.from_json(json, "struct<message:struct<link:array<struct<URL:string,`content-type`:string>>>>")["message"]["link"]
    pdf = lambda x: F.coalesce(F.lower(x["content-type"]).contains("pdf"), F.lit(False)) | F.coalesce(F.lower(x["URL"]).endswith(".pdf"), F.lit(False))
    return http_to_https(F.get(F.filter(links, pdf), F.lit(0))["URL"])


def oa_package_url(xml: Column) -> Column:
    return blank_to_null(F.xpath_string(xml, F.lit("//link[@format='tgz']/@href")))


_UNPAYWALL = "struct<oa_locations:array<struct<url_for_pdf:string,host_type:string>>,best_oa_location:struct<url_for_pdf:string>>"


def oa_candidates(json: Column) -> Column:
    """PDF addresses as https, repository copies first, an address that repeats the one before left out."""
    locations = F.filter(F.from_json(json, _UNPAYWALL)["oa_locations"], lambda x: x["url_for_pdf"].isNotNull())
    repository = lambda x: F.coalesce(x["host_type"] == "repository", F.lit(False))
    urls = F.transform(F.concat(F.filter(locations, repository), F.filter(locations, lambda x: ~repository(x))), lambda x: http_to_https(x["url_for_pdf"]))
    return F.filter(urls, lambda x, i: (i == 0) | (x != F.get(urls, i - 1)))


def oa_best(json: Column) -> Column:
    return F.from_json(json, _UNPAYWALL)["best_oa_location"]["url_for_pdf"]


@F.pandas_udf(T.BinaryType())
def pdf_of_package(package: pd.Series) -> pd.Series:
    """The first PDF member of a tar.gz, if it is one. (pandas: archives have no built-in reader.)"""

    def first(data: bytes | None) -> bytes | None:
        try:
            with tarfile.open(fileobj=io.BytesIO(data or b""), mode="r:gz") as tar:
                for member in tar:
                    if member.isfile() and member.name.lower().endswith(".pdf"):
                        found = tar.extractfile(member).read()
                        return found if found.startswith(b"%PDF-") else None
        except (tarfile.TarError, OSError, EOFError):
            return None
        return None

    return package.map(first)


def is_pdf(content: Column) -> Column:
    """The five-byte mark of a download."""
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def is_pdf_file(content: Column) -> Column:
    """The four-byte mark that validation looks for."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
