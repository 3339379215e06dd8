"""Columns that recognise identifiers of works."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

DOI = r"(10\.\d{4,9}/\S+)"
ARXIV = r"^(?:(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5})(v\d+)?(?:\.pdf)?$"


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, group))


def arxiv_id(c: Column) -> Column:
    """The id with its version, where the whole string is one, bare or as an address."""
    return blank_to_null(F.concat(F.regexp_extract(c, ARXIV, 1), F.regexp_extract(c, ARXIV, 2)))


def doi(c: Column) -> Column:
    """The first thing like a DOI, up to white space."""
    return _extract(c, DOI)


def host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def resolver_doi(c: Column) -> Column:
    """The DOI of an address of the DOI resolver."""
    return F.when(host(c).isin("doi.org", "dx.doi.org"), doi(c))


def pmc_id(c: Column) -> Column:
    return F.upper(_extract(c, r"(?i)^https?://(?:www\.)?pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC\d+)(?:/.*)?$"))


def pmid(c: Column) -> Column:
    return F.coalesce(_extract(c, r"(?i)^https?://(?:www\.)?pubmed\.ncbi\.nlm\.nih\.gov/(\d{4,9})/?$"), _extract(c, r"(?i)^pmid:\s*(\d{4,9})$"))


def url_decoded(c: Column) -> Column:
    """Percent signs decoded, a plus kept; the string as it is where that fails."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def doi_in_url(c: Column) -> Column:
    """A DOI inside an address: cut where the query goes on, without closing punctuation and one .pdf."""
    found = F.regexp_replace(doi(url_decoded(c)), r"[?#&].*$", "")
    found = F.regexp_replace(F.regexp_replace(found, r"[.,;)/]+$", ""), r"\.pdf$", "")
    return F.when(F.length(found) > 3, found)


def is_web(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def classify_input(c: Column, is_path: Column | None = None) -> Column:
    """struct(kind, id): path, arxiv, pmc, pmid, doi, url or unknown, the first that fits in this order."""
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("id"))
    path = F.lit(False) if is_path is None else is_path
    return (
        F.when(path, made("path", c))
        .when(arxiv_id(c).isNotNull(), made("arxiv", arxiv_id(c)))
        .when(pmc_id(c).isNotNull(), made("pmc", pmc_id(c)))
        .when(pmid(c).isNotNull(), made("pmid", pmid(c)))
        .when(is_web(c) & resolver_doi(c).isNotNull(), made("doi", resolver_doi(c)))
        .when(is_web(c), made("url", c))
        .when(doi(c).isNotNull(), made("doi", doi(c)))
        .otherwise(made("unknown", F.lit(None).cast("string")))
    )


def is_importable(c: Column, is_path: Column | None = None) -> Column:
    """An arXiv id, something with a DOI, an address, or an existing path."""
    known = arxiv_id(c).isNotNull() | doi(c).isNotNull() | is_web(c)
    return F.coalesce(known if is_path is None else known | is_path, F.lit(False))


def reduce_url(c: Column) -> Column:
    """What a page's address is passed on as: the bare id of a known service, else a DOI that stands in it, else itself."""
    name = F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    found = lambda source, pattern, group: F.nullif(F.regexp_extract(source, pattern, group), F.lit(""))
    return F.coalesce(
        F.when(name.endswith("arxiv.org"), found(path, r"/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?", 1)),
        F.when(name.isin("doi.org", "dx.doi.org"), url_decoded(F.regexp_replace(path, "^/", ""))),
        F.when(name == "pubmed.ncbi.nlm.nih.gov", found(path, r"/(\d+)", 1)),
        F.when(name.endswith("ncbi.nlm.nih.gov"), F.concat(F.lit("PMC"), found(path, r"(?i)PMC(\d+)", 1))),
        F.when(name.isNotNull(), found(c, r"""10\.\d{4,9}/[^\s"'<>?#]+""", 0)),
        c,
    )


def ftp_to_https(c: Column) -> Column:
    return F.regexp_replace(c, "^ftp://", "https://")


def http_to_https(c: Column) -> Column:
    return F.regexp_replace(c, "^http://", "https://")


def url_file_name(c: Column) -> Column:
    """The last segment of the path if it is a PDF's name, else download.pdf."""
    last = F.try_element_at(F.filter(F.split(F.try_parse_url(c, F.lit("PATH")), "/"), lambda s: s != ""), F.lit(-1))
    return F.when(F.lower(last).endswith(".pdf"), last).otherwise(F.lit("download.pdf"))


def enrichment_source(arxiv: Column, files: Column, doi_: Column, key: Column, title: Column) -> Column:
    """struct(source, id): where missing data would come from, the first that there is."""
    from_files = F.get(F.filter(F.transform(files, lambda f: arxiv_id(F.regexp_replace(f, r"^.*/", ""))), lambda x: x.isNotNull()), F.lit(0))
    made = lambda source, value: F.struct(F.lit(source).alias("source"), value.alias("id"))
    return (
        F.when(arxiv.isNotNull(), made("arxiv", arxiv))
        .when(from_files.isNotNull(), made("file", from_files))
        .when(doi_.isNotNull(), made("doi", doi_))
        .when(arxiv_id(key).isNotNull(), made("key", arxiv_id(key)))
        .when(F.coalesce(title, F.lit("")) != "", made("title", title))
        .otherwise(made("none", F.lit(None).cast("string")))
    )
