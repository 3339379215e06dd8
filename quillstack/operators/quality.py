"""What is missing or wrong in a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(name: str) -> Column:
    return F.col(name).isNotNull()


def completeness(works: DataFrame | None = None) -> Column:
    """0 to 13: how many of a work's fields have something; an empty string counts, the year 0 and an empty title don't."""
    facts = [F.coalesce(F.col("title") != "", F.lit(False)), F.size("authors") > 0, F.coalesce(F.col("year") != 0, F.lit(False))]
    facts += [_present(n) for n in ("doi", "arxiv", "journal", "publisher", "edition", "series", "abstract")]
    facts += [F.size(n) > 0 for n in ("isbn", "tags", "files")]
    return sum((f.cast("int") for f in facts), F.lit(0))


def needs_enrichment() -> Column:
    """No year (or 0) or no authors; for papers no abstract or no DOI, for books no publisher."""
    core = (F.coalesce("year", F.lit(0)) == 0) | (F.size("authors") == 0)
    return core | F.when(F.col("kind") == "book", F.col("publisher").isNull()).otherwise(F.col("abstract").isNull() | F.col("doi").isNull())


def wants() -> Column:
    """struct(abstract, pdf): what a work lacks that could be fetched."""
    return F.struct(F.col("abstract").isNull().alias("abstract"), (~F.col("has_pdf")).alias("pdf"))


def gap_report(works: DataFrame, total: int | None = None) -> DataFrame:
    """One row: total, missing_pdf, missing_pdf_with_doi, missing_abstract; total counts unreadable works too where it is given."""
    pdf = ~F.col("has_pdf")
    return works.agg(
        (F.count("*") if total is None else F.lit(total).cast("long")).alias("total"),
        F.count_if(pdf).alias("missing_pdf"),
        F.count_if(pdf & F.col("doi").isNotNull()).alias("missing_pdf_with_doi"),
        F.count_if(F.col("abstract").isNull()).alias("missing_abstract"),
    )


def backfill_report(works: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome per work, counts) of filling gaps from (key, pdf, abstract) that were fetched."""
    want = works.withColumn("w", wants()).filter("w.abstract or w.pdf").select("key", "w")
    got = want.join(fetched.select("key", F.col("pdf").alias("_p"), F.col("abstract").alias("_a")), "key", "left")
    pdf, abstract = F.col("w.pdf") & F.coalesce("_p", F.lit(False)), F.col("w.abstract") & F.col("_a").isNotNull()
    status = F.when(pdf & abstract, "pdf and abstract added").when(pdf, "pdf added").when(abstract, "abstract added").otherwise("unresolved")
    items = got.select("key", pdf.alias("pdf_added"), abstract.alias("abstract_added"), status.alias("status"))
    counts = items.agg(F.count("*").alias("considered"), F.count_if("pdf_added").alias("pdfs_added"), F.count_if("abstract_added").alias("abstracts_added"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))
    return items, counts


def validation_issues(works: DataFrame, listing: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(key, ord, issue) of every work.

    ``listing`` has (key, name, is_pdf) of the files there are; ``unreadable``
    (key, issue) of the records that could not be read.  A year of 0 passes.
    """
    here = listing.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("name", "is_pdf"))).alias("there"))
    joined = works.join(here, "key", "left").withColumn("there", F.coalesce("there", F.create_map().cast("map<string,boolean>")))
    k = F.col("key")
    facts = F.array(
        F.when(F.col("title") == "", F.concat(F.lit("missing title: "), k)),
        F.when(F.size("authors") == 0, F.concat(F.lit("missing authors: "), k)),
        F.when(F.col("year").isNull(), F.concat(F.lit("missing year: "), k)),
    )
    listed = F.transform(
        "files",
        lambda f: F.when(~F.map_contains_key("there", f), F.concat(F.lit("listed but missing: "), k, F.lit("/"), f)).when(
            ~F.element_at("there", f), F.concat(F.lit("not a PDF: "), k, F.lit("/"), f)
        ),
    )
    any_pdf = F.exists(F.map_entries("there"), lambda e: F.lower(e["key"]).endswith(".pdf") & e["value"])
    none = F.array(F.when((F.size("files") == 0) & ~any_pdf, F.concat(F.lit("no PDF: "), k)))
    temporary = F.transform(F.filter(F.array_sort(F.map_keys("there")), lambda n: n.startswith("tmp")), lambda n: F.concat(F.lit("temp name: "), k, F.lit("/"), n))
    issues = joined.select("key", F.posexplode(F.array_compact(F.concat(facts, listed, none, temporary))).alias("ord", "issue"))
    return issues if unreadable is None else issues.unionByName(unreadable.select("key", F.lit(0).alias("ord"), "issue"))


def fix_plan(works: DataFrame, listing: DataFrame) -> DataFrame:
    """(key, action, old, new): listed files that are no PDFs are removed, PDFs of a temporary name renamed to the key.

    All steps of a work stand in the plan, to be applied together.
    """
    listed = works.select("key", F.explode("files").alias("name"))
    bad = listing.filter(~F.col("is_pdf")).join(listed, ["key", "name"], "left_semi").select("key", F.lit("remove").alias("action"), F.col("name").alias("old"), F.lit(None).cast("string").alias("new"))
    temporary = listing.filter(F.col("is_pdf") & F.col("name").startswith("tmp") & F.col("name").endswith(".pdf"))
    renamed = temporary.groupBy("key").agg(F.min("name").alias("old")).select("key", F.lit("rename").alias("action"), "old", F.concat("key", F.lit(".pdf")).alias("new"))
    return bad.unionByName(renamed)


def apply_fixes(works: DataFrame, plan: DataFrame) -> DataFrame:
    """Works with their file lists as the plan leaves them."""
    steps = plan.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("old", F.coalesce("new", F.lit(""))))).alias("_s"))
    after = F.filter(F.transform("files", lambda f: F.coalesce(F.element_at("_s", f), f)), lambda f: f != "")
    joined = works.join(steps, "key", "left")
    return joined.withColumn("files", F.when(F.col("_s").isNull(), F.col("files")).otherwise(after)).drop("_s")


def validation_summary(total: int, fixed: int, issues: int) -> str:
    """One sentence on a validation run."""
    if not issues:
        return f"Fixed {fixed} issues" if fixed else f"Library OK — {total} references"
    return f"{issues + fixed} issues, fixed {fixed}" if fixed else f"{issues} issues found"


def import_outcome(results: DataFrame) -> DataFrame:
    """(status, n) of a batch import of rows (input, status)."""
    return results.groupBy("status").agg(F.count("*").alias("n"))
