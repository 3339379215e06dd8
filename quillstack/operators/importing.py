"""Imports as one flow: inputs in, works, their index and an outcome for each input out, in one commit.

What services and files say is a table of answers, so a run is a batch plan: inputs
are told apart, resolved by joins, held against the library and against each other
in the order they came in, named, written and indexed.  A run has a name; a run of
a name that was committed gives its outcomes again and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers, pages
from ..functions.text import normal_key, work_key
from ..plans.durable import durable, release
from ..sources.library import file_title
from ..sources.schemas import WORK
from ..sources.store import Store, Version, bucket_of
from .catalogue import final_keys
from .duplicates import probe
from .lexical import lexical_documents
from .lexical_index import LexicalIndex

ANSWER = "service string, id string, body string"
PDF = "id string, text string"
OUTCOME = "run string, pos long, input string, status string, keys array<string>, message string"
_RECORD = "struct<title:string,authors:array<string>,year:int,journal:string,doi:string,abstract:string>"


def _as_record(c: Column, *without: str) -> Column:
    """A parsed answer as the fields of _RECORD, null where it is null."""
    fields = ("title", "authors", "year", "journal", "doi", "abstract")
    made = F.struct(*(F.lit(None).alias(n) if n in without else c[n].alias(n) for n in fields)).cast(_RECORD)
    return F.when(c.isNotNull(), made)


def resolve(inputs: DataFrame, answers: DataFrame, pdfs: DataFrame) -> DataFrame:
    """(pos, input, kind, id, record, arxiv, pdf, file, message) of inputs (pos, input).

    answers (service, id, body) are what services said: ``arxiv`` a feed by arXiv
    id, ``crossref`` an item by DOI, ``pubmed`` an item by PMID, ``pmc`` the ids of
    an article, ``page`` the page at an address.  pdfs (id, text) are files that can
    be had, by arXiv id, DOI, PMC id, address or path, with their text.  pdf is the
    id of the work's file, file its name (null: the work's key), message why there is
    no record.  Of several answers of one id the least counts.
    """
    said = answers.groupBy("service", "id").agg(F.min("body").alias("body"))
    # ids of DOIs are alike in whatever case
    same = lambda service, c: F.when(F.lit(service) == "crossref", F.lower(c)).otherwise(c)

    def ask(df: DataFrame, service: str, by: Column, name: str) -> DataFrame:
        found = said.filter(F.col("service") == service).select(same(service, F.col("id")).alias("_id"), F.col("body").alias(name))
        if service == "crossref":
            found = found.groupBy("_id").agg(F.min(name).alias(name))
        return df.withColumn("_asked", same(service, by)).join(found, F.col("_asked") == F.col("_id"), "left").drop("_id", "_asked")

    have = pdfs.groupBy("id").agg(F.min("text").alias("_text")).select("id")
    paths = have.select(F.col("id").alias("input"), F.lit(True).alias("_path")).filter("lower(input) like '%.pdf'")
    told = inputs.select("pos", "input").join(paths, "input", "left")
    target = identifiers.classify_input(F.col("input"), F.coalesce(F.col("_path"), F.lit(False)) & ~identifiers.is_web(F.col("input")))
    told = told.select("pos", "input", target["kind"].alias("kind"), target["id"].alias("id"))

    # an address is asked for only where its text has no DOI
    in_url = F.when(F.col("kind") == "url", identifiers.doi_in_url(F.col("input")))
    told = ask(told, "page", F.when((F.col("kind") == "url") & in_url.isNull(), F.col("input")), "page")
    told = ask(told, "pmc", F.when(F.col("kind") == "pmc", F.col("id")), "ids")
    landed = pages.landing_info(F.col("input"), F.col("page"))
    told = told.withColumn("_landed", F.when(F.col("page").isNotNull(), landed))
    stem_id = identifiers.arxiv_id(file_title(F.regexp_replace("input", r"^.*/", "")))
    told = told.withColumns({
        "doi": F.when(F.col("kind") == "doi", F.col("id")).when(F.col("kind") == "url", F.coalesce(in_url, F.col("_landed.doi"))).when(F.col("kind") == "pmc", pages.pmc_doi(F.col("ids"), F.col("id"))),
        "arxiv": F.when(F.col("kind") == "arxiv", F.col("id")).when(F.col("kind") == "path", stem_id),
    })
    told = ask(told, "arxiv", F.col("arxiv"), "_feed")
    told = ask(told, "crossref", F.col("doi"), "_item")
    told = ask(told, "pubmed", F.when(F.col("kind") == "pmid", F.col("id")), "_summary")
    # each step is a column that the next one reads several times, so that none is worked out again for every field
    told = told.withColumns({"_iv": F.try_parse_json("_item"), "_sv": F.try_parse_json("_summary")})
    inner = lambda v: F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    told = told.withColumns({"_iv": inner(F.col("_iv")), "_sv": inner(F.col("_sv"))})
    of_json = lambda v: F.when(v.isNotNull(), _as_record(pages.csl_fields(v)))
    told = told.withColumns({"_feed": _as_record(pages.atom_record(F.col("_feed")), "journal"), "_item": of_json(F.col("_iv")), "_summary": of_json(F.col("_sv"))}).drop("_iv", "_sv")
    feed, item, summary = F.col("_feed"), F.col("_item"), F.col("_summary")
    # a record of PubMed that has neither title nor DOI says nothing
    summary = F.when(~((summary["title"] == "Untitled") & summary["doi"].isNull()), summary)
    as_pdf = (F.col("kind") == "path") | ((F.col("kind") == "url") & F.col("doi").isNull())
    pdf = (
        F.when(F.col("kind").isin("arxiv", "pmc", "path"), F.col("id"))
        .when(F.col("kind") == "url", F.coalesce(F.col("_landed.pdf_url"), F.col("input")))
        .when(F.col("kind") == "pmid", summary["doi"])
        .otherwise(F.col("doi"))
    )
    told = told.withColumn("_pdf", pdf).withColumn("_pdf2", F.when(F.col("kind") == "url", F.col("doi")))
    for wanted, name in (("_pdf", "_has"), ("_pdf2", "_has2")):
        told = told.join(have.select(F.col("id").alias("_id"), F.lit(True).alias(name)), F.col(wanted) == F.col("_id"), "left").drop("_id")
    file_name = F.regexp_replace(F.col("input"), r"^.*/", "")
    name = F.when(F.col("kind") == "path", file_name).otherwise(identifiers.url_file_name(F.coalesce(F.col("_landed.pdf_url"), F.col("input"))))
    nothing = F.array().cast("array<string>")
    bare = F.struct(file_title(name).alias("title"), nothing.alias("authors"), *(F.lit(None).cast(k).alias(n) for n, k in (("year", "int"), ("journal", "string"), ("doi", "string"), ("abstract", "string")))).cast(_RECORD)
    record = F.when(F.col("kind") == "arxiv", feed).when(as_pdf & F.col("_has"), F.coalesce(feed, bare)).when(F.col("kind") == "pmid", summary).when(~as_pdf, item)
    must = F.col("kind").isin("arxiv", "pmc") | as_pdf
    message = (
        F.when(F.col("kind") == "unknown", F.concat(F.lit("Not a file, URL, arXiv ID, or DOI: "), F.coalesce("input", F.lit(""))))
        .when((F.col("kind") == "pmc") & F.col("doi").isNull(), F.concat(F.lit("no DOI of "), "id"))
        .when(must & F.col("_has").isNull(), F.concat(F.lit("no PDF of "), "id"))
        .when(record.isNull(), F.concat(F.lit("no record of "), F.coalesce("doi", "arxiv", "id")))
    )
    used = F.when(F.col("_has"), F.col("_pdf")).when(F.col("_has2"), F.col("_pdf2"))
    file = F.when(F.col("kind").isin("arxiv", "pmc"), F.concat("id", F.lit(".pdf"))).when(as_pdf, name)
    return told.select("pos", "input", "kind", "id", F.when(message.isNull(), record).alias("record"), "arxiv", used.alias("pdf"), file.alias("file"), message.alias("message"))


def first_of_each(works: DataFrame) -> DataFrame:
    """(pos, match) of works (pos, doi, title): match is the place of the work before that makes one superfluous, null for those that stay.

    As if one went through them in order and kept a work unless one that was kept
    before has its DOI or its title.  In each round the first of both its groups
    stays and what shares a group with it goes; only minima of groups are joined.
    """
    every = durable(works.select("pos", normal_key(F.col("doi")).alias("d"), normal_key(F.col("title")).alias("t")))
    by = lambda df, g: df.filter(F.col(g).isNotNull()).groupBy(g).agg(F.min("pos").alias(f"_{g}"))
    open_, kept, rounds = every, every.limit(0), []
    while not open_.isEmpty():
        placed = open_.join(by(open_, "d"), "d", "left").join(by(open_, "t"), "t", "left")
        first = F.coalesce("_d", "pos").eqNullSafe(F.col("pos")) & F.coalesce("_t", "pos").eqNullSafe(F.col("pos"))
        stays = durable(placed.filter(first).select("pos", "d", "t"))
        left = open_.join(stays.select("pos"), "pos", "left_anti").join(by(stays, "d"), "d", "left").join(by(stays, "t"), "t", "left")
        open_ = durable(left.filter("_d is null and _t is null").select("pos", "d", "t"))
        kept = kept.unionByName(stays)
        rounds += [stays, open_]
    # those that were kept share no DOI and no title
    gone = every.join(kept.select("pos"), "pos", "left_anti").join(by(kept, "d"), "d", "left").join(by(kept, "t"), "t", "left")
    before = lambda g: F.when(F.col(g) < F.col("pos"), F.col(g))
    out = durable(kept.select("pos", F.lit(None).cast("long").alias("match")).unionByName(gone.select("pos", F.least(before("_d"), before("_t")).alias("match"))))
    release(every, *rounds)
    return out


class Library:
    """Works, their index and the outcomes of runs, in one store below a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.store = Store(spark, root)
        self.index = LexicalIndex(spark, root, buckets=buckets)

    def _table(self, version: Version, name: str, ddl: str, buckets=None) -> DataFrame:
        return self.store.read(version, name, buckets) if name in version.schemas else self.spark.createDataFrame([], ddl)

    def works(self, version: Version | None = None) -> DataFrame:
        return self._table(version or self.store.latest(), "records", WORK)

    def outcomes(self, run: str | None = None, version: Version | None = None) -> DataFrame:
        """(run, pos, input, status, keys, message) of all runs or one, whose bucket alone is read."""
        version = version or self.store.latest()
        if run is None:
            return self._table(version, "runs", OUTCOME)
        bucket = self.spark.range(1).select(bucket_of(F.lit(run), self.buckets)).first()[0]
        return self._table(version, "runs", OUTCOME, [bucket]).filter(F.col("run") == run)

    def add(self, run: str, inputs: DataFrame, answers: DataFrame, pdfs: DataFrame, force: bool = False) -> DataFrame:
        """Adds inputs (pos, input), pos being distinct, and returns their outcomes: added with its key, skipped or failed with a message.

        An input that has the DOI or title of a work of the library, or of an input
        before it that is added, is skipped unless forced.  A work is indexed with the
        text of its first file.  Works, index and outcomes are committed together.
        """
        base = self.store.latest()
        seen = self.outcomes(run, base)
        if not seen.isEmpty():
            return seen
        told = durable(resolve(inputs, answers, pdfs))
        found = told.filter("message is null").select("pos", F.col("record.doi").alias("doi"), F.col("record.title").alias("title"))
        library = self.works(base)
        if force:
            known, fresh = None, found.select("pos", F.lit(None).cast("long").alias("match"))
        else:
            known = durable(probe(found.withColumn("key", F.col("pos")), library).select(F.col("candidate").alias("pos"), F.concat("match", F.lit(" ("), "reason", F.lit(")")).alias("of")))
            fresh = first_of_each(found.join(known, "pos", "left_anti"))
        new = told.join(fresh.filter("match is null").select("pos"), "pos", "left_semi")
        named = final_keys(
            new.select(F.lpad(F.col("pos").cast("string"), 20, "0").alias("key"), "record"), work_key(F.col("record.authors"), F.col("record.year"), F.col("record.title")), library
        ).select(F.col("key").cast("long").alias("pos"), F.col("final_key").alias("key"))
        none = F.array().cast("array<string>")
        files = F.when(F.col("pdf").isNull(), none).otherwise(F.array(F.coalesce("file", F.concat("key", F.lit(".pdf")))))
        lit = {"kind": F.lit("paper"), "arxiv": F.col("arxiv"), "isbn": none, "tags": none, "files": files} | {n: F.lit(None).cast("string") for n in ("edition", "publisher", "series")}
        columns = [c.split()[0] for c in WORK.split(", ")]
        added = durable(new.join(named, "pos").select("pos", "pdf", *(F.col("key") if n == "key" else lit[n].alias(n) if n in lit else F.col(f"record.{n}").alias(n) for n in columns)))

        keys = added.select("pos", F.array("key").alias("keys"))
        outcome = told.join(keys, "pos", "left")
        if known is not None:
            earlier = fresh.filter("match is not null").join(added.select(F.col("pos").alias("match"), F.col("key").alias("_of")), "match").select("pos", F.concat("_of", F.lit(" (this run)")).alias("of"))
            outcome = outcome.join(known.unionByName(earlier), "pos", "left")
        else:
            outcome = outcome.withColumn("of", F.lit(None).cast("string"))
        status = F.when(F.col("keys").isNotNull(), "added").when(F.col("of").isNotNull(), "skipped").otherwise("failed")
        outcome = outcome.select(F.lit(run).alias("run"), F.col("pos").cast("long").alias("pos"), "input", status.alias("status"), F.coalesce("keys", none).alias("keys"), F.coalesce("message", F.concat(F.lit("duplicate of "), "of")).alias("message"))

        changes, schemas = {}, {}
        for name, df, by in (("records", added.select(*columns), "key"), ("runs", outcome, "run")):
            paths = self.store.write(df.withColumn("bucket", bucket_of(F.col(by), self.buckets)).hint("rebalance", "bucket"), name)
            changes[name] = {b: base.tables.get(name, {}).get(b, []) + [[base.number + 1, p]] for b, p in paths.items()}
            schemas[name] = df.schema
        texts = pdfs.groupBy("id").agg(F.min("text").alias("fulltext"))
        docs = lexical_documents(added.join(texts, F.col("pdf") == F.col("id"), "left"))
        of_index = self.index.changed(base, docs, None) if "segment" in base.facts else self.index.built(base, docs)
        version = self.store.commit(base, changes | of_index[0], schemas | of_index[1], of_index[2])
        release(told, added, *(x for x in (known, fresh) if x is not None))
        return self.outcomes(run, version)
