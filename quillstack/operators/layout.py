"""Documents of layout blocks as passages.

The tree of a document is walked in Python, per document, since it is a matter
of following references; folding blocks into passages works on any table of
blocks, as a scan of sorted runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math import normalise_math
from ..functions.text import trim_space
from ..plans.durable import durable, release
from ..sources.store import Store, bucket_of

#: Characters a passage aims at, and what joining a block is reckoned at (fixed values).
PASSAGE_CHARS, JOIN_CHARS = 1800, 8

BLOCKS = "doc string, ord int, label string, text string, page long, level long"
PASSAGES = "doc string, chunk_index int, text string, headings array<string>, page_numbers array<long>, labels array<string>"


def _resolve(tree: dict, ref: str):
    if not ref.startswith("#/"):
        raise ValueError(f"a reference starts with #/: {ref}")
    node = tree
    for step in ref[2:].split("/"):
        try:
            node = node[int(step)] if isinstance(node, list) else node[step.replace("~1", "/").replace("~0", "~")]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ValueError(f"a reference leads nowhere: {ref}") from None
    return node


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else None


def walk(tree: dict) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(label, text, page, level) of a document's texts in reading order; label ``furniture`` for what is not of the body."""
    if tree.get("schema_name") != "DoclingDocument" or not isinstance(tree.get("body", {}).get("children"), list):
        raise ValueError("not a layout document")
    todo = []
    for child in reversed(tree["body"]["children"]):
        if not isinstance(child, dict) or not isinstance(child.get("$ref"), str):
            raise ValueError("a child of the body has no reference")
        todo.append(child["$ref"])
    seen = set()
    while todo:
        ref = todo.pop()
        if ref in seen:
            continue
        seen.add(ref)
        if ref.startswith("#/pictures/"):
            continue
        node = _resolve(tree, ref)
        if ref.startswith("#/texts/"):
            if node.get("content_layer", "body") != "body":
                yield "furniture", "", None, None
            elif (label := node.get("label", "text")) not in ("page_header", "page_footer"):
                text = node["text"] if "text" in node else node.get("orig")
                if isinstance(text, str) and text.strip():
                    first = (node.get("prov") or [{}])[0]
                    yield label, text.strip(), _whole(first.get("page_no")), _whole(node.get("level"))
        else:
            todo.extend(c["$ref"] for c in reversed(node.get("children") or []) if isinstance(c, dict) and isinstance(c.get("$ref"), str))


def layout_blocks(documents: DataFrame, doc: str = "doc", content: str = "content") -> DataFrame:
    """Blocks of layout documents given as JSON, and (label ``error``) why one can't be read.

    Texts other than formulas have their mathematics normalised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, body in zip(batch[doc], batch[content], strict=True):
                try:
                    rows.extend((name, i, *b) for i, b in enumerate(walk(json.loads(body))))
                except (ValueError, TypeError, AttributeError) as e:
                    rows.append((name, 0, "error", str(e), None, None))
            out = pd.DataFrame(rows, columns=["doc", "ord", "label", "text", "page", "level"])
            yield out.astype({"page": "Int64", "level": "Int64", "ord": "int32"})

    blocks = documents.select(F.col(doc).cast("string").alias(doc), F.col(content).cast("string").alias(content)).mapInPandas(run, BLOCKS)
    return blocks.withColumn("text", F.when(F.col("label").isin("formula", "error", "furniture"), F.col("text")).otherwise(normalise_math(F.col("text"))))


def rendered(label: str, text: str) -> str:
    shapes = {"formula": "\\[\n{}\n\\]", "code": "```\n{}\n```", "list_item": "- {}"}
    return shapes.get(label, "{}").replace("{}", text)


class Fold:
    """Blocks of one document after another in, passages (text, headings, pages, labels) out; holds one passage and the headings above it.

    A section header ends a passage and takes the place of the headings from its
    level on.  A block that would take a passage over ``most`` starts the next
    one; a formula never does.
    """

    def __init__(self, most: int = PASSAGE_CHARS):
        self.most = most
        self.path: list[str] = []
        self._begin()

    def _begin(self) -> None:
        self.parts, self.pages, self.labels, self.size = [], set(), set(), 0

    def close(self) -> Iterator[tuple[str, list[str], list[int], list[str]]]:
        """The passage so far, if it has text."""
        text = "\n\n".join(self.parts).strip()
        if text:
            yield text, list(self.path), sorted(self.pages), sorted(self.labels)
        self._begin()

    def add(self, label: str, text: str, page: int | None, level: int | None) -> Iterator[tuple[str, list[str], list[int], list[str]]]:
        if label == "section_header":
            yield from self.close()
            self.path = [*self.path[: max(level or 1, 1) - 1], text]
            return
        if self.parts and label != "formula" and self.size + len(text) + JOIN_CHARS > self.most:
            yield from self.close()
        shown = rendered(label, text)
        self.size += len(shown) + 2 * bool(self.parts)
        self.parts.append(shown)
        self.labels.add(label)
        if page is not None:
            self.pages.add(page)


def fold_blocks(blocks: list[tuple[str, str, int | None, int | None]], most: int = PASSAGE_CHARS) -> list[tuple[str, list[str], list[int], list[str]]]:
    """(text, headings, pages, labels) of the passages that one document's blocks make."""
    fold = Fold(most)
    return [*(p for b in blocks for p in fold.add(*b)), *fold.close()]


def fold_passages(blocks: DataFrame, most: int = PASSAGE_CHARS) -> DataFrame:
    """Passages of tables of blocks: one sort by document and place, then a scan of the sorted runs.

    A task holds one passage and its headings between batches, however long a
    document is; documents are not gathered.  A document's headings depend on all
    blocks before, so it is not divided among tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, fold, n = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for name, *block in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if fold is None or name != doc:
                    if fold is not None:
                        out += [(doc, n, *p) for p in fold.close()]
                    doc, fold, n = name, Fold(most), 0
                for p in fold.add(*block):
                    out.append((doc, n, *p))
                    n += 1
            if out:
                yield _passage_rows(out)
        if fold is not None:
            yield _passage_rows([(doc, n, *p) for p in fold.close()])

    kept = blocks.filter(~F.col("label").isin("furniture", "error")).select("doc", "ord", "label", "text", "page", "level")
    dealt = kept.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc").sortWithinPartitions("doc", "ord")
    return dealt.select("doc", "label", "text", "page", "level").mapInArrow(run, PASSAGES)


def _passage_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc": pa.string(), "chunk_index": pa.int32(), "text": pa.string(), "headings": pa.list_(pa.string()), "page_numbers": pa.list_(pa.int64()), "labels": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def import_report(blocks: DataFrame, passages: DataFrame) -> DataFrame:
    """Per document: passages, body_blocks, formulas, pages that its passages stand on, skipped_furniture, and what is wrong with it."""
    body = ~F.col("label").isin("furniture", "error", "section_header")
    counts = blocks.groupBy("doc").agg(
        F.count_if(body).alias("body_blocks"),
        F.count_if(F.col("label") == "formula").alias("formulas"),
        F.count_if(F.col("label") == "furniture").alias("skipped_furniture"),
        F.min(F.when(F.col("label") == "error", F.col("text"))).alias("error"),
    )
    folded = passages.select("doc", "chunk_index", F.explode_outer("page_numbers").alias("page")).groupBy("doc").agg(F.countDistinct("chunk_index").alias("passages"), F.countDistinct("page").alias("pages"))
    report = counts.join(folded, "doc", "left").na.fill(0, ["passages", "pages"])
    return report.withColumn("error", F.coalesce("error", F.when(F.col("passages") == 0, "the document has no body text to index")))


class Layouts:
    """Imported layout documents and their passages, in one store below a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.buckets, self.store = spark, buckets, Store(spark, root)

    def read(self, name: str) -> DataFrame:
        """``documents`` (doc, content) or ``passages`` as ``fold_passages`` gives them."""
        version = self.store.latest()
        return self.store.read(version, name) if name in version.schemas else self.spark.createDataFrame([], {"documents": "doc string, content string", "passages": PASSAGES}[name])

    def add(self, documents: DataFrame, most: int = PASSAGE_CHARS) -> DataFrame:
        """Puts documents (doc, content) and their passages in the place of what is held of them, in one commit, and returns the report.

        One that can't be read or has no text is reported and not put in; what is
        held of it stays.  Of several rows of a document the least counts.
        """
        base = self.store.latest()
        documents = durable(documents.groupBy("doc").agg(F.min("content").alias("content")))
        blocks = durable(layout_blocks(documents))
        passages = durable(fold_passages(blocks, most))
        report = durable(import_report(blocks, passages))
        good = report.filter("error is null").select("doc")
        bucket = bucket_of(F.col("doc"), self.buckets)
        touched = [r[0] for r in good.select(bucket).distinct().collect()]
        changes, schemas = {}, {}
        for name, fresh in (("documents", documents), ("passages", passages)):
            schemas[name] = fresh.schema
            old = self.store.read(base, name, touched) if name in base.schemas else fresh.limit(0)
            rows = old.join(good, "doc", "left_anti").unionByName(fresh.join(good, "doc", "left_semi"))
            paths = self.store.write(rows.withColumn("bucket", bucket).hint("rebalance", "bucket"), name)
            changes[name] = {b: [[base.number + 1, p]] for b, p in paths.items()}
        self.store.commit(base, changes, schemas, {})
        release(documents, blocks, passages)
        return report


def paragraph_blocks(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """Blocks of plain texts: each line that isn't blank, headers by a leading #, items by a dash."""
    lines = documents.select(F.col(doc).cast("string").alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("ord", "line")).withColumn("line", trim_space(F.col("line"))).filter("line != ''")
    mark = F.regexp_extract("line", "^(#+) ", 1)
    label = F.when(mark != "", "section_header").when(F.col("line").startswith("- "), "list_item").otherwise("text")
    return lines.select("doc", "ord", label.alias("label"), F.regexp_replace("line", "^(?:#+|-) ", "").alias("text"), F.lit(None).cast("long").alias("page"), F.when(mark != "", F.length(mark).cast("long")).alias("level"))
