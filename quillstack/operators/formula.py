"""Formulas and where they stand on their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.math import display_formulas
from ..functions.text import trim_space

_DOCUMENT = (
    "struct<pages:map<string,struct<size:struct<width:double,height:double>>>,"
    "texts:array<struct<label:string,text:string,prov:array<struct<page_no:bigint,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>>>>"
)


def _finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok


def formula_catalogue(documents: DataFrame, doc: str = "doc", content: str = "content") -> DataFrame:
    """(doc, ord, text, page, l, t, r, b, page_width, page_height) of the formulas whose place is fully known."""
    parsed = documents.select(F.col(doc).alias("doc"), F.from_json(F.col(content).cast("string"), _DOCUMENT).alias("d"))
    texts = parsed.select("doc", "d.pages", F.posexplode("d.texts").alias("ord", "x")).filter("x.label = 'formula'")
    first = F.get(F.col("x.prov"), F.lit(0))
    rows = texts.select("doc", "ord", trim_space(F.col("x.text")).alias("text"), first["page_no"].alias("page"), first["bbox"].alias("box"), F.element_at("pages", first["page_no"].cast("string"))["size"].alias("size"))
    rows = rows.filter("text != '' and box.coord_origin = 'BOTTOMLEFT'")
    out = rows.select("doc", "ord", "text", "page", "box.l", "box.t", "box.r", "box.b", F.col("size.width").alias("page_width"), F.col("size.height").alias("page_height"))
    return out.filter(_finite(*(F.col(c) for c in ("l", "t", "r", "b", "page_width", "page_height"))))


def locate_formulas(hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Formulas in hits (id, doc, text, pages) with their place: the k-th of a text in a hit is the k-th of the catalogue's on its pages."""
    found = hits.select("id", "doc", "pages", F.posexplode(display_formulas(F.col("text"))).alias("ord", "text"))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("id", "text").orderBy("ord")))
    known = catalogue.select("doc", "text", "page", F.col("ord").alias("place"), "l", "t", "r", "b", "page_width", "page_height")
    on_page = (F.size("pages") == 0) | F.array_contains("pages", F.col("page"))
    per_hit = found.select("id", "doc", "text", "pages").distinct().join(known, ["doc", "text"]).filter(on_page)
    per_hit = per_hit.withColumn("nth", F.row_number().over(Window.partitionBy("id", "text").orderBy("place"))).drop("pages", "doc")
    return found.drop("pages").join(per_hit, ["id", "text", "nth"], "left")
