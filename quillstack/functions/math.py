"""Columns over formulas and the mathematics inside running text."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trim_space

#: Characters that have a subscript form, and their forms in the same order (fixed values).
SUBSCRIPT_FROM = "0123456789aehijklmnoprstuvx-"
SUBSCRIPT_TO = "₀₁₂₃₄₅₆₇₈₉ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ₋"
#: Letters that stand for sets of numbers, and their signs (fixed values).
NUMBER_SETS = {"N": "ℕ", "Q": "ℚ", "R": "ℝ", "Z": "ℤ"}

_SUBSCRIPT = str.maketrans(SUBSCRIPT_FROM, SUBSCRIPT_TO)
_INDEXED = re.compile(r"\b(?P<base>[A-Za-z])(?P<index>(?:\s+(?:[0-9]+|[aehijklmnoprstuvx])\b)+(?:\s*-\s*[0-9]+)?)")
_ROMAN = frozenset("ivx")


def _subscripted(text: str) -> str:
    def one(m: re.Match) -> str:
        base, index = m["base"], "".join(m["index"].split())
        before, _, minus = index.partition("-")
        in_brackets = text[: m.start()].rstrip().endswith("(") and text[m.end() :].lstrip().startswith(")")
        counts = in_brackets and {base, *index} <= _ROMAN
        subtracts = bool(minus) and before.isdigit()
        return m[0] if counts or subtracts else base + index.translate(_SUBSCRIPT)

    return _INDEXED.sub(one, text)


@F.pandas_udf(T.StringType())
def subscript_indices(text: pd.Series) -> pd.Series:
    """x 1 as x₁; (i i) in an enumeration and a 1 - 2 stay. (pandas: each match depends on what stands around it.)"""
    return text.map(lambda t: None if t is None else _subscripted(t))


def subscript(c: Column) -> Column:
    """Every character that has a subscript form in that form."""
    return F.translate(c, SUBSCRIPT_FROM, SUBSCRIPT_TO)


def tidy_notation(c: Column) -> Column:
    """Spacing inside |x|, brackets and before punctuation put right, and number sets by their signs."""
    c = F.regexp_replace(c, r"(?U)\|\s*([^|\n]+?)\s*\|", "|$1|")
    c = F.regexp_replace(c, r"(?U)([(\[{])\s+", "$1")
    c = F.regexp_replace(c, r"(?U)\s+([)\]}])", "$1")
    c = F.regexp_replace(c, r"(?U)\s+([,.;:])", "$1")
    c = F.regexp_replace(c, r",(?U:\s*)([A-Za-z\-+])", ", $1")
    for letter, sign in NUMBER_SETS.items():
        c = F.regexp_replace(c, rf"(?U)\b{letter}\b", sign)
    return c


def normalise_math(c: Column) -> Column:
    return tidy_notation(subscript_indices(c))


def _is_open(line: Column) -> Column:
    return line.isin("\\[", "$$")


def _is_close(line: Column) -> Column:
    return line.isin("\\]", "$$")


def display_blocks(c: Column) -> Column:
    """array<struct<kind,text>>: lines of text and of display formulas, in order.

    A formula stands between a line \\[ or $$ and a line \\] or $$, in any
    combination.  One that is never closed comes back as text behind \\[.
    """
    lines = F.split(c, "\r?\n")
    start = F.struct(
        F.lit(False).alias("inside"),
        F.array().cast("array<string>").alias("held"),
        F.array().cast("array<struct<kind:string,text:string>>").alias("out"),
    )
    block = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    none = F.array().cast("array<struct<kind:string,text:string>>")

    def joined(kind: str, held: Column) -> Column:
        text = trim_space(F.array_join(held, "\n"))
        return F.when(text != "", block(kind, text)).otherwise(none)

    def step(acc: Column, line: Column) -> Column:
        mark = trim_space(line)
        opens, closes = ~acc["inside"] & _is_open(mark), acc["inside"] & _is_close(mark)
        turn = opens | closes
        return F.struct(
            F.when(turn, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"),
            F.when(turn, F.array().cast("array<string>")).otherwise(F.concat(acc["held"], F.array(line))).alias("held"),
            F.when(opens, F.concat(acc["out"], joined("text", acc["held"]))).when(closes, F.concat(acc["out"], joined("formula", acc["held"]))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        open_end = joined("text", F.concat(F.array(F.lit("\\[")), acc["held"]))
        return F.concat(acc["out"], F.when(acc["inside"], open_end).otherwise(joined("text", acc["held"])))

    return F.aggregate(lines, start, step, finish)


def display_formulas(c: Column) -> Column:
    """The display formulas of a text, trimmed; unclosed and empty ones left out."""
    return F.transform(F.filter(display_blocks(c), lambda b: b["kind"] == "formula"), lambda b: b["text"])


def without_headings(c: Column, headings: Column) -> Column:
    """The text without leading lines that repeat a heading, and without blank lines after these; case counts for nothing in ASCII letters."""
    lines = F.split(F.regexp_replace(c, "\r?\n$", ""), "\r?\n")
    plain = lambda line: F.translate(trim_space(line), ascii_uppercase, ascii_lowercase)
    known = F.transform(headings, plain)
    # headings first (state 0), blank lines then (1), the rest from there (2)
    dropped = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("state")),
        lambda a, line: F.when((a["state"] == 0) & F.array_contains(known, plain(line)), F.struct((a["n"] + 1).alias("n"), F.lit(0).alias("state")))
        .when((a["state"] < 2) & (plain(line) == ""), F.struct((a["n"] + 1).alias("n"), F.lit(1).alias("state")))
        .otherwise(F.struct(a["n"].alias("n"), F.lit(2).alias("state"))),
        lambda a: a["n"],
    )
    return F.array_join(F.slice(lines, dropped + 1, F.greatest(F.size(lines) - dropped, F.lit(0))), "\n")


def pixel_crop(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, ppi: Column, pad: float = 1.0) -> Column:
    """struct(x, y, width, height): a box in points from the lower left as pixels from the upper left; null where box or page is empty.

    The corner is rounded down, width and height are rounded up, each for itself, to 1 at least.
    """
    scale = ppi / 72.0
    x0, y0 = F.greatest(left - pad, F.lit(0.0)), F.greatest(height - top - pad, F.lit(0.0))
    x1, y1 = F.least(right + pad, width), F.least(height - bottom + pad, height)
    extent = lambda a, b: F.greatest(F.ceil((b - a) * scale), F.lit(1))
    crop = F.struct(F.floor(x0 * scale).alias("x"), F.floor(y0 * scale).alias("y"), extent(x0, x1).alias("width"), extent(y0, y1).alias("height"))
    return F.when((width > 0) & (height > 0) & (right > left) & (top > bottom), crop)


def ink_coverage(r: Column, g: Column, b: Column) -> Column:
    """How dark a pixel is, 0 to 255."""
    return F.lit(255) - F.floor((r * 77 + g * 150 + b * 29 + 128) / 256)


def emphasise(coverage: Column) -> Column:
    return F.least(F.ceil(coverage * 5 / 4), F.lit(255))


def blend(front: Column, back: Column, coverage: Column) -> Column:
    return F.floor((front * coverage + back * (255 - coverage)) / 255)


def cell_size(width: Column, height: Column, most_columns: Column, most_rows: Column, cell_width: int = 8, cell_height: int = 16) -> Column:
    """struct(columns, rows): the cells an image takes at its own proportions, within the given room."""
    columns, rows = F.greatest(F.ceil(width / cell_width), F.lit(1)), F.greatest(F.ceil(height / cell_height), F.lit(1))
    scale = F.least(F.lit(1.0), most_columns / columns, most_rows / rows)
    return F.struct(F.greatest(F.ceil(columns * scale), F.lit(1)).alias("columns"), F.greatest(F.ceil(rows * scale), F.lit(1)).alias("rows"))


