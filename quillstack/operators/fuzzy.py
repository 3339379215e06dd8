"""Fuzzy matching of a query with display lines, by alignment over whole batches.

A query is atoms between blanks, all of which have to match; the score is the sum
of theirs.  An atom's letters have to stand in a line in their order; of all ways
to place them the best counts, found by dynamic programming in numpy, a step for
each letter of the atom over all lines of a batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a matched letter counts, what a gap and each further letter in it cost, what a letter next to the one before
#: counts at least, and how often the first letter's place counts (fixed values, as finders of this kind have them).
MATCH, GAP, GAP_MORE, NEXT, FIRST = 16, 3, 1, 4, 2
#: What a place counts: after white space or at the start, after a delimiter, after another mark, where a capital or a number begins (fixed values).
AFTER_SPACE, AFTER_DELIMITER, AFTER_MARK, AT_CHANGE = 10, 9, 8, 5
DELIMITERS = "/,:;|"
#: Letters of lines that are aligned at once.
CELLS = 1 << 18
_NEVER = -(1 << 29)
_SPACE, _DELIMITER, _MARK, _LOWER, _UPPER, _DIGIT = range(6)


@dataclass(frozen=True)
class Atom:
    """Text, lower-cased; kind fuzzy, within, start, end or whole; whether it must not match; whether marks of letters count."""

    text: str
    kind: str = "fuzzy"
    negated: bool = False
    marked: bool = False


def parse_atoms(query: str) -> list[Atom]:
    """The atoms of a query: ``^`` begins one that stands at the start, ``$`` ends one that stands at the end, ``'`` begins one that stands in one piece, ``!`` one that must not stand there in one piece.

    Letters are compared without case; marks of letters count in atoms that have letters outside ASCII.
    """
    atoms = []
    for word in query.split():
        negated = word.startswith("!") and len(word) > 1
        text = word[1:] if negated else word
        kind = "within" if negated else "fuzzy"
        if text.startswith("^") and len(text) > 1:
            text, kind = text[1:], "start"
        elif text.startswith("'") and len(text) > 1:
            text, kind = text[1:], "within"
        if text.endswith("$") and len(text) > 1:
            text, kind = text[:-1], "whole" if kind == "start" else "end"
        atoms.append(Atom("".join(map(_lower, text)), kind, negated, not text.isascii()))
    return atoms


def _lower(ch: str) -> str:
    low = ch.lower()
    return low if len(low) == 1 else ch


def _plain(ch: str) -> str:
    """A letter without its marks, where that is one letter."""
    base = unicodedata.normalize("NFD", ch)[:1]
    return base if base.isalpha() else ch


def _class(ch: str) -> int:
    if ch.isspace():
        return _SPACE
    if ch in DELIMITERS:
        return _DELIMITER
    if ch.isdigit():
        return _DIGIT
    if ch.isalpha():
        return _UPPER if ch.lower() != ch else _LOWER
    return _MARK


def _bonus(kinds: np.ndarray) -> np.ndarray:
    """What each place counts, by its letter's class and that of the one before it."""
    before = np.full_like(kinds, _SPACE)
    before[:, 1:] = kinds[:, :-1]
    word = kinds >= _LOWER
    out = np.select(
        [word & (before == _SPACE), word & (before == _DELIMITER), word & (before == _MARK), (kinds == _UPPER) & (before == _LOWER), (kinds == _DIGIT) & (before != _DIGIT)],
        [np.int32(x) for x in (AFTER_SPACE, AFTER_DELIMITER, AFTER_MARK, AT_CHANGE, AT_CHANGE)],
        np.int32(0),
    )
    # a mark counts as what begins after it would
    return np.where(word, out, np.where(kinds == _SPACE, np.int32(AFTER_SPACE), np.int32(AFTER_MARK)))


def _align(letters: np.ndarray, bonus: np.ndarray, lengths: np.ndarray, atom: Atom) -> np.ndarray:
    """The best score of an atom in each line; far below zero where it doesn't match."""
    code = [ord(x) for x in atom.text]
    n, width = letters.shape
    places = np.arange(width, dtype=np.int32)
    ended = np.full((n, width), _NEVER, dtype=np.int32)
    for i, c in enumerate(code):
        here = letters == c
        if i == 0:
            if atom.kind in ("start", "whole"):
                here &= places == 0
            ended = np.where(here, MATCH + FIRST * bonus, _NEVER)
            continue
        beside = np.full_like(ended, _NEVER)
        beside[:, 1:] = ended[:, :-1] + np.maximum(bonus[:, 1:], NEXT)
        if atom.kind == "fuzzy" and width > 2:
            # the best of all places two and more before, less what the letters between cost
            far = np.maximum.accumulate(ended + GAP_MORE * places, axis=1)
            gap = far[:, :-2] - GAP - GAP_MORE * (places[2:] - 2)
            beside[:, 2:] = np.maximum(beside[:, 2:], gap + bonus[:, 2:])
        ended = np.where(here, MATCH + beside, _NEVER)
    if atom.kind in ("end", "whole"):
        ended = np.where(places == lengths[:, None] - 1, ended, _NEVER)
    return ended.max(axis=1, initial=_NEVER)


def scores(lines: Iterable[str | None], atoms: list[Atom]) -> np.ndarray:
    """The score of each line, -1 where an atom fails or the line is null; an atom's is 0 at least, and a query without atoms scores 0."""
    lines = list(lines)
    out = np.full(len(lines), -1, dtype=np.int64)
    order = sorted((i for i, x in enumerate(lines) if x is not None), key=lambda i: len(lines[i]))
    at = 0
    while at < len(order):
        # lines of like lengths together; a single longer one is a block of its own
        n = 1
        while at + n < len(order) and (n + 1) * max(len(lines[order[at + n]]), 1) <= CELLS:
            n += 1
        rows = order[at : at + n]
        at += n
        lengths = np.array([len(lines[i]) for i in rows])
        width = int(lengths.max())
        codes = np.zeros((len(rows), width), dtype=np.int32)
        codes[places_of(lengths, width)] = np.frombuffer("".join(lines[i] for i in rows).encode("utf-32-le"), dtype="<u4")
        listed = np.flatnonzero(np.bincount(codes.ravel(), minlength=1))
        told = [chr(x) for x in listed.tolist()]
        inside = places_of(lengths, width)

        def look(f):
            of_code = np.zeros(listed[-1] + 1 if listed.size else 1, dtype=np.int32)
            of_code[listed] = [f(x) for x in told]  # noqa: B023
            return np.where(inside, of_code[codes], np.int32(-1))  # noqa: B023

        low, kinds = look(lambda x: ord(_lower(x))), look(_class)
        plain = look(lambda x: ord(_plain(_lower(x))))
        bonus = _bonus(kinds)
        total, good = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows), dtype=bool)
        for atom in atoms:
            found = _align(low if atom.marked else plain, bonus, lengths, atom) if width else np.full(len(rows), _NEVER)
            hit = found > _NEVER // 2
            good &= ~hit if atom.negated else hit
            total += np.where(hit & (not atom.negated), np.maximum(found, 0), 0)
        out[rows] = np.where(good, total, -1)
    return out


def places_of(lengths: np.ndarray, width: int) -> np.ndarray:
    """Which cells of padded rows hold letters."""
    return np.arange(width) < lengths[:, None]


def fuzzy_score(query: str, c: Column) -> Column:
    """How well a query fits a line: null where it doesn't. (pandas: an alignment over batches in numpy.)"""
    atoms = parse_atoms(query)

    @F.pandas_udf(T.LongType())
    def run(lines: pd.Series) -> pd.Series:
        found = pd.Series(scores([None if x is None else str(x) for x in lines], atoms), dtype="Int64")
        return found.where(found >= 0)

    return run(c)
