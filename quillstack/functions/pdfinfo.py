"""Title and author of PDF files, out of their information dictionary."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_authors

_REF = rb"(\d+)\s+(\d+)\s+R"
_INFO = re.compile(rb"/Info\s+" + _REF)
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _dictionary(data: bytes, at: int) -> bytes:
    """The bytes of the dictionary that begins at a place, strings in it passed over; empty where none does."""
    begin = re.compile(rb"\s*<<").match(data, at)
    if not begin:
        return b""
    depth, i = 1, begin.end()
    while i < len(data) and depth:
        two = data[i : i + 2]
        if two == b"<<" or two == b">>":
            depth += 1 if two == b"<<" else -1
            i += 2
        elif data[i : i + 1] == b"(":
            i = _literal(data, i)[1]
        else:
            i += 1
    return data[begin.end() : i - 2] if not depth else b""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins with the parenthesis at a place, and where it has ended."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                i = octal.end()
                continue
            after = data[i + 1 : i + 2]
            if after in (b"\n", b"\r"):
                i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                continue
            out += _ESCAPES.get(after, after)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def _entry(dictionary: bytes, name: bytes) -> str | None:
    """A string of a dictionary, trimmed; null where it is blank or no string."""
    i = 0
    while i < len(dictionary):
        if dictionary[i : i + 1] == b"(":
            i = _literal(dictionary, i)[1]
        elif re.compile(rb"/" + name + rb"(?![A-Za-z0-9_.\-])").match(dictionary, i):
            value = re.compile(rb"\s*").match(dictionary, i + 1 + len(name)).end()
            if dictionary[value : value + 1] == b"(":
                raw = _literal(dictionary, value)[0]
            else:
                found = re.compile(rb"<([0-9A-Fa-f\s]*)>").match(dictionary, value)
                if not found:
                    return None
                digits = re.sub(rb"\s", b"", found[1])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            text = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
            return text.strip() or None
        else:
            i += 1
    return None


def _stream(data: bytes, at: int, dictionary: bytes) -> bytes:
    """The decoded stream behind a dictionary; empty where it can't be decoded."""
    begin = _STREAM.search(data, at)
    if not begin:
        return b""
    if b"/FlateDecode" not in dictionary:
        return data[begin.end() : data.find(b"endstream", begin.end())]
    try:
        return zlib.decompressobj().decompress(data[begin.end() :])
    except zlib.error:
        return b""


def _trailers(data: bytes) -> Iterator[bytes]:
    """Dictionaries that may name the information dictionary: the one that the file's end points to, then others, the last first."""
    end = list(re.finditer(rb"startxref\s+(\d+)", data))
    if end and int(end[-1][1]) < len(data):
        at = int(end[-1][1])
        own = _OBJECT.match(data, at)
        found = data.find(b"trailer", at) if not own else -1
        yield _dictionary(data, own.end()) if own else _dictionary(data, found + 7) if found >= 0 else b""
    for m in reversed(list(re.finditer(rb"\btrailer\b", data))):
        yield _dictionary(data, m.end())
    for m in reversed(list(_OBJECT.finditer(data))):
        found = _dictionary(data, m.end())
        if re.search(rb"/Type\s*/XRef\b", found):
            yield found


def pdf_info(data: bytes | None) -> tuple[str | None, str | None]:
    """(title, author) of a PDF file, null where it has none or can't be read."""
    if not data or b"%PDF-" not in data[:1024]:
        return None, None
    named = next((m for m in map(_INFO.search, _trailers(data)) if m), None)
    if not named:
        return None, None
    number = int(named[1])
    # of several objects of a number the last is in force
    last = None
    for m in _OBJECT.finditer(data):
        if int(m[1]) == number:
            last = m
    info = _dictionary(data, last.end()) if last else b""
    if not last:
        # newer files keep objects in compressed streams: a head of numbers and places, then the objects
        for m in _OBJECT.finditer(data):
            d = _dictionary(data, m.end())
            if not re.search(rb"/Type\s*/ObjStm", d):
                continue
            body, first = _stream(data, m.end(), d), re.search(rb"/First\s+(\d+)", d)
            if not first:
                continue
            head = [int(x) for x in re.findall(rb"\d+", body[: int(first[1])])]
            for n, at in zip(head[::2], head[1::2], strict=False):
                if n == number:
                    info = _dictionary(body, int(first[1]) + at)
    return _entry(info, b"Title"), _entry(info, b"Author")


def pdf_record(name: Column, content: Column) -> Column:
    """struct(title, authors) of a PDF: what it says of itself, else its file's name without the ending, and no authors.

    (pandas: a file's objects are found by reading it.)
    """

    @F.pandas_udf("title string, author string")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pdf_info(None if c is None else bytes(c)) for c in contents], columns=["title", "author"], dtype=object)

    said = run(content)
    stem = F.regexp_extract(F.regexp_replace(name, r"^.*/", ""), r"^(.+?)(?:\.[^.]*)?$", 1)
    authors = F.when(said["author"].isNotNull(), split_authors(said["author"])).otherwise(F.array().cast("array<string>"))
    return F.struct(F.coalesce(said["title"], stem).alias("title"), authors.alias("authors"))
