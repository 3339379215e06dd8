import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from quillstack.llm import bpe, bpe_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_split_like_the_pattern():
    """Every code point below U+0250, alone and between others, in the fast pattern and the full one."""
    texts = [chr(i) for i in range(0x250)] + [f"a{chr(i)} {chr(i)}{chr(i)}1 {chr(i)}" for i in range(0x250)]
    assert all(bpe._LATIN.findall(t) == bpe._SPLIT.findall(t) for t in texts)
    assert all("".join(bpe._SPLIT.findall(t)) == t for t in texts)
    assert regex.compile(public_tokenizers.PATTERN).findall("it's  ok\n\n 12") == bpe._LATIN.findall("it's  ok\n\n 12")


def test_counts(spark, library, edge, edge_rows, nothing):
    got = bpe.token_counts(edge).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 512)
    assert bpe.token_counts(nothing).count() == 0


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = ["a b c d e f g h", "one two three four five six", "a b " + "z" * 200]
    counter = bpe.Counter(bpe.vocabulary(PATH))
    assert [n for t in texts for n in counter.counts([t])] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def check_codec(rows, texts, library):
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == digest(np.array(ids, dtype="<u4").tobytes())
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False).encode())


def test_codec_edges(spark, library, edge_rows, nothing):
    rows = [(i, *r[1:]) for i, r in enumerate(edge_rows)]
    df = spark.createDataFrame(rows, nothing.schema).repartition(3)
    texts = {r[0]: r[1] for r in rows}
    check_codec(bpe_codec.round_trip(df).collect(), texts, library)
    assert bpe_codec.round_trip(nothing).count() == 0
    encoded = bpe_codec.encode(df)
    back = bpe_codec.decode_rows(encoded.drop("text"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: v or "" for k, v in texts.items()}


def test_codec_and_counts_on_documents(spark, library):
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    texts = dict(docs.collect())
    check_codec(bpe_codec.round_trip(docs).collect(), texts, library)
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(docs).collect()} == {k: len(library.encode(v, add_special_tokens=False).ids) for k, v in texts.items()}
