import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillstack.llm import alignment
from quillstack.llm.bpe import Vocabulary

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """Rows of texts as the contract has them, each text tokenized whole."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    pieces = Vocabulary(A).pieces
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]

    def run(texts):
        docs = []
        for t in texts:
            x = a.encode(" " + t, add_special_tokens=False).ids if t else []
            y = b.encode(t) if t else []
            raw = (" " + t).encode() if t else b""
            if b"".join(pieces[i] for i in x) != raw or b"".join(of_b[i] for i in y) != raw:
                x, y = [], []
            groups, i, j = [], 0, 0
            while i < len(x):
                g, h = [x[i]], [y[j]]
                m, n = len(pieces[x[i]]), len(of_b[y[j]])
                i, j = i + 1, j + 1
                while m != n:
                    if m < n:
                        g.append(x[i])
                        m, i = m + len(pieces[x[i]]), i + 1
                    else:
                        h.append(y[j])
                        n, j = n + len(of_b[y[j]]), j + 1
                groups.append((g, h))
            docs.append((len(x), len(y), groups, Counter((p, q) for g, h in groups for p in g for q in h)))
        count = Counter(pair for d in docs for pair in d[3])
        highest = {}
        for (p, _), n in count.items():
            highest[p] = max(highest.get(p, 0), n)
        out = []
        for n_a, n_b, groups, links in docs:
            told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
            best = sum(m for (p, q), m in links.items() if count[p, q] == highest[p])
            out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(m * count[x] for x, m in links.items()), hashlib.sha256(told.encode()).hexdigest() if groups else ""))
        return out

    return run


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [" ", "  two  blanks ", " leading", "trailing ", "a▁b", "c ▁ d", "<s> </s> <unk> <0x41>", "x<|endoftext|>y <|endoftext|> z", "tab\tnew\nline \n x", "it's we'll ’s", "日本語 の text", "\U0001f600\U0001f600 \U0001f469‍\U0001f469‍\U0001f467", "a b 　 c\x1c d \x00e", "é ﬁ Å", "1234567890 " * 30, "éüЖ中" * 200, "▁", "=" * 700]


def test_edges(spark, brute, edge_rows, nothing):
    texts = [r[1] for r in edge_rows] + ODD
    rows = [(i, t, *r[2:]) for i, (t, r) in enumerate(zip(texts, edge_rows + [edge_rows[0]] * len(ODD), strict=True))]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(spark.createDataFrame(rows, nothing.schema).repartition(3)).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) > 4
    assert alignment.align(nothing).count() == 0


def test_keys_of_any_kind(spark, brute):
    texts = ["one two", "one two", "three"]
    df = spark.createDataFrame(list(zip([None, "k", "k"], texts, strict=True)), "name string, body string").selectExpr("*", "1 as row", "2 as pair", "3 as links", "4 as text")
    got = alignment.align(df, key="name", text="body")
    assert got.columns[0] == "name"
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(brute(texts))


def test_documents(spark, brute):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs.repartition(5)).collect()}
    assert got == dict(zip([r[0] for r in rows], brute([r[1] for r in rows]), strict=True))


def test_small_blocks_and_a_short_memory_change_nothing(brute, monkeypatch):
    al = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "WIDE", 4)
    texts = ["one two three four", "éüЖ中" * 5 + " end", "five one two", "=" * 90 + " one"]
    want = brute(texts)
    for _ in range(2):
        for t, w in zip(texts, want, strict=True):
            columns, (pair, _, links) = alignment._block(al, [t])
            assert tuple(columns[c][0] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == (*w[:4], w[6])
            assert links.sum() == w[3]
            assert pair.size == len(set(pair.tolist()))
