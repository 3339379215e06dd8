import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillstack.operators import catalogue, components, duplicates, edits, export, formula, incremental, layout, lexical, quality, vectors

WORK = (
    "key string, kind string, title string, authors array<string>, year int, doi string, arxiv string, journal string, edition string, "
    "publisher string, series string, isbn array<string>, tags array<string>, files array<string>, abstract string, has_pdf boolean, fulltext string"
)


def work(key, **over):
    base = {"kind": "paper", "title": f"Title {key}", "authors": ["Ada Quill"], "year": 2000, "isbn": [], "tags": [], "files": [], "has_pdf": False}
    values = base | over
    return tuple({"key": key, **values}.get(c.split()[0]) for c in WORK.split(", "))


@pytest.fixture
def works(spark):
    return lambda *rows: spark.createDataFrame(list(rows), WORK)


def keys(df):
    return [r["key"] for r in df.collect()]


def test_listing(works):
    w = works(work("b", tags=["ML", "Vision"], authors=["Bo Stack"]), work("a", doi="10.1/X", tags=["nlp"]), work("c", abstract="hidden", year=1999))
    assert keys(catalogue.list_works(w)) == ["a", "b", "c"]
    assert keys(catalogue.list_works(w, "STACK")) == ["b"]
    assert keys(catalogue.list_works(w, "hidden")) == keys(catalogue.list_works(w, "1999")) == []
    assert keys(catalogue.list_works(w, "a title a")) == ["a"]  # over the border of two fields
    assert keys(catalogue.list_works(w, tags=["ml", "NLP"])) == ["a", "b"]
    assert keys(catalogue.with_any_tag(w, ["ml"])) == []
    assert keys(catalogue.list_works(w, limit=0)) == []
    assert keys(catalogue.show(w, "a")) == ["a"]
    for bad in ("../a", "/a", "..", ""):
        with pytest.raises(ValueError):
            catalogue.show(w, bad)
    with pytest.raises(KeyError):
        catalogue.show(w, "z")


def test_sorts(works):
    w = works(work("a", year=None, authors=[]), work("b", year=2001, authors=["Zed, A"]), work("c", year=0, authors=["Ada Mann"]), work("d", year=2001, title="a title"))
    order = lambda by, **k: keys(catalogue.sort_works(w, by, **k))
    assert order("name") == ["a", "b", "c", "d"]
    assert order("year") == ["b", "d", "a", "c"]
    assert order("year", reverse=True) == ["a", "c", "b", "d"]
    assert order("author") == ["a", "c", "d", "b"]
    assert order("title")[0] == "d"
    ranks = {r["key"]: r["rank"] for r in catalogue.ranked_by(w, "year").collect()}
    assert ranks == {"b": 1, "d": 2, "a": 3, "c": 4}


def test_facets_and_pages(works):
    w = works(work("a", tags=["x", "x", "y"]), work("b"))
    assert {(r["tag"], r["n"]) for r in catalogue.tag_facet(w).collect()} == {("x", 2), ("y", 1), ("(all)", 2)}
    assert catalogue.page_bounds(5, 3, 2) == (2, 5, None)
    assert catalogue.page_bounds(5, 5, 2) == (0, 5, None)
    assert catalogue.page_bounds(5, 0, 2) == (2, 2, 2)
    for bad in ((5, 6, 1), (5, 0, 0)):
        with pytest.raises(ValueError):
            catalogue.page_bounds(*bad)
    assert catalogue.page_limit(5, 5, None, True) == 1
    with pytest.raises(ValueError):
        catalogue.page_limit(5, 0, 2, True)
    assert [r["score"] is not None for r in catalogue.fuzzy_filter(w, "tta", F.col("title")).collect()] == [True]


def test_key_collisions(works):
    w = works(work("a"), work("b"), work("c"))
    got = {r["key"]: r["final_key"] for r in catalogue.final_keys(w, F.lit("base"), works(work("base"))).collect()}
    assert got == {"a": "base-2", "b": "base-3", "c": "base-4"}
    there = works(*(work(k) for k in ("base-3", "base-02", "base-2-1984", "basement")))
    got = {r["key"]: r["final_key"] for r in catalogue.final_keys(w, F.lit("base"), there).collect()}
    assert got == {"a": "base", "b": "base-2", "c": "base-4"}
    own = F.when(F.col("key") == "c", "base-2").otherwise("base")
    got = {r["key"]: r["final_key"] for r in catalogue.final_keys(w, own).collect()}
    assert got == {"a": "base", "b": "base-2", "c": "base-2-2"}


def test_components(spark):
    import random

    random.seed(3)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 4)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs if None not in p for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs if None not in p)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_duplicates(works):
    w = works(
        work("a", title="Same ", doi="10.1/A"), work("b", title="same", doi="10.1/b", files=["b.pdf"], has_pdf=True), work("c", title="Other", doi="10.1/B", has_pdf=True, files=["c.pdf"]),
        work("d", title=" "), work("e", title=""),
    )
    groups = duplicates.duplicate_groups(w)
    assert {(r["group_id"], r["key"]) for r in groups.collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    described = duplicates.describe_groups(groups, w)
    assert keys(described.filter("recommended")) == ["c"]  # of equal rank the last
    kept, gone = duplicates.split_trash(w, described)
    assert sorted(keys(kept)) == ["c", "d", "e"]
    assert sorted(keys(gone)) == ["a", "b"]
    there = w.sparkSession.createDataFrame([("a",), ("a-2",), ("b-1",), ("c-17",)], "trash_key string")
    _, gone = duplicates.split_trash(w, described, there)
    assert {r["key"]: r["trash_key"] for r in gone.filter("key is not null").collect()} == {"a": "a-1", "b": "b"}
    _, gone = duplicates.split_trash(w, described, there.filter("trash_key = 'b-1'"))
    assert {r["key"]: r["trash_key"] for r in gone.filter("key is not null").collect()} == {"a": "a", "b": "b"}
    assert duplicates.duplicate_groups(kept).count() == 0
    asked = works(work("n1", title="OTHER", doi="10.1/a"), work("n2", title="new"), work("n3", title="other", doi=None))
    got = {r["candidate"]: (r["match"], r["reason"]) for r in duplicates.probe(asked, w).collect()}
    assert got == {"n1": ("a", "doi"), "n3": ("c", "title")}
    assert sorted(keys(duplicates.without_duplicates(asked, w))) == ["n2"]


def test_quality(works, spark):
    w = works(work("a", title="", authors=[], year=None, files=["x.pdf", "y.pdf"]), work("b", year=0), work("c", kind="book", publisher="P", files=["c.pdf"]))
    listing = spark.createDataFrame([("a", "y.pdf", False), ("a", "tmp1.pdf", True), ("c", "c.pdf", True)], "key string, name string, is_pdf boolean")
    issues = [r["issue"] for r in quality.validation_issues(w, listing).orderBy("key", "ord").collect()]
    assert issues == ["missing title: a", "missing authors: a", "missing year: a", "listed but missing: a/x.pdf", "not a PDF: a/y.pdf", "temp name: a/tmp1.pdf", "no PDF: b"]
    plan = quality.fix_plan(w, listing)
    assert {(r["key"], r["action"], r["old"], r["new"]) for r in plan.collect()} == {("a", "remove", "y.pdf", None), ("a", "rename", "tmp1.pdf", "a.pdf")}
    assert {r["key"]: r["files"] for r in quality.apply_fixes(w, plan).collect()} == {"a": ["x.pdf"], "b": [], "c": ["c.pdf"]}
    assert [r[0] for r in w.orderBy("key").select(quality.completeness()).collect()] == [1, 2, 5]
    assert [r[0] for r in w.orderBy("key").select(quality.needs_enrichment()).collect()] == [True, True, False]
    assert tuple(quality.gap_report(w, 5).first()) == (5, 3, 0, 3)


def test_edits(works):
    w = works(work("a", tags=["X", "y"], year=0, authors=[]), work("b", tags=["z"]))
    got = w.select(edits.edit_tags(F.col("tags"), ["New", "NEW", "Y"], ["x"]).alias("t")).collect()
    assert [r["t"] for r in got] == [["y", "New"], ["z", "New", "Y"]]
    fetched = works(work("a", year=1990, authors=["F"], doi="10.1/f", abstract="abs"))
    merged = edits.merge_missing(w, fetched)
    a = merged.filter("key = 'a'").first()
    assert (a["year"], a["authors"], a["doi"], a["abstract"], a["title"]) == (1990, ["F"], "10.1/f", "abs", "Title a")
    assert {(r["field"], r["before"], r["after"]) for r in edits.field_changes(w, merged).collect()} == {
        ("abstract", "null", '"abs"'), ("authors", "[]", '["F"]'), ("doi", "null", '"10.1/f"'), ("year", "0", "1990"),
    }
    after, changes = edits.update_works(w, "b", {"title": "N"}, ("year",), ["q"])
    assert {(r["field"], r["after"]) for r in changes.collect()} == {("title", '"N"'), ("year", "null"), ("tags", '["z","q"]')}
    assert after.filter("key = 'a'").first()["title"] == "Title a"
    with pytest.raises(ValueError):
        edits.update_works(w, "a")
    with pytest.raises(ValueError):
        edits.update_works(w, "a", {"title": "x"}, ("title",))
    one = w.filter("key = 'b'")
    with pytest.raises(ValueError):
        edits.import_overrides(one, "paper", {"edition": "2"})
    with pytest.raises(ValueError):
        edits.import_overrides(one, "book", {"title": " "})
    r = edits.import_overrides(one, "book", {"edition": " 2 ", "isbn": ["978"]}).first()
    assert (r["kind"], r["edition"], r["publisher"], r["isbn"]) == ("book", "2", None, ["978"])
    got = {(r["field"], r["before"], r["after"]) for r in edits.reviewer_changes(w, merged).collect()}
    assert ("abstract", "", "(fetched)") in got


def test_exports(works, spark, tmp_path):
    w = works(work("a", kind="book", isbn=["978", "979"], publisher="P", tags=["t"]), work("b", arxiv="2101.00001", authors=["Quill, Ada,", "Plato"], year=None))
    by = {r["key"]: r["entry"] for r in export.rendered(w, "BIB").collect()}
    assert by["a"] == "@book{a,\n  title = {Title a},\n  author = {Quill, Ada},\n  year = {2000},\n  publisher = {P},\n  isbn = {978, 979},\n}"
    assert "author = {Quill, Ada and Plato}" in by["b"]
    assert by["b"].endswith("  eprint = {2101.00001},\n  archiveprefix = {arXiv},\n}")
    plain = {r["key"]: json.loads(r["entry"]) for r in export.rendered(w, "json").collect()}
    assert plain["a"]["kind"] == "book"
    assert "kind" not in plain["b"] and "isbn" not in plain["b"] and plain["b"]["year"] is None
    h = {r["key"]: json.loads(r["entry"]) for r in export.rendered(w, "hayagriva").collect()}
    assert h["b"]["url"] == "https://arxiv.org/abs/2101.00001" and h["b"]["serial-number"] == {"arxiv": "2101.00001"}
    assert "url" not in h["a"] and "serial-number" not in h["a"]
    export.write_export(w, "yml", str(tmp_path / "out"), ["t"])
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '- key: "a"'
    assert [r[0] for r in w.select(export.citation(F.col("key"), "latex")).collect()] == ["\\cite{a}", "\\cite{b}"]
    with pytest.raises(ValueError):
        export.citation(F.col("key"), "x")
    with pytest.raises(ValueError):
        export.rendered(w, "doc")
    assert json.loads(export.envelope(spark, None, errors=["e"])) == {"ok": False, "data": None, "warnings": [], "errors": ["e"]}


DOCS = [
    ("a", "Neural nets", "deep neural networks and Café", "x_n"), ("b", "Cafe culture", "coffee", "x-n of things"), ("c", "Things", "neural of the", "neural neural"),
    ("d", "More things", "words and the", ""), ("e", "Other", "nothing else", "n x"), ("f", "Last", "the deep end", "deep"),
]


@pytest.mark.parametrize("query", ["neural", "cafe", "x_n", "the deep", '"things"', "neural zzz", "and", "things of"])
def test_bm25_against_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(key UNINDEXED, title, abstract, fulltext)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", DOCS)
    words = " ".join(f'"{w.replace(chr(34), "")}"' for w in query.split())
    expected = {k: round(s, 5) for k, s in db.execute("SELECT key, bm25(t) FROM t WHERE t MATCH ?", (words,))}
    docs = spark.createDataFrame(DOCS, "key string, title string, abstract string, fulltext string")
    got = {r["key"]: round(r["score"], 5) for r in lexical.bm25(docs, query, ("title", "abstract", "fulltext")).collect()}
    assert got == expected


def test_search_edges(spark):
    docs = spark.createDataFrame(DOCS, "key string, title string, abstract string, fulltext string")
    with pytest.raises(ValueError):
        lexical.bm25(docs, "  ", ("title",))
    assert lexical.bm25(docs, '""', ("title",)).count() == 0
    assert lexical.exact_terms("_X_n a, Deep deep", spark) == ["deep", "x_n"]
    with pytest.raises(ValueError):
        lexical.exact_terms("a _ !", spark)
    assert sorted(r[0] for r in lexical.with_all_terms(docs, "x_n", ("fulltext",), "key").collect()) == ["a", "b"]


def snippet_titles():
    """Titles of all lengths, with sentences, marks, odd separators and phrases that overlap."""
    r = random.Random(8)
    words = ["the", "The", "art", "of", "x", "y", "café", "CAFE", "na\u0131ve", "e\u0301lan", "42", "w"]
    ends = [" ", " ", " ", "  ", ". ", ": ", ".", "-", " \u2014 ", ".\n", "! ", "_", " ."]
    titles = ["", " ", "...", "the", " the. art", "x-y x y x", "of the of the of"]
    for n in [*range(1, 45), *[r.randrange(20, 200) for _ in range(160)]]:
        rare = n > 60
        titles.append(r.choice(["", " ", "\u201c"]) + "".join((r.choice(words) if not rare or r.random() < 0.06 else f"f{r.randrange(9)}") + r.choice(ends) for _ in range(n)))
    return titles


@pytest.mark.parametrize("query", ["the", "cafe", "x y", "x-y", "of-the the", "art the-art 42", "of-the-of x-y-x", "élan 42", "zzz"])
def test_snippet_against_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(title, other)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text extension")
    titles = snippet_titles()
    # the other column matches everywhere, so that titles without a match are shown too
    db.executemany("INSERT INTO t(rowid, title, other) VALUES (?, ?, ?)", [(i, t, query) for i, t in enumerate(titles)])
    match = " ".join(f'"{w}"' for w in query.split())
    want = dict(db.execute("SELECT rowid, snippet(t, 0, '{{', '}}', '...', 20) FROM t WHERE t MATCH ?", (match,)))
    assert len(want) == len(titles)
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", lexical.snippet(F.col("t"), lexical.parse_query(spark, query)).alias("s")).collect()}
    assert {i: s for i, s in got.items() if s != want[i]} == {}
    assert spark.range(1).select(lexical.snippet(F.lit(None).cast("string"), [["a"]])).first()[0] is None


@pytest.fixture
def scored(spark):
    rows = [(1, "p", [1.0, 0.0]), (2, "p", [0.0, 1.0]), (3, "q", [0.9, 0.1]), (4, "q", [1.0, 0.0]), (5, "r", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, work string, embedding array<float>")
    return vectors.score_passages(df, [1.0, 0.0])


def test_vectors(spark, scored):
    assert [r["id"] for r in vectors.top_passages(scored, 0, 3).orderBy("rank").collect()] == [1, 4, 3]
    whole = [r["id"] for r in vectors.rank_passages(scored).orderBy("rank").collect()]
    paged = [r["id"] for at in range(0, 5, 2) for r in vectors.top_passages(scored, at, 2).orderBy("rank").collect()]
    assert whole == paged
    assert [(r["work"], r["matching"]) for r in vectors.top_works(scored).orderBy("rank").collect()] == [("p", 2), ("q", 2), ("r", 1)]
    assert [(r["rank"], r["id"]) for r in vectors.work_page(scored, 0, 2, 1).collect()] == [(1, 1), (2, 4)]
    assert tuple(vectors.page_summary(scored, 1, 1).first()) == (3, 5, 1, 2)
    with pytest.raises(KeyError):
        vectors.work_passages(scored, "zz")
    with pytest.raises(ValueError):
        vectors.per_work(scored, 0)
    a = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="dimensions"):
        a.select(vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert vectors.check_query(" q ", {"model_id": "m", "dimension": 2}, "m", 2, 1) == "q"
    for bad in ((" ", {}, "m", 2, 1), ("q", {"model_id": "x"}, "m", 2, 1), ("q", {"model_id": "m", "dimension": 2}, "m", 2, 0), ("q", {"model_id": "m", "dimension": 3}, "m", 2, 1)):
        with pytest.raises(ValueError):
            vectors.check_query(*bad)
    assert vectors.model_id({}) == "default"
    assert vectors.model_id({"revision": "x"}).startswith("config:")
    for bad in ({"files": ("../x",)}, {"query_template": "x"}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            vectors.model_id(bad)


def test_embedding(spark):
    df = spark.createDataFrame([("T ", "a b"), (None, "c")], "work_title string, text string")
    got = vectors.embed(df, vectors.hashing_encoder(8), 8).collect()
    assert all(len(r["embedding"]) == 8 for r in got)
    with pytest.raises(Exception, match="dimensions"):
        vectors.embed(df, vectors.hashing_encoder(4), 8).collect()


def layout_document():
    texts = [
        {"label": "section_header", "text": "One", "level": 1}, {"label": "text", "text": "x 1 here", "prov": [{"page_no": 1}]}, {"label": "formula", "text": "E = mc", "prov": [{"page_no": 2}]},
        {"label": "page_header", "text": "head"}, {"label": "text", "text": "side", "content_layer": "furniture"}, {"label": "text", "text": "in picture"}, {"label": "list_item", "orig": "item", "text": "item"},
    ]
    refs = lambda *names: [{"$ref": n} for n in names]
    return {
        "schema_name": "DoclingDocument", "texts": texts, "pictures": [{"children": refs("#/texts/5")}], "groups": [{"children": refs("#/texts/6", "#/texts/1")}],
        "body": {"children": refs("#/texts/0", "#/texts/1", "#/texts/2", "#/texts/3", "#/texts/4", "#/pictures/0", "#/groups/0")},
    }


def test_layout(spark):
    docs = spark.createDataFrame([("d", json.dumps(layout_document())), ("bad", "{}"), ("lost", json.dumps(layout_document() | {"texts": []}))], "doc string, content string")
    blocks = layout.layout_blocks(docs)
    assert {r["doc"] for r in blocks.filter("label = 'error'").collect()} == {"bad", "lost"}
    passages = layout.fold_passages(blocks)
    p = passages.collect()
    assert [(r["text"], r["headings"], r["page_numbers"], r["labels"]) for r in p] == [("x₁ here\n\n\\[\nE = mc\n\\]\n\n- item", ["One"], [1, 2], ["formula", "list_item", "text"])]
    report = layout.import_report(blocks, passages).filter("doc = 'd'").first()
    assert (report["passages"], report["body_blocks"], report["formulas"], report["pages"], report["skipped_furniture"]) == (1, 3, 1, 2, 1)


def test_layouts_are_kept(spark, tmp_path):
    held = layout.Layouts(spark, f"file://{tmp_path}/l", buckets=2)
    docs = lambda *rows: spark.createDataFrame(rows, "doc string, content string")
    whole = layout_document()
    other = json.dumps(whole | {"texts": [*whole["texts"][:-1], {"label": "list_item", "text": "changed"}]})
    report = {r["doc"]: r["error"] for r in held.add(docs(("d", json.dumps(whole)), ("e", json.dumps(whole)), ("bad", "{}"))).collect()}
    assert report["d"] is None and report["e"] is None and report["bad"]
    empty = json.dumps(whole | {"texts": [{"label": "section_header", "text": "One"}] * 7})
    report = {r["doc"]: (r["error"], r["passages"]) for r in held.add(docs(("d", other), ("e", empty))).collect()}
    assert report["d"] == (None, 1) and report["e"] == ("the document has no body text to index", 0)
    assert {r["doc"]: r["text"].rsplit(" ", 1)[1] for r in held.read("passages").collect()} == {"d": "changed", "e": "item"}
    assert held.read("documents").count() == 2


def test_fold_over_batches(spark):
    """Against a plain walk, with documents that go over many batches."""
    r = random.Random(2)
    rows = []
    for d in ("hot", "a", "b", None, "empty"):
        for i in range(4000 if d == "hot" else 60):
            label = "section_header" if d == "empty" else r.choice(["text", "text", "text", "formula", "list_item", "section_header", "furniture"])
            rows.append((d, i, label, "w" * r.choice([1, 30, 400, 900]), r.choice([None, 1, 2, 3]), r.choice([None, 0, 1, 2, 4])))
    want = []
    for d in ("hot", "a", "b", None):
        path, held, out = [], [], []
        for _, _, label, text, page, level in [x for x in rows if x[0] == d and x[2] != "furniture"] + [(d, 0, "section_header", "end", None, 1)]:
            size = sum(len(layout.rendered(h[0], h[1])) for h in held) + 2 * max(len(held) - 1, 0)
            if held and (label == "section_header" or (label != "formula" and size + len(text) + 8 > 1800)):
                out.append(("\n\n".join(layout.rendered(h[0], h[1]) for h in held), list(path), sorted({h[2] for h in held} - {None}), sorted({h[0] for h in held})))
                held = []
            if label == "section_header":
                del path[max(level or 1, 1) - 1 :]
                path.append(text)
            else:
                held.append((label, text, page))
        want += [(d, i, *p) for i, p in enumerate(out)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = layout.fold_passages(spark.createDataFrame(rows, layout.BLOCKS).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fold():
    b = lambda label, text, level=None: (label, text, None, level)
    got = layout.fold_blocks([b("section_header", "A", 1), b("section_header", "B", 3), b("text", "x"), b("section_header", "C", 2), b("text", "y" * 1000), b("text", "z" * 900), b("formula", "f" * 900), b("text", "w")])
    assert [h for _, h, _, _ in got] == [["A", "B"], ["A", "C"], ["A", "C"], ["A", "C"]]
    assert [len(t) for t, _, _, _ in got] == [1, 1000, 900 + 2 + 906, 1]
    assert layout.fold_blocks([b("section_header", "A", 1)]) == []


def test_formula_places(spark):
    box = {"l": 1.0, "t": 9.0, "r": 3.0, "b": 7.0, "coord_origin": "BOTTOMLEFT"}
    texts = [{"label": "formula", "text": " a ", "prov": [{"page_no": p, "bbox": box}]} for p in (1, 2, 1)] + [{"label": "formula", "text": "a", "prov": [{"page_no": 1, "bbox": box | {"coord_origin": "TOPLEFT"}}]}]
    docs = spark.createDataFrame([("d", json.dumps({"pages": {"1": {"size": {"width": 10.0, "height": 20.0}}, "2": {"size": {"width": 10.0, "height": 20.0}}}, "texts": texts}))], "doc string, content string")
    known = formula.formula_catalogue(docs)
    assert known.count() == 3
    hits = spark.createDataFrame([(1, "d", "$$\na\n$$\n$$\na\n$$", [1]), (2, "d", "$$\na\n$$", []), (3, "d", "$$\nb\n$$", [])], "id int, doc string, text string, pages array<bigint>")
    got = {(r["id"], r["nth"]): r["place"] for r in formula.locate_formulas(hits, known).collect()}
    assert got == {(1, 1): 0, (1, 2): 2, (2, 1): 0, (3, 1): None}


FILES = "key string, work_title string, source_path string, content string"


def test_incremental(spark):
    line = lambda t, i: json.dumps({"text": t, "chunk_index": i})
    before = spark.createDataFrame([("a", "A", "a.jsonl", f"\n{line('one', 0)}\n{{bad\n{line('two', 1)}"), ("b", "B", "b.jsonl", line("three", 0)), ("c", "C", "c.jsonl", line("gone", 0))], FILES)
    after = spark.createDataFrame([("a", "A", "a.jsonl", f"\n{line('one', 0)}\n{{bad\n{line('two', 1)}"), ("b", "B", "b.jsonl", line("changed", 0)), ("d", "D", "d.jsonl", line("new", 0) + "\n{}")], FILES)
    rows, next_rows = incremental.collect_rows(before), incremental.collect_rows(after)
    assert tuple(incremental.counters(rows).first()) == (3, 4, 0, 1)
    index = incremental.replace_index(rows)
    assert [(r["id"], r["text"]) for r in index.orderBy("id").collect()] == [(1, "one"), (2, "two"), (3, "three"), (4, "gone")]
    actions = incremental.plan(incremental.sources_of(next_rows), incremental.sources_of(rows))
    assert {(r["source_path"], r["action"]) for r in actions.collect()} == {("a.jsonl", "unchanged"), ("b.jsonl", "changed"), ("c.jsonl", "deleted"), ("d.jsonl", "new")}
    updated = incremental.update_index(index, next_rows, actions)
    assert [(r["id"], r["text"]) for r in updated.orderBy("id").collect()] == [(1, "one"), (2, "two"), (5, "changed"), (6, "new")]
    rebuilt = incremental.replace_index(next_rows)
    assert sorted(r["text"] for r in updated.collect()) == sorted(r["text"] for r in rebuilt.collect())
    one = incremental.summary(next_rows, actions).first()
    assert (one["embedded_files"], one["unchanged"], one["removed"], one["embedded_passages"], one["skipped"], one["up_to_date"]) == (2, 1, 1, 2, 1, False)
    assert {r["source_path"] for r in incremental.healed(next_rows, index, incremental.sources_of(next_rows)).collect()} == {"a.jsonl"}
    assert incremental.needs_rebuild({"model_id": "x"}, "y") and incremental.needs_rebuild({"model_id": "x"}, "x", True) and not incremental.needs_rebuild({"model_id": "x"}, "x")


def test_postings_follow(spark):
    docs = spark.createDataFrame(DOCS, "key string, title string, abstract string, fulltext string")
    columns = ("title", "abstract", "fulltext")
    stored = lexical.postings(docs, columns)
    changed = docs.withColumn("title", F.when(F.col("key") == "a", F.lit("New")).otherwise(F.col("title")))
    kept = incremental.refresh_postings(stored, changed, docs.filter("key = 'a'"), columns)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, lexical.postings(changed, columns).collect()))


def test_a_search_counts_once(spark):
    """What is counted is read again for the statistics and the hits, not worked out again; lengths are those of folded texts."""
    docs = spark.createDataFrame([("a", "The caf́é, cafés ́ x́y K2"), ("b", "the the_the İstanbul 'the"), ("c", None), ("d", "other")], "key string, text string")
    found = lexical.bm25(docs, "the", ("text",))
    assert {r["key"] for r in found.collect()} == {"a", "b"}
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["key"]: r["length"] for r in lexical.document_lengths(docs, ("text",)).collect()}
    assert got == {r["key"]: r["n"] for r in docs.select("key", F.size(lexical.tokens(F.col("text"))).alias("n")).collect()} == {"a": 5, "b": 5, "c": 0, "d": 1}


def test_trash_names_are_found_without_the_works(works, monkeypatch):
    """Finding free names writes keys and no other column of a work; the works that go keep theirs."""
    from quillstack.plans import durable as plans

    w = works(work("a", title="Same"), work("b", title="same", abstract="long"), work("c", title="same", has_pdf=True))
    described = duplicates.describe_groups(duplicates.duplicate_groups(w), w)
    write, written = plans.durable, []
    monkeypatch.setattr(plans, "durable", lambda df: written.append(df.columns) or write(df))
    there = w.sparkSession.createDataFrame([("b",), ("b-1",)], "trash_key string")
    _, gone = duplicates.split_trash(w, described, there)
    got = {r["key"]: (r["trash_key"], r["title"], r["abstract"]) for r in gone.filter("key is not null").collect()}
    assert got == {"a": ("a", "Same", w.filter("key = 'a'").first()["abstract"]), "b": ("b-2", "same", "long")}
    assert written and not any("title" in columns for columns in written)


def test_works_that_share_a_key_get_names_of_their_own(works):
    w = works(work("a", title="x"), work("a", title="y"), work("b", title="z"))
    gone = w.sparkSession.createDataFrame([("a", False), ("b", True)], "key string, recommended boolean")
    _, moved = duplicates.split_trash(w, gone, w.sparkSession.createDataFrame([("a",)], "trash_key string"))
    assert sorted(r["trash_key"] for r in moved.filter("key is not null").collect()) == ["a-1", "a-2"]
