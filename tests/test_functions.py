import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quillstack.functions import identifiers, jsonrows, math, pages, text


def test_arxiv_and_doi(column):
    given = ["2101.00001", "https://arxiv.org/pdf/2101.00001v3.pdf", "www.arxiv.org/abs/2101.1234", "arXiv 2101.00001", None, "x 2101.00001"]
    assert column(identifiers.arxiv_id, given) == ["2101.00001", "2101.00001v3", "2101.1234", None, None, None]
    assert column(identifiers.doi, ["see 10.1000/ab.c, yes", "10.1/x", "10.12345/x"]) == ["10.1000/ab.c,", None, "10.12345/x"]
    assert column(identifiers.resolver_doi, ["https://doi.org/10.1000/a", "https://x.org/10.1000/a", "https://dx.doi.org/10.1000/b"]) == ["10.1000/a", None, "10.1000/b"]


def test_doi_in_url(column):
    given = ["https://x.org/a?id=10.1371/j.p&x=1", "https://x.org/10.1000%2Fq.pdf#p", "https://x.org/10.1000/a+b).", "https://x.org/none", "bad%zz 10.1000/k"]
    assert column(identifiers.doi_in_url, given) == ["10.1371/j.p", "10.1000/q", "10.1000/a+b", None, "10.1000/k"]


def test_pubmed_ids(column):
    assert column(identifiers.pmc_id, ["https://pmc.ncbi.nlm.nih.gov/articles/pmc12/pdf", "https://x.org/articles/PMC12"]) == ["PMC12", None]
    assert column(identifiers.pmid, ["https://pubmed.ncbi.nlm.nih.gov/12345/", "PMID: 12345", "pmid:123", "12345"]) == ["12345", "12345", None, None]


def test_classify_input(column):
    given = ["2101.00001", "https://doi.org/10.1000/a", "https://x.org", "10.1000/a", "words", "pmid:12345"]
    got = column(identifiers.classify_input, given)
    assert [(r["kind"], r["id"]) for r in got] == [("arxiv", "2101.00001"), ("doi", "10.1000/a"), ("url", "https://x.org"), ("doi", "10.1000/a"), ("unknown", None), ("pmid", "12345")]
    assert column(identifiers.is_importable, ["2101.00001", "words", None, "http://x"]) == [True, False, False, True]


def test_reduce_url(column):
    given = ["https://arxiv.org/abs/2101.00001v2?x=1", "https://www.pubmed.ncbi.nlm.nih.gov/12345/", "https://doi.org/10.1000%2Fa", "https://x.org/page", "https://pmc.ncbi.nlm.nih.gov/articles/pmc77/", "https://x.org/doi/10.1000/a.b?c=d", "no address 10.1000/a", None]
    assert column(identifiers.reduce_url, given) == ["2101.00001", "12345", "10.1000/a", "https://x.org/page", "PMC77", "10.1000/a.b", "no address 10.1000/a", None]


def test_url_file_name(column):
    assert column(identifiers.url_file_name, ["https://x.org/a/b.PDF?x", "https://x.org/a/", "https://x.org"]) == ["b.PDF", "download.pdf", "download.pdf"]


def test_clean_abstract(column):
    given = ["<jats:title>Abstract</jats:title><jats:p>Polyps are</jats:p>", " ABSTRACT:  a\n b", "Abstraction is", "Abstract is a thing", "AbstractWe show", None]
    assert column(text.clean_abstract, given) == ["Polyps are", "a b", "Abstraction is", "Abstract is a thing", "We show", None]


def test_names(column):
    assert column(text.split_authors, ["A, B; C", "A, B, C", "A B and C D", "A, B", " x "]) == [["A, B", "C"], ["A", "B", "C"], ["A B", "C D"], ["A, B"], ["x"]]
    assert column(text.family_given, ["Ada Mae Quill", "Quill, Ada,", "Plato", " ", "A\tB"]) == ["Quill, Ada Mae", "Quill, Ada", "Plato", "", "B, A"]
    assert column(text.given_family, ["Quill, Ada", "Ada Quill"]) == ["Ada Quill", "Ada Quill"]
    assert column(text.key_surname, ["Ada Quill", "Quill, Ada", "van Quill, Ada, Jr", "Wren George M.", "A. B.", "Plato"]) == ["Quill", "Quill", "van Quill, Ada", "Wren", "B.", "Plato"]
    assert column(text.sort_surname, ["Ada Quill", "Quill, Ada, Jr", None]) == ["quill", "quill", ""]
    assert column(text.row_surname, ["Ada Quill", "Quill, Ada, Jr"]) == ["Quill", "Quill, Ada"]


def test_work_key_and_slug(column):
    assert column(text.slug, ["Ünïcode  Straße!", "--a--", "Łódź Æon"]) == ["unicode-strasse", "a", "lodz-aeon"]
    assert column(text.migration_slug, ["Ünïcode X"]) == ["ncode-x"]
    got = column(lambda a, y, t: text.work_key(F.array(a), y, t), [("Ada Quill", 2001, "The Art of"), ("Ada Quill", None, "the of")], "a string, y int, t string")
    assert got == ["quill-2001-art", "quill-0000-untitled"]


def test_title_match(column):
    given = [("A Title!", "a title"), ("A Title: more", "A Title"), ("A", "B"), ("", "x"), (None, "x")]
    assert column(text.titles_match, given, "a string, b string") == [True, True, False, False, False]


def test_previews(column):
    five = ["a", "b", "c", "d", "e"]
    assert column(text.author_preview, [(five,), (five[:4],), (five[:3],), ([],)], "a array<string>") == ["a · b · e · +2 authors", "a · b · d · +1 author", "a · b · c", ""]
    assert column(lambda c: text.preview(c, 5), ["a  b", "abcdef", None]) == ["a b", "abcd…", None]
    assert column(text.page_location, [([],), ([4],), ([2, 4],)], "a array<bigint>") == [None, "p. 4", "pp. 2, 4"]
    assert column(text.human_size, [1, 2048, 1 << 20, 1600000], "a bigint") == ["1 KB", "2 KB", "1.0 MB", "1.5 MB"]
    # halves of a tenth: to the even one, as the SQL's printf rounds
    assert column(text.human_size, [32768000, 98304000, 163840000, 32768001], "a bigint") == ["31.2 MB", "93.8 MB", "156.2 MB", "31.3 MB"]
    assert column(lambda c: text.bounded_lines(c, 5, 2), ["aa bb cc dd ee ff", "aa"]) == [["aa bb", "cc d…"], ["aa"]]
    assert column(lambda c: text.truncate_ellipsis(c, 5), ["abcde", "abcdef", "aéééé", "", None]) == ["abcde", "abcd…", "aé…", "", None]
    assert column(lambda c: text.truncate_ellipsis(c, 1), ["abc"]) == ["abc"]
    row = lambda a: text.list_row(F.lit("k"), F.array(a), F.lit(2001), F.lit("T"))
    assert column(row, ["Ada Quill", "Bo Ééééééééé", "Quillingtonshire, B"]) == ["2001         Quill  T", "2001        Éééééé  T", "2001  Quillingtons  T"]
    given = ["ab cdefghij", "  a\t b  ", "", "abcdefghi j", "abcd efgh", "éééééééééé x", None]
    want = [["ab", "cdef", "ghij"], ["a b"], [""], ["abcd", "efgh", "i j"], ["abcd", "efgh"], ["éé", "éé", "éé", "éééé", "x"], None]
    assert column(lambda c: text.wrap_words(c, 4), given) == want
    assert column(lambda c: text.wrap_words(c, 0), ["a b"]) == [["a b"]]
    assert column(lambda d, t, s: text.progress_line(d, t, s, 6), [(1, 3, 61), (9, 3, 0), (0, 0, 5)], "d bigint, t bigint, s bigint") == ["Embedding passages [==    ]  33% 1/3 01:01", "Embedding passages [======] 100% 3/3 00:00", "Embedding passages [      ]   0% 0/1 00:05"]


def test_truncate_and_messages(column):
    assert column(lambda c: text.truncate(c, 4), ["abc", "abcdef", "aé日本", "日本", "", None]) == ["abc", "abcd", "aé", "日", "", None]
    given = ["x: Semantic index is empty", "Semantic index uses model a", "odd", None]
    assert column(text.search_error, given) == ["Semantic index not built.\nRun `quillstack semantic-index` first.", "Semantic index was built with an older model; run `quillstack semantic-index`", "Semantic search: odd", None]


def test_meta_tags(column):
    html = "<META content='10.1/a' name=\"citation_doi\"><meta name='citation_author' content='A'><meta content='B' name='citation_author'><meta name='citation_author' content='A'><meta name='x' content=' '>"
    assert column(lambda h: pages.meta_content(h, "citation_doi"), [html, "<p>", None]) == ["10.1/a", None, None]
    assert column(lambda h: pages.meta_contents(h, "citation_author"), [html]) == [["A", "B"]]
    assert column(lambda h: pages.meta_content(h, "x"), [html]) == [None]
    got = column(lambda h: pages.landing_info(F.lit("https://x.org/a/b"), h), ['<meta name="prism.doi" content="doi:10.1000/z"><meta name="citation_pdf_url" content="../c.pdf">'])[0]
    assert (got["doi"], got["pdf_url"]) == ("10.1000/z", "https://x.org/c.pdf")


def test_service_answers(column):
    csl = '{"title":["T","U"],"container-title":"J","author":[{"family":"Q","given":"A"},{"given":"x"}],"published-print":{"date-parts":[[1999]]},"DOI":"10.1/x","abstract":"<p>Abstract: a</p>"}'
    r = column(pages.csl_record, [csl, "{}", "no"])
    assert (r[0]["title"], r[0]["journal"], r[0]["authors"], r[0]["year"], r[0]["doi"], r[0]["abstract"]) == ("T", "J", ["A Q"], 1999, "10.1/x", "a")
    assert (r[1]["title"], r[1]["authors"], r[1]["year"]) == ("Untitled", [], None)
    assert column(pages.first_or_self, ['[{"a":1},2]', '{"a":2}']) == ['{"a":1}', '{"a":2}']
    assert column(lambda j: pages.pmc_doi(j, F.lit("PMC1")), ['{"records":[{"pmcid":"pmc1","doi":"d"}]}']) == ["d"]
    assert column(pages.oa_package_url, ['<OA><link format="pdf" href="a"/><link format="tgz" href="b"/></OA>']) == ["b"]
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title> A\n B </title><summary>S</summary><published>2001-01-01</published><author><name>N</name></author></entry></feed>'
    r = column(pages.atom_record, [xml, "<feed/>"])
    assert (r[0]["title"], r[0]["year"], r[0]["authors"], r[1]) == ("A B", 2001, ["N"], None)
    # of two entries the first; text of elements inside; a blank or missing title makes no record
    two = '<f xmlns:x="u"><title>f</title><entry><title>A <i>b</i></title><x:doi>10.1/a</x:doi><author><name> N </name><name>M</name></author></entry><entry><title>B</title><summary>S</summary></entry></f>'
    r = column(pages.atom_record, [two, None, "", "<f><entry><title> </title></entry></f>", "<entry><title>T</title></entry>"])
    assert (r[0]["title"], r[0]["doi"], r[0]["authors"], r[0]["abstract"], r[0]["year"]) == ("A b", "10.1/a", ["N", "M"], None, None)
    assert (r[1:4], r[4]["title"], r[4]["authors"]) == ([None] * 3, "T", [])


def test_feeds_are_dealt_to_tasks(spark, tmp_path):
    from quillstack.plans.catalogue import QUERIES

    spark.range(5).selectExpr("id AS p_partkey", "'name' AS p_name", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["atom_parse"](spark, str(tmp_path)).rdd.getNumPartitions() >= min(5, spark.sparkContext.defaultParallelism)


def test_packages(column):
    def tar(name, body):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    got = column(pages.pdf_of_package, [tar("a/b.PDF", b"%PDF-1"), tar("a.pdf", b"html"), tar("a.txt", b"%PDF-1"), b"no", None], "a binary")
    assert [None if x is None else bytes(x) for x in got] == [b"%PDF-1", None, None, None, None]
    assert column(pages.is_pdf, [bytearray(b"%PDF-1"), bytearray(b"%PDF1")], "a binary") == [True, False]
    assert column(pages.is_pdf_file, [bytearray(b"%PDF-1"), bytearray(b"%PDF1")], "a binary") == [True, True]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("x 1 and y i j", "x₁ and yᵢⱼ"),
        ("| x + y |", "|x + y|"),
        ("( a , b ]", "(a, b]"),
        ("f in R and ON", "f in ℝ and ON"),
        ("( i i )", "(i i)"),
        ("a 1 - 2", "a 1 - 2"),
        ("x n - 1", "xₙ₋₁"),
        ("a ,-b", "a, -b"),
    ],
)
def test_math(column, given, expected):
    assert column(math.normalise_math, [given]) == [expected]


def test_formulas(column):
    given = ["t\n\\[\na\n$$\nu\n$$\n b \n\\]\n", "\\[\nopen", "$$\n\n$$", "none"]
    assert column(math.display_formulas, given) == [["a", "b"], [], [], []]
    got = column(math.display_blocks, ["t\n$$\nopen"])
    assert [(b["kind"], b["text"]) for b in got[0]] == [("text", "t"), ("text", "\\[\nopen")]
    assert column(lambda t: math.without_headings(t, F.array(F.lit("Intro"))), ["intro\n\nbody\nintro", "x", "INTRO \r\n \nIntro\nbody\n", "\nx"]) == ["body\nintro", "x", "Intro\nbody", "x"]
    own = F.array(F.lit("H1"), F.lit("H2"))
    assert column(lambda t: math.without_headings(t, own), ["H1\n\nH2\nbody", "H1\nh2\n\n\nbody"]) == ["H2\nbody", "body"]
    crop = column(lambda a: math.pixel_crop(a, F.lit(700.0), F.lit(200.0), F.lit(650.0), F.lit(612.0), F.lit(792.0), F.lit(72)), [100.0, 400.0], "a double")
    assert tuple(crop[0]) == (99, 91, 102, 52)
    assert crop[1] is None
    box = column(lambda a: math.pixel_crop(a, F.lit(50.2), F.lit(20.7), F.lit(30.1), F.lit(612.0), F.lit(792.0), F.lit(216)), [10.3], "a double")
    assert tuple(box[0]) == (27, 2222, 38, 67)
    assert column(math.emphasise, [0, 1, 5, 204, 250], "a int") == [0, 2, 7, 255, 255]
    assert column(lambda f, b, c: math.blend(f, b, c), [(255, 0, 127), (10, 200, 100), (0, 255, 255)], "f int, b int, c int") == [127, 125, 0]
    assert tuple(column(lambda w, h: math.cell_size(w, h, F.lit(10), F.lit(20)), [(170, 20)], "w int, h int")[0]) == (10, 1)
    assert tuple(column(lambda w, h: math.cell_size(w, h, F.lit(10), F.lit(20)), [(170, 40)], "w int, h int")[0]) == (10, 2)


def test_json_rows(column):
    given = [
        '{"chunk_index": 7, "text": " a ", "headings": ["H", " "], "page_numbers": [4, "2", 4, "bad"]}',
        '{"page_content": "b", "metadata": {"section": "S", "page": "3", "chunk_id": "12"}}',
        '{"chunk_index": 1, "metadata": {"page": 1}}',
        "{cut",
        " ",
        '[1, 2]',
        '{"text": "  ", "content": "c", "chunk_index": "abc", "chunk_id": 5, "heading": 4, "page": 4294967296}',
        '{"text": "d", "id": 7.5, "page": -1}',
    ]
    got = column(lambda j: jsonrows.passage(j, F.lit(99)), given)
    assert [r["status"] for r in got] == ["ok", "ok", "skipped", "malformed", "blank", "skipped", "ok", "ok"]
    assert (got[0]["chunk_index"], got[0]["text"], got[0]["headings"], got[0]["pages"]) == (7, "a", ["H"], [2, 4])
    assert (got[1]["chunk_index"], got[1]["text"], got[1]["headings"], got[1]["pages"]) == (12, "b", ["S"], [3])
    assert (got[6]["chunk_index"], got[6]["text"], got[6]["headings"], got[6]["pages"]) == (99, "c", [], [])
    assert (got[7]["chunk_index"], got[7]["pages"]) == (99, [])


def test_tokens_are_those_of_the_standard_tokeniser(column):
    """Against the full-text tokens of SQLite, for every character of the Latin, Greek and Cyrillic ranges and what combines with them."""
    import sqlite3

    from quillstack.operators import lexical

    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    given = ["Cafe\u0301s na\u00efve", "x_n x-n 3.14", "\u1ed9t \u01ce\u1e3f", "日本語 a1b2"]
    given += [f"q{chr(i)}z" for i in range(0xA1, 0x250)] + [f"q{chr(i)}z" for i in range(0x300, 0x332)] + [f"q{chr(i)}z" for i in range(0x391, 0x3CA) if i != 0x3A2] + [f"q{chr(i)}z" for i in range(0x410, 0x450)] + [f"q{chr(i)}z" for i in range(0x1E00, 0x1E98)]
    got = column(lexical.tokens, given)
    off = {}
    for i, (text_, tokens) in enumerate(zip(given, got, strict=True)):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i + 1, text_))
        expected = [r[0] for r in db.execute("SELECT term FROM v WHERE doc = ? ORDER BY offset", (i + 1,))]
        if tokens != expected:
            off[text_] = (tokens, expected)
    assert off == {}
