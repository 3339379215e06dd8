import zlib

from pyspark.sql import functions as F

from quillstack.functions.pdfinfo import pdf_info, pdf_record


def built(info, *, number=3, extra=b"", update=None):
    """A small PDF with a cross-reference table, perhaps with an update behind it."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>", number: info}
    out, places = bytearray(b"%PDF-1.4\n" + extra), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n" % (number + 1) + b"".join(b"%010d 00000 n \n" % places.get(n, 0) for n in range(number + 1))
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (number + 1, number, start)
    if update:
        at = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, update)
        second = len(out)
        out += b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Info %d 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (number, at, number, start, second)
    return bytes(out)


def streamed(info):
    """A PDF whose information dictionary lies in a compressed object stream, named by a cross-reference stream."""
    objects = [(1, b"<< /Type /Catalog >>"), (7, info)]
    head, body = b"", b""
    for n, x in objects:
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = zlib.compress(head + body)
    out = bytearray(b"%%PDF-1.5\n4 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed))
    start = len(out)
    table = zlib.compress(b"\0" * 20)
    out += b"5 0 obj\n<< /Type /XRef /Size 8 /W [1 2 1] /Root 1 0 R /Info 7 0 R /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, start)
    return bytes(out)


CASES = [
    (built(b"<< /Title (A \\(nested (title)\\) \\101\\n) /Author (Ada Quill; Bo Wren) >>"), ("A (nested (title)) A", "Ada Quill; Bo Wren")),
    (built(b"<</Author<FEFF00C900640020>/Title<41 42 4>/Producer (/Title (no))>>"), ("AB@", "Éd")),
    (built(b"<< /TitleX (no) /Title (caf\xc3\xa9 \\\nx) >>", number=12), ("café x", None)),
    (built(b"<< /Title ( ) /Author 9 0 R >>"), (None, None)),
    (built(b"<< /Title (old) >>", update=b"<< /Title (new) /Author (X) >>"), ("new", "X")),
    (streamed(b"<< /Title (Inside) /Author (Y) >>"), ("Inside", "Y")),
    (built(b"<< /Title (T) >>").replace(b"startxref\n", b"startxref\n9999"), ("T", None)),
    (b"%PDF-1.4\nno objects", (None, None)),
    (b"not a pdf /Info 3 0 R", (None, None)),
    (b"", (None, None)),
    (None, (None, None)),
    (built(b"<< /Title (open"), (None, None)),
]


def test_info():
    for data, want in CASES:
        assert pdf_info(data) == want, data
    # cut anywhere, a file is read or passed over
    whole = CASES[0][0]
    for n in range(0, len(whole), 7):
        pdf_info(whole[:n])


def test_record(spark):
    rows = [(i, f"/in/Some.Work {i}.pdf", data) for i, (data, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, name string, content binary")
    got = {r["i"]: r["x"] for r in df.select("i", pdf_record(F.col("name"), F.col("content")).alias("x")).collect()}
    assert (got[0]["title"], got[0]["authors"]) == ("A (nested (title)) A", ["Ada Quill", "Bo Wren"])
    assert (got[3]["title"], got[3]["authors"]) == ("Some.Work 3", [])
    assert (got[10]["title"], got[5]["title"]) == ("Some.Work 10", "Inside")
