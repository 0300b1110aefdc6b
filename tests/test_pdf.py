import base64
import zlib

import pytest
from pyspark.sql import functions as F

from docquery.sources import loaders, pdf


def made(pages, compressed=True, info=True):
    """A PDF with a page for each content stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <61> <7a> <0041> endbfrange 1 beginbfchar <20> <0020> endbfchar"
    objects[4] = b"<< /Type /Font /Subtype /Type1 /ToUnicode 5 0 R >>"
    objects[5] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    kids = []
    for i, content in enumerate(pages):
        body = zlib.compress(content) if compressed else content
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if compressed else b"", body)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (b" ".join(kids), len(kids))
    objects[6] = b"<< /Title (A \\(short\\) title) /Author <FEFF00C900760061> >>"
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items()))
    return b"%PDF-1.4\n" + body + b"trailer << /Root 1 0 R " + (b"/Info 6 0 R" if info else b"") + b" >>\n%%EOF"


WORDS = "whitewashed tombs are full of the bones of the dead and of all that is unclean".split()
TIGHT = b"BT /F1 12 Tf 72 700 Td [" + b" -120 ".join(b"(%s)" % w.encode() for w in WORDS) + b"] TJ ET"


@pytest.mark.parametrize("compressed", [True, False])
def test_pages_and_information(compressed):
    first = b"BT /F1 12 Tf 72 700 Td (One \\(1\\) caf\\351) Tj 0 -14 Td [(two) -300 (words)] TJ T* (three) Tj ET"
    pages, info = pdf.extract(made([first, b"", b"BT /F2 9 Tf 1 0 0 1 72 700 Tm (abc z) Tj 1 0 0 1 72 680 Tm <78> Tj ET"], compressed))
    assert pages == ["One (1) café\ntwo words\nthree", "", "ABC Z\nX"]
    assert info == {"title": "A (short) title", "author": "Éva"}


def test_spacing_is_recovered():
    ((text,), _) = pdf.extract(made([TIGHT]))
    assert text == " ".join(WORDS)
    assert pdf.page_text(TIGHT, {}, pdf.GAP) == "".join(WORDS) and pdf.run_together("".join(WORDS))


def test_files_that_cannot_be_read():
    for data in (b"", b"plain", made([b""]).replace(b"/Root", b"/Encrypt 9 0 R /Root")):
        with pytest.raises(ValueError):
            pdf.extract(data)
    assert pdf.extract(b"%PDF-1.4 1 0 obj << broken") == ([], {})


def test_object_streams():
    inner = b"7 0 8 40 << /Type /Catalog /Pages 8 0 R >>          << /Type /Pages /Kids [9 0 R] >>"
    first = inner.index(b"<<")
    inner = b"7 0 8 %d " % (inner.rindex(b"<< /Type") - first) + inner[first:]
    first = inner.index(b"<<")
    packed, content = zlib.compress(inner), b"BT (packed) Tj ET"
    data = b"%%PDF-1.5\n6 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (first, len(packed), packed)
    data += b"9 0 obj << /Type /Page /Contents 10 0 R >> endobj 10 0 obj << /Length %d >> stream\n%s\nendstream endobj" % (len(content), content)
    assert pdf.extract(data) == (["packed"], {})


def test_uploads_of_all_kinds_are_loaded(spark):
    b64 = lambda b: base64.b64encode(b).decode()
    rows = [("a.pdf", b64(made([TIGHT, b"BT (second page) Tj ET"]))), ("dir/b.txt", b64(b"plain text here")), ("c.json", b64(b'{"k": {"v": 1}}')), ("sw.cfg", b64(b"hostname x\ninterface Gi0/1")), ("bad.pdf", b64(b"nothing")), ("d.json", "***"), ("e.exe", b64(b"x")), ("", b64(b"x"))]
    got = {r["source_path"].split("_", 1)[1]: r for r in loaders.load_uploads(spark.createDataFrame(rows, "name string, content_base64 string")).collect()}
    assert len(got) == len(rows)
    assert got["a.pdf"]["content"] == f"--- Page 1 ---\n{' '.join(WORDS)}\n--- Page 2 ---\nsecond page" and got["a.pdf"]["metadata"]["page_count"] == "2"
    assert got["b.txt"]["content"] == "plain text here" and got["c.json"]["content"] == "k.v: 1" and "hostname x" in got["sw.cfg"]["content"]
    assert {n for n, r in got.items() if r["error"]} == {"bad.pdf", "d.json", "e.exe", ""}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(made([TIGHT]))
    (r,) = loaders.load(spark, str(tmp_path)).where(F.col("source_type") == "pdf").collect()
    assert "bones of the dead" in r["content"] and r["metadata"]["pdf_author"] == "Éva"
