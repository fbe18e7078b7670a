"""Reading PDF files without ``pypdf``, from bytes put together here."""

from __future__ import annotations

import random
import zlib

import pytest

from quillgraph.functions import hints
from quillgraph.sources import pdf, plainpdf


def stream(about, data, packed=True):
    raw = zlib.compress(data) if packed else data
    return b"<<" + about + (b" /Filter /FlateDecode" if packed else b"") + b" /Length %d >>\nstream\n" % len(raw) + raw + b"\nendstream"


CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0041> <005A> <0041> endbfrange 2 beginbfchar <0001> <002E> <0002> <0031> endbfchar 1 beginbfrange <0003> <0004> [<0030> <002F>] endbfrange endcmap"


def made(page, info=b"", xmp=None, fonts=b"", more=(), packed=True, trailer=b""):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R" + (b" /Metadata 7 0 R" if xmp else b"") + b" >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << " + fonts + b" >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
        4: stream(b"", page, packed),
        5: b"<<" + info + b">>",
        **({7: stream(b"/Type /Metadata /Subtype /XML", xmp, False)} if xmp else {}),
        **dict(more),
    }
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items())
    return b"%PDF-1.5\n%\xe2\xe3\n" + body + b"trailer\n<< /Root 1 0 R /Info 5 0 R " + trailer + b">>\n%%EOF"


def test_info_xmp_and_text():
    page = b"BT /F1 12 Tf 72 700 Td (arXiv:2401.12345v2 [cs.LG]) Tj 0 -14 Td (See \\(doi\\) ) Tj [(10.12) -20 (34/Ab) -250 (next)] TJ T* (a\\\nb\\101) ' ET"
    info = b"/Title (x) /DOI (https://doi.org/10.5555/A\\(1\\)) /Author <FEFF00D60073> /Pages 3"
    xmp = b'<?xpacket?><rdf:Description prism:doi="10.5555/xmp"/>'
    for packed in (True, False):
        found = plainpdf.Pdf(made(page, info, xmp, packed=packed))
        assert found.info() == {"/Title": "x", "/DOI": "https://doi.org/10.5555/A(1)", "/Author": "Ös", "/Pages": "3.0"}
        assert hints.xmp_values(found.xmp()) == ["10.5555/xmp"]
        assert found.page_text() == "arXiv:2401.12345v2 [cs.LG]\nSee (doi) 10.1234/Ab next\nabA"


def test_fonts_with_a_character_map():
    fonts = {6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>", 8: stream(b"", CMAP)}
    page = b"BT /F7 1 Tf <00020003000100020002000200020004> Tj <00410042> Tj ET"
    assert plainpdf.Pdf(made(page, fonts=b"/F7 6 0 R", more=fonts)).page_text() == "10.1111/AB"
    bare = {6: b"<< /Type /Font /Subtype /Type0 >>"}
    assert plainpdf.Pdf(made(page, fonts=b"/F7 6 0 R", more=bare)).page_text() == ""


def test_objects_in_a_stream():
    inner = [(11, b"<< /Type /Catalog /Pages 12 0 R >>"), (12, b"<< /Kids [13 0 R] >>"), (13, b"<< /Type /Page /Contents 4 0 R >>"), (15, b"<< /doi (10.5555/in) >>")]
    offsets, data = [], b""
    for number, body in inner:
        offsets.append(b"%d %d" % (number, len(data)))
        data += body + b" "
    head = b" ".join(offsets) + b" "
    packed = stream(b"/Type /ObjStm /N 4 /First %d" % len(head), head + data)
    body = b"4 0 obj\n" + stream(b"", b"BT (10.5555/page) Tj ET") + b"\nendobj\n9 0 obj\n" + packed + b"\nendobj\n"
    raw = b"%PDF-1.7\n" + body + b"10 0 obj\n" + stream(b"/Type /XRef /Root 11 0 R /Info 15 0 R", b"x") + b"\nendobj"
    found = plainpdf.Pdf(raw)
    assert found.info() == {"/doi": "10.5555/in"} and found.page_text() == "10.5555/page" and found.xmp() is None


def test_damaged_and_encrypted_files(tmp_path):
    whole = made(b"BT (arXiv:2401.12345) Tj ET", b"/DOI (10.5555/a)", b"<x/>")
    for raw in (b"", b"text", made(b"", trailer=b"/Encrypt 9 0 R ")):
        with pytest.raises(plainpdf.Unreadable):
            plainpdf.Pdf(raw)
    rng = random.Random(1)
    for k in range(200):  # cut off and bitten anywhere: never an error of another kind
        raw = bytearray(whole[: rng.randrange(20, len(whole))] if k % 2 else whole)
        for _ in range(rng.randrange(4)):
            raw[rng.randrange(9, len(raw))] = rng.randrange(256)
        path = tmp_path / "bitten.pdf"
        path.write_bytes(bytes(raw))
        assert set(pdf.read_pdf(str(path))) == {"normalized_path", "info", "xmp", "page1_text"}
    assert pdf.read_pdf(str(tmp_path / "none.pdf"))["info"] is None


def test_documents_of_a_table(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(b"BT (10.5555/text) Tj ET", b"/DOI (10.5555/info)"))
    (tmp_path / "b.pdf").write_bytes(b"not one")
    rows = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.pdf", "b.pdf", "c.pdf")], "normalized_path string")
    got = {r.normalized_path[-5]: r for r in pdf.read_documents(rows).collect()}
    assert got["a"].info == {"/DOI": "10.5555/info"} and got["a"].page1_text == "10.5555/text"
    assert got["b"].info is None and got["c"].page1_text is None
