"""Text layers of PDF files made here, object by object."""

import zlib

import pytest

from foliant.sources import files, pdf

FONTS = {
    "F1": b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding/FirstChar 32/Widths[" + b"500 " * 224 + b"]>>",
    "F2": b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/uni0E01/fi 90/bullet]>>>>",
    "F3": b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</DW 1000/W[1[600 600] 3 5 700]>>]/ToUnicode 90 0 R>>",
}
MAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0001> <0003> <0E01> <0004> <0005> [<00410042> <0043>] endbfrange 1 beginbfchar <0010> <D83DDE00> endbfchar"


def stream(values, data, packed=True):
    data = zlib.compress(data) if packed else data
    return b"<<" + values + (b"/Filter/FlateDecode" if packed else b"") + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"


def made(contents, more=None, trailer=b"", box=b"[0 0 200 200]", bundled=False):
    """A file of one page for each content stream; bundled puts what isn't a stream in an object stream."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 90: stream(b"", MAP), **(more or {})}
    fonts = b"".join(b"/%s %s" % (k.encode(), v) for k, v in FONTS.items())
    kids = []
    for i, c in enumerate(contents):
        objects[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i)
        objects[11 + 2 * i] = c if c.startswith(b"<<") else stream(b"", c)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<</Type/Pages/MediaBox%s/Kids[%s]/Count %d/Resources<</Font<<%s>>/XObject<</I 80 0 R/X 81 0 R>>>>>>" % (box, b" ".join(kids), len(kids), fonts)
    if bundled:
        plain = {n: o for n, o in objects.items() if b"\nstream\n" not in o}
        head, body = b"", b""
        for n, o in plain.items():
            head += b"%d %d " % (n, len(body))
            body += o + b" "
        objects = {n: o for n, o in objects.items() if n not in plain}
        objects[95] = stream(b"/Type/ObjStm/N %d/First %d" % (len(plain), len(head)), head + body)
        objects[96] = stream(b"/Type/XRef/Root 1 0 R", b"")
    out = b"%PDF-1.5\n%\xff\xff\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return out + (b"" if bundled else b"trailer <</Root 1 0 R%s>>\n%%%%EOF" % trailer)


LINES = rb"BT /F1 10 Tf 14 TL 20 150 Td (First \(line\)) Tj T* [(Sec) -20 (ond) -600 (part)] TJ 0 -40 Td (After \141 gap\
) Tj ET"


@pytest.mark.parametrize("bundled", [False, True])
def test_rows_and_gaps(bundled):
    assert pdf.text_layer(made([LINES], bundled=bundled)) == [("First (line)\nSecond part\n\nAfter a gap", 0.0)]


def test_order_of_rows_and_places():
    side = b"BT /F1 10 Tf 1 0 0 1 100 50 Tm (right) Tj 1 0 0 1 20 52 Tm (left) Tj 1 0 0 1 20 90 Tm (above) Tj ET"
    assert pdf.text_layer(made([side]))[0][0] == "above\n\nleft right"
    moved = b"q 1 0 0 1 0 100 cm BT /F1 10 Tf 20 10 Td (up) Tj ET Q BT /F1 10 Tf 20 50 Td (down) Tj ET"
    assert pdf.text_layer(made([moved]))[0][0] == "up\n\ndown"


def test_fonts():
    assert pdf.text_layer(made([b"BT /F2 10 Tf 10 10 Td (AB Z) Tj ET"]))[0][0] == "กfi •"
    assert pdf.text_layer(made([b"BT /F3 10 Tf 10 10 Td <000100020003000400050010> Tj ET"]))[0][0] == "กขฃABC😀"
    assert pdf.text_layer(made([b"BT /F1 10 Tf 10 10 Td (\x93caf\xe9\x94) Tj ET"]))[0][0] == "“café”"
    assert pdf.text_layer(made([b"BT /F9 10 Tf 10 10 Td (no font) Tj ET"])) == [("", 0.0)]


def test_forms_and_images():
    more = {80: stream(b"/Subtype/Image/Width 1/Height 1", b"\0"), 81: stream(b"/Subtype/Form/Matrix[1 0 0 1 0 50]", b"BT /F1 10 Tf 10 10 Td (in a form) Tj ET /X Do")}
    assert pdf.text_layer(made([b"/X Do"], more))[0][0].startswith("in a form")
    assert pdf.text_layer(made([b"q 100 0 0 100 0 0 cm /I Do Q"], more)) == [("", 0.25)]


def test_filters():
    for coded in (stream(b"/Filter/ASCIIHexDecode", LINES.hex().encode() + b">", False), stream(b"/Filter[/A85/Fl]", __import__("base64").a85encode(zlib.compress(LINES)) + b"~>", False)):
        assert pdf.text_layer(made([coded]))[0][0].startswith("First (line)")
    rows = bytes([2, 10, 20, 2, 1, 1, 1, 5, 5, 0, 7, 8, 4, 1, 1, 3, 2, 2])
    assert list(pdf._unpredicted(rows, 2, 1)) == [10, 20, 11, 21, 5, 10, 7, 8, 8, 9, 6, 9]


def test_results():
    page = b"BT /F1 10 Tf 10 100 Td (Enough words on this page) Tj ET"
    picture = {80: stream(b"/Subtype/Image", b"\0")}
    text, figures = pdf.read_pdf(made([page, b"", b"q 200 0 0 200 0 0 cm /I Do Q", page], picture), "a.pdf", {})
    assert text == "# a.pdf\n\n## Page 1\n\nEnough words on this page\n\n## Page 4\n\nEnough words on this page\n"
    assert (figures["pages_total"], figures["pages_with_content"], figures["image_pages"], figures["pages_failed"]) == (4, 2, 1, 0)
    assert figures["warning"].startswith("1 image page(s) were not read (3)")
    text, figures = pdf.read_pdf(made([b"", b""]), "s.pdf", {})
    assert text.startswith("# s.pdf\n\n> No extractable text found on 2 page(s); this PDF appears to be scanned") and figures["warning"].startswith("OCR unavailable")
    broken = stream(b"/Filter/Unknown", b"x", False)
    text, figures = pdf.read_pdf(made([broken, page]), "b.pdf", {})
    assert "## Page 2" in text and figures["pages_failed"] == 1 and figures["pages_read"] == 1


@pytest.mark.parametrize("data, says", [
    (made([LINES], trailer=b"/Encrypt<</V 1>>"), "Password-protected"), (made([stream(b"/Filter/Unknown", b"x", False)]), "unreadable on all 1"), (b"%PDF-1.4\nnothing", "no pages"), (b"text", "no PDF file"),
])
def test_errors(data, says):
    got = files.convert_one("x/a.pdf", "pdf", data, {})
    assert not got["success"] and says in got["error"] and got["markdown"] is None


def test_damaged_files_end():
    whole = made([LINES, LINES], bundled=True)
    for cut in range(0, len(whole), 37):
        files.convert_one("a.pdf", "pdf", whole[:cut], {})
        files.convert_one("a.pdf", "pdf", whole[:cut] + b"\x80" + whole[cut + 1 :], {})
    circle = made([LINES]).replace(b"/Kids[10 0 R]", b"/Kids[2 0 R]")
    assert files.convert_one("a.pdf", "pdf", circle, {})["error"]
