"""Readers, scans, publishing and streams on files made here."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import kinds
from foliant.operators import layout, manifest, publish
from foliant.sources import encoding, files, images, legacy, office, web
from foliant.streaming import intake


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def docx():
    p = lambda text, style="", extra="", runs=None: f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{extra}</w:pPr>{runs or f"<w:r><w:t>{text}</w:t></w:r>"}</w:p>'
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("H9", "heading 9"), ("T", "Title"), ("ST", "Subtitle"), ("LB", "List Bullet"), ("LN", "List Number"), ("LP", "List Paragraph"), ("Q", "Quote"), ("C", "Code")))
    runs = '<w:r><w:t xml:space="preserve">plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">ld </w:t></w:r><w:r><w:rPr><w:b/><w:i/></w:rPr><w:t>both</w:t></w:r>'
    cell = lambda t, form="": f"<w:tc><w:tcPr>{form}</w:tcPr>{''.join(p(x) for x in t.split('/'))}</w:tc>"
    span, down, up = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    grid = f"<w:tbl><w:tr>{cell('a|b', span)}{cell('c', down)}</w:tr><w:tr>{cell('x/y')}{cell('z')}{cell('', up)}</w:tr></w:tbl>"
    level = '<w:numPr><w:ilvl w:val="1"/></w:numPr>'
    body = p("Title", "T") + p("Sub", "ST") + p("One", "H1") + p("Deep", "H9") + p("", runs=runs) + p("item", "LB") + p("inner", "LP", level) + p("first", "LN") + p("said", "Q") + p("x = 1", "C") + p("") + grid
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>"})


def test_docx():
    markdown, _ = office.read_docx(docx(), "d.docx", {})
    wanted = "# d.docx\n\n# Title\n\n## Sub\n\n# One\n\n###### Deep\n\nplain **bold** ***both***\n- item\n  - inner\n1. first\n> said\n`x = 1`\n\n| a\\|b | a\\|b | c |\n| --- | --- | --- |\n| x<br>y | z | c |\n"
    assert markdown == wanted
    assert "bold both" in office.read_docx(docx(), "d.docx", {"inline_styles": False})[0]


def pptx():
    text = lambda *rows: "<p:txBody>" + "".join(f'<a:p><a:pPr lvl="{n}"/><a:r><a:rPr b="{b}"/><a:t>{t}</a:t></a:r></a:p>' for n, b, t in rows) + "</p:txBody>"
    shape = lambda body, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{body}</p:sp>"
    grid = '<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></a:txBody></a:tc><a:tc/></a:tr></a:tbl></p:graphicFrame>'
    slide = lambda shapes: f"<p:sld {P}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    rel = lambda *rows: f"<Relationships {RELS}>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in rows) + "</Relationships>"
    one = slide(shape(text((0, 0, "Subject")), '<p:ph type="title"/>') + f"<p:grpSp>{shape(text((0, 1, '• point'), (2, 0, 'inner'), (9, 0, 'deep')))}</p:grpSp>" + grid)
    two = slide(shape(text((0, 0, "no holder"), (0, 0, "rest"))))
    notes = f'<p:notes {P}><p:cSld><p:spTree>{shape(text((0, 0, "say this")), chr(60) + "p:ph type=" + chr(34) + "body" + chr(34) + "/>")}</p:spTree></p:cSld></p:notes>'
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel(("a", "slides/slide1.xml"), ("b", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": two, "ppt/slides/slide2.xml": one, "ppt/slides/_rels/slide2.xml.rels": rel(("n", "../notesSlides/notesSlide1.xml")), "ppt/notesSlides/notesSlide1.xml": notes,
    })


def test_pptx():
    markdown, _ = office.read_pptx(pptx(), "s.pptx", {})
    assert markdown == "# s.pptx\n\n## Slide 1: Subject\n\n- **point**\n    - inner\n        - deep\n\n| h |  |\n| --- | --- |\n\n> Speaker notes: say this\n\n## Slide 2: no holder\n\n- rest\n".replace("- **point**", "- **• point**")


def xlsx(sheets, merges=""):
    books, rels, parts = "", "", {}
    for i, (name, state, rows) in enumerate(sheets, 1):
        books += f'<sheet name="{name}" sheetId="{i}" state="{state}" r:id="r{i}"/>'
        rels += f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>'
        body = "".join(f'<row r="{n}">{cells}</row>' for n, cells in rows)
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {S}><sheetData>{body}</sheetData>{merges}</worksheet>"
    styles = f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="10"/><xf numFmtId="2"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    return zipped({"xl/workbook.xml": f"<workbook {S}><sheets>{books}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships {RELS}>{rels}</Relationships>", "xl/styles.xml": styles, "xl/sharedStrings.xml": f"<sst {S}><si><t> shared </t></si></sst>", **parts})


def cells(n, *values):
    out = ""
    for c, v in enumerate(values):
        ref = f"{chr(65 + c)}{n}"
        if isinstance(v, tuple):
            out += f'<c r="{ref}" s="{v[1]}"><v>{v[0]}</v></c>'
        elif isinstance(v, str):
            out += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        elif v is not None:
            out += f'<c r="{ref}"><v>{v}</v></c>'
    return n, out


def test_xlsx():
    rows = [cells(1, "Report"), cells(3, "when", "share", "fixed", "n"), (4, '<c r="A4" s="1"><v>45292</v></c><c r="B4" s="2"><v>0.125</v></c><c r="C4" s="3"><v>1.5</v></c><c r="D4" t="s"><v>0</v></c>'), (5, '<c r="A5" s="4"><v>45292.5</v></c><c r="D5" t="b"><v>1</v></c>')]
    markdown, metrics = office.read_xlsx(xlsx([("Data", "visible", rows), ("Aside", "hidden", [cells(1, "x")])]), "b.xlsx", {})
    assert "> 1 hidden sheet(s) were not converted: `Aside`" in markdown
    assert "## Sheet: Data\n\nReport\n\n| when | share | fixed | n |\n| --- | --- | --- | --- |\n| 2024-01-01 | 12.50% | 1.50 | shared |\n| 2024-01-01 12:00:00 |  |  | true |\n" in markdown
    assert metrics == {"sheets_detected": 2, "rows_detected": 5, "rows_detected_is_exact": True, "rows_exported": 5, "truncated": False}
    assert "## Sheet: Aside" in office.read_xlsx(xlsx([("Aside", "hidden", [cells(1, "x")])]), "b.xlsx", {})[0]


def test_xlsx_merged_header():
    rows = [cells(1, "No.", "Period", None, "Note"), cells(2, None, "Mon", "Tue", None), cells(3, 1, "a", "b", "same"), cells(4, 2, "c", "d", None)]
    merges = '<mergeCells><mergeCell ref="A1:A2"/><mergeCell ref="B1:C1"/><mergeCell ref="D1:D2"/><mergeCell ref="D3:D4"/></mergeCells>'
    assert "| No. | Period / Mon | Period / Tue | Note |\n| --- | --- | --- | --- |\n| 1 | a | b | same |\n| 2 | c | d | same |" in office.read_xlsx(xlsx([("S", "visible", rows)], merges), "b.xlsx", {})[0]


@pytest.mark.parametrize("n,kept,truncated", [(9, 10, False), (10, 4, True), (40, 4, True)])
def test_csv_limits(n, kept, truncated):
    data = "\n".join(["a,b,c"] + [f"{i},x,y" for i in range(n)]).encode()
    markdown, metrics = office.read_csv(data, "t.csv", {"max_rows": 10, "sample_rows": 4})
    assert (metrics["rows_exported"], metrics["truncated"], metrics["rows_detected"]) == (kept, truncated, n + 1)
    assert ("Truncated" in markdown) == truncated


def test_csv_blank_tail():
    assert office.scanned([["a"], [""], ["b"], *([""] for _ in range(5))], 99)[1:] == (3, True)
    assert office.scanned([["a"], *([""] for _ in range(1500)), ["b"]], 99)[1:] == (1, False)
    assert office.read_csv("﻿a,b\n1,2\n".encode(), "t.csv", {})[0].startswith("## Sheet: t\n\n| a | b |")


def test_rtf():
    data = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\gen x;}Hello\par caf\'e9 \u8364?x\tab y\line z{\b in}\cell\row \{\}}"
    assert office.rtf_text(data).startswith("Hello\n\ncaf\u00e9 \u20acx\ty\nzin |\n{}")


PAGE = """<!DOCTYPE html><html><head><title> T <b>x</b></title><style>p{}</style><script>var a = '</p>';</script></head><body><nav>menu</nav><h1>Head <i>ing</i></h1>
<p>First <a href="/x">link</a><p>Second<br>line<!-- c --><ul><li>one<li>two <b>bold</b></ul><ol><li>x</ol><table><tr><th>a<th>b|c<tr><td>1</table>
<blockquote>q1<p>q2</blockquote><pre>a  b
 c</pre><img src="i.png" alt="I"><hr><code>k</code></body></html>"""


def test_html():
    markdown = web.html_to_markdown(PAGE, "f.html")
    for wanted in ("# Head ing", "[link](/x)", "Second", "- one\n- two  **bold**", "1. x", "| a | b\\|c |\n| --- | --- |\n| 1 |  |", "> q1\n> \n> q2", "```\na  b\n c\n```", "![I](i.png)", "---", "`k`"):
        assert wanted in markdown, (wanted, markdown)
    for gone in ("menu", "p{}", "var a", "<!--"):
        assert gone not in markdown
    assert web.html_to_markdown("<p>x", "dir/name.html") == "# name\n\nx\n"
    assert web.links(PAGE) == [("link", "/x")]
    assert web.html_to_markdown("<div>" * 5000 + "deep", "d.html").endswith("deep\n")


def test_mail():
    raw = "Subject: =?utf-8?b?4LiX4LiU4Liq4Lit4Lia?=\nFrom: a@b.c\nTo: d@e.f\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html; charset=utf-8\n\n<p>html</p>\n--B\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n4LiX4LiU4Liq4Lit4Lia\n--B\nContent-Type: text/csv\nContent-Disposition: attachment; filename=x.csv\n\na\n--B--\n"
    markdown = web.read_mail(raw.encode(), "m.eml")
    assert markdown.startswith("# ทดสอบ\n\n- **From:** a@b.c\n- **To:** d@e.f\n- **Date:**") and "\n\nทดสอบ\n\n## Attachments\n- x.csv\n" in markdown
    assert "_(no textual body found)_" in web.read_mail(b"Subject: x\nContent-Type: image/png\n\nzz", "m.eml")
    assert web.read_mail(b"Content-Type: text/html\n\n<p>only</p><p>page</p>", "m.eml").endswith("only\n\npage\n")


def test_encodings():
    assert encoding.decoded("ทดสอบ".encode("cp874"), ("utf-8", "cp874")) == "ทดสอบ"
    assert encoding.read_text("a​b﻿c‪d‫e".encode()) == "abcde"
    assert isinstance(encoding.decoded(bytes(range(128, 256))), str)


def test_text_files():
    assert files.read_json(b'{"a": [1, "\xe0\xb8\x81"]}', "x.json", {})[0] == '# x.json\n\n```json\n{\n  "a": [\n    1,\n    "ก"\n  ]\n}\n```\n'
    assert "> Warning: invalid JSON returned verbatim." in files.read_json(b"{oops", "x.json", {})[0]
    assert files.read_code(b"a ``` b\n\n", "x.py", {})[0] == "# x.py\n\n````python\na ``` b\n````\n"
    assert files.read_code(b"# md", "x.md", {})[0] == "# md\n"


def compound(streams):
    """A compound file whose streams are all long enough for whole sectors."""
    size, sectors, chain, entries = 512, [], [], []
    fat_at = 0
    sectors.append(b"")  # the allocation table, filled in last
    chain.append(0xFFFFFFFD)

    def put(data):
        first = len(sectors)
        parts = [data[i : i + size].ljust(size, b"\0") for i in range(0, max(len(data), 1), size)]
        sectors.extend(parts)
        chain.extend([*range(first + 1, first + len(parts)), 0xFFFFFFFE])
        return first

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append((name, 2, put(data), len(data)))
    folder = b"".join(name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB12x36xIQ", 2 * len(name) + 2, kind, 1, first, length) for name, kind, first, length in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries])
    folder_at = put(folder)
    sectors[fat_at] = struct.pack("<128I", *chain, *[0xFFFFFFFF] * (128 - len(chain)))
    head = legacy.SIGNATURE + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, 1, folder_at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, fat_at)
    return head.ljust(512, b"\xff")[:512] + b"".join(sectors)


def word97(text, paragraphs=None, runs=None):
    """A file of two pieces, one of a byte a character; paragraphs and runs: (characters, style, properties) in order."""
    main = bytearray(4096)
    struct.pack_into("<HH", main, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", main, 10, 0x0200)
    struct.pack_into("<i", main, 0x4C, len(text))
    half = len(text) // 2
    a, b = text[:half].encode("cp1252"), text[half:].encode("utf-16-le")
    body = bytes(main) + a
    body += b"\0" * (len(body) % 2)
    second = len(body)
    pieces = struct.pack("<3i", 0, half, len(text)) + struct.pack("<HIH", 0, (4096 * 2) | 0x40000000, 0) + struct.pack("<HIH", 0, second, 0)
    table = b"\x01\x02\x00zz\x02" + struct.pack("<I", len(pieces)) + pieces
    data = bytearray(body + b)
    struct.pack_into("<II", data, 0x01A2, 0, len(table))
    place = lambda i: 4096 + i if i < half else second + 2 * (i - half)
    for at, width, entries in ((0x0102, 13, paragraphs), (0x00FA, 1, runs)):
        if entries is None:
            continue
        page, bounds, end, top = bytearray(512), [0], 510, 4 * (len(entries) + 1)
        for k, (n, style, given) in enumerate(entries):
            bounds.append(bounds[-1] + n)
            body = b"".join(struct.pack("<HB" if c >> 13 < 2 else "<HH", c, v) for c, v in given) + (struct.pack("<HH", 0xD608, 3) + b"zz" if style == 0 and width == 13 else b"")
            body = struct.pack("<H", style) + body if width == 13 else body
            body += b"\0" * (len(body) % 2) if width == 13 else b""
            entry = (b"\0" + bytes([len(body) // 2]) if width == 13 else bytes([len(body)])) + body
            end = (end - len(entry)) // 2 * 2
            page[end : end + len(entry)] = entry
            page[top + width * k] = end // 2
        struct.pack_into(f"<{len(bounds)}I", page, 0, *map(place, bounds))
        page[511] = len(entries)
        data += b"\0" * (-len(data) % 512)
        struct.pack_into("<II", data, at, len(table), 12)
        table += struct.pack("<III", place(0), place(bounds[-1]), len(data) // 512)
        data += page
    return compound({"WordDocument": bytes(data), "1Table": table})


def test_doc():
    text = "First line\rField \x13 HYPERLINK x \x14shown\x15 here\rh1\x07h2\x07\x07a\x07b|c\x07\x07Last\r"
    assert legacy.read_doc(word97(text), "w.doc", {})[0] == "# w.doc\n\nFirst line\n\nField shown here\n\n| h1 | h2 |\n| --- | --- |\n| a | b\\|c |\n\nLast\n"
    assert legacy.read_doc(rb"{\rtf1 hello}", "w.doc", {})[0] == "# w.doc\n\nhello\n"
    with pytest.raises(ValueError):
        legacy.read_doc(b"nothing", "w.doc", {})


def test_doc_formats():
    cell, end = [(legacy.IN_TABLE, 1)], [(legacy.IN_TABLE, 1), (legacy.ROW_END, 1)]
    parts = [("Title\r", 2, []), ("one\r", 0, [(legacy.LIST, 3)]), ("two\r", 0, [(legacy.LIST, 3), (legacy.LEVEL, 1)]), ("h1\x07", 0, cell), ("h2\x07", 0, cell), ("h3\x07", 0, cell), ("\x07", 0, end),
             ("a\x07", 0, cell), ("\x07", 0, cell), ("c\r", 0, cell), ("d\x07", 0, cell), ("\x07", 0, end), ("a\tbold\xa0word and it\r", 0, [])]
    text = "".join(t for t, _, _ in parts)
    lead = len(text) - len("bold\xa0word and it\r")
    runs = [(lead, 0, []), (9, 0, [(legacy.BOLD, 1)]), (5, 0, []), (2, 0, [(legacy.ITALIC, 0x81)]), (1, 0, [(legacy.BOLD, 0x80)])]
    got = legacy.read_doc(word97(text, [(len(t), style, given) for t, style, given in parts], runs), "w.doc", {})[0]
    assert got == "# w.doc\n\n## Title\n\n- one\n  - two\n| h1 | h2 | h3 |\n| --- | --- | --- |\n| a |  | c<br>d |\n\na **bold word** and *it*\n"
    thai = "x ที่ ดี y\r"
    pad = "." * len(thai) + "\r"
    runs = [(len(pad) + 2, 0, []), (1, 0, [(legacy.BOLD, 1)]), (len(thai) - 3, 0, [])]
    assert "x **ที่** ดี y" in legacy.read_doc(word97(pad + thai, None, runs), "w.doc", {})[0]
    assert legacy.plain("\ud83d\ude00 a\x1eb\x13") == "😀 a-b" and legacy.plain("\ud83d") == "�"


def test_ppt():
    record = lambda kind, body, form=0: struct.pack("<HHI", form, kind, len(body)) + body
    old = record(legacy.SLIDE, record(legacy.DRAWING_TEXT, record(legacy.BYTES, b"stale"), 0xF), 0xF)
    new = record(legacy.SLIDE, record(legacy.DRAWING_TEXT, record(legacy.CHARS, "กล่อง\rtwo".encode("utf-16-le")), 0xF), 0xF)
    listed = record(legacy.SLIDE_LIST, record(legacy.SLIDE_PERSIST, struct.pack("<I16x", 2)) + record(legacy.BYTES, b"Title"), 0xF)
    document = record(legacy.DOCUMENT, listed, 0xF)
    stream = bytes(8) + old
    at_document = len(stream)
    stream += document
    at_first = len(stream)
    stream += record(legacy.PERSIST_DIRECTORY, struct.pack("<III", (2 << 20) | 1, at_document, 8))
    edit1 = len(stream)
    stream += record(legacy.USER_EDIT, struct.pack("<II III", 0, 0, 0, at_first, 1))
    at_new = len(stream)
    stream += new
    at_second = len(stream)
    stream += record(legacy.PERSIST_DIRECTORY, struct.pack("<II", (1 << 20) | 2, at_new))
    edit2 = len(stream)
    stream += record(legacy.USER_EDIT, struct.pack("<II III", 0, 0, edit1, at_second, 1))
    user = bytes(16) + struct.pack("<I", edit2)
    assert legacy.read_ppt(compound({"PowerPoint Document": stream, "Current User": user}), "s.ppt", {})[0] == "# s.ppt\n\n## Slide 1: Title\n\n- กล่อง\n- two\n"


GREYS = b"".join(bytes([i, i, i, 0]) for i in range(256))
#: Images of 7 x 5 pixels, header only, with their mode.
PIXELS = {
    "png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBB", 7, 5, 8, 6), "RGBA"),
    "jpeg": (b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HHB", 5, 7, 3), "RGB"),
    "gif": (b"GIF89a" + struct.pack("<HHBBB", 7, 5, 0x80, 0, 0) + bytes(3) + b"\xff\0\0" + b"!\xf9\x02ab\0," + bytes(9), "P"),
    "gif of greys": (b"GIF87a" + struct.pack("<HHBBB", 7, 5, 0x80, 0, 0) + bytes(3) + b"\1\1\1" + b"," + bytes(9), "L"),
    "bmp": (b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 7, -5, 1, 24) + bytes(24), "RGB"),
    "bmp of greys": (b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 7, 5, 1, 8) + bytes(24) + GREYS, "L"),
    "webp": (b"RIFF\0\0\0\0WEBPVP8X" + bytes(4) + b"\x10\0\0\0" + b"\6\0\0\4\0\0", "RGBA"),
    "webp lossless": (b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 6 | 4 << 14), "RGB"),
    "webp lossy": (b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 7, 5), "RGB"),
    "tiff": (b"MM\0*" + struct.pack(">IH", 8, 4) + struct.pack(">HHIHH", 256, 3, 1, 7, 0) + struct.pack(">HHII", 257, 4, 1, 5) + struct.pack(">HHII", 258, 3, 3, 0) + struct.pack(">HHIHH", 277, 3, 1, 3, 0), "RGB"),
}


def test_image_headers():
    for name, (data, mode) in PIXELS.items():
        assert images.header(data) == (name.split()[0], 7, 5, mode)
        for cut in range(len(data) - 1):  # a cut header is an error of its own kind, or still enough
            try:
                images.header(data[:cut])
            except ValueError:
                pass
    assert images.read_image(PIXELS["jpeg"][0], "a.jpg", {})[0].startswith("# a.jpg\n\n- **Type:** image (jpeg)\n- **Dimensions:** 7 x 5\n- **Mode:** RGB\n")
    with pytest.raises(ValueError):
        images.header(b"")


def test_images(spark, tmp_path):
    for name, data in {"i.png": PIXELS["png"][0], "bad.gif": b"GIF89a", "p.html": b"<html><p>x</html>"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.source.rsplit("/", 1)[-1]: r for r in files.converted(files.detections(files.scan(spark, str(tmp_path)))).collect()}
    assert {n for n, r in rows.items() if not r.success} == {"bad.gif"} and rows["bad.gif"].error == "ValueError: a broken gif image"
    assert "- **Dimensions:** 7 x 5\n- **Mode:** RGBA" in rows["i.png"].markdown and rows["i.png"].warning == "OCR unavailable: no OCR engine is installed"
    assert "warning" not in rows["i.png"].metrics and rows["p.html"].warning is None


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    made = {"d.docx": docx(), "s.pptx": pptx(), "b.xlsx": xlsx([("S", "visible", [cells(1, "a", "b", "c"), cells(2, 1, 2, 3)])]), "t.csv": b"a,b,c\n1,2,3\n", "p.html": PAGE.encode(), "x.json": b"{}", "c.py": b"print(1)\n\n\n\n# end\n",
            "bad.docx": b"PK\x03\x04 broken", "f.pdf": b"%PDF-1.4", "note.md": b"# old", "sub/D.html": b"<html><p>same   name</html>", "out/r.html": b"<html>result", "e.txt": b""}
    for name, body in made.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
    return str(root)


def test_conversion(spark, folder):
    found = files.scan(spark, folder, output=f"{folder}/out")
    results = files.converted(files.detections(found)).cache()
    rows = {r.source.rsplit("/", 1)[-1]: r for r in results.collect()}
    assert set(rows) == {"d.docx", "s.pptx", "b.xlsx", "t.csv", "p.html", "x.json", "c.py", "bad.docx", "f.pdf", "D.html"}
    assert {n for n, r in rows.items() if not r.success} == {"bad.docx", "f.pdf"}
    assert rows["d.docx"].confidence == "magic-zip" and rows["f.pdf"].error == "ValueError: the PDF has no pages"
    assert rows["c.py"].markdown == "# c.py\n\n```python\nprint(1)\n\n\n\n# end\n```\n" and rows["D.html"].markdown == "# D\n\nsame name\n"
    assert rows["b.xlsx"].metrics["rows_detected"] == "2"
    with pytest.raises(ValueError):
        files.scan(spark, " ")
    reasons = {r.path: r.reject_reason for r in files.intake(spark.createDataFrame([("a.mp3",), ("b.md",), ("c.zzz",), ("d.pdf",)], "path string")).collect()}
    assert reasons == {"a.mp3": "audio and video are not read", "b.md": "a result", "c.zzz": "unsupported kind", "d.pdf": None}
    twice = spark.createDataFrame([(1, "/A/x"), (2, "/a/X"), (3, "/b")], "n int, path string")
    assert sorted(r.path for r in files.without_repeats(twice, "n").collect()) == ["/A/x", "/b"]


def test_publishing(spark, folder, tmp_path):
    results = files.converted(files.detections(files.scan(spark, folder, output=f"{folder}/out"))).withColumns({"duration_s": F.lit(0.5), "output": F.lit(None).cast("string")})
    out = f"file://{tmp_path}/out"
    named = publish.named(results.filter("success"), "source").withColumn("chunks", F.array(F.lit("one"), F.lit("two")))
    first = publish.publish(named, out).collect()
    assert all(r.outcome == "written" for r in first) and (tmp_path / "out" / "d.part002.md").read_text() == "two"
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name.lower().startswith("d") and ".part" not in p.name} == {"d.md", "D-1.md"}
    publish.publish(named, out).collect()
    assert (tmp_path / "out" / "t-1.md").exists()
    assert all("FileExists" in r.outcome for r in publish.publish(named, out, "fail").collect())
    with pytest.raises(ValueError):
        publish.publish(named, out, "other")
    where = publish.write_bundle(results, f"{tmp_path}/bundle", "source", target="t", created_at=F.lit("2024-01-01T00:00:00+00:00"))
    written = json.loads(open(where).read())
    assert written["schema"] == "1.1" and written["document_count"] == 8 == len(written["documents"]) and "warning" not in written["documents"][0]
    assert all((tmp_path / "bundle" / d["file"]).exists() for d in written["documents"])
    assert written["total_tokens"] == sum(d["tokens"] for d in written["documents"])
    with pytest.raises(FileExistsError):
        publish.write_bundle(results, f"{tmp_path}/bundle", "source")
    assert publish.drop(results, f"{tmp_path}/inbox", "source").endswith("/manifest.json")
    publish.write_report(results, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").filter("status = 'Error'").count() == 2
    assert publish.joined_text(results.filter("success"), "source").first().text.count("\n---\n") == 8
    lines = manifest.savings_lines(manifest.savings(results.withColumn("original_size", F.lit(2048).cast("long")))).collect()
    assert all("2.0 KB" in r.line and r.line.endswith("%") for r in lines)


def test_savings_lines_whole(spark):
    """Whole lines of all documents with their own sizes, and shares on and near halves of a digit."""

    def shown(n):
        for unit, by in (("B", 1), ("KB", 1024), ("MB", 1024**2)):
            if n < by * 1024:
                return f"{n} B" if by == 1 else f"{n / by:.1f} {unit}"

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL").selectExpr("'/in/' || doc_id || '.txt' AS source", "true AS success", "text AS markdown", "CAST(octet_length(text) + pmod(doc_id * 37, 4000) AS BIGINT) AS original_size")
    odd = spark.range(0, 4000).selectExpr("'/in/n' || id || '.txt' AS source", "true AS success", "repeat('x', CAST(id AS INT)) AS markdown", "CAST(4000 AS BIGINT) AS original_size")
    rows = manifest.savings(docs.unionByName(odd))
    got = {r.name: r.line for r in manifest.savings_lines(rows).collect()}
    found = rows.collect()
    assert len(got) == len(found) >= 4000 + docs.count() and docs.count() > 150
    for r in found:
        assert r.saved_ratio == pytest.approx(max(0.0, (1 - r.markdown_size / r.original_size) * 100) if r.original_size else 0.0, abs=1e-12)
        assert got[r.name] == f"{r.name:<28}{shown(r.original_size):>12}{shown(r.markdown_size):>12}{f'~{r.tokens:,}':>10}{f'{r.saved_ratio:.1f}%':>8}"


def test_streams(spark, folder, tmp_path):
    stream = intake.converted(intake.without_copies(intake.file_stream(spark, folder)))
    run = intake.to_tables(stream.select("source", "kind", "success", "markdown"), f"{tmp_path}/t", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = files.converted(files.detections(files.scan(spark, folder)))
    got = {(r.source, r.markdown) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert got == {(r.source, r.markdown) for r in batch.collect()}
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events").schema).parquet(f"{tmp_path}/events")
    counted = intake.tokens_by_window(intake.sanitized(events, "props"), "ts", "1 day", key="event_type")
    run = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("documents")).first()[0] == spark.read.parquet(f"{tmp_path}/events").count()


def test_options(tmp_path):
    assert files.Options(max_rows=0, ocr_dpi=9999) == files.Options(max_rows=1, ocr_dpi=600)
    assert files.preset_of(files.PRESETS["Fast Text"]) == "Fast Text" and files.preset_of(files.Options(max_rows=5)) == "Custom"
    (tmp_path / "a.toml").write_text('max_rows = 7\nunknown = 1\nocr_lang = "eng"\n')
    (tmp_path / "b.toml").write_text("max_rows = = 1")
    assert files.read_options(str(tmp_path / "a.toml")) == (files.Options(max_rows=7, ocr_lang="eng"), "")
    assert files.read_options(str(tmp_path / "b.toml"))[0] == files.Options() and files.read_options(str(tmp_path / "b.toml"))[1]


def test_layout(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, "abcd", 90.0), (1, 1.0, 1.0, 10.0, 10.0, "ab", 80.0), (1, 20.0, 0.0, 30.0, 10.0, "x", 10.0), (2, 0.0, 0.0, 5.0, 5.0, "y", 50.0)], "page int, x0 double, y0 double, x1 double, y1 double, text string, conf double")
    assert sorted(r.text for r in layout.suppressed(boxes, ["page"]).collect()) == ["abcd", "x", "y"]
    assert {r.page: r.area for r in layout.covered_areas(boxes, ["page"]).collect()} == {1: 200.0, 2: 25.0}
    assert layout.union_area([(0, 0, 4, 4), (2, 2, 6, 6), (0, 0, 1, 1)]) == 28
    fragments = spark.createDataFrame([(1, 10.0, 8.0, 50.0, "b"), (1, 12.0, 8.0, 0.0, "a"), (1, 30.0, 8.0, 0.0, "c"), (1, 15.0, 8.0, 90.0, "d")], "page int, y double, height double, x double, text string")
    assert [r.text for r in layout.clustered_rows(fragments, ["page"]).orderBy("row_no").collect()] == ["a b", "d", "c"]


def test_heads_of_other_encodings(spark):
    """A head cut inside a character, or not in UTF-8, is still read for its marks."""
    thai = "<!DOCTYPE html>" + "ภาษาไทย" * 2000
    rows = [(f"p{k}", " ".encode() * k + thai.encode()) for k in range(4)]
    rows += [("cp874", thai.encode("cp874")), ("latin", "#!/bin/sh\n# café".encode("latin-1")), ("short", b"<html>\xe0\xb8"), ("blob", bytes(range(256)) * 8)]
    frame = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "path string, content binary")
    got = {r.path: r.k.kind for r in frame.select("path", kinds.detected(F.col("path"), F.col("content")).alias("k")).collect()}
    assert got == {"p0": "html", "p1": "html", "p2": "html", "p3": "html", "cp874": "html", "latin": "code", "short": "html", "blob": "unknown"}


def test_equal_words_stay_apart(spark):
    from foliant.operators import layout

    words = spark.createDataFrame([(1, 5, 5, 2, 2, "a"), (1, 5, 5, 2, 2, "a")], "page int, left int, top int, width int, height int, text string")
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 10)], "page int, r int, c int, x0 int, y0 int, x1 int, y1 int")
    assert layout.words_to_cells(words, cells, ["page"], "left").count() == 2


def test_names_of_mixed_families(spark):
    """Generated and natural names meet: as by going through all documents in order."""
    import random

    from foliant.functions import names

    rng = random.Random(3)
    stems = [rng.choice(["a", "A", "a-1", "a-1-1", "a-2", "b", "b-7", "c", "C"]) for _ in range(300)] + [f"d-{i}" for i in range(50)] + ["e"] * 50
    used, wanted = set(), {}
    for i, stem in enumerate(stems):
        n = 0
        while (name := f"{stem}-{n}" if n else stem).lower() in used:
            n += 1
        used.add(name.lower())
        wanted[i] = f"{name}.md"
    frame = spark.createDataFrame(list(enumerate(stems)), "n long, stem string").repartition(3)
    assert {r.n: r.file for r in names.unique_names(frame, "stem", "n").collect()} == wanted
