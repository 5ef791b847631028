"""Binary workbooks made here, record by record."""

import struct

import pytest
from test_sources import compound

from foliant.sources import biff, files


def record(kind, body=b"", fmt=None, *values):
    body = struct.pack(fmt, *values) + body if fmt else body
    return struct.pack("<HH", kind, len(body)) + body


def wide(text):
    return struct.pack("<HB", len(text.encode("utf-16-le")) // 2, 1) + text.encode("utf-16-le")


def cell(kind, row, column, body, style=0):
    return record(kind, struct.pack("<HHH", row, column, style) + body)


SHARED = ["name", "ราคา", "split by a record", "a|b", "rich"]
#: The table of strings, cut among the third one's characters, which go on as wide ones; the last has form runs.
TABLE = [struct.pack("<II", 9, 5) + struct.pack("<HB", 4, 0) + b"name" + wide("ราคา") + struct.pack("<HB", 17, 0) + b"split ", b"\x01" + "by a record".encode("utf-16-le") + wide("a|b") + struct.pack("<HBH", 4, 8, 2) + b"rich" + bytes(8)]


def workbook(sheets, early=False, extra=b"", table=TABLE):
    bof = lambda what: record(0x809, b"", "<HHHHII", 0x600, what, 0, 0, 0, 0)
    styles = b"".join(record(0xE0, bytes(16), "<HH", 0, f) for f in (0, 14, 10, 164, 21))
    formats = record(0x41E, struct.pack("<H", 164) + wide('yyyy"y"'))
    strings = record(0xFC, table[0]) + b"".join(record(0x3C, t) for t in table[1:])
    head = lambda places: bof(5) + extra + record(0x22, b"", "<H", early) + formats + styles + b"".join(
        record(0x85, struct.pack("<IBB", at, hidden, 0) + struct.pack("<BB", len(name), 0) + name.encode()) for at, (name, hidden, _) in zip(places, sheets, strict=True)) + strings + record(0x0A)
    at, places, bodies = len(head([0] * len(sheets))), [], b""
    for _, _, cells in sheets:
        places.append(at + len(bodies))
        bodies += bof(0x10) + cells + record(0x0A)
    return compound({"Workbook": head(places) + bodies})


def shared(row, column, n):
    return cell(0xFD, row, column, struct.pack("<I", n))


CELLS = (
    shared(0, 0, 0) + shared(0, 1, 1) + shared(0, 2, 2) + shared(0, 3, 3)
    + cell(0x203, 1, 0, struct.pack("<d", 2.5)) + cell(0x27E, 1, 1, struct.pack("<I", (7 << 2) | 2)) + cell(0x27E, 1, 2, struct.pack("<I", (1234 << 2) | 3)) + cell(0x205, 1, 3, b"\x07\x01")
    + cell(0x203, 2, 0, struct.pack("<d", 45000.5), 1) + cell(0x203, 2, 1, struct.pack("<d", 0.125), 2) + cell(0x203, 2, 2, struct.pack("<d", 45000), 3) + cell(0x203, 2, 3, struct.pack("<d", 0.25), 4)
    + record(0xBD, struct.pack("<HH", 3, 0) + struct.pack("<HIHI", 0, ((-3 & 0x3FFFFFFF) << 2) | 2, 0, struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32) + struct.pack("<H", 1)) + cell(0x205, 3, 2, b"\x01\x00") + shared(3, 3, 4)
    + cell(0x06, 4, 0, struct.pack("<d", 9.0) + bytes(8)) + cell(0x06, 4, 1, b"\x00" + bytes(5) + b"\xff\xff" + bytes(8)) + record(0x207, wide("made")) + cell(0x06, 4, 2, b"\x01\x00\x00\x00\x00\x00\xff\xff" + bytes(8)) + cell(0x06, 4, 3, b"\x02\x00\x2a\x00\x00\x00\xff\xff" + bytes(8))
    + cell(0x204, 6, 0, struct.pack("<HB", 3, 0) + b"old")
)


def test_cells():
    text, figures = biff.read_xls(workbook([("One", 0, CELLS)]), "w.xls", {})
    assert text.splitlines() == [
        "# w.xls", "", "## Sheet: One", "", "| name | ราคา | split by a record | a\\|b |", "| --- | --- | --- | --- |", "| 2.5 | 7 | 12.34 | #DIV/0! |", "| 2023-03-15 12:00:00 | 12.50% | 2023-03-15 | 06:00:00 |",
        "| -3 | 1.5 | true | rich |", "| 9 | made | false | #N/A |", "| old |  |  |  |",
    ]
    assert figures["rows_detected"] == 7 and figures["sheets_detected"] == 1


def test_sheets_and_merges():
    merged = record(0xE5, struct.pack("<H4H", 1, 0, 1, 0, 0))
    block = shared(0, 0, 0) + shared(0, 1, 1) + shared(0, 2, 2) + shared(1, 1, 3) + shared(1, 2, 4) + shared(2, 0, 0) + shared(2, 1, 1) + shared(2, 2, 4)
    book = workbook([("Seen", 0, block + merged), ("Gone", 1, shared(0, 0, 0))])
    text, _ = biff.read_xls(book, "w.xls", {})
    assert "> 1 hidden sheet(s) were not converted: `Gone`." in text and "| name | ราคา / a\\|b | split by a record / rich |" in text
    assert "## Sheet: Gone" in biff.read_xls(book, "w.xls", {"include_hidden_sheets": True})[0]
    early = biff.read_xls(workbook([("A", 0, cell(0x203, 0, 0, struct.pack("<d", 1.0), 1))], early=True), "w.xls", {})[0]
    assert "1904-01-02" in early
    chart = record(0x809, b"", "<HHHHII", 0x600, 0x20, 0, 0, 0, 0) + shared(5, 5, 0) + record(0x0A)
    assert biff.read_xls(workbook([("A", 0, chart + shared(0, 0, 1))]), "w.xls", {})[0].endswith("| ราคา |\n| --- |\n")
    assert biff.read_xls(workbook([("A", 0, b"")]), "w.xls", {})[0] == "# w.xls\n\n## Sheet: A\n\n_(empty sheet)_\n"


@pytest.mark.parametrize("data, says", [
    (workbook([("A", 0, b"")], extra=record(0x2F, bytes(6))), "protected by a password"), (compound({"Other": b"x"}), "no workbook"), (compound({"Workbook": bytes(8)}), "not a workbook"),
    (workbook([("A", 0, b"")], table=TABLE[:1]), "ends early"),
])
def test_errors(data, says):
    got = files.convert_one("a.xls", "xlsx", data, {})
    assert not got["success"] and says in got["error"]


def test_by_kind():
    got = files.convert_one("x/a.xls", "xlsx", workbook([("A", 0, CELLS)]), {"max_rows": 3, "sample_rows": 2})
    assert got["success"] and got["engine"] == "sheets" and "Truncated Summary" in got["markdown"] and got["metrics"]["truncated"] == "true"
