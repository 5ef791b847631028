"""Binary workbooks (.xls): values as they were last computed, number formats and merged cells."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

from foliant.sources.legacy import Compound
from foliant.sources.office import BLANK_RUN, BUILT_IN, MOST_COLUMNS, book_markdown, is_date, shown

#: Types of records.
BOF, EOF, SHEET, STRINGS, MORE, FORMAT, STYLE, EPOCH, LOCK, CODEPAGE = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22, 0x2F, 0x42
SHARED, NUMBER, SHORT, SHORTS, LABEL, RICH, TRUTH, FORMULA, RESULT, MERGES = 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0xD6, 0x205, 0x06, 0x207, 0xE5
#: What codes of errors show; code pages that have other names.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
CODECS = {1200: "utf-16-le", 10000: "mac_roman", 32768: "mac_roman", 32769: "cp1252"}
GENERAL, WORKSHEET, GLOBALS, NEW = "General", 0, 5, 0x600


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


class Parts:
    """Bytes of a record and of those that go on with it."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.at = iter(parts), 0
        self.part = next(self.parts)

    def left(self) -> int:
        return len(self.part) - self.at

    def on(self) -> None:
        """To the next record's bytes."""
        self.part, self.at = next(self.parts, b""), 0
        if not self.part:
            raise ValueError("the table of strings ends early")

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if not self.left():
                self.on()
            got = self.part[self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
        return out

    def text(self) -> str:
        """A string; where a record ends among its characters the next one starts with their width."""
        length, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, size = [], 1 + (flags & 1)
        while length:
            if self.left() < size:
                self.on()
                size = 1 + (self.take(1)[0] & 1)
            n = min(length, self.left() // size)
            out.append(self.take(n * size).decode("utf-16-le" if size == 2 else "latin-1", "surrogatepass"))
            length -= n
        self.take(4 * runs + extra)
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def short(raw: int) -> float:
    """A number in 30 bits: whole, or the upper bits of a double, maybe in hundredths."""
    value = float((raw >> 2) - (1 << 30 if raw & 1 << 31 else 0)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))[0]
    return value / 100 if raw & 1 else value


class Book:
    def __init__(self, data: bytes):
        files = Compound(data)
        name = next((n for n in ("Workbook", "Book") if n in files.entries), None)
        if name is None:
            raise ValueError("no workbook in this file")
        self.data = files.read(name)
        self.strings, self.styles, self.sheets, self.codec = [], [], [], "cp1252"
        formats, early, pending = dict(BUILT_IN), False, []
        all_ = records(self.data)
        kind, body = next(all_, (0, b""))
        if kind != BOF or struct.unpack_from("<H", body, 2)[0] != GLOBALS:
            raise ValueError("not a workbook of Excel 5 or later")
        self.new = struct.unpack_from("<H", body)[0] == NEW
        for kind, body in all_:
            if kind == MORE and pending:
                pending.append(body)
            elif kind == LOCK:
                raise ValueError("the workbook is protected by a password")
            elif kind == EOF:
                break
            elif kind == CODEPAGE:
                page = struct.unpack_from("<H", body)[0]
                self.codec = CODECS.get(page, f"cp{page}")
            elif kind == STRINGS:
                pending = [body]
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", body)[0]] = self.text(body[2:], 2 if self.new else 1)
            elif kind == STYLE:
                self.styles.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == EPOCH:
                early = struct.unpack_from("<H", body)[0] == 1
            elif kind == SHEET:
                place, hidden, what = struct.unpack_from("<IBB", body)
                if what == WORKSHEET:
                    self.sheets.append((self.text(body[6:], 1).strip(), hidden & 3 == 0, place))
        self.formats = [formats.get(f, GENERAL) for f in self.styles]
        self.epoch = dt.datetime(1904, 1, 1) if early else dt.datetime(1899, 12, 30)
        if pending:
            parts = Parts(pending)
            _, count = struct.unpack("<II", parts.take(8))
            self.strings = [parts.text() for _ in range(count)]

    def text(self, body: bytes, width: int) -> str:
        """A string whose length takes so many bytes."""
        length, rest = int.from_bytes(body[:width], "little"), body[width:]
        if not self.new:
            return rest[:length].decode(self.codec, "replace")
        return rest[1 : 1 + 2 * length].decode("utf-16-le", "replace") if rest[0] & 1 else rest[1 : 1 + length].decode("latin-1")

    def number(self, value: float, style: int) -> object:
        number_format = self.formats[style] if style < len(self.formats) else GENERAL
        if is_date(number_format):
            try:
                moment = self.epoch + dt.timedelta(seconds=round(value * 86400))
            except OverflowError:
                return shown(value, number_format)
            return shown(moment.time() if value < 1 else moment)
        return shown(value, number_format)

    def content(self, place: int) -> tuple[list[list], list[tuple[int, int, int, int]]]:
        """Rows, those left out being empty, and merges from 1."""
        cells: dict[int, dict[int, object]] = {}
        merges, waiting, depth = [], None, 0

        def put(row: int, column: int, value: object) -> None:
            if value is not None and value != "" and column < MOST_COLUMNS:
                cells.setdefault(row, {})[column] = value

        for kind, body in records(self.data, place):
            if kind == BOF:
                depth += 1  # a chart inside the sheet has records of its own
            elif kind == EOF:
                depth -= 1
                if not depth:
                    break
            elif depth != 1:
                continue
            elif kind == MERGES:
                ranges = struct.iter_unpack("<4H", body[2 : 2 + 8 * struct.unpack_from("<H", body)[0]])
                merges += [(r1 + 1, c1 + 1, r2 + 1, min(c2 + 1, MOST_COLUMNS)) for r1, r2, c1, c2 in ranges]
            elif kind == RESULT and waiting:
                put(*waiting, shown(self.text(body, 2)))
                waiting = None
            elif kind == SHORTS:
                row, column = struct.unpack_from("<HH", body)
                for i, (style, raw) in enumerate(struct.iter_unpack("<HI", body[4 : 4 + (len(body) - 6) // 6 * 6])):
                    put(row, column + i, self.number(short(raw), style))
            elif kind in (SHARED, NUMBER, SHORT, LABEL, RICH, TRUTH, FORMULA):
                row, column, style = struct.unpack_from("<HHH", body)
                if kind == FORMULA and body[12:14] == b"\xff\xff":
                    waiting = (row, column) if body[6] == 0 else None
                    put(row, column, {1: bool(body[8]), 2: ERRORS.get(body[8], "#ERR")}.get(body[6]))
                else:
                    put(row, column, self.value(kind, body, style))
        rows, at = [], -1
        for row in sorted(cells):
            rows += [[] for _ in range(min(row - at - 1, BLANK_RUN))]
            rows.append([cells[row].get(c) for c in range(max(cells[row]) + 1)])
            at = row
        return rows, merges

    def value(self, kind: int, body: bytes, style: int) -> object:
        if kind == SHARED:
            return shown(self.strings[struct.unpack_from("<I", body, 6)[0]])
        if kind in (LABEL, RICH):
            return shown(self.text(body[6:], 2))
        if kind == TRUTH:
            return ERRORS.get(body[6], "#ERR") if body[7] else bool(body[6])
        return self.number(short(struct.unpack_from("<I", body, 6)[0]) if kind == SHORT else struct.unpack_from("<d", body, 6)[0], style)


def read_xls(data: bytes, name: str, options: dict) -> tuple[str, dict]:
    book = Book(data)
    return book_markdown(name, [(title, seen, lambda p=p: book.content(p)) for title, seen, p in book.sheets], options)
