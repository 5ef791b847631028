"""Images: type, size and pixel mode from their headers. Words in them need an OCR engine, which is another reader."""

from __future__ import annotations

import struct

#: Pixel modes by PNG colour type, and by number of JPEG components.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
#: JPEG markers without a body; those of frames, which hold the size.
JPEG_BARE = {0x01, *range(0xD0, 0xD9)}
JPEG_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: Tags of TIFF directories, and their value types.
TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_COLOURS, TIFF_SAMPLES = 256, 257, 258, 262, 277
TIFF_TYPES = {1: "B", 3: "H", 4: "I"}
NO_ENGINE = "no OCR engine is installed"


def png(data: bytes) -> tuple[int, int, str]:
    if data[12:16] != b"IHDR":
        raise ValueError("a PNG image without a header")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    mode = PNG_MODES[colour]
    return width, height, {1: "1", 16: "I;16"}.get(depth, mode) if mode == "L" else mode


def jpeg(data: bytes) -> tuple[int, int, str]:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG image with a broken segment")
        marker = data[at + 1]
        if marker == 0xFF or marker in JPEG_BARE:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in JPEG_FRAMES:
            height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
            return width, height, JPEG_MODES[parts]
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ValueError("a JPEG image without a frame")


def grey(palette: bytes, step: int) -> bool:
    """Whether entry i of a palette is the grey of value i."""
    return all(set(palette[i * step : i * step + 3]) == {i} for i in range(len(palette) // step))


def gif(data: bytes) -> tuple[int, int, str]:
    """Of the first frame: the mode is that of its own palette, or of the whole image's."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, palette = 13, b""
    if flags & 0x80:
        palette = data[at : (at := at + 3 * (2 << (flags & 7)))]
    while data[at : at + 1] == b"!":  # extensions: a label, then blocks up to an empty one
        at += 2
        while data[at : at + 1] not in (b"\0", b""):
            at += 1 + data[at]
        at += 1
    if data[at : at + 1] != b",":
        raise ValueError("a GIF image without a frame")
    if (own := data[at + 9]) & 0x80:
        palette = data[at + 10 : at + 10 + 3 * (2 << (own & 7))]
    return width, height, "L" if grey(palette, 3) else "P"


def bmp(data: bytes) -> tuple[int, int, str]:
    header = struct.unpack("<I", data[14:18])[0]
    if header == 12:
        width, height, _, bits = struct.unpack("<HHHH", data[18:26])
        colours, step = 1 << bits, 3
    else:
        width, height, _, bits = struct.unpack("<iiHH", data[18:30])
        colours, step = struct.unpack("<I", data[46:50])[0] or 1 << bits, 4
    if bits > 8:
        alpha = bits == 32 and header >= 56 and struct.unpack("<I", data[66:70])[0]
        return width, abs(height), "RGBA" if alpha else "RGB"
    palette = data[14 + header : 14 + header + colours * step]
    if colours == 2 and [palette[:3], palette[step : step + 3]] == [b"\0\0\0", b"\xff\xff\xff"]:
        return width, abs(height), "1"
    return width, abs(height), "L" if colours > 2 and grey(palette, step) else "P"


def webp(data: bytes) -> tuple[int, int, str]:
    kind = data[12:16]
    if kind == b"VP8X":
        size = [1 + int.from_bytes(data[i : i + 3], "little") for i in (24, 27)]
        return *size, "RGBA" if data[20] & 0x10 else "RGB"
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB"
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF, "RGB"
    raise ValueError("a WebP image without a frame")


def tiff(data: bytes) -> tuple[int, int, str]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    found = {TIFF_BITS: 1, TIFF_SAMPLES: 1, TIFF_COLOURS: 1}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count, value = struct.unpack(order + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
        if kind in TIFF_TYPES:
            size = struct.calcsize(TIFF_TYPES[kind])
            if size * count > 4:  # the values stand elsewhere
                start = struct.unpack(order + "I", value)[0]
                value = data[start : start + size]
            found[tag] = struct.unpack(order + TIFF_TYPES[kind], value[:size])[0]
    bits, samples, colours = found[TIFF_BITS], found[TIFF_SAMPLES], found[TIFF_COLOURS]
    one = "P" if colours == 3 else {1: "1", 16: "I;16"}.get(bits, "L")
    many = {2: "LA", 3: "RGB", 4: "CMYK" if colours == 5 else "RGBA"}
    return found[TIFF_WIDTH], found[TIFF_HEIGHT], one if samples == 1 else many.get(samples, "RGB")


#: What files of each format start with.
FORMATS = (("png", b"\x89PNG\r\n\x1a\n", png), ("jpeg", b"\xff\xd8\xff", jpeg), ("gif", b"GIF8", gif), ("bmp", b"BM", bmp), ("tiff", b"II*\0", tiff), ("tiff", b"MM\0*", tiff), ("webp", b"RIFF", webp))


def header(data: bytes) -> tuple[str, int, int, str]:
    """Format, width, height, mode."""
    for name, start, read in FORMATS:
        if data.startswith(start):
            try:
                return name, *read(data)
            except (struct.error, IndexError, KeyError) as e:
                raise ValueError(f"a broken {name} image") from e
    raise ValueError("not an image of a known format")


def read_image(data: bytes, name: str, options: dict) -> tuple[str, dict]:
    """A page of what the header tells; the warning says that no words were read."""
    kind, width, height, mode = header(data)
    lines = [f"# {name}", "", f"- **Type:** image ({kind})", f"- **Dimensions:** {width} x {height}", f"- **Mode:** {mode}", ""]
    note = f"> OCR was not run: no OCR backend is available ({NO_ENGINE})."
    return "\n".join([*lines, note]) + "\n", {"pages_total": 1, "warning": f"OCR unavailable: {NO_ENGINE}"}
