"""What a file is, from its first bytes, its text and its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.names import suffix_of

HEAD = 8192

#: Kinds by suffix.
DOCUMENTS = {
    ".pdf": "pdf", ".doc": "doc", ".dot": "doc", ".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".xls": "xlsx", ".csv": "csv", ".ppt": "ppt", ".pps": "ppt",
    ".pptx": "pptx", ".html": "html", ".htm": "html", ".xhtml": "html", ".eml": "eml", ".json": "json", ".txt": "text", ".md": "text", ".log": "text",
}
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp"}
MEDIA = {
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".m4a": "audio/mp4", ".aac": "audio/aac", ".flac": "audio/flac", ".ogg": "audio/ogg", ".wma": "audio/x-ms-wma", ".aiff": "audio/aiff",
    ".mp4": "video/mp4", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo", ".mov": "video/quicktime", ".flv": "video/x-flv", ".wmv": "video/x-ms-wmv", ".webm": "video/webm", ".m4v": "video/mp4",
}
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".sh": "bash", ".bat": "batch", ".ps1": "powershell", ".sql": "sql",
    ".r": "r", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".xml": "xml", ".css": "css",
}
#: Media types by kind.
MIME = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "csv": "text/csv", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "html": "text/html", "eml": "message/rfc822", "image": "application/octet-stream",
    "media": "application/octet-stream", "json": "application/json", "code": "text/x-code", "text": "text/plain", "unknown": "application/octet-stream",
}
#: First bytes, in hexadecimal, of kinds and media types.
MAGIC = (("255044462D", "pdf", "application/pdf"), ("89504E470D0A1A0A", "image", "image/png"), ("FFD8FF", "image", "image/jpeg"), ("474946383761", "image", "image/gif"), ("474946383961", "image", "image/gif"), ("424D", "image", "image/bmp"), ("49492A00", "image", "image/tiff"), ("4D4D002A", "image", "image/tiff"))
ZIP, OLE = "504B0304", "D0CF11E0A1B11AE1"
OLE_KINDS = {".doc": "doc", ".dot": "doc", ".xls": "xlsx", ".ppt": "ppt", ".pps": "ppt"}
#: Header names that mail starts with.
MAIL = r"(?i)\A(?:from|to|subject|date|message-id|mime-version):"


def lookup(keys: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[keys]


def found(kind: Column | str, mime: Column | str, confidence: str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(kind).alias("kind"), as_column(mime).alias("mime"), F.lit(confidence).alias("confidence"))


def by_magic(content: Column, suffix: Column, entries: Column | None = None) -> Column:
    """From the first bytes; entries: names in a zip archive, if it is one."""
    starts = lambda h: F.startswith(F.substring(content, 1, 32), F.unhex(F.lit(h)))
    out = F.lit(None).cast("struct<kind:string,mime:string,confidence:string>")
    riff = starts("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    out = F.when(riff, found("image", "image/webp", "magic")).otherwise(out)
    for head, kind, mime in reversed(MAGIC):
        out = F.when(starts(head), found(kind, mime, "magic")).otherwise(out)
    ole = lookup(suffix, OLE_KINDS)
    out = F.when(starts(OLE), F.when(ole.isNotNull(), found(ole, lookup(ole, MIME), "magic-ole"))).otherwise(out)
    if entries is not None:
        inside = lambda prefix: F.exists(entries, lambda e: F.startswith(e, F.lit(prefix)))
        office = F.when(inside("word/"), F.lit("docx")).when(inside("xl/"), F.lit("xlsx")).when(inside("ppt/"), F.lit("pptx"))
        out = F.when(starts(ZIP), F.when(office.isNotNull(), found(office, lookup(office, MIME), "magic-zip"))).otherwise(out)
    else:
        out = F.when(starts(ZIP), F.lit(None)).otherwise(out)
    return out


def mail_headers(text: Column, lines: int = 40) -> Column:
    """How many of the first lines start with a mail header."""
    return F.size(F.filter(F.slice(F.split(text, "\r\n|\r|\n"), 1, lines), lambda x: F.trim(x).rlike(MAIL)))


def by_text(head: Column) -> Column:
    """From the head's text: web page, mail, JSON, script."""
    lowered = F.lower(head)
    bare = F.regexp_replace(head, r"\A[\ufeff \t\r\n]+", "")
    parsed = F.substring(bare, 1, 1).isin("{", "[") & F.try_parse_json(bare).isNotNull()
    page = F.contains(lowered, F.lit("<!doctype html")) | F.contains(lowered, F.lit("<html"))
    return (
        F.when(page, found("html", MIME["html"], "heuristic")).when(mail_headers(head) >= 2, found("eml", MIME["eml"], "heuristic"))
        .when(parsed, found("json", MIME["json"], "heuristic")).when(F.startswith(head, F.lit("#!")), found("code", MIME["code"], "heuristic"))
    )


def by_suffix(suffix: Column) -> Column:
    document, image, media = lookup(suffix, DOCUMENTS), lookup(suffix, IMAGES), lookup(suffix, MEDIA)
    return (
        F.when(document.isNotNull(), found(document, lookup(document, MIME), "extension")).when(image.isNotNull(), found("image", image, "extension"))
        .when(media.isNotNull(), found("media", media, "extension")).when(lookup(suffix, LANGUAGES).isNotNull(), found("code", MIME["code"], "extension"))
    )


def head_text(head: Column) -> Column:
    """A file's first bytes as text: UTF-8, of whose last character the cut may have left a part, else one byte a character."""
    whole = [F.substring(head, F.lit(1), F.length(head) - k) for k in range(4)]
    cut = [F.when(F.is_valid_utf8(x) & ((F.length(head) == HEAD) | F.lit(k == 0)), x.cast("string")) for k, x in enumerate(whole)]
    return F.coalesce(*cut, F.decode(head, "ISO-8859-1"))


def detected(path: Column, content: Column, entries: Column | None = None) -> Column:
    """(kind, mime, confidence): from magic bytes, else the text, else the suffix, else unknown."""
    suffix = suffix_of(path)
    text = head_text(F.substring(content, 1, HEAD))
    return F.coalesce(by_magic(content, suffix, entries), by_text(text), by_suffix(suffix), found("unknown", MIME["unknown"], "fallback"))


def language(path: Column) -> Column:
    return F.coalesce(lookup(suffix_of(path), LANGUAGES), F.lit(""))
