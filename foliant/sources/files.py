"""Files as rows: which ones, what they are, and their text."""

from __future__ import annotations

import io
import json
import re
import signal
import threading
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import kinds, names, text
from foliant.sources import biff, images, legacy, office, pdf, web
from foliant.sources.encoding import read_text

#: Suffixes that a folder's scan passes over, so results aren't read again.
RESULTS = (".md",)
RESULT = T.StructType([
    T.StructField("success", T.BooleanType()), T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType()), T.StructField("warning", T.StringType()),
    T.StructField("engine", T.StringType()), T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
])


@dataclass(frozen=True)
class Options:
    """How files are read. Presets and a configuration file fill the same fields."""

    max_rows: int = 10_000
    sample_rows: int = 25
    include_hidden_sheets: bool = False
    inline_styles: bool = True
    pdf_tables: bool = True
    ocr_lang: str = "tha+eng"
    ocr_dpi: int = 300

    def __post_init__(self):
        object.__setattr__(self, "max_rows", max(1, int(self.max_rows)))
        object.__setattr__(self, "ocr_dpi", min(600, max(72, int(self.ocr_dpi))))


#: Named sets of options.
PRESETS = {
    "Balanced AI": Options(),
    "High Fidelity": Options(ocr_dpi=400),
    "Fast Text": Options(ocr_lang="eng", ocr_dpi=150, pdf_tables=False),
    "Thai Scanned Document": Options(ocr_lang="tha"),
}


def preset_of(options: Options) -> str:
    return next((name for name, o in PRESETS.items() if o == options), "Custom")


def read_options(path: str) -> tuple[Options, str]:
    """Options of a TOML file and a message; unknown keys are passed over, a broken file gives the defaults."""
    import tomllib

    try:
        with open(path, "rb") as f:
            given = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        return Options(), f"{path}: {e}"
    known = asdict(Options())
    try:
        return Options(**{k: type(known[k])(v) for k, v in given.items() if k in known}), ""
    except (TypeError, ValueError) as e:
        return Options(), f"{path}: {e}"


def without_repeats(paths: DataFrame, order: str | None = None) -> DataFrame:
    """Paths (path) once each whatever their case; the first spelling stays."""
    first = F.min(F.struct(order, "path")).alias("f") if order else F.min(F.struct("path")).alias("f")
    return paths.groupBy(F.lower("path").alias("k")).agg(first).select("f.path")


def supported(path: Column) -> Column:
    suffix = names.suffix_of(path)
    every = [*kinds.DOCUMENTS, *kinds.IMAGES, *kinds.LANGUAGES]
    return suffix.isin(*every) & ~suffix.isin(*RESULTS)


def scan(spark: SparkSession, *paths: str, output: str | None = None, folder: bool = True) -> DataFrame:
    """Files of folders, patterns or single paths as (path, length, content). From folders only supported kinds come, no
    results, and nothing under ``output`` where that lies inside a folder that is scanned. Files of no bytes are no rows."""
    if not paths or any(not str(p).strip() for p in paths):
        raise ValueError("a path is empty")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "content")
    if not folder:
        return files
    files = files.filter(supported(F.col("path")))
    inside = output and any(output.rstrip("/").startswith(str(p).rstrip("/") + "/") for p in paths)
    return files.filter(~F.contains("path", F.lit(output.rstrip("/") + "/"))) if inside else files


def intake(paths: DataFrame) -> DataFrame:
    """path and why it isn't taken (null where it is)."""
    suffix = names.suffix_of(F.col("path"))
    reason = F.when(suffix.isin(*kinds.MEDIA), F.lit("audio and video are not read")).when(suffix.isin(*RESULTS), F.lit("a result")).when(~supported(F.col("path")), F.lit("unsupported kind"))
    return paths.select("path", reason.alias("reject_reason"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def zip_entries(contents: pa.Array) -> pa.Array:
    """Names in zip archives; null for anything else."""

    def listed(data: bytes | None) -> list[str] | None:
        if not data or data[:4] != b"PK\x03\x04":
            return None
        try:
            return zipfile.ZipFile(io.BytesIO(data)).namelist()
        except (zipfile.BadZipFile, ValueError, OSError):
            return None

    return pa.array([listed(x.as_py()) for x in contents], pa.list_(pa.string()))


def detections(files: DataFrame) -> DataFrame:
    """files with kind, mime and confidence."""
    return files.withColumn("d", kinds.detected(F.col("path"), F.col("content"), zip_entries("content"))).select(*files.columns, "d.kind", "d.mime", "d.confidence")


def read_json(data: bytes, name: str, options: dict) -> tuple[str, dict]:
    source = read_text(data)
    try:
        body, note = json.dumps(json.loads(source), indent=2, ensure_ascii=False), ""
    except (ValueError, RecursionError):
        body, note = source.strip(), "> Warning: invalid JSON returned verbatim.\n\n"
    return f"# {name}\n\n{note}```json\n" + "\n".join(x[:10_000] for x in body.splitlines()) + "\n```\n", {}


def read_code(data: bytes, name: str, options: dict) -> tuple[str, dict]:
    source = read_text(data)
    suffix = re.search(r"\.[^.]*\Z", name)
    suffix = suffix[0].lower() if suffix else ""
    if suffix == ".md":
        return source if source.endswith("\n") else source + "\n", {}
    if suffix == "" and source.lstrip()[:1] in ("{", "["):
        return read_json(data, name, options)
    fence = "`" * max(3, max(map(len, re.findall("`+", source)), default=0) + 1)
    body = "\n".join(x[:10_000] for x in source.rstrip().splitlines())
    return f"# {name}\n\n{fence}{kinds.LANGUAGES.get(suffix, 'text')}\n{body}\n{fence}\n", {}


Reader = Callable[[bytes, str, dict], tuple[str, dict]]
#: Readers by kind. Another kind, or a better reader of one, is an entry more. A figure named warning is the result's.
READERS: dict[str, tuple[str, Reader]] = {
    "html": ("web", lambda d, n, o: (web.read_html(d, n), {})), "eml": ("mail", lambda d, n, o: (web.read_mail(d, n), {})), "docx": ("word", office.read_docx), "pptx": ("slides", office.read_pptx),
    "xlsx": ("sheets", lambda d, n, o: (biff.read_xls if d.startswith(legacy.SIGNATURE) else office.read_xlsx)(d, n, o)), "csv": ("sheets", office.read_csv), "json": ("text", read_json), "code": ("text", read_code), "text": ("text", read_code),
    "doc": ("word binary", legacy.read_doc), "ppt": ("slides binary", legacy.read_ppt), "image": ("image", images.read_image), "pdf": ("pdf", pdf.read_pdf),
}
MISSING = {"media": "audio and video are not read", "unknown": "the kind of file is not known"}


class limit:
    """Ends what runs inside after so many seconds, by a timer of the main thread; 0 is no limit, and so are other threads."""

    def __init__(self, seconds: float):
        self.on, self.seconds = seconds > 0 and threading.current_thread() is threading.main_thread(), seconds

    def __enter__(self) -> None:
        if self.on:
            self.before = signal.signal(signal.SIGALRM, self.ended)
            signal.setitimer(signal.ITIMER_REAL, self.seconds)

    def ended(self, *_) -> None:
        raise TimeoutError(f"not converted within {self.seconds:g} s")

    def __exit__(self, *_) -> None:
        if self.on:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.before)


def convert_one(path: str, kind: str, content: bytes | None, options: dict, readers: dict | None = None, timeout: float = 0) -> dict:
    """A file's result; whatever is wrong with one file is its own error, one that takes longer than timeout seconds, too."""
    readers = READERS if readers is None else readers
    name = path.rsplit("/", 1)[-1]
    out = {"success": False, "markdown": None, "error": None, "warning": None, "engine": None, "metrics": {}}
    if kind not in readers:
        return {**out, "error": MISSING.get(kind, f"no reader for {kind}")}
    engine, reader = readers[kind]
    try:
        if not content:
            raise ValueError("the file is empty")
        with limit(timeout):
            markdown, metrics = reader(content, name, options)
        warning = metrics.pop("warning", None)
        return {**out, "success": True, "markdown": markdown, "warning": warning, "engine": engine, "metrics": {k: str(v).lower() for k, v in metrics.items()}}
    except Exception as e:  # noqa: BLE001  one bad file never fails the others
        return {**out, "engine": engine, "error": f"{type(e).__name__}: {e}"}


def converted(files: DataFrame, options: Options = Options(), readers: dict | None = None, sanitize: bool = True, timeout: float = 0) -> DataFrame:
    """files (path, kind, content ...) as results: source, kind and the other columns, success, markdown, error, warning,
    engine, metrics, review_lines. Parsing runs by Arrow batches, cleaning in the JVM."""
    given = asdict(options)

    @F.arrow_udf(RESULT)
    def run(paths: pa.Array, whats: pa.Array, contents: pa.Array) -> pa.Array:
        rows = [convert_one(p.as_py(), k.as_py(), c.as_py(), given, readers, timeout) for p, k, c in zip(paths, whats, contents, strict=True)]
        struct = pa.struct([("success", pa.bool_()), ("markdown", pa.string()), ("error", pa.string()), ("warning", pa.string()), ("engine", pa.string()), ("metrics", pa.map_(pa.string(), pa.string()))])
        return pa.array([{**r, "metrics": list(r["metrics"].items())} for r in rows], struct)

    others = [c for c in files.columns if c not in ("path", "content")]
    made = files.select(F.col("path").alias("source"), *others, run("path", "kind", "content").alias("r")).select("source", *others, "r.*")
    marked = made.withColumn("review_lines", F.when(F.col("success"), text.review_lines(F.col("markdown"))))
    clean = text.optimized(text.without_review(F.col("markdown"))) if sanitize else text.without_review(F.col("markdown"))
    # a file of Markdown, and code, stay as they are
    return marked.withColumn("markdown", F.when(F.col("engine") == "text", F.col("markdown")).otherwise(clean))


def error_class(error: Column) -> Column:
    """Why a file has no text: timeout, unavailable (nothing reads its kind), protected or failed; null without an error."""
    kinds_of = {"timeout": r"\ATimeoutError:", "unavailable": r"\A(?:no reader for |the kind of file is not known|audio and video )", "protected": r"(?i)password|encrypted"}
    out = F.when(error.isNotNull(), F.lit("failed"))
    for name, pattern in reversed(kinds_of.items()):
        out = F.when(error.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def strictly(results: DataFrame) -> DataFrame:
    """results, which end the query with the first error of a file."""
    said = F.concat_ws(": ", "source", "error")
    return results.withColumn("success", F.when(F.col("success"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def redone(results: DataFrame, found: DataFrame, **how) -> DataFrame:
    """results, with those that failed converted once more from found (path, kind, content ...)."""
    failed = results.filter("NOT success").select(F.col("source").alias("path"))
    again = converted(found.join(failed, "path", "left_semi").select(*found.columns), **how)
    return results.filter("success").unionByName(again, allowMissingColumns=True)


def registered(spark: SparkSession) -> None:
    """html_to_markdown(html, name) for SQL."""

    @F.pandas_udf(T.StringType())
    def html_to_markdown(pages, stems):
        return pages.combine(stems, lambda p, s: None if p is None else web.html_to_markdown(p, s or ""))

    spark.udf.register("html_to_markdown", html_to_markdown)


